"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A word's symbols are its bytes, the last one marked as the word's end. An automaton of all tokens lists the tokens that
match at each position. The encoder takes the longest one that is compatible with the token before it, and steps back
where none is. Two tokens are compatible if merging their joined symbols gives just these two; a sequence whose
neighbours are all compatible is the one that the merges give, so the result is exact. Each position is ruled out once at
most, so the work is linear in the word for a vocabulary of bounded token length. Words are memoised (bounded; an entry
only saves work).

Null texts count as empty: no ids, and an empty decoded text. Whole texts of any length are encoded, a few megabytes at a
time. Case, normal form and classes of characters are those of the file's normalizer and pattern in the tokenizers library,
whatever Unicode version Python has. Other columns are ignored, whatever their names; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorewright.llm.common import bound_batches, worker_state
from lorewright.llm.wordlists import Memo, Words, joined, slices

SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Control characters that str.split() takes for spaces and the tokenizer doesn't.
NO_SPACES = "\x1c\x1d\x1e\x1f"
#: Bytes of pieces and their ids, and of words with ids and decoded text, that a worker keeps; pairs whose verdict it keeps.
PIECE_BYTES, WORD_BYTES = 192 << 20, 64 << 20
PAIRS = 400_000
#: ASCII characters that are neither letters, digits nor spaces.
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Characters before this one (Latin letters) have had one class, case and normal form in all versions of Unicode in use.
OLDEST = "\u0250"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class BacktrackingBpe:
    """Encoder and decoder for a word-level BPE file whose last symbol of each word carries a suffix."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # The offset table: all tokens' text in one string, and where each id's text begins and ends.
        by_id = sorted([(i, t) for t, i in vocab.items()] + [(i, t) for t, i in self.special.items()])
        self.spelling, self.begin, self.end = "".join(t for _, t in by_id), {}, {}
        at = 0
        for i, t in by_id:
            self.begin[i], self.end[i] = at, at + len(t)
            at += len(t)
        # Each symbol is one character here: a byte's letter, or for a word's last byte the letter in another plane.
        self.letters = byte_letters()
        self.symbol = {}
        for c in self.letters:
            self.symbol[c] = c
            self.symbol[c + self.suffix] = chr(ord(c) + 0x10000)
        self.ids, self.rank = {}, {}
        for t, s in self.symbol.items():
            if t in vocab:
                self.ids[s] = vocab[t]
        spelled = dict(self.symbol)
        for order, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            joined = spelled[a] + spelled[b]
            spelled.setdefault(a + b, joined)
            self.ids.setdefault(joined, vocab[a + b])
            self.rank.setdefault((spelled[a], spelled[b]), order)
        self.automaton = ahocorasick.Automaton()
        for s in self.ids:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        # The file's own rules for characters, for words with any that Unicode versions treat differently.
        self.normalizer, self.cutter = Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split_space = regex.compile(f"[{SPACES}]+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.pieces, self.words = Memo(PIECE_BYTES, 14, 250), Memo(WORD_BYTES, 14, 300)

    def merged(self, symbols: str) -> list[str]:
        """The merges applied one by one, lowest rank first: the definition, used for short strings only."""
        parts, rank = list(symbols), self.rank
        while len(parts) > 1:
            best = min((rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether left and right may stand side by side; an empty left asks whether right is a token by itself."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def encode_symbols(self, symbols: str) -> tuple[int, ...]:
        n = len(symbols)
        starting: list[list[str]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(symbols):
            starting[end + 1 - len(token)].append(token)  # ends ascend, so do the lengths
        reachable, tried = [True] * (n + 1), [len(x) for x in starting]
        out: list[str] = []
        at = 0
        compatible = self.compatible
        while at < n:
            before, options = out[-1] if out else "", starting[at]
            while tried[at]:
                tried[at] -= 1
                token = options[tried[at]]
                if reachable[at + len(token)] and compatible("", token) and (not before or compatible(before, token)):
                    out.append(token)
                    at += len(token)
                    break
            else:
                if not out:
                    raise ValueError(f"no token sequence for {symbols!r}")
                reachable[at], tried[at] = False, len(options)
                at -= len(out.pop())
        return tuple(self.ids[t] for t in out)

    def rendered(self, piece: str) -> tuple[tuple[int, ...], bytes, bytes]:
        """A piece's ids, these in decimal, and the text decoded from them, with a space before each id."""
        found = self.pieces.get(piece)
        if found is None:
            letters = "".join(map(self.letters.__getitem__, piece.encode("utf-8", "surrogatepass")))
            ids = self.encode_symbols(letters[:-1] + self.symbol[letters[-1] + self.suffix])
            found = (ids, "".join([f" {i}" for i in ids]).encode(), b" " + self.decode(ids).encode("utf-8", "surrogatepass"))
            self.pieces.add([piece], [found])
        return found

    def encode_word(self, word: str) -> list[tuple[tuple[int, ...], bytes, bytes]]:
        """The rendered pieces of a text without spaces."""
        out = []
        for part in self.split_special.split(word) if self.split_special and "<|" in word else (word,):
            if part in self.special:
                i = self.special[part]
                out.append(((i,), b" %d" % i, b" " + self.decode([i]).encode()))
            elif part:
                out.extend(map(self.rendered, self.cut(part)))
        return out

    def cut(self, part: str) -> list[str]:
        """The normal form's pieces. Below OLDEST all Unicode versions agree; beyond it the file's normalizer and pattern are asked, not Python's tables."""
        if part.isascii():
            return self.pattern.findall(part.lower())
        if max(part) < OLDEST:
            return self.pattern.findall(unicodedata.normalize("NFC", part).lower())
        return [piece for piece, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part))]

    def split(self, text: str) -> list[str]:
        if any(c in text for c in NO_SPACES):
            return [w for w in self.split_space.split(text) if w]
        return text.split()

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split(text) for x in self.encode_word(w) for i in x[0]]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included, joined by a space as where the file names no decoder."""
        return " ".join(self.spelling[self.begin[i] : self.end[i]] for i in ids)

    def known(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Each word's number of ids, its ids in decimal and its decoded text, the latter two with a space before each id."""
        memo, pieces, rendered = self.words, self.pieces, self.rendered
        found = list(map(memo.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        for k in new:
            word = words[k].decode("utf-8", "surrogatepass")
            stem = word.rstrip(SYMBOLS)
            if stem.isalpha() and word.isascii():  # letters, then symbols: a piece each
                stem, tail = stem.lower(), word[len(stem) :]
                a = pieces.get(stem) or rendered(stem)
                if tail:
                    b = pieces.get(tail) or rendered(tail)
                    found[k] = (len(a[0]) + len(b[0]), a[1] + b[1], a[2] + b[2])
                else:
                    found[k] = (len(a[0]), a[1], a[2])
            else:
                parts = [x for w in self.split(word) for x in self.encode_word(w)]
                found[k] = (sum([len(x[0]) for x in parts]), b"".join([x[1] for x in parts]), b"".join([x[2] for x in parts]))
        if memo.size < memo.bound:  # the words met first are the frequent ones; the rest are made of their pieces
            memo.add([words[k] for k in new], [found[k] for k in new])
        return found

    def round_trips(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Of each text the number of ids, the ids in decimal joined by one space, and the text decoded from them.

        Words are cut at ASCII white space, which no token holds, and each distinct one is encoded once.
        """
        words = Words(texts, lower=False)
        found = self.known(words.distinct)
        numbers = np.append(0, np.cumsum(np.array([x[0] for x in found], np.int64)[words.codes]))
        out = []
        for part in (1, 2):
            pieces, begin = joined([x[part] for x in found], words.codes)
            raw, at = pieces.buffers()[2], begin[words.first].tolist()
            raw = memoryview(raw) if raw is not None else memoryview(b"")
            out.append([bytes(raw[a + 1 : b]) for a, b in zip(at[:-1], at[1:], strict=True)])
        return np.diff(numbers[words.first]), *out


def encoder(path: str) -> BacktrackingBpe:
    return worker_state(("bpe", path), lambda: BacktrackingBpe(path))


def bpe_round_trip(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, token_ids (list of int), decoded (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole):
                ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
                yield pa.record_batch(
                    [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    ["id", "n_tokens", "token_ids", "decoded"],
                )

    rows = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    bound_batches(documents.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, token_ids array<int>, decoded string")


def bpe_digests(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, SHA-256 of the decimal ids and of the decoded text; digests leave no long rows behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole):
                counts, *parts = bpe.round_trips(batch.column(1))
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in part], pa.string()) for part in parts]
                yield pa.record_batch([batch.column(0), pa.array(counts), *digests], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    bound_batches(documents.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
