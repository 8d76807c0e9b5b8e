"""Packing by concatenating and cutting: two-pass prefix sums give every document a global token offset.

Pass 1 tokenizes each partition and writes, per document, its ids and its start within the partition. The partition
totals (one row per partition, whatever the documents) are summed to offsets of partitions. Pass 2 cuts the stream of all
tokens at every seq_len tokens; a document that crosses a boundary gives one piece per sequence. Nothing is sorted and no
text is shuffled; only the last sequence is short.

Null texts count as empty: they are the end id alone, or no piece where there is no end id. Texts longer than a sequence
give a piece for each that they reach into, whatever their number. Rows that repeat an id, null ids too, are packed each.
Other columns are ignored, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import materialize, worker_state
from lorewright.llm.wordlists import Memo, Words, joined, slices

#: Bytes of words and their ids that a worker keeps; an entry only saves work.
MEMO_BYTES = 80 << 20
#: ASCII characters that are neither letters, digits nor spaces; and a text that ends in a letter of Latin-1.
SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile(rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]$")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit bytes.

    The file's rules lower-case text, drop white space and never look across it, so a text's ids are those of its words one
    after the other, and each distinct word goes to the library once. Texts that might hold a special token go to it whole,
    and words with combining marks, which lower-casing can join, keep their case.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.mark = self.library.encode("0", add_special_tokens=False).ids[0]
        self.memo = Memo(MEMO_BYTES, 5)

    def lookup(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. A word that ends in symbols after a letter is its stem and these symbols, which are never joined."""
        found = list(map(self.memo.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        stems, tails = [], []
        for k in new:
            word = words[k]
            stem = word.rstrip(SYMBOLS)
            if len(stem) == len(word) or b"<|" in word or not (stem[-1:].isalpha() or LATIN.search(stem)):
                stem = word
            stems.append(stem)
            tails.append(word[len(stem) :])
        known = {b"": b""}
        wanted = list({*stems, *tails} - {b""})
        known.update((w, ids) for w, ids in zip(wanted, map(self.memo.get, wanted), strict=True) if ids is not None)
        asked = [w for w in wanted if w not in known]
        answers = self.ask(asked)
        known.update(zip(asked, answers, strict=True))
        for k, stem, tail in zip(new, stems, tails, strict=True):
            found[k] = known[stem] + known[tail]
        self.memo.add(asked, answers)
        return found

    def ask(self, words: list[bytes]) -> list[bytes]:
        """One call for many words, set apart by a digit, which is always one id; those that hold that digit go by themselves."""
        plain = [w for w in words if b"0" not in w and b"<|" not in w]
        answers = {}
        for lo in range(0, len(plain), 20_000):
            block = plain[lo : lo + 20_000]
            ids = np.array(self.library.encode_batch_fast([b" 0 ".join(block).decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == self.mark)).tolist()
            raw = ids.tobytes()
            answers.update(zip(block, [raw[a + 4 : b] for a, b in zip([-4, *cuts], [*cuts, len(raw)], strict=True)], strict=True))
        return [answers[w] if w in answers else self.whole(w.decode("utf-8", "surrogatepass")) for w in words]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """Ids of each text and tail, as an array of binary. Texts of a slice; each distinct word is looked up once."""
        cased = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\u0300-\u036f]"))
        cased = pc.fill_null(cased, False)
        odd = np.flatnonzero(cased.to_numpy(zero_copy_only=False))
        words = Words(pc.if_else(cased, pa.scalar("", texts.type), texts) if len(odd) else texts, lower=True)
        codes = np.insert(words.codes, words.first[1:], len(words.distinct))
        ids, begin = joined([*self.lookup(words.distinct), tail], codes)
        ends = begin[np.append(0, words.first[1:] + np.arange(1, len(words.first)))]
        found = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends)), ids.buffers()[2]])
        if len(odd):
            out = found.to_pylist()
            for k in odd.tolist():
                text = texts[k].as_py()
                out[k] = (self.whole(text) if "<|" in text else b"".join(self.lookup(text.encode("utf-8", "surrogatepass").split()))) + tail
            found = pa.array(out, pa.large_binary())
        return found.cast(pa.binary())


def word_encoder(path: str) -> WordEncoder:
    return worker_state(("packing", path), lambda: WordEncoder(path))


def tokenize(documents: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ids (binary), n_tokens, part and start (tokens before it in its partition). One pass, no shuffle."""
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole):
                ids = encoder.encode(batch.column(1), tail)
                n = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.record_batch([batch.column(0), ids, pa.array(n), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts)], ["id", "ids", "n_tokens", "part", "start"])

    rows = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, part bigint, start bigint")


def pack(documents: DataFrame, tokenizer_path: str, seq_len: int = 4096, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of seq_len tokens.

    Per piece: id, start (tokens of its document before it), length, doc_tokens, sequence_id, offset (in the sequence) and
    ids (binary, little-endian unsigned 32-bit).
    """
    written = materialize(tokenize(documents, tokenizer_path, end_id, id_col, text_col), "tokens")
    spark = documents.sparkSession
    # One row per partition of the scan: thousands where the rows are billions.
    totals = {r["part"]: r["n"] for r in written.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = [], 0
    for part in sorted(totals):
        before.append((part, at))
        at += totals[part]
    offsets = spark.createDataFrame(before, "part bigint, before bigint")
    placed = written.join(F.broadcast(offsets), "part").select("id", "ids", "n_tokens", (F.col("before") + F.col("start")).alias("first")).where("n_tokens > 0")
    length = F.lit(seq_len).cast("long")
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("n_tokens") - 1) / length))))
    begin = F.greatest(F.col("first"), F.col("sequence_id") * length)
    end = F.least(F.col("first") + F.col("n_tokens"), (F.col("sequence_id") + 1) * length)
    pieces = pieces.withColumns({"begin": begin, "length": end - begin}).withColumns({"start": F.col("begin") - F.col("first"), "offset": F.col("begin") - F.col("sequence_id") * length})
    cut = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    return pieces.select("id", "start", "length", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset", cut.alias("ids"))
