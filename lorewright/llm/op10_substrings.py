"""Substring dedup by recompression: rounds give names to runs and pairs of words, alike wherever the words are alike.

Round 0 names words and marks those that repeat their left neighbour (runs); in each later round every symbol falls on one
of two sides by its name, and a left one followed by a right one becomes one symbol, named by the two. A name is the 64-bit
hash of what it stands for, so equal runs and pairs get equal names in all tasks. Whether symbols join depends on the two
alone, so in two equal passages all symbols but the outermost begin and end at the same words. After two rounds of pairs a
symbol has 1 to 4 words; in a window of 20 words the boundaries from 3 to 17 words in are the same in each copy of it. A
further round names the shortest row of symbols from each boundary that has at least SPAN words (a high-level symbol, 6 to 9
words), and one of those that lie within the same boundaries, that with the least name, stands for the window.

A run isn't named by its length: a window that cuts a run sees another length of it.

Spark counts the high-level symbols over all documents; a window that occurs twice has one that occurs twice. Only windows
whose symbol is shared go on to the last round, which names whole windows by two independent 64-bit names, four symbols of
five words each; the earliest place of each name is found, and words under the others are removed. A bitmap of bounded size
(see BITMAP_KEYS) tells shared symbols, or a join where there are more of them; it may take in too many, which costs time
and changes nothing. Two different windows get one pair of names with a chance of 2**-128 for each pair of windows.

Exact copies of a text (by two 64-bit hashes) skip all this: every window of theirs starts earlier in the first copy.

Null texts count as empty. Rows that repeat an id and its text get the same result; where texts of one id differ, each is a
document of its own, in the order of its hashes. Rows with a null id are left as they are. Texts shorter than a window lose
nothing; very long ones are handled whole. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import anti_join, discard, materialize, semi_join
from lorewright.llm.wordlists import Words, slices

WINDOW = 20
#: Boundaries of symbols that are alike in all copies of a window: from FIRST to LAST words in. Words of a high-level symbol.
FIRST, LAST, SPAN = 3, 17, 6
#: Repeated names up to this number are told by a bitmap of 16 to 32 bits for each (16 MB at most); beyond it by a join.
BITMAP_KEYS, BITMAP_BITS = 4_000_000, 27
#: A document: its id, and two hashes of its text.
KEY = "struct<id:bigint,d1:bigint,d2:bigint>"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


FACTORS = mix(np.arange(100, 164, dtype=np.uint64)) | np.uint64(1)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def gram(w: np.ndarray, n: int, at: int) -> np.ndarray:
    """Hash of the n words from each position."""
    h = w[: len(w) - n + 1] * FACTORS[at]
    for k in range(1, n):
        h = h + w[k : len(w) - n + 1 + k] * FACTORS[at + k]
    return mix(h)


def symbols(w: np.ndarray, doc: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols after the rounds, and the word at which each begins; doc tells which document a word is of."""
    again = np.zeros(len(w), np.uint64)
    again[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
    name, first = mix(w + again * FACTORS[60]), np.arange(len(w))
    for k in range(rounds):
        right = (mix(name + FACTORS[61 + k]) >> np.uint64(63)).astype(bool)
        joined = np.zeros(len(name), bool)
        joined[:-1] = ~right[:-1] & right[1:] & (doc[first[1:]] == doc[first[:-1]])
        follows = np.zeros(len(name), bool)
        follows[1:] = joined[:-1]
        pair = np.where(joined, mix(name * FACTORS[62] + np.append(name[1:], name[:1]) * FACTORS[63]), name)
        name, first = pair[~follows], first[~follows]
    return name, first


def high_symbols(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest rows of symbols with at least SPAN words: names, first words, and the words after their last ones."""
    name, first = symbols(w, doc)
    bounds = np.append(first, len(w))
    end = np.minimum(np.searchsorted(bounds, first + SPAN), len(first))  # the symbol after the row
    number = end - np.arange(len(first))
    high = mix(number.astype(np.uint64))
    for k in range(SPAN):
        take = np.minimum(np.arange(len(first)) + k, len(first) - 1)
        high = np.where(k < number, high + name[take] * FACTORS[40 + k], high)
    return mix(high), first, bounds[end]


def windows_and_names(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the high-level symbol that stands for each, and all such symbols' names and first words."""
    if len(w) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    names, first, after = high_symbols(w, doc)
    starts = np.flatnonzero(doc[: len(w) - WINDOW + 1] == doc[WINDOW - 1 :])
    # Of the symbols lo to hi - 1, at most LAST - FIRST - SPAN + 1, that with the least name; ties are equal names.
    lo, hi = np.searchsorted(first, starts + FIRST), np.searchsorted(after, starts + LAST, "right")
    level, best = np.frexp(hi - lo)[1] - 1, np.zeros(len(starts), np.int64)
    least = np.arange(len(names))
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        a, b = least[lo[at]], least[hi[at] - (1 << k)]
        best[at] = np.where(names[b] < names[a], b, a)
        a, b = least[: max(len(least) - (1 << k), 0)], least[1 << k :]
        least = np.where(names[b] < names[a], b, a)
    return starts, best, names, first


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches, word hashes of their texts (column 1), row of each word, first word of each row."""
    for whole in batches:
        for batch in slices(whole, size=2 << 20):
            words = Words(batch.column(1), lower=False)
            yield batch, words.hashes(), words.rows(), words.first[:-1]


def lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """One list per row; rows is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values))


def names(texts: DataFrame) -> DataFrame:
    """The names that represent each row's windows: id, names (array of long), places (array of int, words in the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w, doc, first in parsed(batches):
            _, chosen, all_names, begin = windows_and_names(w, doc)
            at = np.flatnonzero(np.bincount(chosen, minlength=len(all_names)))
            rows, n = doc[begin[at]], batch.num_rows
            yield pa.record_batch([batch.column(0), lists(all_names[at].view(np.int64), rows, n), lists((begin[at] - first[rows]).astype(np.int32), rows, n)], ["id", "names", "places"])

    return texts.mapInArrow(run, f"id {KEY}, names array<bigint>, places array<int>")


def candidates(texts: DataFrame, bitmap: np.ndarray | None) -> DataFrame:
    """Windows whose name is repeated: id, starts, h1, h2 (arrays). texts: id, text, and places (repeated names) if bitmap is None."""
    shared = None if bitmap is None else texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w, doc, first in parsed(batches):
            starts, chosen, all_names, begin = windows_and_names(w, doc)
            if shared is None:
                hot = np.zeros(len(w), bool)
                for k, places in enumerate(batch.column(2)):
                    if places.is_valid:
                        hot[first[k] + np.array(places.as_py(), np.int64)] = True
                hit = hot[begin[chosen]]
            else:
                bit = (all_names & np.uint64(8 * len(shared.value) - 1)).astype(np.int64)
                hit = ((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0)[chosen]
            s = starts[hit]
            rows, found = doc[s], []
            for at in (0, 30):
                five = gram(w, 5, at) if len(s) else np.zeros(0, np.uint64)
                found.append(mix(sum(five[s + 5 * k] * FACTORS[at + 10 + k] for k in range(4))) if len(s) else five)
            some = np.unique(rows)
            back = np.searchsorted(some, rows)
            ids = batch.column(0).take(pa.array(some))
            yield pa.record_batch([ids, lists((s - first[rows]).astype(np.int32), back, len(some)), *(lists(h.view(np.int64), back, len(some)) for h in found)], ["id", "starts", "h1", "h2"])

    return texts.mapInArrow(run, f"id {KEY}, starts array<int>, h1 array<bigint>, h2 array<bigint>")


def key(document_id, text):
    return F.struct(document_id.cast("long").alias("id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))


def repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses words: id (its key), whole (an exact copy of an earlier one), starts (windows that start earlier elsewhere)."""
    texts = documents.select(key(documents[id_col], documents[text_col]).alias("id"), documents[text_col].alias("text")).where("id.id is not null")
    digests = materialize(texts.where(F.length("text") >= 2 * WINDOW - 1).select("id.*"), "digests")
    earliest = materialize(digests.groupBy("d1", "d2").agg(F.min("id").alias("least")), "earliest")
    copies = digests.join(earliest, ["d1", "d2"]).where("id <> least").select(F.struct("id", "d1", "d2").alias("id"))
    copies = materialize(copies.distinct(), "copies")
    rest = anti_join(texts, copies, "id").select("id", "text")

    named = names(rest)
    counted = named.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    repeated = materialize(counted, "names")
    number = repeated.limit(BITMAP_KEYS + 1).count()
    if number <= BITMAP_KEYS:
        bits = min(BITMAP_BITS, max(20, (16 * number).bit_length()))
        bit = F.col("name").bitwiseAND(F.lit((1 << bits) - 1)) + 1
        pages = repeated.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for r in pages.toLocalIterator():
            page = np.frombuffer(r["bits"], np.uint8)
            bitmap[(r["page"] - 1) * len(page) :][: len(page)] = page
        found = candidates(rest, bitmap)
    else:
        places = named.select("id", F.explode(F.arrays_zip("names", "places")).alias("x")).select("id", F.col("x.names").alias("name"), F.col("x.places").alias("place"))
        places = places.join(repeated, "name").groupBy("id").agg(F.collect_list("place").alias("places"))
        found = candidates(rest.join(places, "id").select("id", "text", "places"), None)
    found = materialize(found, "windows")
    rows = found.select("id", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("x")).select("id", F.col("x.starts").alias("start"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))
    firsts = rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "start")).alias("first"))
    firsts = firsts.groupBy(F.col("first.id").alias("id")).agg(F.collect_list("first.start").alias("firsts"))
    later = found.select("id", "starts").join(firsts, "id", "left").select("id", F.lit(False).alias("whole"), F.array_except("starts", F.coalesce("firsts", F.array().cast("array<int>"))).alias("starts")).where(F.size("starts") > 0)
    later = materialize(later, "repeats")
    discard(found)
    return later.groupBy("id").agg(F.first("whole").alias("whole"), F.min("starts").alias("starts")).union(copies.select("id", F.lit(True), F.array().cast("array<int>")))


def removed_mask(n: int, whole: bool, starts: list[int] | None) -> np.ndarray:
    gone = np.zeros(n, bool)
    if whole and n >= WINDOW:
        gone[:] = True
    elif starts:
        edge = np.zeros(n + 1, np.int64)
        s = np.array(starts)
        np.add.at(edge, s, 1)
        np.add.at(edge, np.minimum(s + WINDOW, n), -1)
        gone = np.cumsum(edge[:-1]) > 0
    return gone


def _with_repeats(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns of documents, lw_whole and lw_starts. Only documents that lose words take part in a join by text."""
    gone = materialize(repeats(documents, id_col, text_col), "gone")
    keys = gone.select(F.col("id").alias("lw_id"))
    rows = documents.withColumn("lw_id", key(documents[id_col], documents[text_col]))
    touched = semi_join(rows, keys, "lw_id").join(gone.select(F.col("id").alias("lw_id"), F.col("whole").alias("lw_whole"), F.col("starts").alias("lw_starts")), "lw_id")
    rest = anti_join(rows, keys, "lw_id").withColumns({"lw_whole": F.lit(False), "lw_starts": F.array().cast("array<int>")})
    return touched.unionByName(rest).drop("lw_id")


def cut_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    rows = _with_repeats(documents, id_col, text_col)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "lw_whole", "lw_starts")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sha = [], [], []
            for text, whole, starts in zip(*batch.columns[1:], strict=True):
                words = split(text.as_py())
                gone = removed_mask(len(words), whole.as_py(), starts.as_py())
                n = int(gone.sum())
                total.append(len(words))
                removed.append(n)
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if n else words)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def cut(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated words cut from text, each with the space after it, and lw_removed (number of words).

    Texts that lose nothing are unchanged.
    """
    rows = _with_repeats(documents, id_col, text_col)
    fields = [f for f in rows.schema.fields if f.name not in ("lw_whole", "lw_starts")]

    def shortened(text: str | None, whole: bool, starts: list[int]) -> tuple[str | None, int]:
        if not whole and not starts:
            return text, 0
        raw = text.encode("utf-8", "surrogatepass")
        spans = [m.start() for m in WORD.finditer(raw)]
        gone = removed_mask(len(spans), whole, starts)
        parts = [raw[: spans[0]]] if spans else [raw]
        parts += [raw[a:b] for a, b, g in zip(spans, [*spans[1:], len(raw)], gone, strict=True) if not g]
        return b"".join(parts).decode("utf-8", "surrogatepass"), int(gone.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            found = [shortened(t.as_py(), w.as_py(), s.as_py()) for t, w, s in zip(columns[text_col], columns.pop("lw_whole"), columns.pop("lw_starts"), strict=True)]
            columns[text_col] = pa.array([x[0] for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array([x[1] for x in found], pa.int64())], [*columns, "lw_removed"])

    return rows.mapInArrow(run, type(rows.schema)([*fields]).add("lw_removed", "long"))
