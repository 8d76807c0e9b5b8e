"""Which sources of a language use its words unlike the language or each other, by integer dictionaries.

Terms are runs of letters (ASCII letters, lower-cased, and all characters beyond ASCII). A language keeps the terms that are
in at least min_docs of its documents. Counts of (language, source, term) are made once and sorted by language and term in
ranges; each run of a range is a chunk: its kept terms are one sorted array, a term's id is its place there by searchsorted,
and each source's counts are a vector over these ids. Numbers of chunks and ids within them rise with the UTF-8 order of the
terms through the whole language, so that ties are decided by them and terms are looked up only for what is reported.

Shares are p = 1 + floor(SCALE * (count + 2) / (n + 2 * kept)) of a group and of the language (q), and the divergence of two
shares is floor((p - q)^2 / (p + q)); all in 64-bit integers, exact for up to 9e15 occurrences of kept terms in a language.

Pairs of sources are compared chunk by chunk, in tiles of two blocks of sources, and the tiles' sums added; every pair is
reported, as the report asks for all. A frequent term has one row per source, whatever its occurrences.

Null languages, sources and texts count as empty strings. Rows that repeat an id are documents of their own. Long texts and
terms are taken whole. Equal values are ranked by the item's UTF-8 order. A language that keeps no term gives pairs of value
0. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.llm.common import bound_batches, checked, materialize

SCALE = 1_000_000_000
#: What stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of counts that a worker gathers before it hands them on, and rows and bytes of counts in a chunk.
HELD, ROWS, BYTES = 300_000, 65_536, 16 << 20
#: Sources in a block.
BLOCK = 64

COUNTS = "lang string, source string, term string, n bigint, docs bigint"
CHUNKS = "lang string, chunk bigint, source string, terms array<string>, ids array<int>, counts array<bigint>, totals array<bigint>"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, by language and source; batches: lang, source, text."""
    keys = ["lang", "source", "term"]
    held, rows = [], 0

    def combined() -> pa.Table:
        table = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return table.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    for batch in batches:
        words = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), BETWEEN)
        row = pc.list_parent_indices(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        size = len(coded.dictionary)
        if not size:
            continue
        places, n = np.unique(row.astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
        row, term = places // size, places % size
        solid = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[term]
        row, term, n = row[solid], term[solid], n[solid]
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64)[row] * len(source.dictionary) + source.indices.to_numpy()[row]
        order = np.argsort(group * size + term, kind="stable")
        group, term, n = group[order], term[order], n[order]
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (term[1:] != term[:-1])]) if len(group) else np.zeros(0, np.int64)
        if not len(first):
            continue
        docs = np.diff(np.r_[first, len(group)])
        columns = [lang.dictionary.take(pa.array(group[first] // len(source.dictionary))), source.dictionary.take(pa.array(group[first] % len(source.dictionary))), coded.dictionary.take(pa.array(term[first]))]
        held.append(pa.table([*columns, pa.array(np.add.reduceat(n, first).astype(np.int64)), pa.array(docs.astype(np.int64))], [*keys, "n", "docs"]))
        rows += len(first)
        if rows > HELD:
            held = [combined()]
            rows = held[0].num_rows
            if rows > HELD // 2:
                yield from held[0].to_batches(65_536)
                held, rows = [], 0
    if held:
        yield from combined().to_batches(65_536)


def _chunk(rows: pa.Table, min_docs: int, chunk: int) -> pa.RecordBatch | None:
    """The dictionary of a language's sorted rows (whole terms), and each source's vector over it."""
    terms = rows["term"].combine_chunks()
    of = np.cumsum(np.r_[False, pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)])
    docs = np.bincount(of, weights=rows["docs"].to_numpy())
    distinct = np.array([t.encode() for t in terms.take(pa.array(np.flatnonzero(np.r_[True, np.diff(of) > 0]))).to_pylist()], object)
    kept = distinct[docs >= min_docs]
    if not len(kept):
        return None
    ids = np.searchsorted(kept, distinct)
    known = kept[np.minimum(ids, len(kept) - 1)] == distinct
    row_ids, stays = ids[of], known[of]
    sources = rows["source"].combine_chunks().dictionary_encode()
    row_ids, n, source = row_ids[stays], rows["n"].to_numpy()[stays], sources.indices.to_numpy()[stays]
    totals = np.bincount(row_ids, weights=n, minlength=len(kept)).astype(np.int64)
    lang = rows["lang"][0].as_py()
    out = [(lang, chunk, None, [t.decode() for t in kept], None, None, totals)]
    for k in np.unique(source):
        own = source == k
        counts = np.bincount(row_ids[own], weights=n[own], minlength=len(kept)).astype(np.int64)
        at = np.flatnonzero(counts)
        out.append((lang, chunk, sources.dictionary[int(k)].as_py(), None, at.astype(np.int32), counts[at], totals[at]))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["lang", "chunk", "source", "terms", "ids", "counts", "totals"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)


def chunked(min_docs: int):
    """Chunks of rows that are sorted by language and term, as numbers that rise with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []

        def cut(rows: pa.Table, last: bool) -> Iterator[tuple[pa.Table, bool]]:
            """rows by language; whether those of a language are whole, or the last term may go on."""
            lang = rows["lang"].combine_chunks()
            starts = [0, *(np.flatnonzero(pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(lang)]
            for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                yield rows.slice(a, b - a), last or k < len(starts) - 2

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal no, held
            rows, held = pa.concat_tables(held).combine_chunks(), []
            for own, whole in cut(rows, last):
                if not whole:
                    terms = own["term"].combine_chunks()
                    end = len(own) - 1
                    goes_on = pc.equal(terms, terms[end]).to_numpy(zero_copy_only=False)
                    first = int(np.argmax(goes_on))
                    held = [own.slice(first)]
                    own = own.slice(0, first)
                if len(own) and (found := _chunk(own, min_docs, part << 32 | no)) is not None:
                    no += 1
                    yield found

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                if sum(t.num_rows for t in held) >= ROWS or sum(t.nbytes for t in held) >= BYTES:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def shares(counts: np.ndarray, n, kept) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / (n + 2 * kept)): a long division in three digits of a thousand, so nothing overflows."""
    over = np.asarray(n, np.int64) + 2 * np.asarray(kept, np.int64)
    rest, found = counts.astype(np.int64) + 2, np.zeros(counts.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // over
        rest = rest % over
    return 1 + found


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of divergences over a chunk, of the sources in one block with those in another."""
    size, kept = int(pdf["size"].iloc[0]), int(pdf["kept"].iloc[0])
    pdf = pdf.sort_values("source", ignore_index=True)
    dense = np.zeros((len(pdf), size), np.int64)
    for k, (ids, counts) in enumerate(zip(pdf["ids"], pdf["counts"], strict=True)):
        if ids is not None:
            dense[k, ids] = counts
    p = shares(dense, pdf["n"].to_numpy()[:, None], kept) if size else dense
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    left, right = (np.flatnonzero(pdf["block"].to_numpy() == b) for b in (lo, hi))
    names, rows = pdf["source"].tolist(), []
    for k, i in enumerate(left):
        others = right[k + 1 :] if lo == hi else right
        values = divergence(p[others], p[i]).sum(1)
        for j, value in zip(others, values, strict=True):
            rows += [(names[i], names[j], int(value)), (names[j], names[i], int(value))]
    out = pd.DataFrame(rows, columns=["source", "item", "value"])
    out.insert(0, "lang", pdf["lang"].iloc[0])
    return out


def _best(top: int):
    """Of each source's terms in a chunk the `top` that the language uses less, by divergence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.array(r["ids"], np.int32)
                p, q = shares(np.array(r["counts"]), r["n"], r["kept"]), shares(np.array(r["totals"]), r["total"], r["kept"])
                ids, value = ids[p > q], divergence(p, q)[p > q]
                first = np.lexsort((ids, -value))[:top]
                out += [(r["lang"], r["source"], r["chunk"], int(i), int(v)) for i, v in zip(ids[first], value[first], strict=True)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["lang", "source", "chunk", "id", "value"])

    return run


def divergences(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: each other source of the language (part pair) and the source's `top` own terms (part term)."""
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(*[F.coalesce(documents[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = docs.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = materialize(counted, "term-counts")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = counted.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(chunked(min_docs), CHUNKS)
    chunks = materialize(chunks, "term-chunks")
    dictionary, vectors = chunks.where("source is null"), chunks.where("source is not null")

    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    langs = dictionary.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"), F.sum(total("totals")).alias("total"))
    groups = docs.select("lang", "source").distinct()
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(langs, "lang", "left").select("lang", "blocks", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"))
    langs = materialize(langs, "term-langs")
    sums = vectors.groupBy("lang", "source").agg(F.sum(total("counts")).alias("n"))
    groups = groups.join(sums, ["lang", "source"], "left").join(checked(langs), "lang")
    groups = materialize(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "kept", "total", F.pmod(F.xxhash64("source"), "blocks").alias("block"), "blocks"), "term-groups")
    few = checked(groups)

    # A language without kept terms has one empty chunk, so that its pairs are there.
    sizes = dictionary.select("lang", "chunk", F.size("terms").alias("size")).union(langs.where("kept = 0").select("lang", F.lit(-1).cast("long"), F.lit(0)))
    rows = sizes.join(few, "lang").join(vectors.select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("lang", "chunk", "size", "kept", "source", "n", "block", "ids", "counts", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    pairs = rows.groupBy("lang", "chunk", "lo", "hi").applyInPandas(_tile, "lang string, source string, item string, value bigint")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked.orderBy(F.desc("value"), "item")).alias("rank"))

    best = vectors.join(few.select("lang", "source", "n", "kept", "total"), ["lang", "source"]).select("lang", "source", "chunk", "ids", "counts", "totals", "n", "kept", "total")
    best = best.mapInArrow(_best(top), "lang string, source string, chunk bigint, id int, value bigint")
    best = best.withColumn("rank", F.row_number().over(ranked.orderBy(F.desc("value"), "chunk", "id"))).where(F.col("rank") <= top)
    best = best.join(dictionary.select("lang", "chunk", "terms"), ["lang", "chunk"]).select("lang", "source", F.lit("term").alias("part"), F.get("terms", F.col("id")).alias("item"), "value", "rank")
    return pairs.unionByName(best)
