"""Near-duplicate detection by circulant MinHash.

Words are lower-cased (A to Z) runs of non-space characters; a document's set is its distinct shingles of five words, as
64-bit hashes. One permutation places the shingles, and a second one, read from each place on, gives all signature
coordinates: coordinate k is the smallest value found k places on. So a shingle costs one contiguous read. Bands of the
signature are hashed to buckets, and each bucket's members are compared with one of theirs at a time; every link is
confirmed on the full sets.

Documents with equal sets form a class and only its smallest id goes on, so copies never meet in a bucket. Within a bucket
every member is first paired with one chosen member (the smallest; then that with the most links), each round in a quarter
of the buckets, as most of a group's buckets tell the same. Those rounds only save work: after them every bucket that
still holds several components has all its pairs across components compared on the full sets, however many they are, so
only the bands leave anything to chance. Hot buckets are dealt in pairs of blocks; buckets of equal members count once.
With 32 bands of 4, a pair at 0.75 shares no bucket with chance 5e-6.

Null or empty texts have an empty set and are linked with nothing. Rows with a null id are left alone: no component, kept.
Rows that repeat an id are one document's. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import connected_components, discard, materialize, semi_join, worker_state
from lorewright.llm.wordlists import Words, slices

BANDS, ROWS = 32, 4
#: Rounds against one chosen member before all pairs that are left are compared.
ROUNDS = 3
#: Of the buckets, such a round uses one share, told by the key; the shares take turns.
SHARES = 4
#: Shingles of a block, as expected: a bucket with more is compared by pairs of blocks.
BLOCK = 1 << 20
PLACES = 1 << 20


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The places of shingles, and the second permutation's windows of one signature's length at each place."""
    return worker_state(("minhash", "permutations"), _permutations)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_01)
    place = draw.permutation(PLACES).astype(np.int32)
    ring = draw.permutation(PLACES).astype(np.int32)
    ring = np.concatenate((ring, ring[: BANDS * ROWS - 1]))
    return place, np.lib.stride_tricks.sliding_window_view(ring, BANDS * ROWS)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct shingles of texts as sorted unsigned 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        words = Words(texts, lower=True)
        w, size, found = words.hashes(), self.size, []
        h = np.zeros(max(len(w) - size + 1, 0), np.uint64)
        for k in range(size):
            h += w[k : len(h) + k] * self.factors[k]
        h = mix(h)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= size:
                found.append(np.unique(h[a : b - size + 1]))
            elif b > a:
                found.append(mix((w[a:b] * self.factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                found.append(w[:0])
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets(pa.array([text], pa.string()))[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    place, ring = permutations()
    at = place[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
    out = ring[at[0]].copy()
    for lo in range(0, len(at), 1024):
        np.minimum(out, ring[at[lo : lo + 1024]].min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h + parts[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def signatures(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per document: id, n, hi and lo (digest of the set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for whole in batches:
            for batch in slices(whole):
                n, hi, lo, bands = [], [], [], []
                for s in shingles.sets(batch.column(1)):
                    n.append(len(s))
                    if len(s):
                        digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                        hi.append(int(digest[0]))
                        lo.append(int(digest[1]))
                        bands.append(band_keys(signature(s)))
                    else:
                        hi.append(None)
                        lo.append(None)
                        bands.append(None)
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "hi", "lo", "bands"])

    rows = documents.select(documents[id_col].cast("long").alias("id"), documents[text_col].alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, hi bigint, lo bigint, bands array<bigint>")


def sets(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per document: id and its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for whole in batches:
            for batch in slices(whole):
                found = [x.view(np.int64) for x in shingles.sets(batch.column(1))]
                yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    rows = documents.select(documents[id_col].cast("long").alias("id"), documents[text_col].alias("text"))
    return rows.mapInArrow(run, "id bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets have an intersection of at least percent of their union."""
    left, right = members.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), members.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return both.where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def links_within(ids: np.ndarray, components: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], across: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join all components whose members are near; across: only pairs of different blocks are compared.

    Pairs inside one component, links found here included, are left out.
    """
    _, component, size = np.unique(components, return_inverse=True, return_counts=True)
    order = np.lexsort((component, size[component]))  # the largest last: its members are compared with no later one
    ids, component, blocks, sets = ids[order], component[order], blocks[order], [sets[k] for k in order]
    n = np.array([len(x) for x in sets])
    begin = np.cumsum(n) - n
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), bool)
    out = []
    for k in range(len(ids) - 1):
        rest = n[k + 1 :]
        wanted = (component[k + 1 :] != component[k]) & (100 * np.minimum(rest, n[k]) >= percent * np.maximum(rest, n[k]))
        if across:
            wanted &= blocks[k + 1 :] != blocks[k]
        later = np.flatnonzero(wanted) + k + 1
        if not len(later):
            continue
        own = code[begin[k] : begin[k] + n[k]]
        mark[own] = True
        shared = np.add.reduceat(mark[code[begin[k + 1] :]], begin[k + 1 :] - begin[k + 1], dtype=np.int64)[later - k - 1]
        mark[own] = False
        for j in later[100 * shared >= percent * (n[k] + n[later] - shared)]:
            if component[j] != component[k]:
                out.append((int(ids[k]), int(ids[j])))
                component[component == component[j]] = component[k]
    return out


def exact_links(at: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components from all pairs in the buckets of at (key, id, n, component); chosen: id, shingles.

    A bucket of more than BLOCK shingles is dealt in blocks, its largest component apart, as that isn't compared with itself.
    """
    hashes = [F.xxhash64("id", F.lit(k)) for k in range(2)]
    parts = at.groupBy("key", "component").agg(F.sum("n").alias("t"), *[F.bit_xor(h).alias(f"x{k}") for k, h in enumerate(hashes)])
    buckets = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("t").alias("t"), F.max_by("component", "t").alias("top"), F.max("t").alias("top_t"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1")).where("parts > 1")
    buckets = buckets.groupBy("x0", "x1").agg(F.min_by(F.struct("key", "t", "top", "top_t"), "key").alias("v")).select("v.*")
    blocks = lambda t: F.ceil(t / F.lit(float(BLOCK))).cast("int")
    whole = F.col("t") <= BLOCK
    buckets = materialize(buckets.select("key", "top", F.when(whole, 1).otherwise(blocks(F.col("t") - F.col("top_t"))).alias("others"), F.when(whole, 0).otherwise(blocks(F.col("top_t"))).alias("tops")), "rest")
    rows = at.join(buckets, "key").withColumn("other", (F.col("component") != F.col("top")) | (F.col("tops") == 0))
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    rows = rows.withColumn("block", F.when(F.col("other"), salt("others")).otherwise(F.col("others") + F.pmod(F.xxhash64("id", F.lit(3)), F.greatest("tops", F.lit(1))).cast("int")))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.when(F.col("other"), F.col("others") + F.col("tops")).otherwise(F.col("others")) - 1)))
    rows = rows.select("key", F.least("block", "x").alias("lo"), F.greatest("block", "x").alias("hi"), "block", "id", "component")
    rows = rows.join(chosen, "id").select("key", "lo", "hi", "block", "id", "component", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, found = None, [], []

        def close() -> None:
            if sum(len(x[0]) for x in held) > 1:
                found.extend(links_within(*(np.concatenate([x[k] for x in held]) for k in range(3)), [s for x in held for s in x[3]], unit[1] != unit[2], percent))
            held.clear()

        for batch in batches:
            key, lo, hi, block, ids, component = (batch.column(k).to_numpy() for k in range(6))
            lists = batch.column(6)
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for begin, end in zip([0, *edges], [*edges, len(key)], strict=True):
                if begin == end:
                    continue
                this = (key[begin], lo[begin], hi[begin])
                if this != unit:
                    close()
                    unit = this
                held.append((ids[begin:end], component[begin:end], block[begin:end], [flat[offsets[k] : offsets[k + 1]] for k in range(begin, end)]))
            if found:
                yield pa.record_batch([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])
                found.clear()
        close()
        if found:
            yield pa.record_batch([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links) and kept (whether that is its own)."""
    signed = materialize(signatures(documents, id_col, text_col, size), "minhash")
    classes = materialize(signed.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep")), "classes")
    reps = signed.where("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    banded = materialize(reps.select("id", "n", F.explode("bands").alias("key")), "bands")
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = materialize(banded.join(shared, "key"), "members")
    discard(banded)
    chosen = materialize(sets(semi_join(documents, members.select(F.col("id").alias(id_col)), id_col), id_col, text_col, size).dropDuplicates(["id"]), "sets")

    spark = documents.sparkSession
    links = labels = spark.createDataFrame([], "a bigint, b bigint")
    labels = labels.toDF("node", "component")
    seen = links
    comparable = F.lit(100) * F.least("n", "other_n") >= F.lit(percent) * F.greatest("n", "other_n")
    ends = [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]
    for turn in range(ROUNDS + 1):
        # A member's component; buckets that hold one component are done.
        at = members.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
        if turn:
            at = materialize(at, "at")
        if turn == ROUNDS:
            new = materialize(exact_links(at, chosen, percent), "links")
        else:
            at = at.where(F.pmod("key", F.lit(SHARES)) == turn % SHARES)
            if turn == 2:
                degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
                at = at.join(degree, "id", "left")
                rank = F.struct(F.coalesce("degree", F.lit(0)), -F.col("id"))
            else:
                rank = F.struct(F.lit(0), -F.col("id"))
            hubs = at.groupBy("key").agg(F.max_by(F.struct("id", "n", "component"), rank).alias("hub"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key", "hub")
            pairs = at.join(hubs, "key").select("id", "n", "component", F.col("hub.id").alias("other"), F.col("hub.n").alias("other_n"), F.col("hub.component").alias("other_component")).where("component <> other_component")
            pairs = pairs.where(comparable)
            if turn == 0:
                pairs = pairs.groupBy("id").agg(F.min("other").alias("other"))
            pairs = pairs.select(*ends).distinct()
            if turn:
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs")
            seen = seen.union(pairs)
            new = materialize(confirmed(pairs, chosen, percent), "links")
        if not new.isEmpty():
            links = links.union(new)
            labels = materialize(connected_components(links), "labels")
    out = signed.select("id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left")
    out = out.join(labels, F.col("rep") == F.col("node"), "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
