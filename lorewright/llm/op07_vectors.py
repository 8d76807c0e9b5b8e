"""Near-duplicate vectors by spherical k-means cells and blocked cosines.

Equal vectors form a class; one of each class goes on. Centroids are fitted on a bounded random sample (`sample` rows,
drawn by a hash of the id); every vector's home is the cell of its nearest centroid. A vector is also a guest in each cell
whose border is within half the search angle of it: of two vectors within the angle, one at least is a guest in the other's
home, so no link is lost (reach=1; a smaller reach makes fewer guests and may lose links).

A cell's vectors are dealt in blocks of bounded size, and each pair of blocks is one matrix product in double precision.
A block pair returns, per vector, how many vectors it is linked with, and a spanning forest of the links; never the pairs.

Vectors of each length have cells of their own, all searched in one pass; the driver gets one row per length.

Vectors that are null, zero, or hold null or non-finite components are linked with nothing. An empty table gives an empty
result. Rows that repeat an id are one vector, that with the least digest, and all get its result; rows with a null id have
no component and are kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import connected_components, materialize
from lorewright.llm.op04_langid import spherical_kmeans

#: Vectors in a block of homes, and of those compared with it.
BLOCK = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of double), hi and lo (digest) of the vectors that may be linked."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(xxhash.xxh3_128_digest((np.array(v.as_py()) + 0.0).tobytes()), np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(x[0]) for x in found], pa.int64()), pa.array([int(x[1]) for x in found], pa.int64())], ["id", "v", "hi", "lo"])

    return rows.mapInArrow(run, "id bigint, v array<double>, hi bigint, lo bigint")


def stack(column) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, sample: int = 20_000, reach: float = 1.0) -> DataFrame:
    """Per vector: id, n_links (others at `cosine` or more), component_id (smallest id reachable by links) and kept (its own)."""
    spark = vectors.sparkSession
    good = materialize(usable(vectors, id_col, vector_col), "vectors")
    ids = materialize(good.groupBy("id").agg(F.min(F.struct("hi", "lo")).alias("digest")).select("id", "digest.*"), "vector-ids")
    classes = materialize(ids.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    reps = good.join(classes.select(F.col("rep").alias("id"), "hi", "lo", "copies"), ["id", "hi", "lo"]).dropDuplicates(["id"]).select("id", "v", "copies")
    reps = materialize(reps, "vector-reps")
    lengths = {r["d"]: r["count"] for r in reps.groupBy(F.size("v").alias("d")).count().collect()}
    found = spark.createDataFrame([], "id bigint, links bigint, component bigint")
    if lengths:
        chance = min(1.0, sample / sum(lengths.values()))
        drawn = reps.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30)))).select("id", "v").toPandas().sort_values("id")
        centroids = {}
        for d, n in sorted(lengths.items()):
            own = [v for v in drawn["v"] if len(v) == d]
            cells = max(1, min(2048, int(math.sqrt(n) / 3), len(own)))
            centroids[d] = np.unique(spherical_kmeans(stack(own), cells, 8), axis=0) if own else np.ones((1, d)) / math.sqrt(d)
        found = _linked(reps, centroids, cosine, reach)
        links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
        joined = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
        of = classes.join(links, F.col("rep") == F.col("id"), "left").drop("id").join(joined, F.col("rep") == F.col("node"), "left")
        of = materialize(of.select("hi", "lo", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "vector-links")
        found = ids.join(of, ["hi", "lo"]).select("id", "links", "component")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"))
    out = rows.join(found.select(F.col("id").alias("of"), "links", "component"), F.col("id") == F.col("of"), "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _linked(reps: DataFrame, centroids: dict[int, np.ndarray], cosine: float, reach: float) -> DataFrame:
    """Rows (id, links, other): a vector's linked copies in one block pair (other null), or a link of its spanning forest.

    centroids: those of the vectors of each length. Cells are numbered through all lengths.
    """
    near = reach * math.sin(math.acos(min(1.0, max(-1.0, cosine))) / 2) + 1e-9
    firsts = np.cumsum([0, *(len(c) for c in centroids.values())]).tolist()
    apart = lambda c: np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18))
    shared = reps.sparkSession.sparkContext.broadcast({d: (first, c, apart(c)) for first, (d, c) in zip(firsts, centroids.items(), strict=False)})

    def places(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The first cell for vectors of this length, and counted from it: home of each vector, and which cells it visits."""
        first, c, far = shared.value[x.shape[1]]
        dots = np.einsum("ij,kj->ik", x, c)
        home = dots.argmax(1)
        visits = (dots[np.arange(len(x)), home][:, None] - dots) / far[home] <= near
        visits[np.arange(len(x)), home] = False
        return first, home, visits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                lengths = pc.list_value_length(batch.column(1)).to_numpy()
                for d in np.unique(lengths):
                    part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                    first, home, visits = places(stack(part.column(1).to_pylist()))
                    row, cell = np.nonzero(visits)
                    row, cell = np.concatenate((np.arange(len(home)), row)), np.concatenate((home, cell))
                    names = ["id", "v", "copies"]
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in range(3)), pa.array((first + cell).astype(np.int32)), pa.array(home[row] == cell)], [*names, "cell", "home"])

    dealt = reps.mapInArrow(deal, "id bigint, v array<double>, copies bigint, cell int, home boolean")
    # Blocks of homes and of visitors by the cell's own numbers of rows; hot cells have more blocks.
    counts = dealt.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).collect()  # one row per cell
    blocks = reps.sparkSession.createDataFrame([(r["cell"], math.ceil(r["homes"] / BLOCK) or 1, math.ceil(r["all"] / (4 * BLOCK)) or 1) for r in counts], "cell int, hbs int, qbs int")
    rows = dealt.join(F.broadcast(blocks), "cell")
    hb = F.pmod(F.xxhash64("id"), F.col("hbs")).cast("int")
    qb = F.pmod(F.xxhash64("id", F.lit(5)), F.col("qbs")).cast("int")
    tiles = rows.where("home").select("id", "v", "copies", "cell", F.lit(True).alias("target"), hb.alias("hb"), F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), "home")
    tiles = tiles.union(rows.select("id", "v", "copies", "cell", F.lit(False), F.explode(F.sequence(F.lit(0), F.col("hbs") - 1)).alias("hb"), qb.alias("qb"), "home"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        is_home = pdf["target"].to_numpy(bool)
        t, q = pdf[is_home], pdf[~is_home]
        none = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": pd.array([], "Int64")})
        if not len(t) or not len(q):
            return none
        cell = int(pdf["cell"].iloc[0])
        x, y = stack(t["v"]), stack(q["v"])
        tid, qid, q_home = t["id"].to_numpy(), q["id"].to_numpy(), q["home"].to_numpy(bool)
        rows, cols = [], []
        for lo in range(0, len(y), 1024):
            a, b = np.nonzero(y[lo : lo + 1024] @ x.T >= cosine)
            a = a + lo
            mine = ~q_home[a] | (qid[a] < tid[b])
            rows.append(a[mine])
            cols.append(b[mine])
        a, b = np.concatenate(rows), np.concatenate(cols)
        guest = ~q_home[a]
        if guest.any():
            # A pair that both cells see is the one with the smaller number's.
            who = np.unique(b[guest])
            first, _, visits = places(x[who])
            back = np.searchsorted(who, b[guest])
            _, other_home, _ = places(y[np.unique(a[guest])])
            theirs = other_home[np.searchsorted(np.unique(a[guest]), a[guest])]
            drop = visits[back, theirs] & (first + theirs < cell)
            stay = np.ones(len(a), bool)
            stay[np.flatnonzero(guest)[drop]] = False
            a, b = a[stay], b[stay]
        if not len(a):
            return none
        tc, qc = t["copies"].to_numpy(), q["copies"].to_numpy()
        ids, at = np.unique(np.concatenate((qid[a], tid[b])), return_inverse=True)
        links = np.bincount(at, weights=np.concatenate((tc[b], qc[a])).astype(np.float64)).astype(np.int64)
        # The smallest id reachable within the tile, by relabelling both ends until nothing changes.
        left, right, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
        while True:
            new = label.copy()
            np.minimum.at(new, left, label[right])
            np.minimum.at(new, right, label[left])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(ids))
        return pd.DataFrame({"id": np.concatenate((ids, ids[moved])), "links": np.concatenate((links, np.zeros(int(moved.sum()), np.int64))), "other": pd.array([*[None] * len(ids), *ids[label[moved]]], "Int64")})

    return materialize(tiles.groupBy("cell", "hb", "qb").applyInPandas(tile, "id bigint, links bigint, other bigint"), "vector-tiles")
