"""A persistent approximate vector index: cells of an inverted file, product-quantised residuals, exact re-ranking (SRC6).

A folder holds the model (cell centroids, a codebook for each part of the residual), the rows by cell, and the ids that a
later insertion replaced. A row keeps its codes and its unit vector; a search reads the codes of the probed cells only
(a static partition filter and two columns), takes each query's best `rerank` by the approximate product, block of queries
by slice of rows, and reads the vectors of these for the exact cosine.

Cells grow with the square root of the rows, so that the model stays small beside them (31,623 cells of 64 floats, 8 MB, for
a billion rows); it is what a worker is given. Centroids and codebooks are fitted on a random sample of `sample` rows or 32
for each cell, whichever is more; every row is indexed. How many cells a search probes is measured on the sample too, for
the recall that is asked for (neighbours in a sample are farther apart, so the index does no worse). Queries are a stated batch. Vectors that are null, zero, of another
length or hold null or non-finite components are left out. Rows are written in files of a bounded size, hot cells in many.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright import shared
from lorewright.functions import vectors as V

#: Entries of a codebook; one byte names one.
CODES = 256
#: Rows of the sample whose nearest ones tell how many cells a search has to probe.
TRIED = 2_000
#: Queries and rows that meet in a group of a search at most, rows that a group takes at a time, and pairs that it holds
#: before it sorts out the best (some 10 MB).
ASKED, ROWS, STEP, KEPT = 512, 1 << 18, 4_096, 400_000
#: Rows found and components of queries that are broadcast at most (some 5 MB each); beyond it joins shuffle.
FEW_FOUND, FEW_FLOATS = 50_000, 1 << 20
#: How far a matrix product may be from the sum in the order of the elements.
MARGIN = 1e-9


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k means of the rows of x by Lloyd's rounds; means without rows restart at the rows farthest from theirs."""
    draw = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    means = distinct[draw.choice(len(distinct), 1)]
    gap = ((x - means[0]) ** 2).sum(1)
    for _ in range(k - 1):  # starts far from one another
        means = np.vstack([means, x[draw.choice(len(x), p=gap / gap.sum())]])
        gap = np.minimum(gap, ((x - means[-1]) ** 2).sum(1))
    for _ in range(rounds):
        far = ((x**2).sum(1)[:, None] - 2 * x @ means.T) + (means**2).sum(1)
        home = far.argmin(1)
        sizes = np.bincount(home, minlength=k)
        sums = np.zeros_like(means)
        np.add.at(sums, home, x)
        means = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], means)
        if (empty := np.flatnonzero(sizes == 0)).size:
            means[empty] = x[np.argsort(-far.min(1), kind="stable")[: len(empty)]]
    return means


def usable(rows: DataFrame, dims: int) -> DataFrame:
    """rows with vector as a unit vector of floats, without those that have none."""
    fine = (F.size("vector") == dims) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("vector", V.normalized(F.col("vector")).cast("array<float>"))


@dataclass
class VectorIndex:
    """An index in a folder; build() or open() give one.

    centroids: cells x dims; books: for each part codes x its dims; reach: the cells to probe for the recall asked for, by the sample.
    """

    spark: SparkSession
    path: str
    centroids: np.ndarray
    books: list[np.ndarray]
    reach: int

    @staticmethod
    def build(rows: DataFrame, path: str, parts: int = 16, sample: int = 20_000, cells: int | None = None, recall: float = 0.97, seed: int = 7) -> VectorIndex:
        """Fits a model on rows (id, vector and others) and writes all of them; path must be new."""
        spark = rows.sparkSession
        dims = rows.where("vector is not null").select(F.size("vector").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
        if dims is None:
            raise ValueError("no vectors to fit an index on")
        good = usable(rows, dims["d"])
        n = good.count()
        cells = cells or max(1, int(math.sqrt(n)))
        chance = min(1.0, max(sample, 32 * cells) / max(n, 1))
        drawn = good.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30))))
        drawn = shared.materialize(drawn.select("vector"), "index-sample")
        fitted = KMeans(k=max(2, cells), distanceMeasure="cosine", maxIter=10, seed=seed).fit(drawn.select(array_to_vector("vector").alias("features")))
        centroids = np.array(fitted.clusterCenters(), np.float64)
        centroids /= np.maximum(np.sqrt((centroids**2).sum(1, keepdims=True)), 1e-12)
        cuts = [c.tolist() for c in np.array_split(np.arange(dims["d"]), min(parts, dims["d"]))]
        few = min(1.0, sample / max(1, drawn.count()))

        def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(0))
                rest = x - centroids[(x @ centroids.T).argmax(1)]
                for k, cut in enumerate(cuts):
                    yield pa.record_batch([pa.array(np.full(len(x), k, np.int32)), pa.array(list(rest[:, cut]), pa.list_(pa.float64()))], ["part", "rest"])

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            book = lloyd(np.stack(pdf["rest"].to_numpy()), CODES, seed=seed)
            return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "no": range(len(book)), "vector": list(book)})

        # One task for each part of the vector, on the bounded sample.
        some = drawn.where(F.rand(seed) < few) if few < 1 else drawn
        fitted = some.mapInArrow(residuals, "part int, rest array<double>").groupBy("part").applyInPandas(fit, "part int, no int, vector array<double>")
        fixed = [(-1, k, c.tolist()) for k, c in enumerate(centroids)]

        def reach(pdf: pd.DataFrame) -> pd.DataFrame:
            """How many cells to probe so that `recall` of the ten nearest within some rows are met."""
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            near = x @ x.T
            np.fill_diagonal(near, -2)
            best = np.argsort(-near, axis=1)[:, :10]
            order = np.argsort(np.argsort(-(x @ centroids.T), axis=1), axis=1)
            ranks = np.take_along_axis(order, (x @ centroids.T).argmax(1)[best], 1)
            return pd.DataFrame({"part": [-2], "no": [0], "vector": [[float(np.quantile(ranks, recall, method="higher")) + 1]]})

        tried = drawn.orderBy(F.xxhash64("vector")).limit(TRIED).groupBy().applyInPandas(reach, "part int, no int, vector array<double>")
        model = fitted.unionByName(tried).unionByName(spark.createDataFrame(fixed, "part int, no int, vector array<double>"))
        model.write.parquet(f"{path}/model")
        index = VectorIndex.open(spark, path)
        index._write(good, 0)
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/model").orderBy("part", "no").collect()  # cells and codes, never rows
        books: dict[int, list] = {}
        for r in rows:
            books.setdefault(r["part"], []).append(r["vector"])
        centroids, reach = np.array(books.pop(-1)), int(books.pop(-2)[0][0])
        return VectorIndex(spark, path, centroids, [np.array(books[k]) for k in sorted(books)], reach)

    def _coded(self, rows: DataFrame) -> DataFrame:
        centroids, books = self.centroids, self.books
        edges = np.cumsum([0, *(b.shape[1] for b in books)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(batch.schema.get_field_index("vector")))
                cell = (x @ centroids.T).argmax(1)
                rest = x - centroids[cell]
                codes = np.empty((len(x), len(books)), np.uint8)
                for k, book in enumerate(books):
                    part = rest[:, edges[k] : edges[k + 1]]
                    codes[:, k] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype(np.int32))], [*batch.schema.names, "codes", "cell"])

        return rows.mapInArrow(run, type(rows.schema)([*rows.schema.fields]).add("codes", "binary").add("cell", "integer"))

    def _write(self, rows: DataFrame, stamp: int) -> None:
        shared.bound_batches(self.spark)
        coded = self._coded(rows).hint("rebalance", "cell")
        coded.write.partitionBy("cell").parquet(f"{self.path}/rows/stamp={stamp}")

    def rows(self) -> DataFrame:
        """All rows of the index with their cell and stamp, those that were replaced left out."""
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        if self._stamps() > 1:
            gone = self.spark.read.parquet(f"{self.path}/replaced").groupBy("id").agg(F.max("before").alias("before"))
            rows = rows.join(shared.checked(gone), "id", "left").where("before is null or stamp >= before").drop("before")
        return rows

    def _stamps(self) -> int:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        listed = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
        return max([int(s.getPath().getName().removeprefix("stamp=")) for s in listed if s.getPath().getName().startswith("stamp=")], default=-1) + 1

    def insert(self, rows: DataFrame) -> None:
        """Adds rows with the columns of the first ones; a row replaces one of the same id. The model stays as it was fitted."""
        stamp = self._stamps()
        good = usable(rows, self.centroids.shape[1])
        old = self.rows().select("id").join(good.select("id"), "id", "left_semi").select("id", F.lit(stamp).alias("before"))
        old.write.parquet(f"{self.path}/replaced/batch={stamp}")
        self._write(good, stamp)

    def probes(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, q (unit vector) and cells: those with the nearest centroids, for each query."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.argsort(-(_matrix(batch.column(1)) @ centroids.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["query_id", "q", "cells"])

        asked = usable(queries.select("query_id", "vector"), centroids.shape[1])
        return asked.mapInArrow(run, "query_id string, q array<float>, cells array<int>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int = 200) -> DataFrame:
        """query_id, rank, score (exact cosine) and the columns of the k best rows found for each query (query_id, vector).

        Blocks of queries meet slices of rows' codes, each pair of them in a group of its own, and a group gives each query's
        best `rerank` rows. Neither pairs nor vectors beyond FEW_FOUND and FEW_FLOATS pass through the driver.
        """
        probed = shared.materialize(self.probes(queries, probes or self.reach).withColumn("lw_no", F.monotonically_increasing_id()), "probes")
        cells = sorted(r["cell"] for r in probed.select(F.explode("cells").alias("cell")).distinct().collect())  # cells, at most those of the model
        stored = self.rows().where(F.col("cell").isin(cells))
        asked, n = probed.count(), stored.count()
        side = math.ceil(math.sqrt(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))  # about a group for each partition
        blocks = max(1, -(-asked // max(1, min(ASKED, KEPT // rerank))), min(side, asked))
        slices = max(1, -(-n // ROWS), min(side, n // 1_000))

        block = lambda key, of: F.pmod(F.xxhash64(*key), F.lit(of)).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        left = probed.select(block(["lw_no"], blocks).alias("block"), each(slices).alias("slice"), "lw_no", "query_id", "q", "cells")
        right = stored.select(each(blocks).alias("block"), block(["cell", "id"], slices).alias("slice"), "cell", "id", "codes")
        out = type(stored.schema)([probed.schema["lw_no"], probed.schema["query_id"], stored.schema["cell"], stored.schema["id"]]).add("near", "double")
        near = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(_meet(self.centroids, self.books, rerank, KEPT), out)
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        found = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rerank).select("lw_no", "query_id", "cell", "id")
        found = shared.materialize(found, "index-found")
        light = lambda rows, few: F.broadcast(rows) if few else rows.hint("merge")  # noqa: E731  # else files that compress well count as small
        rows = stored.drop("codes", "stamp").join(light(found, asked * rerank <= FEW_FOUND), ["cell", "id"])
        rows = rows.join(light(probed.select("lw_no", "q"), asked * self.centroids.shape[1] <= FEW_FLOATS), "lw_no").withColumn("score", V.dot(F.col("q"), F.col("vector")))
        final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return rows.drop("q", "vector", "cell", "lw_no").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


def _meet(centroids: np.ndarray, books: list[np.ndarray], rerank: int, kept: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of queries and a slice of rows: lw_no, query_id, cell, id and near of each query's best `rerank` rows in its cells."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        asked, rows = asked.combine_chunks(), rows.combine_chunks()
        cell = rows["cell"].to_numpy()
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(cell), len(books))
        q = _matrix(asked["q"].combine_chunks()) if len(asked) else np.empty((0, centroids.shape[1]))
        probed = np.zeros((len(centroids), len(q)), bool)
        for i, mine in enumerate(asked["cells"]):
            probed[mine.values.to_numpy(), i] = True
        bound = np.full(len(q), -np.inf)
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        pending = 0

        def vectors(at: np.ndarray) -> np.ndarray:
            return centroids[cell[at]] + np.concatenate([b[codes[at, j]] for j, b in enumerate(books)], 1)

        def compact() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            who, at, near = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((-near, who))
            last = order[_ranks(who[order]) == rerank - 1]
            bound[who[last]] = near[last]
            best = near >= bound[who] - MARGIN
            return who[best], at[best], near[best]

        use = _least_copies(rows["id"], cell, codes, rerank)  # by cell
        for lo in range(0, len(use), STEP):
            mine = use[lo : lo + STEP]
            x, own = vectors(mine), cell[mine]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for a, b in zip(cuts, [*cuts[1:], len(mine)], strict=True):
                who = np.flatnonzero(probed[own[a]])
                near = q[who] @ x[a:b].T
                i, j = np.nonzero(near >= bound[who, None] - MARGIN)
                held.append((who[i], mine[a + j], near[i, j]))
                pending += len(i)
                if pending > kept:
                    held, pending = [compact()], 0
        who, at, _ = compact()
        near = np.concatenate([np.empty(0), *((vectors(at[lo : lo + STEP]) * q[who[lo : lo + STEP]]).sum(1) for lo in range(0, len(at), STEP))])  # the same wherever a row is
        best = pa.table([asked["lw_no"].take(who), asked["query_id"].take(who), pa.array(cell[at], pa.int32()), rows["id"].take(at), near], ["lw_no", "query_id", "cell", "id", "near"])
        return _best([best], rerank) if len(best) else best

    return run


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Places, from 0, of sorted keys among equal ones."""
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1])[: len(keys)], at, 0))


def _least_copies(ids: pa.ChunkedArray, cell: np.ndarray, codes: np.ndarray, most: int) -> np.ndarray:
    """Rows by cell; of those of equal cell and codes, which are equally near to all queries, only the `most` of the least ids."""
    place = np.empty(len(cell), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(cell))
    words = np.zeros((len(cell), -(-codes.shape[1] // 8) * 8), np.uint8)
    words[:, : codes.shape[1]] = codes
    words = words.view(np.uint64)
    order = np.lexsort((place, *words.T, cell))
    new = np.append(True, (cell[order][1:] != cell[order][:-1]) | (words[order][1:] != words[order][:-1]).any(1))[: len(cell)]
    return order[_ranks(np.cumsum(new)) < most]


def _best(held: list[pa.Table], rerank: int) -> pa.Table:
    """Each query's `rerank` rows with the largest near, of equal ones those with the least ids."""
    rows = pa.concat_tables(held).combine_chunks()
    rows = rows.take(pc.sort_indices(rows, [("query_id", "ascending"), ("near", "descending"), ("id", "ascending")]))
    query = rows["query_id"].combine_chunks().dictionary_encode("encode")
    query = (query.chunk(0) if isinstance(query, pa.ChunkedArray) else query).indices.to_numpy()
    return rows.filter(pa.array(_ranks(query) < rerank))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)
