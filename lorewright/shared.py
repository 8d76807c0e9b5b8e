"""The shared folder, lineage cuts, size-checked joins and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables were written, to be removed when the interpreter ends.
_written: list[tuple[SparkSession, str]] = []
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Python workers of this session get 8 MB at a time from now on, as texts may be long, unless its setting isn't Spark's default."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lorewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone; the shared folder's owner clears it then
            return


atexit.register(_remove_written)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running stage only, never the stages before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorewright/{name}-{uuid.uuid4().hex}"
    bound_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    for entry in list(_written):
        if entry[0] is spark and any(entry[1].rsplit("/", 1)[-1] in f for f in files[:1]):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry[1])
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            _written.remove(entry)


#: Graphs of up to so many edges (16 MB of ids) are labelled by one task; larger ones by rounds of joins.
ONE_TASK_EDGES = 1_000_000


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and components of the edges in one partition: labels fall along edges and jump to their label's label."""
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not rows:
        return
    lo, hi = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    nodes, at = np.unique(np.concatenate((lo, hi)), return_inverse=True)
    a, b = at[: len(lo)], at[len(lo) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component = smallest node reachable), for every node in edges (a, b).

    Graphs of at most ONE_TASK_EDGES edges, by count, are labelled by one task. Beyond it, large-star / small-star in turn:
    each round every node is relinked to the smallest neighbour seen, so that chains shorten by a constant factor; rows never
    exceed twice the edges and no group is gathered (min is a partial aggregate).
    """
    pairs = edges.select(F.least("a", "b").cast("long").alias("lo"), F.greatest("a", "b").cast("long").alias("hi")).where("lo < hi").distinct()
    pairs = materialize(pairs, "cc")
    if pairs.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        return pairs.coalesce(1).mapInArrow(_label, "node bigint, component bigint")
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (itself included).
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        new = materialize(small, "cc")
        # Stars only, and every node in one star: done.
        moved = new.join(new.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count() + new.groupBy("hi").count().where("count > 1").limit(1).count()
        discard(pairs)
        pairs = new
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


#: Keys up to this number are broadcast (8 MB of longs); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def checked(keys: DataFrame) -> DataFrame:
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return F.broadcast(keys) if few else keys


def checked_lists(rows: DataFrame, column: str, per_row: int = 4) -> DataFrame:
    """rows with a broadcast hint if they number at most BROADCAST_KEYS and their lists hold at most per_row times as many
    elements; else unchanged, for a shuffle join."""
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("elements")).first()
    return F.broadcast(rows) if found["n"] <= BROADCAST_KEYS and found["elements"] <= per_row * BROADCAST_KEYS else rows


def semi_join(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among keys; broadcasts keys only if their counted number is within BROADCAST_KEYS."""
    return rows.join(checked(materialize(keys.select(on).distinct(), "keys")), on, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key isn't among keys; broadcasts keys only if their counted number is within BROADCAST_KEYS."""
    return rows.join(checked(materialize(keys.select(on).distinct(), "keys")), on, "left_anti")
