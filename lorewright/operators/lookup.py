"""Point lookups in a stored graph: adjacency by buckets of nodes, with Bloom filters for the nodes in each file (GR2).

A lookup reads the buckets of the nodes asked for, by a filter on the partition column, and in them the row groups whose
Bloom filters or ranges may hold these nodes. Rows of a bucket are sorted by node; a hub's bucket is in several files.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright import shared
from lorewright.operators import graph

#: Rows of a bucket.
ROWS = 1_000_000


@dataclass
class GraphLookup:
    """nodes: id and attributes; edges: node, neighbour and attributes, from either end."""

    spark: SparkSession
    path: str
    buckets: int

    @staticmethod
    def write(nodes: DataFrame, edges: DataFrame, path: str, buckets: int | None = None) -> GraphLookup:
        both = shared.materialize(graph.both_ways(edges), "both-ways")
        buckets = buckets or max(16, math.ceil(both.count() / ROWS))
        for name, rows, key in (("nodes", nodes, "id"), ("edges", both, "node")):
            rows = rows.withColumn("bucket", _bucket(F.col(key), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
            rows.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/{name}-{buckets}")
        return GraphLookup(nodes.sparkSession, path, buckets)

    def _stored(self, name: str, key: str, asked: DataFrame) -> DataFrame:
        """Rows of the nodes asked for (id, a stated batch)."""
        wanted = shared.materialize(asked.select("id").distinct(), "asked")
        buckets = [r[0] for r in wanted.select(_bucket(F.col("id"), self.buckets)).distinct().collect()]  # at most all buckets
        rows = self.spark.read.parquet(f"{self.path}/{name}-{self.buckets}").where(F.col("bucket").isin(buckets)).drop("bucket")
        few = [r["id"] for r in wanted.limit(BLOOM + 1).collect()]
        if len(few) <= BLOOM:  # as a filter, which the scan holds against the Bloom filters
            rows = rows.where(F.col(key).isin(few))
        return rows.join(shared.checked(wanted.withColumnRenamed("id", key)), key, "left_semi")

    def nodes(self, asked: DataFrame) -> DataFrame:
        return self._stored("nodes", "id", asked)

    def node_edges(self, asked: DataFrame) -> DataFrame:
        """node, neighbour and the attributes of all edges at the nodes asked for."""
        return self._stored("edges", "node", asked)

    def has_node(self, asked: DataFrame) -> DataFrame:
        """id and has_node of each node asked for."""
        found = self.nodes(asked).select("id", F.lit(True).alias("has_node")).distinct()
        return asked.select("id").join(found, "id", "left").select("id", F.coalesce("has_node", F.lit(False)).alias("has_node"))

    def degrees(self, asked: DataFrame) -> DataFrame:
        """id and degree of each node asked for; a loop counts twice, and a node that isn't there has 0."""
        ends = F.sum(F.when(F.col("node") == F.col("neighbour"), 2).otherwise(1))
        found = self.node_edges(asked).groupBy(F.col("node").alias("id")).agg(ends.alias("degree"))
        return asked.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def has_edge(self, asked: DataFrame) -> DataFrame:
        """src, dst and has_edge of each pair asked for, whichever way the edge was written."""
        edges = self.node_edges(asked.select(F.col("src").alias("id"))).select(F.col("node").alias("src"), F.col("neighbour").alias("dst"), F.lit(True).alias("has_edge")).distinct()
        return asked.select("src", "dst").join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("has_edge", F.lit(False)).alias("has_edge"))


#: Nodes asked for up to this number stand in the scan's filter.
BLOOM = 1_000


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")
