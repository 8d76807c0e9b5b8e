"""The engine's front: a knowledge base of tables in a folder, and answers for batches of queries.

    python -m lorewright.engine FOLDER --query "..." [--max-evidence N] [--debug]
"""

from __future__ import annotations

import argparse
import dataclasses
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright import hooks, schemas
from lorewright.functions import text as T
from lorewright.operators import answer, retrieval
from lorewright.sources import tables

NAMES = ("segments", "frames", "chunks", "nodes", "edges", "chunk_vectors", "entity_vectors", "global_nodes", "registry")


@dataclass
class KnowledgeBase:
    """The tables of schemas by name; nodes and edges are the videos' graphs, global_nodes the merged one's."""

    segments: DataFrame
    frames: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chunk_vectors: DataFrame
    entity_vectors: DataFrame
    global_nodes: DataFrame
    registry: DataFrame

    @staticmethod
    def load(spark: SparkSession, folder: str, root: str | None = None) -> KnowledgeBase:
        """Parquet tables of a folder, which must lie in root if it is given."""
        return KnowledgeBase(**{n: spark.read.parquet(tables.guarded(f"{folder}/{n}.parquet", root or folder)) for n in NAMES})

    def save(self, folder: str) -> None:
        for n in NAMES:
            tables.write_table(getattr(self, n), f"{folder}/{n}.parquet")

    def hits(self, queries: DataFrame, settings: schemas.Settings) -> DataFrame:
        """All branches' hits of queries (query_id, query, vector, intent)."""
        return retrieval.retrieve_all(
            retrieval.dense(queries, self.chunk_vectors, self.chunks, settings.chunks_k),
            retrieval.entity_graph(queries, self.entity_vectors, self.nodes, self.edges, self.chunks, settings),
            retrieval.global_graph(queries, self.global_nodes, self.chunks, settings.graph_k),
            retrieval.visual_support(queries, self.frames, self.chunks, settings.frames_k),
        )

    def answer(self, queries: DataFrame, generate=hooks.echo, embed=hooks.hashed_embedding, settings: schemas.Settings | None = None) -> DataFrame:
        """Answers of queries (query_id, query) in one plan; the query is embedded and analysed once."""
        s = settings or schemas.Settings()
        asked = embed(queries, "query").withColumn("intent", T.intent(F.col("query")))
        return answer.answer(asked, self.hits(asked, s), self.segments, self.chunks.select("video_name").distinct(), generate, self.registry, s)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("--query", required=True)
    p.add_argument("--max-evidence", type=int, default=schemas.Settings.final_k)
    p.add_argument("--debug", action="store_true")
    args = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    asked = spark.createDataFrame([("0", args.query)], "query_id string, query string")
    settings = dataclasses.replace(schemas.Settings(), final_k=args.max_evidence)
    found = KnowledgeBase.load(spark, args.folder).answer(asked, settings=settings).first().asDict()
    print(json.dumps(found if args.debug else {k: found[k] for k in ("answer", "confidence")}, ensure_ascii=False))


if __name__ == "__main__":
    main()
