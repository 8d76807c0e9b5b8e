"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents, n_chars being that of the text as it then is. Between stages the rows are written as Parquet and read again.

In every stage: null and empty texts, and texts without letters, go with language ID; rows with a null id are never copies
of others and are packed like the rest; rows that repeat an id are treated as their stage's operator states; very long texts
are handled whole; of equal documents, lines and passages the earliest stays; other columns are carried along untouched,
whatever their names, up to packing; no documents give no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm import op02_lines, op03_packing, op04_langid, op06_minhash, op10_substrings
from lorewright.llm.common import anti_join, materialize

TOKENIZER = "word_bpe_49k.json"


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's centroids are near, or without text or letters, go."""
    model = op04_langid.fit(docs)
    return op04_langid.flag(docs, model).where(~F.col("lw_rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is like go, and documents of which none is left."""
    cut = op02_lines.dedup_lines(docs)
    return _sized(cut.where((F.col("lw_removed") == 0) | (F.col("lw_removed") < F.col("lw_lines"))), docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    found = op06_minhash.near_duplicates(docs)
    return anti_join(docs, found.where(~F.col("kept")).select(F.col("id").alias("doc_id")), "doc_id").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that start earlier elsewhere are cut; documents of which nothing is left go."""
    cut = op10_substrings.cut(docs)
    return _sized(cut.where((F.col("lw_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 4096."""
    pieces = op03_packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Near-duplicate groups and tokens aren't SQL's; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
