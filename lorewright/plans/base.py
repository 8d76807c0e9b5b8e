"""What the catalogue's queries share: the driver's tables in the engine's roles, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as segments: a source is a video, its documents in order are the segments."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("video_name"), F.col("doc_id").alias("ord"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("ref"), "text")


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers, synthesized: for each nation an entity, its region, and their relation, with repeats and bad records."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.concat(
        F.lit('("entity"<|>'), "n_name", F.lit('<|>geo<|>Nation of '), "r_name", F.lit(')##("entity"<|>'), F.lower("r_name"), F.when(F.col("n_nationkey") % 2 == 0, "<|>organization").otherwise("<|>place"),
        F.lit("<|>Region (large) of "), "n_name", F.lit(')##("entity"<|>'), "n_name", F.lit('<|>person<|>again)##("relationship"<|>'), "n_name", F.lit("<|>"), "r_name", F.lit("<|>lies in<|>"), F.col("n_nationkey").cast("string"),
        F.lit(')##("relationship"<|>'), "r_name", F.lit("<|>"), "n_name", F.lit('<|>holds<|>3)##("relationship"<|>'), "n_name", F.lit("<|>NOWHERE<|>x<|>2)##note<|COMPLETE|>"),
    )
    return rows.select(F.concat(F.lit("chunk-"), F.col("n_nationkey").cast("string")).alias("chunk_id"), F.col("n_nationkey").cast("long").alias("chunk_ord"), raw.alias("raw"))


#: What parsing extractions() gives, in SQL: entities (chunk_ord, entity_name, entity_type, description) and relations.
PARSED_SQL = """
entities AS (
    SELECT n_nationkey AS chunk_ord, upper(n_name) AS entity_name, 'GEO' AS entity_type, 'Nation of ' || r_name AS description, 0 AS ord FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_nationkey, upper(r_name), CASE WHEN n_nationkey % 2 = 0 THEN 'ORGANIZATION' ELSE 'UNKNOWN' END, 'Region (large) of ' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
), relations AS (
    SELECT n_nationkey AS chunk_ord, upper(n_name) AS src, upper(r_name) AS dst, greatest(1.0, least(10.0, CAST(n_nationkey AS DOUBLE))) AS weight, 'lies in' AS description FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and nations as a graph: nodes (id, node_ord, source_id) and edges (src, dst, weight, source_id)."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    chunk = F.concat(F.lit("c"), (F.col("s_suppkey") % 37).cast("string"))
    other = F.concat(F.lit("c"), (F.col("s_suppkey") % 11).cast("string"))
    suppliers = s.select(F.col("s_name").alias("id"), F.col("s_suppkey").alias("node_ord"), F.concat(chunk, F.lit("<SEP>"), other).alias("source_id"))
    nations = n.select(F.col("n_name").alias("id"), (F.col("n_nationkey") + F.lit(1_000_000_000)).cast("long").alias("node_ord"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("source_id"))
    weight = F.round(F.abs("s_acctbal") / 1000 * 1000) / 1000  # three places as DuckDB rounds: the product, not the decimal form
    edges = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"), weight.alias("weight"), chunk.alias("source_id"))
    return suppliers.unionByName(nations), edges


GRAPH_SQL = """
nodes AS (
    SELECT s_name AS id, s_suppkey AS node_ord, ['c' || (s_suppkey % 37), 'c' || (s_suppkey % 11)] AS ids FROM supplier
    UNION ALL SELECT n_name, n_nationkey + 1000000000, ['c' || n_nationkey] FROM nation
), edges AS (
    SELECT s_name AS src, n_name AS dst, round(abs(s_acctbal) / 1000, 3) AS weight, 'c' || (s_suppkey % 37) AS source_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
), ends AS (SELECT src AS node, dst AS neighbour, weight, source_id FROM edges UNION ALL SELECT dst, src, weight, source_id FROM edges)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: benchmark items whose id is divisible by 100, with their intent."""
    b = table(spark, sf_dir, "benchmark").where(F.col("item_id") % 100 == 0)
    return b.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), T.intent(F.col("text")).alias("intent"))


def near_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


#: DuckDB's spelling of text.tokens().
def sql_tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-zA-Z][a-zA-Z0-9_''-]+'))"
