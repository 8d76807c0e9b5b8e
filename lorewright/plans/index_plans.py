"""Queries of the structures that are built, written and read again: the vector index, stores, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright import hooks
from lorewright.operators import communities, lookup, walks
from lorewright.plans.base import graph_tables, near_queries, query, table
from lorewright.plans.more_plans import _place
from lorewright.sources import artefacts, log
from lorewright.sources.vector_index import VectorIndex
from lorewright.streaming import ingest


@query("src6_index")
def src6_index(spark, sf):
    """Half of the vectors are indexed, the rest inserted, and the index opened again for the stated queries."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    path = _place(spark, "index")
    VectorIndex.build(rows.where("id % 2 = 0"), path)
    VectorIndex.open(spark, path).insert(rows.where("id % 2 = 1"))
    found = VectorIndex.open(spark, path).search(near_queries(spark, sf), 10)
    return found.select("query_id", "rank", "id", "label", F.round("score", 5).alias("score"))


@query("gr9_leiden")
def gr9_leiden(spark, sf):
    """Levels of communities among suppliers, customers, their nations and regions."""
    nodes, edges = graph_tables(spark, sf)
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    people = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"), F.lit(1.0).alias("weight"))
    areas = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.concat(F.lit("in "), "r_name").alias("dst"), F.lit(5.0).alias("weight"))
    far = lambda k, by: (F.col(k) + F.lit(by)).cast("long").alias("node_ord")
    nodes = nodes.select("id", "node_ord").union(c.select("c_name", far("c_custkey", 2_000_000_000_000))).union(r.select(F.concat(F.lit("in "), "r_name"), far("r_regionkey", 3_000_000_000_000)))
    return communities.hierarchy(nodes, edges.select("src", "dst", "weight").union(people).union(areas))


def _area_graph(spark, sf):
    """Customers and suppliers with their nations, as edges."""
    nodes, edges = graph_tables(spark, sf)
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    people = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"), F.lit(1.0).alias("weight"))
    return nodes.select("id").union(c.select("c_name")), edges.select("src", "dst", "weight").union(people)


@query("gr10_node2vec")
def gr10_node2vec(spark, sf):
    """Second-order walks from every node."""
    return walks.walks(*_area_graph(spark, sf), length=5, p=0.5, q=2.0)


@query(
    "gr2_lookups",
    """WITH asked AS (SELECT s_name AS id FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT r_name || ' nowhere' FROM region),
e AS (SELECT s_name AS src, n_name AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey), d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
known AS (SELECT s_name AS id FROM supplier UNION ALL SELECT n_name FROM nation)
SELECT id, id IN (SELECT id FROM known) AS has_node, coalesce(n, 0) AS degree, EXISTS (SELECT 1 FROM e WHERE (src = id AND dst = 'FRANCE') OR (dst = id AND src = 'FRANCE')) AS with_france FROM asked LEFT JOIN d USING (id)""",
)
def gr2_lookups(spark, sf):
    """Which of some names are nodes, their degrees, and which have an edge with one other."""
    nodes, edges = graph_tables(spark, sf)
    stored = lookup.GraphLookup.write(nodes, edges, _place(spark, "lookup"))
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    ids = s.where("s_suppkey % 7 = 0").select(F.col("s_name").alias("id")).union(n.where("n_nationkey % 5 = 0").select("n_name")).union(r.select(F.concat("r_name", F.lit(" nowhere"))))
    pairs = stored.has_edge(ids.select(F.col("id").alias("src"), F.lit("FRANCE").alias("dst")))
    return stored.has_node(ids).join(stored.degrees(ids), "id").join(pairs.select(F.col("src").alias("id"), F.col("has_edge").alias("with_france")), "id")


@query("u5_source", "SELECT source AS video_name, CAST(doc_id AS VARCHAR) AS segment_idx, sha256(text) AS text FROM documents")
def u5_source(spark, sf):
    """Documents as artefact folders, written and read through the data source."""
    artefacts.register(spark)
    path = _place(spark, "artefacts")
    rows = table(spark, sf, "documents").select(F.col("source").alias("video_name"), F.col("doc_id").cast("string").alias("segment_idx"), F.lit("0-30").alias("time"), F.col("text").alias("content"), F.lit("").alias("transcript"))
    rows.write.format("lorewright").option("table", "segments").mode("append").save(path)
    return spark.read.format("lorewright").option("table", "segments").load(path).select("video_name", "segment_idx", F.sha2("content", 256).alias("text"))


@query("s4_once", "SELECT doc_id, lang, length(text) AS n FROM documents")
def s4_once(spark, sf):
    """Documents as a stream in which a third come again; each is committed once."""
    path = _place(spark, "once")
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text")
    rows.write.parquet(f"{path}/in/first")
    stream = lambda: spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
    target = log.LoggedTable(spark, f"{path}/table")
    log.ingest_once(stream(), target, "doc_id", f"{path}/checkpoint").awaitTermination()
    rows.where("doc_id % 3 = 0").write.parquet(f"{path}/in/again")
    log.ingest_once(stream(), target, "doc_id", f"{path}/checkpoint").awaitTermination()
    return target.read().select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query("s5_failures", "SELECT doc_id, CASE WHEN doc_id % 49 = 0 THEN 'failed' ELSE 'done' END AS state, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN doc_id % 49 = 0 THEN NULL ELSE 'answer ' || doc_id END AS raw FROM documents")
def s5_failures(spark, sf):
    """A model that fails on some documents, first on more of them; the failed ones are tried once more."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("prompt"))
    status = log.LoggedTable(spark, _place(spark, "status"))

    def model(bad: int):
        def complete(prompts: list[str]) -> list[str]:
            if any(int(p) % bad == 0 for p in prompts):
                raise ValueError("no answer")
            return [f"answer {p}" for p in prompts]

        return complete

    hooks.run_with_status(rows, "doc_id", "prompt", model(7), status)
    return hooks.outcome(hooks.run_with_status(rows, "doc_id", "prompt", model(49), status), "doc_id").drop("error")


@query(
    "stream_state",
    """WITH e AS (SELECT user_id, date_trunc('millisecond', ts) AS ts, event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-08' AS late FROM events), k AS (SELECT user_id, ts FROM e WHERE NOT late),
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
found AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, start, "end", n FROM found WHERE "end" <= (SELECT max(date_trunc('millisecond', ts)) FROM e) - INTERVAL 1 HOUR
UNION ALL SELECT -1, NULL, NULL, count(*) FROM e WHERE late""",
)
def stream_state(spark, sf):
    """Sessions of events that come week by week, some of the first week's three weeks late; the stream stops and goes on after each. The row of user -1 counts the late ones."""
    path = _place(spark, "state")
    late = (F.col("event_id") % 50 == 0) & (F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    events = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), late.alias("late"), F.least(F.floor(F.date_diff(F.col("ts"), F.lit("2024-01-01").cast("date")) / 8), F.lit(3)).alias("week"))
    target, dropped = log.LoggedTable(spark, f"{path}/out"), 0
    for week in range(5):
        part = events.where(F.col("late")) if week == 4 else events.where(~F.col("late") & (F.col("week") == week))
        part.select("user_id", "ts").write.parquet(f"{path}/in/{week}")
        stream = spark.readStream.schema("user_id long, ts timestamp").option("recursiveFileLookup", True).parquet(f"{path}/in")
        dropped += ingest.late_rows(ingest.run_available(ingest.stateful_sessions(stream), target, f"{path}/checkpoint"))
    rows = target.read().select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
    return rows.union(spark.createDataFrame([(-1, None, None, dropped)], rows.schema))
