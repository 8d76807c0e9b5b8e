"""Queries of sources' round trips, prompts, hooks and the engine's front."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorewright import engine, hooks, shared
from lorewright.functions import text as T
from lorewright.functions import unicode as U
from lorewright.operators import answer, graph, sanitize
from lorewright.plans.base import asked, extractions, graph_tables, query, table
from lorewright.sources import artefacts, tables


def _place(spark, name: str) -> str:
    return f"{shared.shared_dir(spark)}/lorewright/{name}-{uuid.uuid4().hex}"


def _written_text(df, name: str) -> str:
    path = _place(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return path


@query("src1_json_store", "SELECT source AS video_name, CAST(doc_id AS VARCHAR) AS segment_idx, length(text) AS n FROM documents")
def src1_json_store(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("video_name"), F.col("doc_id").cast("string").alias("segment_idx"), F.lit("0-30").alias("time"), F.col("text").alias("content"), F.lit("").alias("transcript"), F.array(F.lit(1.0)).alias("frame_times"))
    path = _place(spark, "json")
    # One object of one video in each line.
    tables.json_rows(d, "segment_idx").select(F.concat(F.lit('{"'), "video_name", F.lit('":'), "json", F.lit("}")).alias("value")).write.text(path)
    outer = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,map<string,struct<content:string>>>")).alias("video_name", "m"))
    return outer.select("video_name", F.explode("m").alias("segment_idx", "v")).select("video_name", "segment_idx", F.length("v.content").cast("long").alias("n"))


@query("src3_graphml", """SELECT s_name AS src, n_name AS dst, round(abs(s_acctbal) / 1000, 3) AS weight, CAST(1 AS BIGINT) AS "order" FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def src3_graphml(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    path = _place(spark, "graphml")
    tables.write_graphml(nodes.select("id", F.lit("GEO").alias("entity_type"), F.lit("a & <b>").alias("description"), "source_id"), edges.withColumns({"description": F.lit('"d"'), "order": F.lit(1).cast("long")}), path)
    return tables.read_graphml(spark, f"{path}/*")[1].select("src", "dst", "weight", "order")


@query("src5_vectors", "SELECT CAST(vec_id AS VARCHAR) AS id, 64 AS embedding_dim, array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR)), ' ') AS vector FROM embeddings")
def src5_vectors(spark, sf):
    """Every component of every vector, through vector files of each label and task."""
    artefacts.register(spark)
    path = _place(spark, "vectors")
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_name"), F.col("vec_id").cast("string").alias("id"), F.lit("e").alias("entity_name"), F.col("embedding").alias("vector"))
    rows.write.format("lorewright").option("table", "vectors").mode("append").save(path)
    told = F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), " ")
    return tables.read_vectors(spark, f"{path}/v*").select("id", "embedding_dim", told.alias("vector"))


@query("src11_jsonl", "SELECT event_id, event_type FROM events")
def src11_jsonl(spark, sf):
    path = _place(spark, "jsonl")
    tables.append_jsonl(table(spark, sf, "events").select("event_id", "event_type"), path)
    return spark.read.schema("event_id long, event_type string").json(path)


@query("src12_cases", "SELECT CAST(item_id AS VARCHAR) AS question, text AS answer_gold FROM benchmark")
def src12_cases(spark, sf):
    """A list of cases for each partition, a file each."""
    path = _place(spark, "cases")
    rows = table(spark, sf, "benchmark").groupBy(F.spark_partition_id().alias("part")).agg(F.collect_list(F.struct(F.col("item_id").cast("string").alias("question"), F.col("text").alias("answer_gold"))).alias("cases"))
    rows.select("part", F.to_json(F.struct("cases")).alias("value")).write.partitionBy("part").text(path)
    return tables.read_cases(spark, f"{path}/part=*").select("question", "answer_gold")


@query("src13_registry", "SELECT r_name AS video_name, 'http://' || r_regionkey AS url FROM region WHERE r_regionkey <> 0")
def src13_registry(spark, sf):
    entry = F.struct("r_name", F.struct(F.when(F.col("r_regionkey") == 0, " ").otherwise(F.concat(F.lit(" http://"), F.col("r_regionkey").cast("string"))).alias("url")))
    rows = table(spark, sf, "region").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return tables.read_registry(spark, _written_text(rows, "registry"))


@query("src14_leaderboard", "SELECT c_mktsegment AS system, count(*) AS cases FROM customer GROUP BY 1")
def src14_leaderboard(spark, sf):
    path = _place(spark, "csv")
    tables.write_leaderboard(table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("system")).agg(F.count("*").alias("cases")), path)
    return spark.read.schema("system string, cases long").option("header", True).csv(path)


@query("flt4_time_render", "SELECT event_id, format('{:g}', event_id / 4.0) || '-' || format('{:g}', CAST(event_id + 30 AS DOUBLE)) AS time FROM events")
def flt4_time_render(spark, sf):
    return table(spark, sf, "events").select("event_id", T.render_time(F.struct((F.col("event_id") / 4).alias("start"), (F.col("event_id") + 30).cast("double").alias("end"))).alias("time"))


@query("tx3_entity_keys", "SELECT c_custkey, regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^0-9a-z]', '', 'g') AS k FROM customer")
def tx3_entity_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", U.entity_key(F.concat(F.lit('"'), "c_name", F.lit(" &amp; "), "c_mktsegment", F.lit('"'))).alias("k"))


@query("tx2_clean_str", "SELECT page_id, md5(replace(replace(trim(url), '&amp;', '&'), '&quot;', '\"')) AS h FROM pages")
def tx2_clean_str(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(U.clean_str(F.col("url")).cast("binary")).alias("h"))


@query("tx5_names", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PYKE' WHEN 1 THEN 'AHRI' WHEN 2 THEN 'AURELION SOL' ELSE upper(c_name) END AS name FROM customer")
def tx5_names(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, " pike ").when(k % 4 == 1, '"Áhri"').when(k % 4 == 2, "Aurelion Soll").otherwise(F.col("c_name"))
    return U.normalize_names(table(spark, sf, "customer").withColumn("raw", raw), "raw", {"PYKE": ["PIKE"], "AHRI": ["ARI"], "AURELION SOL": ["AURELION"]}).select("c_custkey", "name")


@query("tx6_diacritics", "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents")
def tx6_diacritics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(U.strip_diacritics(F.col("text")).cast("binary")).alias("h"))


@query("tx8_split", "SELECT o_orderkey, [o_orderstatus, o_orderpriority] AS parts FROM orders")
def tx8_split(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.multi_split(F.concat(F.lit("## "), "o_orderstatus", F.lit("<|>"), "o_orderpriority", F.lit(" ##")), ["##", "<|>"]).alias("parts"))


@query("tx14_normalize", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def tx14_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_query(F.col("text")).cast("binary")).alias("h"))


@query("tx17_aliases", "SELECT c_custkey, ['O''Brien', 'Name ' || c_custkey, 'Other' || c_custkey] AS names FROM customer")
def tx17_aliases(spark, sf):
    k = F.col("c_custkey").cast("string")
    about = F.concat(F.lit("x, also known as: Name "), k, F.lit("<SEP>also called O&#39;Brien<SEP>was spelled Other"), k, F.lit("."))
    return table(spark, sf, "customer").select("c_custkey", T.name_candidates(U.unescape(about)).alias("names"))


@query("tx18_types", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey = b.n_regionkey OR a.n_regionkey = 0 OR b.n_regionkey = 0 AS ok FROM nation a JOIN nation b ON b.n_nationkey > a.n_nationkey")
def tx18_types(spark, sf):
    kind = lambda c: F.when(F.col(c) == 0, "UNKNOWN").otherwise(F.col(c).cast("string"))
    n = table(spark, sf, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")).join(n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb")), F.col("b") > F.col("a"))
    return pairs.select("a", "b", T.types_compatible(kind("ra"), kind("rb")).alias("ok"))


@query("tx19_hashes", "SELECT doc_id, 'ent-' || md5(source) AS id FROM documents")
def tx19_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.md5_id(F.col("source"), "ent-").alias("id"))


@query("tx25_prune", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A. C?' ELSE 'A. B! C?' END AS t FROM part")
def tx25_prune(spark, sf):
    bad = F.when(F.col("p_size") % 2 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return table(spark, sf, "part").select("p_partkey", T.prune(F.lit("A. B! C?"), bad).alias("t"))


@query("tx29_payload", "SELECT p_partkey, '(\"entity\"<|>' || p_name || ')' AS t FROM part")
def tx29_payload(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.from_first_marker(F.concat(F.lit('thinking... ("entity"<|>'), "p_name", F.lit(") "))).alias("t"))


@query("tx33_transcripts", "SELECT event_id, printf('[%.2fs -> %.2fs] %s', CAST(event_id AS DOUBLE), event_id + 1.5, event_type) AS t FROM events")
def tx33_transcripts(spark, sf):
    return table(spark, sf, "events").select("event_id", T.transcript_line(F.col("event_id").cast("double"), F.col("event_id") + F.lit(1.5), F.col("event_type")).alias("t"))


@query("tx36_clip", "SELECT doc_id, substring(text, 1, 600) AS t FROM documents")
def tx36_clip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clip(F.col("text"), 600).alias("t"))


@query("tx37_keywords", "SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'und') AS hit FROM documents")
def tx37_keywords(spark, sf):
    from lorewright.operators.evaluate import contains_any

    return table(spark, sf, "documents").select("doc_id", contains_any(F.col("text"), F.array(F.lit("THE"), F.lit("und"))).alias("hit"))


@query("tx39_tools", "SELECT p_partkey, 'find' AS name, p_brand AS argument FROM part")
def tx39_tools(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.tool_call(F.concat(F.lit("please @find("), "p_brand", F.lit(") now"))).alias("c")).select("p_partkey", "c.*")


@query("tx40_roles", "SELECT p_partkey, 'user:' || p_brand || ',assistant:' || p_type AS t FROM part")
def tx40_roles(spark, sf):
    packed = T.pack_roles(F.array("p_brand", "p_type"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(packed, lambda x: F.concat_ws(":", x["role"], x["content"])), ",").alias("t"))


@query("tx41_numbered", "SELECT p_partkey, '1. ' || p_brand || chr(10) || '2. ' || p_type AS t FROM part")
def tx41_numbered(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.numbered(F.array("p_brand", "p_type")).alias("t"))


@query("tx42_prompts", "SELECT p_partkey, 'Game: ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'None' END || ' / ' || p_type AS t FROM part")
def tx42_prompts(spark, sf):
    field = T.context_field("Game", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" "))
    return table(spark, sf, "part").select("p_partkey", T.fill("{field} / {kind}", field=field, kind=F.col("p_type")).alias("t"))


@query("mv12_arrays", "SELECT c_custkey, list_sort(list_distinct([c_mktsegment, c_name, c_mktsegment])) AS a, c_mktsegment || '<SEP>' || c_name AS b FROM customer")
def mv12_arrays(spark, sf):
    a = F.array("c_mktsegment", "c_name", "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", F.array_sort(F.array_distinct(a)).alias("a"), graph.joined(F.array_distinct(a)).alias("b"))


@query("mv15_json", "SELECT c_custkey, '{\"a\":[' || c_custkey || ',1]}' AS j FROM customer")
def mv15_json(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.array(F.col("c_custkey"), F.lit(1).cast("long")).alias("a"))).alias("j"))


@query("mv20_projection")
def mv20_projection(spark, sf):
    """The embeddings' two principal components, for plots."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))


@query("ag17_status", "SELECT event_type AS video_name, CASE WHEN count(*) FILTER (event_id % 2 = 0) < count(*) THEN 'warn' ELSE 'pass' END AS status FROM events GROUP BY 1")
def ag17_status(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("video_name"), "event_id")
    return sanitize.status(sanitize.file_counts({"events": (e, e.where("event_id % 2 = 0"))}))


@query("q9_extraction", "SELECT upper(n_name) AS entity_name, 'GEO' AS entity_type FROM nation")
def q9_extraction(spark, sf):
    """Chunks through the extraction hook with one gleaning pass, parsed and merged."""
    raw = extractions(spark, sf).select("chunk_id", F.col("raw").alias("prompt"))
    found = hooks.glean(raw, "prompt", lambda rows: rows.withColumn("raw", F.regexp_extract("prompt", r'(?s)^(\("entity"[^)]*\))', 1)))
    entities, _ = graph.parse_extractions(found)
    return graph.merge_nodes(entities.withColumn("source_id", F.col("chunk_id"))).select("entity_name", "entity_type")


@query("q12_choices", "SELECT p_partkey AS query_id, CASE WHEN p_size % 3 = 0 THEN 'No Content' ELSE p_brand END AS answer FROM part")
def q12_choices(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") % 3 == 0, "none").otherwise(F.concat(F.lit('so {"Answer":"'), "p_brand", F.lit('","Explanation":"e"}'))).alias("prompt"))
    return answer.multiple_choice(rows, lambda df: df.withColumn("raw", F.col("prompt")), 2).select("query_id", "answer")


@query("q3_engine")
def q3_engine(spark, sf):
    """The whole read path from a knowledge base of the documents: four branches, ranking, evidence, context, answer (Q1 to Q6)."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    video, cid = F.col("source").alias("video_name"), F.concat(F.lit("c"), k.cast("string"))
    chunks = d.select(video, cid.alias("chunk_id"), F.col("text").alias("content"), F.array(F.concat("source", F.lit("_"), k.cast("string"))).alias("video_segment_id"))
    nodes = d.select(video, k.alias("node_ord"), F.concat(F.lit("NODE "), k.cast("string")).alias("id"), F.col("text").alias("description"), cid.alias("source_id"))
    ends = nodes.select("video_name", "node_ord", "id", "source_id")
    edges = ends.join(ends.select("video_name", (F.col("node_ord") + 20).alias("node_ord"), F.col("id").alias("dst")), ["video_name", "node_ord"]).select("video_name", F.col("id").alias("src"), "dst", F.lit(2.0).alias("weight"), "source_id")
    base = engine.KnowledgeBase(
        segments=d.select(video, k.cast("string").alias("segment_idx"), F.lit("0-30").alias("time")), frames=d.select(video, F.concat(k.cast("string"), F.lit("_0")).alias("frame_key"), k.cast("string").alias("segment_idx"), F.col("text").alias("vlm_output"), F.lit("").alias("transcript")),
        chunks=chunks, nodes=nodes, edges=edges, chunk_vectors=hooks.hashed_embedding(chunks.select("video_name", F.col("chunk_id").alias("id"), "content"), "content").drop("content"),
        entity_vectors=hooks.hashed_embedding(nodes.select("video_name", F.col("id"), F.col("id").alias("entity_name"), "description"), "description").drop("description"),
        global_nodes=nodes, registry=spark.createDataFrame([("src0", "http://u")], "video_name string, url string"),
    )
    return base.answer(asked(spark, sf).select("query_id", "query"))
