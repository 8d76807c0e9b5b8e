"""Queries of the read path: vectors, branches, ranking, context, confidence, evaluation, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright import hooks
from lorewright.functions import text as T
from lorewright.functions import vectors as V
from lorewright.operators import answer, chunking, evaluate, graph, retrieval
from lorewright.plans.base import GRAPH_SQL, asked, graph_tables, near_queries, query, sql_tokens, table
from lorewright.schemas import Settings
from lorewright.sources import tables
from lorewright.streaming import ingest

NEAR_SQL = """q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT query_id, label AS video_name, vec_id AS id, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS score FROM embeddings, q)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").alias("video_name"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("tk1_dense_topk", f"WITH {NEAR_SQL} SELECT query_id, video_name, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_name ORDER BY score DESC, id) AS rank FROM near) WHERE rank <= 30")
def tk1_dense_topk(spark, sf):
    return retrieval.nearest(near_queries(spark, sf), _vectors(spark, sf), 30).select("query_id", "video_name", "id", F.round("score", 6).alias("score"), "rank")


@query("flt16_threshold", f"WITH {NEAR_SQL} SELECT query_id, video_name, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_name ORDER BY score DESC, id) AS rank FROM near WHERE score > 0.2) WHERE rank <= 20")
def flt16_threshold(spark, sf):
    return retrieval.nearest(near_queries(spark, sf), _vectors(spark, sf), 20, 0.2).select("query_id", "video_name", "id")


@query(
    "tk12_routing",
    """WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2), c AS (SELECT label AS video_name, list(x ORDER BY i) AS v FROM m GROUP BY 1),
s AS (SELECT query_id, video_name, list_cosine_similarity(qv, v) AS score FROM q, c) SELECT query_id, video_name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_name) AS r FROM s WHERE score > 0.1) WHERE r <= 3""",
)
def tk12_routing(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = rows.groupBy(F.col("label").alias("video_name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    return retrieval.route_videos(near_queries(spark, sf), means, 0.1).select("query_id", "video_name", F.round("score", 6).alias("score"))


@query(
    "mv1_cosine",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def mv1_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("mv2_boost", "SELECT s_suppkey, round(least(1.0, 0.5 + ln(1 + greatest(0.0, CASE WHEN s_suppkey % 5 = 0 THEN 1.0 ELSE s_acctbal END)) * 0.05), 6) AS boost FROM supplier")
def mv2_boost(spark, sf):
    w = F.when(F.col("s_suppkey") % 10 == 0, F.lit(None).cast("double")).when(F.col("s_suppkey") % 5 == 0, 0.0).otherwise(F.col("s_acctbal"))
    return table(spark, sf, "supplier").select("s_suppkey", F.round(V.neighbour_boost(F.lit(0.5), w), 6).alias("boost"))


@query(
    "mv6_max_sim",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, [v[1:16], v[17:32]] AS q, [v[33:48], v[49:64]] AS d FROM e)
SELECT vec_id, round((greatest(list_dot_product(q[1], d[1]), list_dot_product(q[1], d[2])) + greatest(list_dot_product(q[2], d[1]), list_dot_product(q[2], d[2]))) / 2, 6) AS score FROM p""",
)
def mv6_max_sim(spark, sf):
    part = lambda k: F.slice("embedding", k, 16)
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.max_sim(F.array(part(1), part(17)), F.array(part(33), part(49))), 6).alias("score"))


@query(
    "tk15_late_interaction",
    f"""WITH {NEAR_SQL}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM near) WHERE r <= 30),
s AS (SELECT c.query_id, c.id, list_dot_product(q.qv[1:32], CAST(e.embedding AS DOUBLE[])[1:32]) AS a, list_dot_product(q.qv[33:64], CAST(e.embedding AS DOUBLE[])[33:64]) AS b, list_dot_product(q.qv[1:32], CAST(e.embedding AS DOUBLE[])[33:64]) AS x, list_dot_product(q.qv[33:64], CAST(e.embedding AS DOUBLE[])[1:32]) AS y FROM c JOIN q USING (query_id) JOIN embeddings e ON e.vec_id = c.id)
SELECT query_id, arg_max(id, (greatest(a, x) + greatest(b, y)) / 2) AS id FROM s GROUP BY query_id""",
)
def tk15_late_interaction(spark, sf):
    q = near_queries(spark, sf)
    rows = retrieval.nearest(q, _vectors(spark, sf).withColumn("video_name", F.lit(0)), 30).join(_vectors(spark, sf).select("id", "vector"), "id").join(q.withColumnRenamed("vector", "qv"), "query_id")
    half = lambda c: F.array(F.slice(c, 1, 32), F.slice(c, 33, 32))
    return rows.withColumn("s", V.max_sim(half("qv"), half("vector"))).groupBy("query_id").agg(F.max_by("id", "s").alias("id"))


@query("mv5_bands", "SELECT event_id, CASE WHEN value / 100 >= 0.75 THEN 'high' WHEN value / 100 >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM events")
def mv5_bands(spark, sf):
    return table(spark, sf, "events").select("event_id", V.band(F.col("value") / 100).alias("band"))


@query("mv9_histograms", "SELECT vec_id, round(sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(a, b), lambda p: sqrt(p[1] * p[2]))) / sqrt(list_sum(a) * list_sum(b)))), 6) AS d FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:32], lambda x: abs(x)) AS a, list_transform(CAST(embedding AS DOUBLE[])[33:64], lambda x: abs(x)) AS b FROM embeddings)")
def mv9_histograms(spark, sf):
    h = lambda k: F.transform(F.slice("embedding", k, 32), lambda x: F.abs(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.bhattacharyya(h(1), h(33)), 6).alias("d"))


@query(
    "mv7_select",
    """WITH t AS (SELECT vec_id, i, CAST(embedding AS DOUBLE[])[16 * i + 1:16 * i + 16] AS v FROM embeddings, range(4) AS r(i)), e AS (SELECT vec_id, i, k, v[k] AS x FROM t, range(1, 17) AS r(k)),
m AS (SELECT vec_id, k, avg(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT e.vec_id, e.i, sum(e.x * m.x) / sqrt(sum(e.x * e.x)) / sqrt(sum(m.x * m.x)) AS cos FROM e JOIN m USING (vec_id, k) GROUP BY 1, 2),
o AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, i) AS r FROM c)
SELECT vec_id, (SELECT string_agg(CAST(CAST(round(v[1] * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY r) FROM o JOIN t USING (vec_id, i) WHERE o.vec_id = b.vec_id AND r <= 2) AS kept,
  (SELECT string_agg(CAST(i AS VARCHAR), ' ' ORDER BY i) FROM t WHERE t.vec_id = b.vec_id AND len(list_filter(v, lambda x: x > 0)) >= 16 * 0.05) AS patches FROM embeddings b""",
)
def mv7_select(spark, sf):
    part = lambda k: F.slice("embedding", k, 16)
    tokens = F.array(part(1), part(17), part(33), part(49))
    kept = F.array_join(F.transform(V.token_select(tokens), lambda t: F.round(F.get(t, F.lit(0)).cast("double") * 10000).cast("long").cast("string")), " ")
    patches = F.array_join(F.transform(V.padding_select(tokens), lambda i: i.cast("string")), " ")
    return table(spark, sf, "embeddings").select("vec_id", kept.alias("kept"), patches.alias("patches"))


@query("mv10_mse", "SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[])[1:32], CAST(embedding AS DOUBLE[])[33:64]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 32, 6) AS mse FROM embeddings")
def mv10_mse(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.mean_squared_error(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 6).alias("mse"))


@query(
    "mv11_letterbox",
    """WITH p AS (SELECT vec_id, k, (k // 224) * 16 // 224 AS y, (k % 224) * 16 // 224 AS x, CAST(embedding AS DOUBLE[]) AS v FROM embeddings, range(50176) AS r(k)),
q AS (SELECT vec_id, k, CASE WHEN y BETWEEN 6 AND 9 THEN v[(y - 6) * 16 + x + 1] ELSE 0.0 END AS g FROM p) SELECT vec_id, count(*) AS pixels, round(sum(g), 4) AS total, round(sum(g * (k % 97)), 3) AS places FROM q GROUP BY 1""",
)
def mv11_letterbox(spark, sf):
    """Every pixel goes into two sums, one of them by its place."""
    boxed = table(spark, sf, "embeddings").select("vec_id", V.letterbox(F.col("embedding").cast("array<double>"), F.lit(16), F.lit(4)).alias("g"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return boxed.select("vec_id", F.size("g").cast("long").alias("pixels"), F.round(add("g"), 4).alias("total"), F.round(add(F.transform("g", lambda x, k: x * (k % 97))), 3).alias("places"))


@query("mv19_image_rerank", "SELECT vec_id, round(0.8 * embedding[1] - 0.2 * embedding[2] + CASE WHEN label = 0 THEN 0.2 ELSE 0.0 END, 5) AS s FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def mv19_image_rerank(spark, sf):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.image_rerank(at(0), at(1), F.col("label") == 0), 5).alias("s"))


@query("flt17_aspect", "SELECT p_partkey FROM part WHERE p_size * 1.0 / 25 BETWEEN 0.7 AND 1.4")
def flt17_aspect(spark, sf):
    return table(spark, sf, "part").where(V.aspect_ok(F.col("p_size") * 1.0, F.lit(25))).select("p_partkey")


@query(
    "tx13_lexical_topk",
    f"""WITH q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {sql_tokens("text")} AS q FROM benchmark WHERE item_id % 100 = 0), d AS (SELECT doc_id, lower(source) AS name, {sql_tokens("lower(source) || ' ' || lower(text)")} AS w FROM documents),
s AS (SELECT query_id, doc_id, len(list_intersect(q, w)) / len(list_distinct(list_concat(q, w))) + CASE WHEN len(list_filter(q, lambda t: contains(name, t))) > 0 THEN 0.15 ELSE 0 END AS score FROM q, d WHERE len(q) > 0 AND len(w) > 0)
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 30""",
)
def tx13_lexical_topk(spark, sf):
    q = asked(spark, sf).select("query_id", T.tokens(F.col("query")).alias("q"))
    rows = retrieval.lexical_scores(q, table(spark, sf, "documents"), ["doc_id"], "source", "text")
    return retrieval.top_k(rows, ["query_id"], "score", ["doc_id"], 30).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _store(spark, sf):
    """Chunks, nodes, segments, frames of the documents: each document is a chunk of its source."""
    d = table(spark, sf, "documents")
    video, k = F.col("source").alias("video_name"), F.col("doc_id")
    chunk_id = F.concat(F.lit("c"), k.cast("string"))
    ref = F.concat("source", F.lit("_"), k.cast("string"))
    chunks = d.select(video, chunk_id.alias("chunk_id"), F.col("text").alias("content"), F.array(ref).alias("video_segment_id"))
    nodes = d.select(k.alias("node_ord"), F.concat(F.lit("node "), k.cast("string")).alias("id"), F.col("text").alias("description"), chunk_id.alias("source_id"))
    segs = d.select(video, k.cast("string").alias("segment_idx"), F.concat((k % 100).cast("string"), F.lit("-"), (k % 100 + 30).cast("string")).alias("time"))
    frames = d.select(video, F.concat(k.cast("string"), F.lit("_0")).alias("frame_key"), k.cast("string").alias("segment_idx"), F.col("text").alias("vlm_output"), F.lit("").alias("transcript"))
    return chunks, nodes, segs, frames


LEX_SQL = f"""q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text, {sql_tokens("text")} AS q FROM benchmark WHERE item_id % 100 = 0),
lex AS (SELECT query_id, q, doc_id, source AS video_name, d.text AS chunk_text, {sql_tokens("'node ' || doc_id || ' ' || lower(d.text)")} AS w, {sql_tokens("d.text")} AS cw, 'node ' || doc_id AS name FROM documents d, q),
gs AS (SELECT *, len(list_intersect(q, w)) / len(list_distinct(list_concat(q, w))) + CASE WHEN len(list_filter(q, lambda t: contains(name, t))) > 0 THEN 0.15 ELSE 0 END AS g, len(list_intersect(q, cw)) / len(q) AS o FROM lex),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, doc_id) AS r FROM gs WHERE g > 0), gtop AS (SELECT * FROM gr WHERE r <= 30)"""


@query("gr7_global", f"WITH {LEX_SQL} SELECT query_id, 'c' || doc_id AS chunk_id, round(g, 6) AS score FROM gtop")
def gr7_global(spark, sf):
    chunks, nodes, _, _ = _store(spark, sf)
    return retrieval.global_graph(asked(spark, sf), nodes, chunks).select("query_id", "chunk_id", F.round("score_graph", 6).alias("score"))


@query("q2_visual", f"WITH {LEX_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_name ORDER BY o DESC, doc_id || '_0') AS vr FROM gs WHERE o > 0) SELECT query_id, 'c' || doc_id AS chunk_id, round(o, 6) AS score FROM v WHERE vr <= 6")
def q2_visual(spark, sf):
    chunks, _, _, frames = _store(spark, sf)
    q = asked(spark, sf).withColumn("intent", F.struct(F.lit(True).alias("is_visual_detail")))
    return retrieval.visual_support(q, frames, chunks).select("query_id", "chunk_id", F.round("score_entity", 6).alias("score"))


RERANK_SQL = f"""{LEX_SQL}, scored AS (SELECT query_id, video_name, doc_id, r, o, g, chunk_text, q FROM gtop),
terms AS (SELECT query_id, list(DISTINCT t) AS ts FROM (SELECT query_id, unnest(q) AS t FROM q) GROUP BY 1)"""


def _hits(spark, sf):
    chunks, nodes, segs, frames = _store(spark, sf)
    q = asked(spark, sf)
    visual = q.withColumn("intent", F.struct(F.lit(True).alias("is_visual_detail")))
    return q, retrieval.retrieve_all(retrieval.global_graph(q, nodes, chunks), retrieval.visual_support(visual, frames, chunks)), segs


@query(
    "ag10_dedupe",
    f"""WITH {LEX_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_name ORDER BY o DESC, doc_id || '_0') AS vr FROM gs WHERE o > 0),
h AS (SELECT query_id, doc_id, 'global_graph' AS source, g, 0.0 AS e FROM gtop UNION ALL SELECT query_id, doc_id, 'visual_support', 0.0, o FROM v WHERE vr <= 6)
SELECT query_id, 'c' || doc_id AS chunk_id, string_agg(source, '|' ORDER BY source) AS source, round(max(g), 6) AS score_graph, round(max(e), 6) AS score_entity FROM h GROUP BY 1, 2""",
)
def ag10_dedupe(spark, sf):
    return answer.dedupe_hits(_hits(spark, sf)[1]).select("query_id", "chunk_id", "source", F.round("score_graph", 6).alias("score_graph"), F.round("score_entity", 6).alias("score_entity"))


@query("ag11_sources", f"WITH {LEX_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_name ORDER BY o DESC, doc_id || '_0') AS vr FROM gs WHERE o > 0) SELECT query_id, 'global_graph' AS source, count(*) AS n FROM gtop GROUP BY 1 UNION ALL SELECT query_id, 'visual_support', count(*) FROM v WHERE vr <= 6 GROUP BY 1")
def ag11_sources(spark, sf):
    return answer.source_counts(_hits(spark, sf)[1])


SCORES_SQL = """h AS (SELECT doc_id, source AS video_name, (doc_id * 7 % 101) / 100.0 AS sem, (doc_id * 13 % 97) / 96.0 AS ent, (doc_id * 29 % 89) / 88.0 AS gra FROM documents),
f AS (SELECT *, 0.5 * sem + 0.2 * ent + 0.2 * gra + 0.1 AS score FROM h)"""


def _scored(spark, sf):
    k = F.col("doc_id")
    h = table(spark, sf, "documents").select(F.lit("q").alias("query_id"), F.lit(0).alias("branch_ord"), k.alias("arrival"), F.col("source").alias("video_name"), k.cast("string").alias("chunk_id"), "doc_id", (k * 7 % 101 / 100.0).alias("sem"), (k * 13 % 97 / 96.0).alias("ent"), (k * 29 % 89 / 88.0).alias("gra"))
    return h.withColumn("final_score", V.weighted(F.col("sem"), F.col("ent"), F.col("gra")))


@query("mv4_weighted", f"WITH {SCORES_SQL} SELECT doc_id, round(score, 6) AS score FROM f")
def mv4_weighted(spark, sf):
    return _scored(spark, sf).select("doc_id", F.round("final_score", 6).alias("score"))


@query("wn5_diversity", f"WITH {SCORES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY round(score, 9) DESC, doc_id) AS r FROM f) SELECT doc_id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM v WHERE r <= 3 ORDER BY round(score, 9) DESC, doc_id LIMIT 14")
def wn5_diversity(spark, sf):
    return answer.diversify(_scored(spark, sf).withColumn("final_score", F.round("final_score", 9)), F.lit(3)).select("doc_id", "rank")


@query(
    "mv3_components",
    f"""WITH t AS (SELECT conv_id, turn, {sql_tokens("text")} AS w, lower(text) AS l, contains(role, 'user') AS u FROM conversations), s AS (SELECT *, len(list_intersect(['de', 'les', 'ing'], w)) / 3 AS o, len(list_filter(['de', 'les'], lambda x: contains(l, x))) / 2 AS b FROM t)
SELECT conv_id, turn, round(greatest(0.1, 0.65 * o + 0.35 * b), 6) AS e, round(CASE WHEN u THEN least(1.0, 0.25 + 0.75 * o) ELSE 0.2 * o END, 6) AS g, round(o, 6) AS s FROM s""",
)
def mv3_components(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.lit("de les ing").alias("query"), F.array(F.lit("de"), F.lit("LES")).alias("terms"), F.col("text").alias("chunk_text"), F.when(F.col("role") == "user", "global_graph").otherwise("dense_chunk").alias("source"), F.lit(0.1).alias("score_entity"), F.lit(0.0).alias("score_graph"), F.lit(0.0).alias("score_semantic"))
    return answer.component_scores(rows).select("conv_id", "turn", F.round("score_entity", 6).alias("e"), F.round("score_graph", 6).alias("g"), F.round("score_semantic", 6).alias("s"))


@query(
    "jn7_spans",
    """SELECT source AS video_name, (min(doc_id % 100) // 60) || ':' || lpad(CAST(min(doc_id % 100) % 60 AS VARCHAR), 2, '0') || '-' || (max(doc_id % 100 + 30) // 60) || ':' || lpad(CAST(max(doc_id % 100 + 30) % 60 AS VARCHAR), 2, '0') AS time_span FROM documents GROUP BY source""",
)
def jn7_spans(spark, sf):
    _, _, segs, _ = _store(spark, sf)
    refs = segs.groupBy("video_name").agg(F.collect_list(F.concat("video_name", F.lit("_"), "segment_idx")).alias("segment_ids"))
    return answer.time_spans(refs, segs)


def _blocks(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("query_id"), F.col("turn").alias("at"), F.col("role").alias("video_name"), F.lit("0:00-0:30").alias("time_span"), F.col("turn").cast("string").alias("chunk_id"), F.when(F.col("turn") % 2 == 0, "dense_chunk|global_graph").otherwise("visual_support").alias("source"), "text", (F.col("turn") % 10 / 10.0).alias("final_score"))


@query("tx22_context", "SELECT CAST(conv_id AS VARCHAR) AS query_id, md5(string_agg('[video=' || role || ' | time=0:00-0:30 | chunk=' || turn || ' | source=' || CASE WHEN turn % 2 = 0 THEN 'dense_chunk|global_graph' ELSE 'visual_support' END || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS context FROM conversations GROUP BY 1")
def tx22_context(spark, sf):
    return answer.context(_blocks(spark, sf)).select("query_id", F.md5(F.col("context").cast("binary")).alias("context"))


@query(
    "ag13_confidence",
    """WITH b AS (SELECT conv_id, count(*) AS n, avg(turn % 10 / 10.0) AS s, count(DISTINCT turn % 2) AS k, lower(string_agg(text, ' ' ORDER BY turn) FILTER (turn < 3)) AS top FROM conversations GROUP BY 1),
c AS (SELECT conv_id, 0.5 * s + 0.35 * 0.6 + 0.15 * least(1.0, k / 3.0) - CASE WHEN n < 2 THEN 0.15 ELSE 0 END - CASE WHEN conv_id % 2 = 0 THEN 0.25 ELSE 0 END - CASE WHEN contains(top, 'de') OR contains(top, 'the') THEN 0 ELSE 0.1 END AS v FROM b)
SELECT CAST(conv_id AS VARCHAR) AS query_id, round(greatest(0.0, least(1.0, v)), 6) AS confidence FROM c""",
)
def ag13_confidence(spark, sf):
    q = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("query_id"), F.lit("The DE").alias("query")).distinct()
    verified = q.select("query_id", F.lit(0.6).alias("supported_ratio"), F.when(F.col("query_id").cast("long") % 2 == 0, 0.5).otherwise(0.1).alias("unsupported_ratio"))
    return answer.confidence(q, _blocks(spark, sf), verified).select("query_id", F.round("confidence", 6).alias("confidence"))


@query(
    "ag14_verification",
    """SELECT CAST(p_partkey AS VARCHAR) AS query_id, CAST(3 AS INT) AS claims_total, round(CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END / 3, 6) AS supported, round(CASE p_size % 3 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END / 3, 6) AS unsupported,
CASE p_size % 3 WHEN 2 THEN 'Evidence is partially conflicting or insufficient for parts of this answer. One. Two! Three?' WHEN 1 THEN 'One. Three?' ELSE 'One. Two! Three?' END AS answer FROM part""",
)
def ag14_verification(spark, sf):
    s = F.col("p_size") % 3
    raw = F.when(s == 0, 'x {"claims":[{"label":" Supported"}],"summary":"s"} y').when(s == 1, '{"claims":[{"label":"supported"},{"label":"unsupported"}]}').otherwise('{"claims":[{"label":"unsupported"},{"label":"unsupported"}]}')
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("query_id"), F.lit("One. Two! Three?").alias("answer"), raw.alias("raw"))
    return answer.verification(rows).select("query_id", "claims_total", F.round("supported_ratio", 6).alias("supported"), F.round("unsupported_ratio", 6).alias("unsupported"), "answer")


@query("flt15_gate", "SELECT CAST(conv_id AS VARCHAR) AS query_id, max(turn % 10 / 10.0) >= 0.18 AS enough FROM conversations GROUP BY 1")
def flt15_gate(spark, sf):
    b = _blocks(spark, sf)
    return answer.answerable(b.select("query_id").distinct(), b).select("query_id", "enough")


@query("tx35_caution", "SELECT event_id, value / 100 < 0.45 OR user_id % 100 / 100.0 < 0.45 AS cautioned FROM events")
def tx35_caution(spark, sf):
    return table(spark, sf, "events").select("event_id", (answer.cautioned(F.lit("x"), F.col("value") / 100, F.col("user_id") % 100 / 100.0) != "x").alias("cautioned"))


@query("tx23_urls", "SELECT c_custkey, 'see big (http://a) AUTO (http://b) and c' || c_custkey AS t FROM customer")
def tx23_urls(spark, sf):
    names = F.array(F.struct(F.lit("big").alias("name"), F.lit("http://a").alias("url")), F.struct(F.lit("big_AUTO").alias("name"), F.lit("http://b").alias("url")))
    return table(spark, sf, "customer").select("c_custkey", T.inject_urls(F.concat(F.lit("see big_AUTO and c"), F.col("c_custkey").cast("string")), names).alias("t"))


@query("tx38_focus", "SELECT c_custkey, c_custkey % 3 = 1 AS single FROM customer")
def tx38_focus(spark, sf):
    q = F.when(F.col("c_custkey") % 3 == 0, "about nothing").when(F.col("c_custkey") % 3 == 1, "about My Video please").otherwise("my video and other one")
    return table(spark, sf, "customer").select("c_custkey", T.single_focus(q, F.array(F.lit("My_Video"), F.lit("Other_One"))).alias("single"))


@query("tx46_snippets", "SELECT conv_id AS query_id, turn AS ord, md5(CASE WHEN lag(turn // 2) OVER w = turn // 2 THEN '(Continued from previous source video)' || chr(10) || b || chr(10) ELSE 'Source Video: ' || (turn // 2) || chr(10) || 'Content:' || chr(10) || b || chr(10) END) AS part FROM (SELECT *, CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || '... (truncated)' ELSE text END AS b FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def tx46_snippets(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), F.floor(F.col("turn") / 2).cast("string").alias("video_name"), F.col("text").alias("content"))
    return retrieval.snippet_context(rows).select("query_id", "ord", F.md5(F.col("part").cast("binary")).alias("part"))


@query(
    "jn3_graph_retrieval",
    f"""WITH {GRAPH_SQL}, st AS (SELECT id, ids, round(node_ord % 10 / 10.0, 3) AS base FROM nodes WHERE id LIKE 'Supplier%'),
s AS (SELECT unnest(ids) AS c, base AS score FROM st UNION ALL SELECT unnest(n.ids), least(1.0, base + ln(1 + CASE WHEN weight = 0 THEN 1 ELSE weight END) * 0.05) FROM st JOIN ends ON node = st.id JOIN nodes n ON n.id = neighbour UNION ALL SELECT source_id, least(1.0, base + ln(1 + CASE WHEN weight = 0 THEN 1 ELSE weight END) * 0.05) FROM st JOIN ends ON node = st.id)
SELECT c AS chunk_id, round(max(score), 6) AS score FROM s GROUP BY 1""",
)
def jn3_graph_retrieval(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    starts = nodes.where(F.col("id").startswith("Supplier")).withColumn("base", F.round(F.col("node_ord") % 10 / 10.0, 3))
    near = starts.select("id", "base").join(graph.both_ways(edges).withColumnRenamed("node", "id"), "id").withColumn("score", V.neighbour_boost(F.col("base"), F.col("weight")))
    near = near.join(nodes.select(F.col("id").alias("neighbour"), F.col("source_id").alias("ids")), "neighbour")
    rows = starts.select(F.col("source_id").alias("ids"), F.col("base").alias("score")).union(near.select("ids", "score")).union(near.select("source_id", "score"))
    return rows.select(F.explode(T.split_ids(F.col("ids"))).alias("chunk_id"), "score").groupBy("chunk_id").agg(F.round(F.max("score"), 6).alias("score"))


@query(
    "gr6_entity_graph",
    f"""WITH {GRAPH_SQL}, q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS base FROM q, embeddings), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY base DESC, vec_id) <= {Settings.entities_k}),
st AS (SELECT query_id, id, ids, base FROM t JOIN nodes ON lower(id) = 'supplier#' || lpad(CAST(vec_id AS VARCHAR), 9, '0')), nb AS (SELECT query_id, neighbour, source_id, least(1.0, base + ln(1 + CASE WHEN weight = 0 THEN 1 ELSE weight END) * 0.05) AS score FROM st JOIN ends ON node = st.id),
x AS (SELECT query_id, unnest(ids) AS chunk_id, base AS score FROM st UNION ALL SELECT query_id, unnest(ids), score FROM nb JOIN nodes ON id = neighbour UNION ALL SELECT query_id, source_id, score FROM nb),
m AS (SELECT query_id, chunk_id, max(score) AS score FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS arrival FROM m)
SELECT query_id, arrival, chunk_id, 'entity_graph' AS source, 'text' AS chunk_text, 'v_0' AS segment_ids, round(score, 6) AS score_entity, round(score, 6) AS score_graph FROM r WHERE arrival <= {Settings.graph_k}""",
)
def gr6_entity_graph(spark, sf):
    e = table(spark, sf, "embeddings")
    vectors = e.select(F.lit("v").alias("video_name"), F.col("vec_id").alias("id"), F.concat(F.lit("supplier#"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("entity_name"), F.col("embedding").alias("vector"))
    nodes, edges = graph_tables(spark, sf)
    video = F.lit("v").alias("video_name")
    chunks = spark.range(60).select(video, F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit("text").alias("content"), F.array(F.lit("v_0")).alias("video_segment_id"))
    found = retrieval.entity_graph(near_queries(spark, sf), vectors, nodes.withColumn("video_name", video), edges.withColumn("video_name", video), chunks)
    return found.select("query_id", "arrival", "chunk_id", "source", "chunk_text", F.array_join("segment_ids", ",").alias("segment_ids"), F.round("score_entity", 6).alias("score_entity"), F.round("score_graph", 6).alias("score_graph"))


@query(
    "jn2_cascade",
    """WITH f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN '"' || c_mktsegment || '"' WHEN 2 THEN lower(c_mktsegment) ELSE substring(c_mktsegment, 1, 1) || lower(substring(c_mktsegment, 2)) END AS entity_name FROM customer), n AS (SELECT DISTINCT CASE WHEN length(c_mktsegment) % 2 = 0 THEN c_mktsegment ELSE '"' || c_mktsegment || '"' END AS id FROM customer)
SELECT c_custkey, min(id) AS id, count(*) AS n FROM f JOIN n ON lower(trim(id, '"')) = lower(trim(entity_name, '"')) GROUP BY c_custkey""",
)
def jn2_cascade(spark, sf):
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(k % 4 == 0, m).when(k % 4 == 1, F.concat(F.lit('"'), m, F.lit('"'))).when(k % 4 == 2, F.lower(m)).otherwise(F.concat(F.substr(m, F.lit(1), F.lit(1)), F.lower(F.substr(m, F.lit(2)))))
    c = table(spark, sf, "customer")
    found = c.select(k.cast("string").alias("query_id"), F.lit("v").alias("video_name"), name.alias("entity_name"), "c_custkey")
    nodes = c.select(F.lit("v").alias("video_name"), F.when(F.length(m) % 2 == 0, m).otherwise(F.concat(F.lit('"'), m, F.lit('"'))).alias("id"), F.lit("c").alias("source_id")).distinct()
    return retrieval.entity_nodes(found, nodes).groupBy("c_custkey").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("jn13_alignment", "SELECT c_custkey, c_name AS question, c_custkey % 10 <> 0 AS ok FROM customer")
def jn13_alignment(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("question"))
    return evaluate.aligned(c, c.withColumn("question", F.when(F.col("c_custkey") % 10 == 0, "other").otherwise(F.col("question"))), "c_custkey", "question")


@query("jn14_cache", "SELECT p_partkey, p_brand || '!' AS raw FROM part")
def jn14_cache(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    cache = spark.createDataFrame([], "hash string, return string, model string")
    return hooks.cached(p, cache, "p_brand", lambda rows: rows.withColumn("raw", F.concat("p_brand", F.lit("!"))))[0].select("p_partkey", "raw")


@query("mv16_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 64 END AS n FROM embeddings")
def mv16_upsert(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit("v").alias("video_name"), F.lit("chunks").alias("namespace"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    new = e.where("id % 3 = 0").withColumn("vector", F.array(F.lit(1.0).cast("float")))
    return hooks.upsert_vectors(e, new).select("id", F.size("vector").alias("n"))


@query("mv17_rebuild")
def mv17_rebuild(spark, sf):
    chunks, nodes, _, _ = _store(spark, sf)
    return hooks.rebuild_vectors(chunks, nodes.withColumn("video_name", F.lit("global"))).select("video_name", "namespace", "id", F.size("vector").alias("n"))


@query(
    "ag15_percentile",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS p95 FROM r WHERE r = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)""",
)
def ag15_percentile(spark, sf):
    return evaluate.percentile(table(spark, sf, "events"), ["event_type"], "value", 0.95, "p95")


@query("ag16_proxy", "SELECT doc_id, 0.5 * CAST(contains(lower(text), 'the') AS INT) + 0.5 * CASE WHEN lang = 'en' THEN 0.5 ELSE 0 END AS proxy FROM documents")
def ag16_proxy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", evaluate.retrieval_proxy(F.col("text"), F.array("lang"), F.array(F.lit("THE")), F.array(F.lit("EN"), F.lit("xx"))).alias("proxy"))


@query(
    "q14_evaluation",
    """WITH c AS (SELECT doc_id, 0.5 * CAST(contains(lower(text), 'the') AS INT) + 0.5 * CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS p, n_chars / 1000.0 AS l FROM documents), r AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS r, count(*) OVER () AS n FROM c)
SELECT (SELECT count(*) FROM c) AS cases_total, round((SELECT avg(p) FROM c), 6) AS proxy, 0.25 AS grounded, (SELECT l FROM r WHERE r = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, (SELECT l FROM r WHERE r = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95""",
)
def q14_evaluation(spark, sf):
    cases = table(spark, sf, "documents").select(F.col("text").alias("answer"), F.array("lang").alias("found"), F.array(F.lit("the")).alias("keywords"), F.array(F.lit("en")).alias("expected"), F.lit(0.25).alias("supported_ratio"), (F.col("n_chars") / 1000.0).alias("latency_s"))
    return evaluate.summary(cases).select("cases_total", F.round("retrieval_recall_proxy_mean", 6).alias("proxy"), F.col("groundedness_proxy_mean").alias("grounded"), F.col("latency_p50_s").alias("p50"), F.col("latency_p95_s").alias("p95"))


@query("q15_compare")
def q15_compare(spark, sf):
    """Each turn of a conversation as the gold answer; the turn before it and an empty answer as two systems."""
    from pyspark.sql import Window

    w = table(spark, sf, "conversations").select(F.col("text").alias("answer_gold"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("rag_answer"), F.lit("").alias("weak_llm_answer"))
    return evaluate.compare_systems(w, ["rag_answer", "weak_llm_answer"])


@query("q16_summary_gate", "SELECT doc_id, length(text) >= 2000 AS needs FROM documents")
def q16_summary_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", evaluate.needs_summary(F.col("text")).alias("needs"))


@query("q17_fill", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'made' END AS answer FROM part")
def q17_fill(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  ").alias("answer"))
    return evaluate.fill_missing(p, "answer", lambda rows: rows.withColumn("raw", F.lit("made")))


@query("q6_answer")
def q6_answer(spark, sf):
    q, hits, segs = _hits(spark, sf)
    return answer.answer(q, hits, segs, segs.select("video_name").distinct(), hooks.echo)


@query("q13_routed")
def q13_routed(spark, sf):
    e = table(spark, sf, "embeddings")
    v = e.select(F.col("label").cast("string").alias("video_name"), F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("string").alias("entity_name"), F.col("embedding").alias("vector"))
    summaries = v.groupBy("video_name").agg(F.min_by("vector", "id").alias("vector"))
    nodes = v.select("video_name", "id", F.col("id").alias("source_id"))
    edges = v.select("video_name", F.col("id").alias("src"), F.lit("0").alias("dst"), F.lit(1.0).alias("weight"))
    chunks = v.select("video_name", F.col("id").alias("chunk_id"), F.col("id").alias("content"))
    return retrieval.routed_query(near_queries(spark, sf), summaries, v, v, nodes, edges, chunks, threshold=0.1)


@query("q11_hybrid", "SELECT 'q' AS query_id, source || '_' || doc_id AS segment_id FROM documents WHERE (doc_id % 3 = 0 OR doc_id % 5 = 0) AND doc_id % 2 = 0")
def q11_hybrid(spark, sf):
    d = table(spark, sf, "documents").withColumn("segment_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string")))
    of = lambda n: d.where(f"doc_id % {n} = 0").select(F.lit("q").alias("query_id"), "segment_id")
    captions = d.select(F.col("source").alias("video_name"), F.col("doc_id").cast("string").alias("segment_idx"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, "Yes.").otherwise("no").alias("verdict"))
    return retrieval.hybrid_segments(of(3), of(5), captions, F.contains(F.lower("verdict"), F.lit("yes"))).select("query_id", "segment_id")


@query(
    "tk8_regions",
    """WITH m AS (SELECT l_orderkey AS frame_key, l_linenumber % 2 AS r, l_returnflag || l_linestatus AS name, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT frame_key, coalesce(first(name ORDER BY s DESC, name) FILTER (r = 0), 'Unknown') AS main, coalesce((list(name ORDER BY s DESC, name) FILTER (r = 1))[1:4], []) AS partners FROM m GROUP BY 1)
SELECT frame_key, main, array_to_string(partners, ',') AS partners, array_to_string(CASE WHEN main = 'Unknown' THEN partners ELSE list_concat([main], list_filter(partners, lambda p: p <> main)) END, ',') AS entities FROM f""",
)
def tk8_regions(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_key"), F.when(F.col("l_linenumber") % 2 == 0, "middle").otherwise("partners").alias("region"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_extendedprice").alias("score"))
    return tables.best_regions(rows).select("frame_key", "main", F.array_join("partners", ",").alias("partners"), F.array_join("entities", ",").alias("entities"))


def _files(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "kv_store_video_segments.json").when(k % 3 == 1, "kv_store_video_frames.json").otherwise("kv_store_video_path.json")
    return table(spark, sf, "part").select(F.concat(F.lit("/d/"), "p_brand", F.lit("/"), name).alias("path"), name.alias("name"), F.col("p_brand").alias("folder"), F.lit(1).cast("long").alias("bytes"))


@query("src8_folders", "SELECT DISTINCT p_brand AS folder FROM part WHERE p_partkey % 3 = 0 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def src8_folders(spark, sf):
    return tables.find_folders(_files(spark, sf), "kv_store_video_segments.json", table(spark, sf, "part").where("p_size = 1").select(F.col("p_brand").alias("folder")))


@query("src10_complete", "SELECT p_brand AS folder, count(DISTINCT p_partkey % 3) = 3 AS complete FROM part GROUP BY 1")
def src10_complete(spark, sf):
    return tables.complete_folders(_files(spark, sf))


@query("src9_videos", "SELECT p_partkey || '.MP4' AS name FROM part WHERE p_size % 2 = 0")
def src9_videos(spark, sf):
    name = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".MP4").otherwise(".txt"))
    return tables.find_videos(table(spark, sf, "part").select(name.alias("path"), name.alias("name"), F.lit("f").alias("folder"), F.lit(1).alias("bytes"))).select("name")


@query("src15_assets", "SELECT '/d/' || r_name AS path, 'required' AS need, false AS ok FROM region UNION ALL SELECT DISTINCT '/d/' || p_brand, 'recommended', true FROM part")
def src15_assets(spark, sf):
    wanted = table(spark, sf, "region").select(F.concat(F.lit("/d/"), "r_name").alias("path"), F.lit("required").alias("need"), F.lit("dir").alias("kind"))
    wanted = wanted.union(table(spark, sf, "part").select(F.concat(F.lit("/d/"), "p_brand"), F.lit("recommended"), F.lit("dir")).distinct())
    return tables.check_assets(wanted, _files(spark, sf))


@query(
    "src4_graphml",
    f"""WITH {GRAPH_SQL}, heads AS (SELECT unnest([{', '.join(chr(39) + line.replace(chr(39), chr(39) * 2) + chr(39) for line in tables.GRAPHML_HEAD)}]) AS line, unnest(range({len(tables.GRAPHML_HEAD)})) AS k)
SELECT 0 AS part, lpad(CAST(k AS VARCHAR), 4, '0') AS at, line FROM heads
UNION ALL SELECT 1, id, '<node id="' || id || '"><data key="d0">GEO</data><data key="d1">a &amp; b</data><data key="d2">' || array_to_string(ids, '&lt;SEP&gt;') || '</data></node>' FROM nodes
UNION ALL SELECT 2, src || ' ' || dst, '<edge source="' || src || '" target="' || dst || '"><data key="d3">' || CAST(weight AS VARCHAR) || '</data><data key="d4">d</data><data key="d5">' || source_id || '</data><data key="d6">1</data></edge>' FROM edges
UNION ALL SELECT 3, '0000', '</graph>' UNION ALL SELECT 3, '0001', '</graphml>'""",
)
def src4_graphml(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    nodes = nodes.select("id", F.lit("GEO").alias("entity_type"), F.lit("a & b").alias("description"), "source_id")
    return tables.graphml_rows(nodes, edges.withColumns({"description": F.lit("d"), "order": F.lit(1).cast("long")}))


@query(
    "src2_export",
    """SELECT source AS video_name, '{' || string_agg('"' || doc_id || '":{"text":' || to_json(text) || ',"lang":' || to_json(lang) || '}', ',' ORDER BY CAST(doc_id AS VARCHAR)) || '}' AS json FROM documents GROUP BY source""",
)
def src2_export(spark, sf):
    return tables.json_rows(table(spark, sf, "documents").select(F.col("source").alias("video_name"), F.col("doc_id").cast("string").alias("key"), "text", "lang"), "key")


@query("stream_windows", "SELECT time_bucket(INTERVAL 30 SECOND, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf):
    return ingest.sessions(table(spark, sf, "events"))


@query("wn6_ordinals", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations")
def wn6_ordinals(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("k"))


@query(
    "flagship",
    """WITH q AS (SELECT CAST(item_id AS VARCHAR) AS query_id FROM benchmark WHERE item_id % 100 = 0) SELECT query_id, true AS enough FROM q""",
)
def flagship(spark, sf):
    """Lexical retrieval from packed chunks to a token-budgeted context, for the stated queries."""
    from lorewright.plans.base import segments

    packed = chunking.chunk_pack(segments(spark, sf))
    chunks = packed.select("video_name", "chunk_id", "content", "video_segment_id")
    nodes = packed.select(F.xxhash64("chunk_id").alias("node_ord"), F.col("chunk_id").alias("id"), F.col("content").alias("description"), F.col("chunk_id").alias("source_id"))
    q = asked(spark, sf)
    hits = retrieval.global_graph(q, nodes, chunks)
    segs = segments(spark, sf).select("video_name", F.col("ord").cast("string").alias("segment_idx"), F.lit("0-30").alias("time"))
    return answer.answer(q, hits, segs, packed.select("video_name").distinct(), hooks.echo).select("query_id", "enough")
