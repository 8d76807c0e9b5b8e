"""Queries of parsing, merging, resolving and measuring the graph, and of referential checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.operators import graph, sanitize
from lorewright.plans.base import GRAPH_SQL, PARSED_SQL, extractions, graph_tables, query, table


@query("tx9_parse", f"WITH {PARSED_SQL} SELECT 'chunk-' || chunk_ord AS chunk_id, entity_name AS a, entity_type AS b, description FROM entities UNION ALL SELECT 'chunk-' || chunk_ord, src, dst, description || ' ' || CAST(weight AS INT) FROM relations")
def tx9_parse(spark, sf):
    entities, relations = graph.parse_extractions(extractions(spark, sf))
    rows = entities.select("chunk_id", F.col("entity_name").alias("a"), F.col("entity_type").alias("b"), "description")
    return rows.union(relations.select("chunk_id", "src", "dst", F.concat("description", F.lit(" "), F.col("weight").cast("int").cast("string"))))


def _parsed(spark, sf):
    entities, relations = graph.parse_extractions(extractions(spark, sf))
    order = F.regexp_extract("chunk_id", "([0-9]+)$", 1).cast("long")
    return entities.withColumns({"ord": order * 100 + F.col("ord"), "source_id": F.col("chunk_id")}), relations.withColumn("source_id", F.col("chunk_id"))


AG3_SQL = """votes AS (SELECT entity_name, entity_type, count(*) AS n, min(chunk_ord * 100 + ord) AS f FROM entities GROUP BY 1, 2),
types AS (SELECT entity_name, entity_type FROM votes QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, f) = 1),
texts AS (SELECT entity_name, array_to_string(list_sort(list(DISTINCT description)), '<SEP>') AS description, array_to_string(list_sort(list(DISTINCT 'chunk-' || chunk_ord)), '<SEP>') AS source_id FROM entities GROUP BY 1),
ag3 AS (SELECT entity_name, entity_type, description, source_id FROM types JOIN texts USING (entity_name))"""


@query("ag3_nodes", f"WITH {PARSED_SQL}, {AG3_SQL} SELECT * FROM ag3")
def ag3_nodes(spark, sf):
    return graph.merge_nodes(_parsed(spark, sf)[0]).select("entity_name", "entity_type", "description", "source_id")


@query(
    "ag4_edges",
    f"""WITH {PARSED_SQL} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight, CAST(1 AS BIGINT) AS "order",
array_to_string(list_sort(list(DISTINCT description)), '<SEP>') AS description, array_to_string(list_sort(list(DISTINCT 'chunk-' || chunk_ord)), '<SEP>') AS source_id FROM relations GROUP BY 1, 2""",
)
def ag4_edges(spark, sf):
    return graph.merge_edges(_parsed(spark, sf)[1])


@query(
    "ag5_merge_existing",
    f"""WITH {PARSED_SQL}, {AG3_SQL}, votes2 AS (SELECT entity_name, entity_type, n, f, 0 AS late FROM votes UNION ALL SELECT upper(r_name), 'EVENT', 1, 0, 1 FROM region),
v3 AS (SELECT entity_name, entity_type, sum(n) AS n, min(late * 1000000 + f) AS f FROM votes2 GROUP BY 1, 2),
t3 AS (SELECT entity_name, entity_type FROM v3 QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, f) = 1),
rows AS (SELECT entity_name, description, 'chunk-' || chunk_ord AS s FROM entities UNION ALL SELECT upper(r_name), 'a<SEP>b', unnest(['old-1', 'old-2']) FROM region)
SELECT entity_name, entity_type, array_to_string(list_sort(list(DISTINCT description)), '<SEP>') AS description, array_to_string(list_sort(list(DISTINCT s)), '<SEP>') AS source_id FROM rows JOIN t3 USING (entity_name) GROUP BY 1, 2""",
)
def ag5_merge_existing(spark, sf):
    existing = table(spark, sf, "region").select(F.upper("r_name").alias("id"), F.lit("EVENT").alias("entity_type"), F.lit("a<SEP>b").alias("description"), F.lit("old-1<SEP>old-2").alias("source_id"))
    return graph.merge_nodes(_parsed(spark, sf)[0], existing).select("entity_name", "entity_type", "description", "source_id")


@query(
    "jn11_endpoints",
    f"""WITH {PARSED_SQL}, e AS (SELECT src, dst, description, 'chunk-' || chunk_ord AS source_id FROM relations),
have AS (SELECT DISTINCT entity_name FROM entities WHERE entity_type = 'GEO')
SELECT entity_name, NULL AS entity_type FROM have UNION ALL SELECT DISTINCT dst, '"UNKNOWN"' FROM e WHERE dst NOT IN (SELECT entity_name FROM have)""",
)
def jn11_endpoints(spark, sf):
    entities, relations = _parsed(spark, sf)
    have = entities.where("entity_type = 'GEO'").select("entity_name").distinct().withColumns({"entity_type": F.lit(None).cast("string"), "description": F.lit(None).cast("string"), "source_id": F.lit(None).cast("string")})
    return graph.complete_endpoints(have, relations.select("src", "dst", "description", "source_id")).select("entity_name", "entity_type")


@query(
    "ag6_post_nodes",
    """WITH n AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 50 = 0 THEN '<entity>' WHEN c_custkey % 49 = 0 THEN '' ELSE c_mktsegment || (c_custkey % 40) END AS id, CASE WHEN c_custkey % 3 = 0 THEN 'UNKNOWN' WHEN c_custkey % 3 = 1 THEN 'thing<SEP>"person"' ELSE 'GEO' END AS t,
  'd' || (c_custkey % 5) AS d, ['c' || (c_custkey % 9), 'c' || (c_custkey % 7), 'x'] AS s FROM customer),
k AS (SELECT ord, id, CASE WHEN t = 'GEO' THEN 'GEO' WHEN t = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'PERSON' END AS t, d, list_sort(list_distinct(list_filter(s, lambda x: x IN ('c1', 'c2', 'c3', 'c4', 'c5')))) AS s FROM n WHERE id <> '' AND id <> '<entity>'),
v AS (SELECT * FROM k WHERE len(s) > 0)
SELECT id, coalesce(arg_min(t, ord) FILTER (t <> 'UNKNOWN'), 'UNKNOWN') AS entity_type, array_to_string(list_sort(list(DISTINCT d)), '<SEP>') AS description, array_to_string(list_sort(list_distinct(flatten(list(s)))), '<SEP>') AS source_id FROM v GROUP BY id""",
)
def ag6_post_nodes(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    name = F.when(k % 50 == 0, "<entity>").when(k % 49 == 0, "").otherwise(F.concat("c_mktsegment", (k % 40).cast("string")))
    kind = F.when(k % 3 == 0, "UNKNOWN").when(k % 3 == 1, 'thing<SEP>"person"').otherwise("GEO")
    source = F.concat(F.lit("c"), (k % 9).cast("string"), F.lit("<SEP>c"), (k % 7).cast("string"), F.lit("<SEP>x"))
    nodes = c.select(k.alias("ord"), name.alias("id"), kind.alias("entity_type"), F.concat(F.lit("d"), (k % 5).cast("string")).alias("description"), source.alias("source_id"))
    return graph.post_merge_nodes(nodes, _valid(spark))


def _valid(spark):
    return spark.createDataFrame([(f"c{k}",) for k in range(1, 6)], "chunk_id string")


@query(
    "ag7_post_edges",
    """WITH e AS (SELECT o_orderkey AS ord, 'n' || (o_custkey % 30) AS s, 'n' || (o_orderkey % 23) AS d, CASE WHEN o_orderkey % 4 = 0 THEN 'bad' ELSE CAST(o_orderkey % 13 AS VARCHAR) || '.5' END AS w, CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE CAST(o_orderkey % 17 AS VARCHAR) END AS o, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS t, 'c' || (o_orderkey % 8) AS c FROM orders)
SELECT least(s, d) AS src, greatest(s, d) AS dst, max(greatest(0.0, least(10.0, coalesce(TRY_CAST(w AS DOUBLE), 1.0)))) AS weight, min(CASE WHEN o = 'x' THEN 1 ELSE CAST(o AS BIGINT) END) AS "order",
 array_to_string(list_sort(list(DISTINCT t)), '<SEP>') AS description, array_to_string(list_sort(list(DISTINCT c)), '<SEP>') AS source_id
FROM e WHERE s <> d AND c IN ('c1','c2','c3','c4','c5') AND CAST(substring(s, 2) AS INT) < 25 AND CAST(substring(d, 2) AS INT) < 25 GROUP BY 1, 2""",
)
def ag7_post_edges(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    edges = o.select(
        k.alias("ord"), F.concat(F.lit("n"), text(F.col("o_custkey") % 30)).alias("src"), F.concat(F.lit("n"), text(k % 23)).alias("dst"), F.when(k % 4 == 0, "bad").otherwise(F.concat(text(k % 13), F.lit(".5"))).alias("weight"),
        F.when(k % 6 == 0, "x").otherwise(text(k % 17)).alias("order"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("description"), F.concat(F.lit("c"), text(k % 8)).alias("source_id"),
    )
    nodes = spark.range(25).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    return graph.post_merge_edges(edges, nodes, _valid(spark))


@query(
    "st2_compose",
    "SELECT c_name AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS description FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
)
def st2_compose(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where(F.col("c_custkey") % 2 == 0).select(F.col("c_name").alias("id"), F.lit("old").alias("description"))
    return graph.compose(old, c.where(F.col("c_custkey") % 3 == 0).select(F.col("c_name").alias("id"), F.lit("new").alias("description")), ["id"])


@query("gr1_upsert", "SELECT c_custkey AS id, c_name AS a, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_mktsegment END AS b FROM customer")
def gr1_upsert(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    return graph.upsert(c, c.where(F.col("id") % 3 == 0).select("id", F.lit(None).cast("string").alias("a"), F.lit("x").alias("b")), ["id"])


@query(
    "ag24_preserve_merge",
    "SELECT upper(k) AS id, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a ELSE a || '|' || b END AS v FROM (SELECT n_name AS k, CASE WHEN n_nationkey % 2 = 0 THEN r_name END AS a, CASE WHEN n_nationkey % 3 = 0 THEN r_name WHEN n_nationkey % 3 = 1 THEN n_name END AS b FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE a IS NOT NULL OR b IS NOT NULL",
)
def ag24_preserve_merge(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    first = rows.where(k % 2 == 0).select(F.concat(F.lit(" "), F.lower("n_name")).alias("id"), F.col("r_name").alias("v"))
    second = rows.where(k % 3 < 2).select(F.col("n_name").alias("id"), F.when(k % 3 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("v"))
    return graph.preserve_merge(first, second, "id", "v").select("id", F.array_join("v", "|").alias("v"))


@query(
    "st5_overlap",
    "SELECT count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 3 = 0) AS common, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AS only_left, count(*) FILTER (c_custkey % 2 <> 0 AND c_custkey % 3 = 0) AS only_right FROM customer",
)
def st5_overlap(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return graph.overlap_stats(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), "c_custkey")


@query("ag18_degree", f"WITH {GRAPH_SQL} SELECT id, count(node) AS degree FROM nodes LEFT JOIN ends ON node = id GROUP BY id")
def ag18_degree(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    return graph.degrees(nodes, edges)


@query("ag18_edge_degree", f"WITH {GRAPH_SQL}, d AS (SELECT node, count(*) AS n FROM ends GROUP BY node) SELECT src, dst, a.n + b.n AS degree FROM edges JOIN d a ON a.node = src JOIN d b ON b.node = dst")
def ag18_edge_degree(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    return graph.edge_degrees(nodes, edges)


AG19_SQL = f"""{GRAPH_SQL}, ranked AS (SELECT id, node_ord, ids FROM nodes WHERE id LIKE 'Supplier%'),
own AS (SELECT node_ord, id, unnest(ids) AS chunk_id FROM ranked), firsts AS (SELECT chunk_id, arg_min(id, node_ord) AS id, min(node_ord) AS ord FROM own GROUP BY chunk_id),
near AS (SELECT DISTINCT e.node AS id, e.neighbour, unnest(n.ids) AS chunk_id FROM ends e JOIN nodes n ON n.id = e.neighbour),
counts AS (SELECT f.chunk_id, f.ord, count(neighbour) AS relation_counts FROM firsts f LEFT JOIN near USING (id, chunk_id) GROUP BY 1, 2)"""


@query("ag19_relation_counts", f"WITH {AG19_SQL} SELECT * FROM counts")
def ag19_relation_counts(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    ranked = nodes.where(F.col("id").startswith("Supplier")).select(F.col("node_ord").alias("ord"), "id")
    return graph.relation_counts(ranked, nodes, edges)


@query("gr11_segments", f"WITH {AG19_SQL}, top AS (SELECT chunk_id FROM counts ORDER BY relation_counts DESC, ord, chunk_id LIMIT 10) SELECT DISTINCT 'v_' || (CAST(substring(chunk_id, 2) AS INT) % 4) AS segment_id FROM top")
def gr11_segments(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    ranked = nodes.where(F.col("id").startswith("Supplier")).select(F.col("node_ord").alias("ord"), "id")
    chunks = spark.range(60).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.array(F.concat(F.lit("v_"), (F.col("id") % 4).cast("string"))).alias("video_segment_id"))
    return graph.related_segments(ranked, nodes, edges, chunks, 10)


@query("ag21_neighbours", f"WITH {GRAPH_SQL} SELECT neighbour AS id, round(sum(weight), 6) AS score FROM ends WHERE node LIKE 'Supplier%' GROUP BY neighbour ORDER BY score DESC, id LIMIT 10")
def ag21_neighbours(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    return graph.neighbour_weights(nodes.where(F.col("id").startswith("Supplier")).select("id"), edges, 10).select("id", F.round("score", 6).alias("score"))


@query(
    "gr12_graph_chunks",
    f"WITH {GRAPH_SQL}, top AS (SELECT neighbour AS id, sum(weight) AS s FROM ends WHERE node LIKE 'Supplier%' GROUP BY 1 ORDER BY s DESC, id LIMIT 10) SELECT DISTINCT unnest(ids) AS chunk_id FROM top JOIN nodes USING (id)",
)
def gr12_graph_chunks(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    chunks = spark.range(60).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"))
    return graph.graph_chunks(nodes.where(F.col("id").startswith("Supplier")).select("id"), nodes, edges, chunks, 10)


@query(
    "ag20_communities",
    f"""WITH {GRAPH_SQL}, m AS (SELECT id, 0 AS level, 'a' || (node_ord % 2) AS cluster FROM nodes UNION ALL SELECT id, 1, 'b' || (node_ord % 4) FROM nodes),
c AS (SELECT m.level, m.cluster, list_sort(list(DISTINCT ch)) AS chunk_ids FROM m JOIN (SELECT id, unnest(ids) AS ch FROM nodes) n USING (id) GROUP BY 1, 2),
g AS (SELECT level, cluster, count(DISTINCT least(node, neighbour) || '<SEP>' || greatest(node, neighbour)) AS n_edges FROM m JOIN ends ON node = id GROUP BY 1, 2),
s AS (SELECT level, cluster, count(DISTINCT id) AS n_nodes FROM m GROUP BY 1, 2)
SELECT level, cluster, n_nodes, coalesce(n_edges, 0) AS n_edges, array_to_string(chunk_ids, ',') AS chunks, round(len(chunk_ids) / (SELECT max(len(chunk_ids)) FROM c), 6) AS occurrence,
  CASE WHEN level = 0 THEN CASE cluster WHEN 'a0' THEN 'b0,b2' ELSE 'b1,b3' END ELSE '' END AS subs FROM c JOIN s USING (level, cluster) LEFT JOIN g USING (level, cluster)""",
)
def ag20_communities(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    of = lambda level, letter, n: nodes.select("id", F.lit(level).alias("level"), F.concat(F.lit(letter), (F.col("node_ord") % n).cast("string")).alias("cluster"))
    rows = graph.community_schema(of(0, "a", 2).union(of(1, "b", 4)), nodes, edges)
    return rows.select("level", "cluster", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), F.array_join("chunk_ids", ",").alias("chunks"), F.round("occurrence", 6).alias("occurrence"), F.array_join("sub_communities", ",").alias("subs"))


#: An order links its customer with one that depends on it alone, so each customer has one way on. Doubled ways end in a cycle or
#: at a customer without one; the least number that is met from there is the same for all of a component. 2^18 customers.
COMPONENTS_SQL = (
    "WITH n AS (SELECT count(*) AS n FROM customer), w AS (SELECT DISTINCT o_custkey AS id, (o_custkey * 7 + 3) % n + 1 AS nxt FROM orders, n), "
    "f0 AS (SELECT c_custkey AS id, coalesce(w.nxt, c_custkey) AS nxt, c_custkey AS m FROM customer c LEFT JOIN (SELECT w.* FROM w JOIN customer k ON k.c_custkey = w.nxt) w ON w.id = c.c_custkey), "
    + ", ".join(f"f{k + 1} AS (SELECT a.id, b.nxt, least(a.m, b.m) AS m FROM f{k} a JOIN f{k} b ON b.id = a.nxt)" for k in range(18))
    + ", l AS (SELECT a.id, b.m AS label FROM f18 a JOIN f18 b ON b.id = a.nxt) SELECT id, min(id) OVER (PARTITION BY label) AS component FROM l"
)


@query("gr4_components", COMPONENTS_SQL)
def gr4_components(spark, sf):
    """Components under all orders."""
    return _order_components(spark, sf, table(spark, sf, "orders"))


def _order_components(spark, sf, orders):
    c = table(spark, sf, "customer")
    n = c.agg(F.count("*").alias("n"))
    edges = orders.crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + 3) % F.col("n") + 1).alias("dst"))
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("node_ord"))
    return graph.components(nodes, edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")).select("id", "component")


def _names(spark, sf):
    """Customers as nodes whose names collide when normalised; some give another name in their description."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Ent "), (k % 97).cast("string"))).when(k % 4 == 1, F.concat(F.lit("ENT-"), (k % 89).cast("string"))).otherwise(F.concat(F.lit("Solo "), k.cast("string")))
    name = F.concat(name, F.lit("."), F.when(k % 8 == 0, "").otherwise(F.lit(" ")), F.repeat(F.lit("."), (k % 3).cast("int")))
    kind = F.when(k % 5 == 0, "UNKNOWN").when(k % 5 == 1, "PERSON").otherwise("GEO")
    about = F.when(k % 10 == 2, F.concat(F.lit("also called: Ent "), (k % 7).cast("string"))).otherwise(F.concat(F.lit("d"), (k % 3).cast("string")))
    rows = c.select(name.alias("id"), k.alias("node_ord"), kind.alias("entity_type"), about.alias("description"), F.concat(F.lit("c"), (k % 6).cast("string")).alias("source_id"))
    return rows.groupBy("id").agg(F.min_by(F.struct("node_ord", "entity_type", "description", "source_id"), "node_ord").alias("v")).select("id", "v.*")


NAMES_SQL = """base AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'Ent ' || (c_custkey % 97) WHEN c_custkey % 4 = 1 THEN 'ENT-' || (c_custkey % 89) ELSE 'Solo ' || c_custkey END || '.' || CASE WHEN c_custkey % 8 = 0 THEN '' ELSE ' ' END || repeat('.', c_custkey % 3) AS id,
  CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' WHEN c_custkey % 5 = 1 THEN 'PERSON' ELSE 'GEO' END AS t, CASE WHEN c_custkey % 10 = 2 THEN 'also called: Ent ' || (c_custkey % 7) ELSE 'd' || (c_custkey % 3) END AS d, 'c' || (c_custkey % 6) AS s FROM customer),
n AS (SELECT id, min(k) AS k, arg_min(t, k) AS t, arg_min(d, k) AS d, arg_min(s, k) AS s FROM base GROUP BY id),
keys AS (SELECT DISTINCT k, id, t, key FROM (SELECT k, id, t, regexp_replace(lower(id), '[^0-9a-z]', '', 'g') AS key FROM n UNION ALL SELECT k, id, t, regexp_replace(lower(substring(d, 14)), '[^0-9a-z]', '', 'g') FROM n WHERE d LIKE 'also called: %') WHERE key <> ''),
firsts AS (SELECT key, min(k) AS fk, arg_min(t, k) AS ft FROM keys GROUP BY key),
links AS (SELECT DISTINCT fk AS a, k AS b FROM keys JOIN firsts USING (key) WHERE k <> fk AND (ft = t OR ft = 'UNKNOWN' OR t = 'UNKNOWN')),
two AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r AS (SELECT a AS node, b AS other FROM two UNION SELECT r.node, two.b FROM r JOIN two ON two.a = r.other),
comp AS (SELECT n.k, least(n.k, coalesce(min(other), n.k)) AS component FROM n LEFT JOIN r ON node = n.k GROUP BY n.k)"""


@query("jn17_alias_links", f"WITH RECURSIVE {NAMES_SQL} SELECT x.id AS src, y.id AS dst FROM links JOIN n x ON x.k = a JOIN n y ON y.k = b")
def jn17_alias_links(spark, sf):
    return graph.alias_edges(graph.resolution_keys(_names(spark, sf)))


@query(
    "gr3_resolution",
    f"""WITH RECURSIVE {NAMES_SQL}, m AS (SELECT component, n.*, trim(id) AS bare FROM n JOIN comp USING (k)),
rep AS (SELECT component, id AS rep FROM m QUALIFY row_number() OVER (PARTITION BY component ORDER BY CASE WHEN t <> 'UNKNOWN' THEN 1 ELSE 0 END DESC, CASE WHEN bare = id THEN 1 ELSE 0 END DESC, length(bare), length(id), k) = 1),
u AS (SELECT component, t, d, s, k FROM m), f AS (SELECT component, 't' AS c, t AS v, min(k) AS p FROM u GROUP BY 1, 3 UNION ALL SELECT component, 'd', d, min(k) FROM u GROUP BY 1, 3 UNION ALL SELECT component, 's', s, min(k) FROM u GROUP BY 1, 3)
SELECT rep AS id, component AS node_ord, string_agg(v, '<SEP>' ORDER BY p) FILTER (c = 't') AS entity_type, string_agg(v, '<SEP>' ORDER BY p) FILTER (c = 'd') AS description, string_agg(v, '<SEP>' ORDER BY p) FILTER (c = 's') AS source_id FROM f JOIN rep USING (component) GROUP BY 1, 2""",
)
def gr3_resolution(spark, sf):
    nodes = _names(spark, sf)
    none = spark.createDataFrame([], "src string, dst string, weight double")
    return graph.resolve_entities(nodes, none)[0]


@query("gr3_unicode")
def gr3_unicode(spark, sf):
    from lorewright.functions import unicode as U

    nodes = table(spark, sf, "documents").select(F.col("text").alias("id"), F.col("doc_id").alias("node_ord"), F.lit("PERSON").alias("entity_type"), F.col("lang").alias("description"), F.col("source").alias("source_id"))
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct("node_ord", "entity_type", "description", "source_id"), "node_ord").alias("v")).select("id", "v.*")
    return graph.resolve_entities(nodes, spark.createDataFrame([], "src string, dst string"), U.entity_key, U.unquote)[0]


@query(
    "gr8_largest",
    f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT node, neighbour AS other FROM ends UNION SELECT r.node, e.neighbour FROM r JOIN ends e ON e.node = r.other),
c AS (SELECT id, least(min(n1.node_ord), coalesce(min(n2.node_ord), min(n1.node_ord))) AS c FROM nodes n1 LEFT JOIN r ON r.node = id LEFT JOIN nodes n2 ON n2.id = r.other GROUP BY id) """.replace("SELECT id, least", "SELECT n1.id, least").replace("r.node = id", "r.node = n1.id").replace("GROUP BY id)", "GROUP BY n1.id)")
    + "SELECT upper(id) AS id FROM c WHERE c = (SELECT c FROM c GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)",
)
def gr8_largest(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    return graph.largest_component(nodes, edges)[0]


def _labels_sql(rounds: int = 5) -> str:
    """Rounds of label propagation, a CTE each."""
    parts = ["l0 AS (SELECT id, id AS cluster FROM nodes)"]
    for k in range(rounds):
        votes = f"SELECT node, cluster, count(*) AS n FROM ends JOIN l{k} ON id = neighbour WHERE node <> neighbour GROUP BY 1, 2"
        parts.append(f"l{k + 1} AS (SELECT l.id, coalesce(b.cluster, l.cluster) AS cluster FROM l{k} l LEFT JOIN (SELECT node, cluster FROM ({votes}) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, cluster) = 1) b ON b.node = l.id)")
    return f"WITH {GRAPH_SQL}, {', '.join(parts)} SELECT id, 0 AS level, cluster FROM l{rounds}"


@query("gr9_communities", _labels_sql())
def gr9_communities(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    return graph.label_communities(nodes, edges)


@query("gr10_walks")
def gr10_walks(spark, sf):
    nodes, edges = graph_tables(spark, sf)
    return graph.random_walks(nodes, edges)


@query("gr10_embedding")
def gr10_embedding(spark, sf):
    """Vectors of all nodes, trained on their walks in blocks."""
    nodes, edges = graph_tables(spark, sf)
    return graph.node_vectors(graph.random_walks(nodes, edges))


#: The graph has the even names, the video the odd ones, which are numbered after them.
MERGED_SQL = NAMES_SQL.replace("\nn AS (", "\nn0 AS (").replace(
    "\nkeys AS",
    "\nn AS (SELECT id, CASE WHEN k % 2 = 0 THEN k ELSE k + 1 + (SELECT max(k) FROM n0 WHERE k % 2 = 0) - (SELECT min(k) FROM n0 WHERE k % 2 = 1) END AS k, t, d, s FROM n0),\nkeys AS",
)


@query(
    "gr5_global_merge",
    f"""WITH RECURSIVE {MERGED_SQL}, m AS (SELECT component, n.*, trim(id) AS bare FROM n JOIN comp USING (k)),
rep AS (SELECT component, id AS rep FROM m QUALIFY row_number() OVER (PARTITION BY component ORDER BY CASE WHEN t <> 'UNKNOWN' THEN 1 ELSE 0 END DESC, CASE WHEN bare = id THEN 1 ELSE 0 END DESC, length(bare), length(id), k) = 1),
f AS (SELECT component, 't' AS c, t AS v, min(k) AS p FROM m GROUP BY 1, 3 UNION ALL SELECT component, 'd', d, min(k) FROM m GROUP BY 1, 3 UNION ALL SELECT component, 's', s, min(k) FROM m GROUP BY 1, 3),
nodes AS (SELECT rep AS id, component AS node_ord, string_agg(v, '<SEP>' ORDER BY p) FILTER (c = 't') AS entity_type, string_agg(v, '<SEP>' ORDER BY p) FILTER (c = 'd') AS description, string_agg(v, '<SEP>' ORDER BY p) FILTER (c = 's') AS source_id FROM f JOIN rep USING (component) GROUP BY 1, 2),
reps AS (SELECT m.id, rep FROM m JOIN rep USING (component))
SELECT 'node' AS part, id, node_ord, entity_type, description, source_id FROM nodes
UNION ALL SELECT 'edge', x.rep, -1, y.rep, 'w1.0', NULL FROM n a JOIN n b ON b.s = a.s AND b.k = a.k + 6 JOIN reps x ON x.id = a.id JOIN reps y ON y.id = b.id WHERE x.rep <> y.rep
UNION ALL SELECT 'manifest', v, -1, NULL, NULL, NULL FROM (SELECT unnest(['seen', 'new']) AS v)""",
)
def gr5_global_merge(spark, sf):
    names = _names(spark, sf)
    even = F.col("node_ord") % 2 == 0
    manifest = spark.createDataFrame([("seen",)], "video_name string")

    def part(nodes):
        """A graph whose edges go from a node to the one six numbers on, where that has the same source."""
        after = nodes.select(F.col("id").alias("dst"), (F.col("node_ord") - 6).alias("node_ord"), "source_id")
        return nodes, nodes.select(F.col("id").alias("src"), "node_ord", "source_id").join(after, ["node_ord", "source_id"]).select("src", "dst", F.lit(1.0).alias("weight"))

    nodes, edges, listed = graph.merge_into_global(part(names.where(even)), part(names.where(~even)), manifest, "new")
    null, no = F.lit(None).cast("string"), F.lit(-1).cast("long")
    rows = nodes.select(F.lit("node").alias("part"), "id", "node_ord", "entity_type", "description", "source_id")
    rows = rows.union(edges.select(F.lit("edge"), "src", no, "dst", F.concat(F.lit("w"), F.col("weight").cast("string")), null))
    return rows.union(listed.select(F.lit("manifest"), "video_name", no, null, null, null))


@query(
    "tx44_snapshot",
    f"""WITH {PARSED_SQL} SELECT 'chunk-' || e.chunk_ord AS chunk_id, string_agg('- "' || entity_name || '" (' || entity_type || '): ' || e.description, chr(10) ORDER BY ord) AS entities, any_value('- "' || src || '" -> "' || dst || '" (w=' || weight || '): ' || r.description) AS relations FROM entities e JOIN relations r USING (chunk_ord) GROUP BY 1""",
)
def tx44_snapshot(spark, sf):
    return graph.snapshot(*graph.parse_extractions(extractions(spark, sf)))


@query("flt7_referential", "SELECT source AS video_name, count(*) AS n FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations) GROUP BY source")
def flt7_referential(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("video_name"), F.col("doc_id").cast("string").alias("segment_idx"))
    refs = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("segment_idx")).distinct().join(docs, "segment_idx")
    chunks = refs.select("video_name", F.array(F.concat("video_name", F.lit("_"), "segment_idx")).alias("video_segment_id"))
    return sanitize.referenced_segments(docs, chunks).groupBy("video_name").agg(F.count("*").alias("n"))


@query(
    "flt5_frames",
    """SELECT CAST(o_orderkey AS VARCHAR) || '_0' AS frame_key, CAST(o_orderkey AS VARCHAR) AS segment_idx FROM orders JOIN customer ON c_custkey = o_orderkey WHERE o_orderkey % 3 <> 0""",
)
def flt5_frames(spark, sf):
    k = F.col("o_orderkey")
    frames = table(spark, sf, "orders").select(F.lit("v").alias("video_name"), F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit("_0"))).alias("frame_key"), F.when(k % 2 == 0, k.cast("string")).alias("segment_idx"))
    kept = table(spark, sf, "customer").select(F.lit("v").alias("video_name"), F.col("c_custkey").cast("string").alias("segment_idx"))
    return sanitize.frames_of(frames, kept).select("frame_key", "segment_idx")


@query(
    "flt6_chunks",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'empty_after_clean' WHEN doc_id % 3 = 0 THEN 'no_valid_segment_refs' ELSE 'kept' END AS reason FROM documents""",
)
def flt6_chunks(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select(k.alias("doc_id"), F.col("source").alias("video_name"), k.cast("string").alias("chunk_id"), k.alias("chunk_ord"), F.when(k % 5 == 0, " ").otherwise("text").alias("content"), k.alias("chunk_order_index"), F.array(F.when(k % 3 == 0, "other_1").otherwise(F.concat("source", F.lit("_1")))).alias("video_segment_id"))
    return sanitize.valid_chunks(rows, clean=T.clean_text)[1].select("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("flt9_names", "SELECT p_partkey, p_size % 4 = 0 OR p_size % 5 = 0 OR p_size % 7 = 0 AS blocked FROM part")
def flt9_names(spark, sf):
    s = F.col("p_size")
    name = F.when(s % 4 == 0, "").when(s % 5 == 0, " <Any thing> ").when(s % 7 == 0, F.repeat(F.lit("x"), F.lit(121))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", T.blocked_name(name).alias("blocked"))


@query(
    "flt10_sources",
    "SELECT c_custkey AS id, array_to_string(list_sort(list_distinct(list_filter(['c' || (c_custkey % 9), 'c' || (c_custkey % 4)], lambda x: x IN ('c1','c2','c3','c4','c5')))), ',') AS sources FROM customer WHERE c_custkey % 9 IN (1,2,3,4,5) OR c_custkey % 4 IN (1,2,3)",
)
def flt10_sources(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("c"), (k % 9).cast("string"), F.lit("<SEP> c"), (k % 4).cast("string")).alias("source_id"))
    return graph.canonical_sources(rows, _valid(spark), ["id"]).select("id", F.array_join("sources", ",").alias("sources"))


@query("flt14_types", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'PERSON' ELSE 'UNKNOWN' END AS entity_type FROM customer")
def flt14_types(spark, sf):
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, "UNKNOWN<SEP>PERSON").when(k % 3 == 1, 'robot<SEP> "person"').otherwise(F.lit(None).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", T.first_allowed_type(value).alias("entity_type"))


@query("flt18_warnings", "SELECT DISTINCT source AS video_name, w AS warning FROM documents, (SELECT unnest(['malformed segment reference', 'missing segment']) AS w) UNION ALL SELECT source, 'chunk count mismatch' FROM documents GROUP BY source HAVING count(*) <> count(*) FILTER (doc_id % 2 = 0)")
def flt18_warnings(spark, sf):
    d = table(spark, sf, "documents")
    chunks = d.select(F.col("source").alias("video_name"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("bad"))).otherwise(F.array(F.lit("v_gone"))).alias("video_segment_id"))
    both = chunks.select("video_name", F.array(F.lit("bad"), F.lit("v_gone")).alias("video_segment_id"))
    vectors = d.where("doc_id % 2 = 0").select(F.col("source").alias("video_name"))
    nodes = d.select(F.col("source").alias("video_name"))
    return sanitize.store_warnings(both, vectors, d.select(F.col("source").alias("video_name"), F.col("doc_id").cast("string").alias("segment_idx")), nodes, nodes)


@query("flt19_light", """SELECT regexp_replace(c_mktsegment, '"', '', 'g') AS id, max(c_custkey) AS node_ord FROM customer GROUP BY 1""")
def flt19_light(spark, sf):
    k = F.col("c_custkey")
    return sanitize.light_global(table(spark, sf, "customer").select(F.when(k % 2 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).otherwise(F.col("c_mktsegment")).alias("id"), k.alias("node_ord"), F.lit("d").alias("description"))).select("id", "node_ord")


@query("flt20_incremental", "SELECT event_id FROM events WHERE user_id % 3 <> 0")
def flt20_incremental(spark, sf):
    e = table(spark, sf, "events")
    return sanitize.missing(e.select("event_id", "user_id"), e.where("user_id % 3 = 0").select("user_id").distinct(), ["user_id"]).select("event_id")


@query("flt21_fetch", "SELECT CAST(i AS INT) AS at, i * 7 % 2000 AS id, c_name FROM (SELECT unnest(range(2000)) AS i) LEFT JOIN customer ON c_custkey = i * 7 % 2000")
def flt21_fetch(spark, sf):
    ids = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: (i * 7 % 2000).cast("long")).alias("ids"))
    return sanitize.fetch(ids, table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name"), ["c_name"])


@query("st6_manifest", "SELECT DISTINCT event_type AS video_name FROM events UNION SELECT DISTINCT source FROM documents")
def st6_manifest(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("video_name")).union(table(spark, sf, "documents").select("source")).distinct().orderBy("video_name")


@query("mv14_map_merge", "SELECT c_custkey, c_mktsegment AS a, 'new' AS b FROM customer")
def mv14_map_merge(spark, sf):
    first = F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.col("c_name"))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(first), lambda e: e["key"] != "b"), F.map_entries(F.create_map(F.lit("b"), F.lit("new")))))
    return table(spark, sf, "customer").select("c_custkey", merged["a"].alias("a"), merged["b"].alias("b"))


@query("q7_sanitize_pre")
def q7_sanitize_pre(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    segments = d.select(F.col("source").alias("video_name"), k.cast("int").alias("seg_ord"), k.cast("string").alias("segment_idx"), F.when(k % 9 == 0, "oops").otherwise("0-30").alias("time"), F.col("text").alias("content"), F.lit("").alias("transcript"), F.array(F.lit(1.0)).alias("frame_times"))
    frames = d.select(F.col("source").alias("video_name"), F.concat(k.cast("string"), F.lit("_0")).alias("frame_key"), F.lit("").alias("frame_path"), k.cast("string").alias("segment_idx"), F.array(F.lit("pike"), F.lit("Ahry"), F.lit("PYKE")).alias("entities"), F.col("text").alias("transcript"), F.lit("").alias("vlm_output"), F.lit("smoulder").alias("main_champ"), F.array(F.lit("ari")).alias("partners"))
    paths = d.select(F.col("source").alias("video_name")).distinct().withColumn("path", F.concat(F.lit("/v/"), "video_name"))
    return sanitize.sanitize_pre(segments, frames, paths, {"PYKE": ["PIKE"], "AHRI": ["AHRY", "ARI"], "SMOLDER": ["SMOULDER"]}).report


@query("q8_sanitize_post")
def q8_sanitize_post(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    video = F.col("source").alias("video_name")
    chunks = d.select(video, k.cast("string").alias("chunk_id"), k.cast("int").alias("chunk_ord"), F.col("text").alias("content"), k.alias("chunk_order_index"), F.array(F.concat("source", F.lit("_"), k.cast("string"))).alias("video_segment_id"))
    segments = d.select(video, k.cast("string").alias("segment_idx"), F.col("text").alias("content"), F.lit("").alias("transcript"))
    frames = d.select(video, F.concat(k.cast("string"), F.lit("_0")).alias("frame_key"), k.cast("string").alias("segment_idx"), F.array(F.lit("pike")).alias("entities"), F.lit("t").alias("transcript"), F.lit("").alias("vlm_output"), F.lit(None).cast("string").alias("main_champ"), F.array(F.lit(" ")).alias("partners"))
    nodes = d.select(k.alias("node_ord"), F.concat(F.lit('"'), "lang", F.lit('"')).alias("id"), F.lit("PERSON").alias("entity_type"), F.col("source").alias("description"), k.cast("string").alias("source_id"))
    edges = d.select(k.alias("edge_ord"), F.col("lang").alias("src"), F.lit("en").alias("dst"), F.lit("2").alias("weight"), F.lit("1").alias("order"), F.col("source").alias("description"), k.cast("string").alias("source_id"))
    done = sanitize.sanitize_post(chunks, segments, frames, nodes, edges, {"PYKE": ["PIKE"]})
    return done.report.select("video_name", "file", "in", "out", "dropped").union(done.tables["nodes"].select("id", F.lit("node"), F.size(F.split("source_id", "<SEP>")), F.lit(0), F.lit(0))).union(done.tables["edges"].select("src", "dst", F.col("weight").cast("int"), F.lit(0), F.lit(0)))
