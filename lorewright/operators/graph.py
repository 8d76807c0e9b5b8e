"""The knowledge graph as two tables: nodes and edges, merged, resolved and measured.

nodes: video_name, node_ord, id, entity_type, description, source_id; edges: video_name, edge_ord, src, dst, weight,
description, source_id, order. Ties are decided by the ordinals, which state the order in which rows came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright import shared
from lorewright.functions import text as T
from lorewright.functions import unicode as U
from lorewright.operators import walks as node_walks
from lorewright.schemas import SEP


def joined(values: Column) -> Column:
    return F.array_join(values, SEP)


def unique_in_order(rows: DataFrame, key: list[str], order: list[str], values: Column, out: str) -> DataFrame:
    """Per key the distinct values of the arrays `values`, in order of first occurrence."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, values.alias("v"))))
    return rows.groupBy(*key).agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["v"]))).alias(out))


def parse_extractions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a model's answers (chunk_id, raw): TX9 to TX11, WN4, JN10.

    The first entity of a name and the first relation of an unordered pair stay, in each chunk; relations need both ends among
    their chunk's entities, and a description.
    """
    rows = raw.select("chunk_id", F.posexplode(T.records(F.col("raw"))).alias("ord", "fields"))
    entities = rows.select("chunk_id", "ord", T.entity_record(F.col("fields")).alias("e")).where("e is not null").select("chunk_id", "ord", "e.*")
    entities = entities.where(T.strip(F.col("description")) != "")
    first = Window.partitionBy("chunk_id", "entity_name").orderBy("ord")
    entities = entities.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")
    relations = rows.select("chunk_id", "ord", T.relation_record(F.col("fields")).alias("r")).where("r is not null").select("chunk_id", "ord", "r.*")
    relations = relations.where((F.col("src") != F.col("dst")) & (T.strip(F.col("description")) != ""))
    for end in ("src", "dst"):
        relations = relations.join(entities.select("chunk_id", F.col("entity_name").alias(end)), ["chunk_id", end], "left_semi")
    pair = Window.partitionBy("chunk_id", F.least("src", "dst"), F.greatest("src", "dst")).orderBy("ord")
    relations = relations.withColumn("rank", F.row_number().over(pair)).where("rank = 1").drop("rank")
    return entities, relations


def merge_nodes(entities: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per name: the most frequent type (ties: the first seen), distinct descriptions and chunks sorted (AG3).

    entities: ord, entity_name, entity_type, description, source_id. existing rows count as one vote and one description each
    and come last (AG5); source ids, whose order the semantics leave open, are sorted.
    """
    rows = entities.select(F.lit(0).alias("late"), "ord", "entity_name", "entity_type", "description", F.array("source_id").alias("sources"))
    if existing is not None:
        rows = rows.unionByName(existing.select(F.lit(1).alias("late"), F.lit(0).cast(rows.schema["ord"].dataType).alias("ord"), F.col("id").alias("entity_name"), "entity_type", "description", T.split_ids(F.col("source_id")).alias("sources")))
    votes = rows.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"), F.min(F.struct("late", "ord")).alias("first"))
    types = votes.groupBy("entity_name").agg(F.max_by("entity_type", F.struct("n", -F.col("first.late"), -F.col("first.ord"))).alias("entity_type"))
    texts = rows.groupBy("entity_name").agg(joined(F.array_sort(F.collect_set("description"))).alias("description"), joined(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))).alias("source_id"))
    return types.join(texts, "entity_name")


def merge_edges(relations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per unordered pair: weights added, the least order, descriptions and chunks distinct and sorted (AG4, AG5)."""
    rows = relations.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "description", F.array("source_id").alias("sources"), F.lit(1).cast("long").alias("order"))
    if existing is not None:
        rows = rows.unionByName(existing.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "description", T.split_ids(F.col("source_id")).alias("sources"), F.coalesce("order", F.lit(1)).cast("long").alias("order")))
    return rows.groupBy("src", "dst").agg(
        F.sum("weight").alias("weight"), F.min("order").alias("order"), joined(F.array_sort(F.collect_set("description"))).alias("description"),
        joined(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))).alias("source_id"),
    )


def complete_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and, for each end of an edge that isn't among them, one of type "UNKNOWN" (with its quotes) with the first edge's texts (JN11)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity_name"), F.struct("src", "dst", "description", "source_id").alias("e"))
    missing = ends.join(nodes.select("entity_name"), "entity_name", "left_anti").groupBy("entity_name").agg(F.min("e").alias("e"))
    return nodes.unionByName(missing.select("entity_name", F.lit('"UNKNOWN"').alias("entity_type"), F.col("e.description").alias("description"), F.col("e.source_id").alias("source_id")), allowMissingColumns=True)


def post_merge_nodes(nodes: DataFrame, valid_chunks: DataFrame) -> DataFrame:
    """Nodes (ord, id, entity_type, description, source_id) after sanitizing: FLT9, FLT10, FLT14, AG6.

    Blocked names and nodes without a valid chunk go; nodes of one id are one, its type the first that isn't UNKNOWN.
    """
    rows = nodes.where(~T.blocked_name(F.col("id"))).withColumn("entity_type", T.first_allowed_type(F.col("entity_type")))
    sources = canonical_sources(rows, valid_chunks, ["id", "ord"])
    rows = rows.drop("source_id").join(sources, ["id", "ord"])
    known = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entity_type"))), lambda x: x["entity_type"]), lambda t: t != "UNKNOWN")
    return rows.groupBy("id").agg(
        F.coalesce(F.get(known, 0), F.lit("UNKNOWN")).alias("entity_type"), _pieces("description", keep_empty=False).alias("description"),
        joined(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))).alias("source_id"),
    )


def _pieces(column: str, keep_empty: bool) -> Column:
    """Distinct parts of joined texts, sorted and joined; a single text stays as it is."""
    parts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(column, SEP, -1)))))
    merged = joined(parts if keep_empty else F.filter(parts, lambda x: x != ""))
    return F.when(F.count("*") == 1, F.first(column)).otherwise(merged)


def canonical_sources(rows: DataFrame, valid_chunks: DataFrame, key: list[str]) -> DataFrame:
    """key and sources: the valid chunk ids of source_id, distinct and sorted; rows without any are left out (FLT10)."""
    ids = rows.select(*key, F.explode(T.split_ids(F.col("source_id"))).alias("chunk_id")).join(valid_chunks.select("chunk_id"), "chunk_id", "left_semi")
    return ids.groupBy(*key).agg(F.array_sort(F.collect_set("chunk_id")).alias("sources"))


def post_merge_edges(edges: DataFrame, nodes: DataFrame, valid_chunks: DataFrame) -> DataFrame:
    """Edges (ord, src, dst, weight as text, order as text, description, source_id) after sanitizing: JN10, FLT12, AG7.

    Weights are clamped to 0 to 10 and the largest stays; the empty description counts as one.
    """
    rows = edges.where(F.col("src") != F.col("dst"))
    for end in ("src", "dst"):
        rows = rows.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    rows = rows.join(canonical_sources(rows, valid_chunks, ["ord"]), "ord")
    weight = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(T.number(F.col("weight").cast("string")), F.lit(1.0))))
    order = F.when(F.col("order").cast("string").rlike("^[0-9]+$"), F.col("order").try_cast("long")).otherwise(F.lit(1).cast("long"))
    rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("weight"), F.coalesce(order, F.lit(1)).alias("order"), "description", "sources")
    return rows.groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.min("order").alias("order"), _pieces("description", keep_empty=True).alias("description"), joined(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))).alias("source_id"))


def upsert(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; attributes that the new row has (not null) replace the current ones (GR1)."""
    others = [c for c in current.columns if c not in key]
    rows = current.alias("a").join(new.alias("b"), key, "full_outer")
    return rows.select(*key, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in others])


def compose(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Union by key where the second's rows replace the first's (ST2); attributes aren't merged."""
    return first.join(second.select(*key), key, "left_anti").unionByName(second)


def preserve_merge(first: DataFrame, second: DataFrame, key: str, column: str) -> DataFrame:
    """Union by key, upper-cased and with single spaces, with the distinct values of both in order (AG24)."""
    ids = lambda df, side: df.select(T.normalize_query(F.upper(F.col(key))).alias(key), F.lit(side).alias("side"), F.array(column).alias("v"))
    return unique_in_order(ids(first, 0).unionByName(ids(second, 1)), [key], ["side"], F.col("v"), column)


def overlap_stats(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """How many keys both have, and each alone (ST5)."""
    a, b = (df.select(key).distinct() for df in (first, second))
    return a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full_outer").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: node, neighbour and the edge's columns; a self-loop once."""
    rows = edges.withColumnRenamed("src", "node").withColumnRenamed("dst", "neighbour")
    back = edges.where(F.col("src") != F.col("dst")).withColumnRenamed("dst", "node").withColumnRenamed("src", "neighbour")
    return rows.unionByName(back)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges at each node; a self-loop counts twice (AG18)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def edge_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of the degrees of an edge's ends, 0 for one that isn't a node (AG18)."""
    d = degrees(nodes, edges)
    rows = edges.select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src", "left").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst", "left")
    return rows.select("src", "dst", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("degree"))


def relation_counts(ranked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each chunk of ranked entities (ord, id): its first entity's order, and how many of that entity's neighbours have it (AG19)."""
    chunks = ranked.join(nodes, "id").select("ord", "id", F.explode(T.split_ids(F.col("source_id"))).alias("chunk_id"))
    firsts = chunks.groupBy("chunk_id").agg(F.min_by(F.struct("ord", "id"), "ord").alias("e")).select("chunk_id", "e.ord", "e.id")
    near = both_ways(edges.select("src", "dst")).join(nodes.select(F.col("id").alias("neighbour"), "source_id"), "neighbour")
    near = near.select(F.col("node").alias("id"), F.col("neighbour"), F.explode(F.array_distinct(T.split_ids(F.col("source_id")))).alias("chunk_id")).distinct()
    counts = firsts.join(near, ["id", "chunk_id"], "left").groupBy("chunk_id", "ord").agg(F.count("neighbour").alias("relation_counts"))
    return counts


def related_segments(ranked: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Distinct segments of the k chunks with the highest relation counts (GR11). chunks: chunk_id, video_segment_id."""
    top = relation_counts(ranked, nodes, edges).orderBy(F.desc("relation_counts"), "ord", "chunk_id").limit(k)
    return chunks.join(F.broadcast(top.select("chunk_id")), "chunk_id").select(F.explode("video_segment_id").alias("segment_id")).distinct()


def neighbour_weights(starts: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k neighbours of the start nodes (id) with the largest weights in all (AG21, TK14)."""
    rows = both_ways(edges.select("src", "dst", "weight")).join(starts.select(F.col("id").alias("node")), "node", "left_semi")
    return rows.groupBy(F.col("neighbour").alias("id")).agg(F.sum("weight").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def graph_chunks(starts: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Chunks of the strongest neighbours (GR12)."""
    top = neighbour_weights(starts, edges, k)
    ids = nodes.join(F.broadcast(top.select("id")), "id").select(F.explode(T.split_ids(F.col("source_id"))).alias("chunk_id")).distinct()
    return chunks.join(ids, "chunk_id", "left_semi")


def community_schema(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities of (id, level, cluster): nodes, edges, chunks, occurrence and the next level's communities within (AG20)."""
    base = members.join(nodes.select("id", "source_id"), "id")
    chunk_sets = base.select("level", "cluster", F.explode(F.split("source_id", SEP, -1)).alias("chunk_id")).groupBy("level", "cluster").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    node_sets = members.groupBy("level", "cluster").agg(F.array_sort(F.collect_set("id")).alias("nodes"))
    ends = both_ways(edges.select("src", "dst")).select(F.col("node").alias("id"), F.concat(F.least("node", "neighbour"), F.lit(SEP), F.greatest("node", "neighbour")).alias("edge"))
    edge_sets = members.join(ends, "id").groupBy("level", "cluster").agg(F.array_sort(F.collect_set("edge")).alias("edges"))
    rows = node_sets.join(chunk_sets, ["level", "cluster"]).join(edge_sets, ["level", "cluster"], "left")
    most = chunk_sets.agg(F.max(F.size("chunk_ids")).alias("most"))
    levels = members.select("level").distinct().withColumn("next_level", F.lead("level").over(Window.orderBy("level")))  # one row per level
    inside = members.alias("a").join(F.broadcast(levels), "level").join(members.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("b.level") == F.col("next_level")))
    inside = inside.groupBy("a.level", "a.cluster", F.col("b.level").alias("sub_level"), F.col("b.cluster").alias("sub")).agg(F.count_distinct("a.id").alias("shared"))
    sizes = members.groupBy(F.col("level").alias("sub_level"), F.col("cluster").alias("sub")).agg(F.count_distinct("id").alias("size"))
    subs = inside.join(sizes, ["sub_level", "sub"]).where("shared = size").groupBy("level", "cluster").agg(F.array_sort(F.collect_set("sub")).alias("sub_communities"))
    rows = rows.join(subs, ["level", "cluster"], "left").join(F.broadcast(most))
    none = F.array().cast("array<string>")
    return rows.select("level", "cluster", F.concat(F.lit("Cluster "), "cluster").alias("title"), "nodes", F.coalesce("edges", none).alias("edges"), "chunk_ids", (F.size("chunk_ids") / F.col("most")).alias("occurrence"), F.coalesce("sub_communities", none).alias("sub_communities"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (smallest node_ord reachable) of nodes (id, node_ord) under edges (src, dst) (GR4)."""
    numbers = nodes.select("id", "node_ord")
    pairs = edges.join(numbers.select(F.col("id").alias("src"), F.col("node_ord").alias("a")), "src").join(numbers.select(F.col("id").alias("dst"), F.col("node_ord").alias("b")), "dst")
    found = shared.connected_components(pairs.select("a", "b"))
    return numbers.join(found, F.col("node_ord") == F.col("node"), "left").select("id", "node_ord", F.coalesce("component", "node_ord").alias("component"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest component (ties: that of the smallest ordinal), ids in upper case, sorted (GR8)."""
    of = components(nodes, edges)
    top = of.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    kept = of.join(F.broadcast(top), "component", "left_semi").select("id")
    upper = lambda c: T.strip(F.upper(F.col(c)))
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi")
    inside = inside.select(F.least(upper("src"), upper("dst")).alias("src"), F.greatest(upper("src"), upper("dst")).alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return kept.select(upper("id").alias("id")).distinct().orderBy("id"), inside.orderBy("src", "dst")


def resolution_keys(nodes: DataFrame, key=T.ascii_key) -> DataFrame:
    """Each node's keys: its own and those of the other names its description gives (GR3). nodes: node_ord, id, entity_type, description."""
    names = F.concat(F.array("id"), T.name_candidates(U.unescape(F.col("description"))))
    rows = _keyed(nodes.select("node_ord", "id", "entity_type", F.explode(names).alias("name")), key)
    return rows.where("key <> ''").select("node_ord", "id", "entity_type", "key").distinct()


def _keyed(rows: DataFrame, key) -> DataFrame:
    """rows with the key of their name; the one beyond ASCII is made step by step."""
    return U.with_entity_key(rows, "name", "key") if key is U.entity_key else rows.withColumn("key", key(F.col("name")))


#: Longer keys go by their SHA-256, which has so many characters.
KEY_CHARS = 64


def _alias_pairs(nodes: DataFrame, key) -> DataFrame:
    """alias_edges of resolution_keys by node_ord: a and b. Names, which may be whole texts, are read once and then stay behind."""
    names = F.concat(F.array("id"), T.name_candidates(U.unescape(F.col("description"))))
    rows = _keyed(nodes.select("node_ord", "entity_type", F.explode(names).alias("name")), key).drop("name").where("key <> ''")
    short = F.when(F.length("key") < KEY_CHARS, F.col("key")).otherwise(F.sha2("key", 256))
    keys = shared.materialize(rows.select("node_ord", "entity_type", short.alias("key")).distinct(), "keys")
    first = keys.groupBy("key").agg(F.min_by(F.struct("node_ord", "entity_type"), "node_ord").alias("f"))
    pairs = keys.join(first, "key").where(F.col("node_ord") != F.col("f.node_ord"))
    return pairs.where(T.types_compatible(F.col("f.entity_type"), F.col("entity_type"))).select(F.col("f.node_ord").alias("a"), F.col("node_ord").alias("b"))


def alias_edges(keys: DataFrame) -> DataFrame:
    """Links from the first node of a key to the others whose type is compatible with the first's (JN17). One link per other node, never pairs."""
    first = keys.groupBy("key").agg(F.min_by(F.struct("node_ord", "id", "entity_type"), "node_ord").alias("f"))
    rows = keys.join(first, "key").where(F.col("node_ord") != F.col("f.node_ord"))
    return rows.where(T.types_compatible(F.col("f.entity_type"), F.col("entity_type"))).select(F.col("f.id").alias("src"), F.col("id").alias("dst")).distinct()


def resolve_entities(nodes: DataFrame, edges: DataFrame, key=T.ascii_key, stripped=T.strip) -> tuple[DataFrame, DataFrame]:
    """Nodes of one component of alias links as one, edges moved to them (GR3, TK9, AG8).

    The representative has a known type, then no quotes, then the shortest name, then came first. Texts are the distinct parts
    in members' order. Self-loops go; parallel edges stay. For ids beyond ASCII pass functions.unicode's entity_key and unquote.
    """
    found = shared.connected_components(_alias_pairs(nodes, key)).withColumnRenamed("node", "node_ord")
    rows = nodes.join(found, "node_ord", "left").withColumns({"component": F.coalesce("component", "node_ord"), "lw_bare": stripped(F.col("id"))})
    kind = T.strip(F.coalesce("entity_type", F.lit("")))
    bare = F.col("lw_bare")
    score = F.struct(((kind != "") & (kind != "UNKNOWN")).cast("int").alias("typed"), (bare == F.col("id")).cast("int").alias("plain"), (-F.length(bare)).alias("short"), (-F.length("id")).alias("raw"), (-F.col("node_ord")).alias("first"))
    parts = lambda c: F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", T.split_ids(F.col(c)).alias("v")))), lambda x: x["v"]))), SEP)
    merged = rows.groupBy("component").agg(F.max_by("id", score).alias("rep"), *[parts(c).alias(c) for c in ("entity_type", "description", "source_id")])
    out = merged.select(F.col("rep").alias("id"), F.col("component").alias("node_ord"), "entity_type", "description", "source_id")
    to = rows.select("id", "component").join(merged.select("component", "rep"), "component").select("id", "rep")
    moved = edges.join(to.select(F.col("id").alias("src"), F.col("rep").alias("s")), "src").join(to.select(F.col("id").alias("dst"), F.col("rep").alias("d")), "dst").where("s <> d")
    moved = moved.select(F.col("s").alias("src"), F.col("d").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return out, moved


def merge_into_global(current: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], manifest: DataFrame, video: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The global graph with a video's, resolved again, and the manifest with the video; unchanged if it is listed already (GR5, D13, ST6).

    A video's attributes replace those of the same node. Nodes of the graph keep their numbers (node_ord); those that only the
    video has follow in its order, so that first-come rules hold through all videos.
    """
    if not manifest.where(F.col("video_name") == video).isEmpty():
        return (*current, manifest)
    nodes = compose(current[0].select("id", "entity_type", "description", "source_id"), new[0].select("id", "entity_type", "description", "source_id"), ["id"])
    start = current[0].agg(F.max("node_ord").alias("n")).first()["n"]
    least = new[0].agg(F.min("node_ord").alias("n")).first()["n"]
    orders = current[0].select("id", "node_ord").union(new[0].select("id", F.col("node_ord") + F.lit((-1 if start is None else start) + 1 - (least or 0))))
    nodes = nodes.join(orders.groupBy("id").agg(F.min("node_ord").alias("node_ord")), "id")
    edges = compose(current[1], new[1], ["src", "dst"])
    listed = manifest.select("video_name").union(manifest.sparkSession.createDataFrame([(video,)], "video_name string")).distinct()
    return (*resolve_entities(nodes, edges), listed)


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Clusters by label propagation, quicker and coarser than communities.hierarchy (GR9): each round a node takes its neighbours' most frequent label, the smallest of equals."""
    labels = nodes.select("id", F.col("id").alias("cluster"))
    near = shared.materialize(both_ways(edges.select("src", "dst")).where("node <> neighbour"), "neighbours")
    for _ in range(rounds):
        votes = near.join(labels.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("node", "cluster").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("cluster"))).alias("b"))
        labels = shared.materialize(labels.join(best, F.col("id") == F.col("node"), "left").select("id", F.coalesce("b.cluster", "cluster").alias("cluster")), "labels")
    return labels.select("id", F.lit(0).alias("level"), "cluster")


def random_walks(nodes: DataFrame, edges: DataFrame, length: int = 6, walks: int = 2, seed: int = 7) -> DataFrame:
    """First-order walks of operators.walks over edges that may have no weight (GR10)."""
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    return node_walks.walks(nodes, weighted, length, walks, seed=seed)


def node_vectors(walks: DataFrame, size: int = 32, window: int = 3, seed: int = 7) -> DataFrame:
    """id and vector of every node on the walks, trained in blocks (GR10)."""
    return node_walks.vectors(walks, size, window, epochs=1, seed=seed)


def snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A chunk's graph as lines of a prompt; None where it is empty (TX44). nodes: chunk_id, ord, entity_name, entity_type, description."""
    lines = nodes.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit('- "'), "entity_name", F.lit('" ('), "entity_type", F.lit("): "), "description").alias("l")))), lambda x: x["l"]), "\n").alias("entities"))
    links = edges.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit('- "'), "src", F.lit('" -> "'), "dst", F.lit('" (w='), F.col("weight").cast("string"), F.lit("): "), "description").alias("l")))), lambda x: x["l"]), "\n").alias("relations"))
    return lines.join(links, "chunk_id", "full_outer").select("chunk_id", F.coalesce("entities", F.lit("None")).alias("entities"), F.coalesce("relations", F.lit("None")).alias("relations"))
