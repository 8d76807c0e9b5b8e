"""The four retrieval branches over a batch of queries.

A query is a row (query_id, query, vector, intent); a hit is a row of schemas.HITS. Branches are unions, never loops: all
queries are answered in one plan. Query batches are the small side; they are broadcast only if their number is checked
(shared.checked), else joined by nested blocks that Spark spreads over the stored rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lorewright import shared
from lorewright.functions import text as T
from lorewright.functions import vectors as V
from lorewright.schemas import Settings

BRANCHES = ("dense_chunk", "entity_graph", "global_graph", "visual_support")


def top_k(rows: DataFrame, key: list[str], score: str, ties: list[str], k: int) -> DataFrame:
    """The k rows of each key with the highest score; a rank limit that Spark applies before the shuffle too."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Stored vectors and queries of a block (fewer where vectors are long), queries whose blocks are broadcast, and how far a
#: matrix product may be from the cosine in the order of the elements.
ROWS_BLOCK, ASKED_BLOCK, BLOCK_ELEMENTS, ASKED_BROADCAST, MARGIN = 4_096, 512, 1 << 18, 50_000, 1e-9
#: Rows or candidates that a task holds before it gives what it has and starts anew.
HELD = 1_000_000


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Each column as lists of up to `most` rows, with the rows' vectors all of one length in a block."""
    for b in batches:
        sizes = pc.list_value_length(b.column("vector")).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            same = b.filter(pa.array(sizes == size))
            step = max(64, min(most, BLOCK_ELEMENTS // max(1, int(size))))
            for at in range(0, same.num_rows, step):
                part = same.slice(at, step)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
                yield pa.record_batch(lists, part.schema.names)


def _in_blocks(rows: DataFrame, most: int, prefix: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in rows.schema)
    found = rows.mapInArrow(lambda batches: _blocks(batches, most), schema)
    return found.select(*[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns])


def _best(key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have one of their key's k highest scores, ties with the k-th included; the keys with k rows at least, and their k-th score."""
    order = np.lexsort((-score, key))
    keys = key[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(keys)])
    bound = np.where(size >= k, score[order[np.minimum(first + k, first + size) - 1]], -np.inf)
    return order[score[order] >= np.repeat(bound, size)], keys[first[size >= k]], bound[size >= k]


def _nearest(k: int, threshold: float | None, schema: pa.Schema):
    """Pairs of blocks: the best of each query and video in this task, k and their ties at least.

    A matrix product tells which pairs can be among them; only those are scored in the order of the elements, as SQL does:
    the product over the root of both squares' product, within -1 and 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, codes, asked, rows = [], {}, {}, 0  # (query, video, place, score); videos; queries by id; blocks held
        held: list[pa.StructArray] = []
        names, bounds, pending, last = [], {}, 0, None

        def compact() -> None:
            nonlocal kept, pending
            if kept:
                q, v, place, score = (np.concatenate(x) for x in zip(*kept, strict=True))
                best, keys, bound = _best(q * len(codes) + v, np.where(np.isnan(score), np.inf, score), k)
                kept = [(q[best], v[best], place[best], score[best])]
                bounds.clear()
                bounds.update(zip(zip((keys // len(codes)).tolist(), (keys % len(codes)).tolist(), strict=True), bound.tolist(), strict=True))
            pending = 0

        def give() -> Iterator[pa.RecordBatch]:
            compact()
            if kept:
                q, _, place, score = kept[0]
                payload = pa.concat_arrays(held)
                for at in range(0, len(q), 10_000):
                    part = slice(at, at + 10_000)
                    found = payload.take(pa.array(place[part]))
                    columns = [pa.array(names, schema.field("query_id").type).take(pa.array(q[part])), *found.flatten(), pa.array(score[part])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                ids, y = cell("a_query_id"), cell("a_vector")
                x, videos = cell("v_vector"), cell("v_video_name")
                size = len(x[0])  # one length in a block
                if size != len(y[0]):
                    continue  # vectors of other lengths have no cosine
                payload_names = [n[2:] for n in batch.schema.names if n.startswith("v_") and n != "v_vector"]
                payload = pa.StructArray.from_arrays([cell(f"v_{n}") for n in payload_names], payload_names)
                mark = (size, payload)
                if last is None or last[0] != mark[0] or not last[1].equals(payload):
                    if rows > HELD or pending + sum(len(z[0]) for z in kept) > 4 * HELD:
                        yield from give()
                        kept, held, rows = [], [], 0
                        bounds.clear()
                    last, start = mark, rows
                    held.append(payload)
                    rows += len(payload)
                    code = np.array([codes.setdefault(v, len(codes)) for v in videos.to_pylist()])
                    matrix = x.flatten().to_numpy(zero_copy_only=False).reshape(len(videos), -1)
                    # Of equal vectors of a video only the k smallest ids can be among the best.
                    place = np.argsort(np.asarray(pc.sort_indices(cell("v_id"), null_placement="at_start")))
                    _, group = np.unique(np.column_stack((code.astype(np.float64), matrix)).view(np.uint64), axis=0, return_inverse=True)
                    order = np.lexsort((place, group.ravel()))
                    g = group.ravel()[order]
                    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
                    use = np.sort(order[rank < k])
                    use = use[np.argsort(code[use], kind="stable")]
                    code, matrix = code[use], np.ascontiguousarray(matrix[use])
                    square = _dots(matrix, matrix)
                    unit = matrix / np.sqrt(square)[:, None]
                    cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                qs = np.array([asked.setdefault(z, len(asked)) for z in ids.to_pylist()])
                names.extend(list(asked)[len(names) :])
                query = y.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                query_square = _dots(query, query)
                near = unit @ (query / np.sqrt(query_square)[:, None]).T
                for a, b in zip(cuts, np.r_[cuts[1:], len(code)], strict=True):
                    part, video = near[a:b], int(code[a])
                    bound = np.array([bounds.get((int(z), video), -np.inf) for z in qs])
                    if threshold is not None:
                        bound = np.maximum(bound, threshold)
                    if b - a > k:
                        bound = np.fmax(bound, np.partition(part, b - a - k, axis=0)[b - a - k])
                    r, c = np.nonzero(~(part < bound - MARGIN))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score = np.clip(_dots(matrix[a + r], query[c]) / np.sqrt(square[a + r] * query_square[c]), -1.0, 1.0)
                    if threshold is not None:
                        good = (score > threshold) | np.isnan(score)
                        r, c, score = r[good], c[good], score[good]
                    kept.append((qs[c], np.full(len(c), video), start + use[a + r], score))
                    pending += len(c)
                if pending > HELD:
                    compact()
        yield from give()

    return run


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in the order of the elements."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def nearest(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The k stored vectors of each video nearest to each query by cosine (MV1, JN15, TK1, TK2, TK11; FLT16 with a threshold).

    vectors: video_name, id, vector and others. Each stored row meets each query of the batch, a block of rows and one of
    queries at a time; a task gives its best rows of each query and video only. Vectors of another length than the query's,
    zero vectors and those with nulls take no part.
    """
    shared.bound_batches(queries.sparkSession)
    whole = lambda rows, *names: rows.select(*names, F.col("vector").cast("array<double>").alias("vector")).where(V.norm(F.col("vector")) > 0)
    others = [c for c in vectors.columns if c not in ("video_name", "id", "vector")]
    asked = whole(queries, "query_id")
    number = asked.count()
    asked = _in_blocks(asked.repartition(max(1, -(-number // ASKED_BLOCK))), 2 * ASKED_BLOCK, "a")
    rows = _in_blocks(whole(vectors, "video_name", "id", *others), ROWS_BLOCK, "v")
    pairs = rows.crossJoin(F.broadcast(asked) if number <= ASKED_BROADCAST else asked)
    out = StructType([queries.schema["query_id"], *[vectors.schema[c] for c in ("video_name", "id", *others)], StructField("score", DoubleType())])
    return top_k(pairs.mapInArrow(_nearest(k, threshold, to_arrow_schema(out)), out), ["query_id", "video_name"], "score", ["id"], k)


def resolve(found: DataFrame, chunks: DataFrame, branch: str, semantic: Column, entity: Column, graph: Column) -> DataFrame:
    """Hits of (query_id, video_name, chunk_id, arrival) rows; those without a chunk go (JN1)."""
    rows = found.withColumns({"score_semantic": semantic.cast("double"), "score_entity": entity.cast("double"), "score_graph": graph.cast("double")})
    rows = rows.join(chunks.select("video_name", "chunk_id", F.coalesce("content", F.lit("")).alias("chunk_text"), F.col("video_segment_id").alias("segment_ids")), ["video_name", "chunk_id"])
    return rows.select(
        "query_id", F.lit(BRANCHES.index(branch)).alias("branch_ord"), F.col("arrival").cast("long").alias("arrival"), "video_name", "chunk_id", F.lit(branch).alias("source"),
        "chunk_text", "segment_ids", "score_semantic", "score_entity", "score_graph", F.lit(0.0).alias("final_score"),
    )


def dense(queries: DataFrame, chunk_vectors: DataFrame, chunks: DataFrame, k: int = Settings.chunks_k) -> DataFrame:
    """Q1: the chunks nearest to each query, per video."""
    found = nearest(queries, chunk_vectors, k).withColumnsRenamed({"id": "chunk_id", "rank": "arrival"})
    return resolve(found, chunks, "dense_chunk", F.col("score"), F.lit(0.0), F.lit(0.0))


def entity_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of entity hits (…, video_name, entity_name): the name as it is, without quotes, in upper or lower case; only where none is, any node equal but for case and quotes (JN2)."""
    bare = lambda c: F.regexp_replace(c, '^"+|"+$', "")
    name = F.col("entity_name")
    tried = found.withColumn("id", F.explode(F.array_distinct(F.array(name, bare(name), F.upper(name), F.lower(name)))))
    exact = tried.join(nodes.select("video_name", "id", "source_id"), ["video_name", "id"])
    rest = found.join(exact.select("query_id", "video_name", "entity_name").distinct(), ["query_id", "video_name", "entity_name"], "left_anti")
    loose = nodes.select("video_name", "id", "source_id", bare(F.lower("id")).alias("k"))
    fallback = rest.withColumn("k", F.lower(bare(name))).join(loose, ["video_name", "k"]).drop("k")
    return exact.unionByName(fallback.select(*exact.columns))


def entity_graph(queries: DataFrame, entity_vectors: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """GR6: chunks of the nearest entities, their neighbours and the edges between, each with its best score (TK2, JN2 to JN4, MV2, AG9, TK3)."""
    s = settings or Settings()
    found = nearest(queries, entity_vectors, s.entities_k).where(T.strip(F.coalesce("entity_name", F.lit(""))) != "")
    starts = entity_nodes(found.select("query_id", "video_name", "entity_name", F.col("score").alias("base")), nodes).select("query_id", "video_name", "id", "source_id", "base")
    own = starts.select("query_id", "video_name", F.col("source_id").alias("ids"), F.col("base").alias("score"))
    near = edges.select("video_name", F.col("src").alias("id"), F.col("dst").alias("other"), "weight", F.col("source_id").alias("edge_ids"))
    near = near.unionByName(edges.where("src <> dst").select("video_name", F.col("dst").alias("id"), F.col("src").alias("other"), "weight", F.col("source_id").alias("edge_ids")))
    near = starts.select("query_id", "video_name", "id", "base").join(near, ["video_name", "id"]).withColumn("score", V.neighbour_boost(F.col("base"), F.col("weight")))
    near = near.join(nodes.select("video_name", F.col("id").alias("other"), F.col("source_id").alias("node_ids")), ["video_name", "other"], "left")
    scored = own.unionByName(near.select("query_id", "video_name", F.col("node_ids").alias("ids"), "score")).unionByName(near.select("query_id", "video_name", F.col("edge_ids").alias("ids"), "score"))
    scored = scored.select("query_id", "video_name", F.explode(T.split_ids(F.col("ids"))).alias("chunk_id"), "score").groupBy("query_id", "video_name", "chunk_id").agg(F.max("score").alias("score"))
    best = top_k(scored, ["query_id", "video_name"], "score", ["chunk_id"], s.graph_k).withColumnRenamed("rank", "arrival")
    return resolve(best, chunks, "entity_graph", F.lit(0.0), F.col("score"), F.col("score"))


def shared_words(queries: DataFrame, rows: DataFrame, key: list[str], name: Column | None = None) -> DataFrame:
    """Per query and key that have a word in common or named: n_query, n_words, common (words of both), named (TX13, ST3).

    queries: query_id, q (distinct words); rows: key, words (distinct), and what `name` reads. An equi-join on words, and on the
    first characters of words in names, which are then held against the name: each row's words are made once, and only rows
    with a query's word go on; a filter on them before would be moved to where they come from and make them again. Counts are partial sums, so that neither a frequent word nor a long text gathers in one task.
    Keys are unique.
    """
    asked = queries.where(F.size("q") > 0).select("query_id", F.size("q").alias("n_query"), F.explode("q").alias("word"))
    entry = lambda gram, rest: F.struct(gram.alias("gram"), rest.alias("rest"))
    words = F.transform("words", lambda w: entry(w, F.lit(None).cast("string")))
    if name is None:
        asked, found = asked.select("*", F.col("word").alias("gram"), F.lit(False).alias("is_name")), words
    else:
        longest = queries.agg(F.max(F.array_max(F.transform("q", F.length)))).first()[0] or 0
        asked = asked.select("*", F.inline(F.array(F.struct(F.col("word").alias("gram"), F.lit(False).alias("is_name")), F.struct(T.first_gram(F.col("word")).alias("gram"), F.lit(True).alias("is_name")))))
        found = F.concat(words, F.transform(T.name_grams(name, longest), lambda x: entry(x["gram"], x["rest"])))
    found = F.when(F.size("words") > 0, found)
    met = rows.select(*key, F.size("words").alias("n_words"), F.inline(found)).withColumn("is_name", F.col("rest").isNotNull())
    met = met.join(shared.checked(asked), ["gram", "is_name"]).where(~F.col("is_name") | F.startswith("rest", "word"))
    return met.groupBy(*key, "query_id").agg(F.first("n_query").alias("n_query"), F.first("n_words").alias("n_words"), F.count_if(~F.col("is_name")).alias("common"), F.max("is_name").alias("named"))


def lexical_scores(queries: DataFrame, rows: DataFrame, key: list[str], name: str, description: str) -> DataFrame:
    """key, query_id, score: the Jaccard overlap of the words, and 0.15 more if the name holds a query word; only above 0 (TX13)."""
    plain = T.plain_name(F.col(name))
    words = T.tokens(F.concat_ws(" ", plain, F.lower(F.coalesce(description, F.lit("")))))
    found = shared_words(queries, rows.select(*key, words.alias("words"), plain.alias("lw_plain")), key, F.coalesce("lw_plain", F.lit("")))
    score = F.col("common") / (F.col("n_query") + F.col("n_words") - F.col("common")) + F.when(F.col("named"), 0.15).otherwise(0.0)
    return found.select(*key, "query_id", score.alias("score"))


def global_graph(queries: DataFrame, nodes: DataFrame, chunks: DataFrame, k: int = Settings.graph_k) -> DataFrame:
    """GR7: chunks of the k nodes of the global graph that are most like the query in words (JN16, TX13, TK4). k counts nodes; a chunk is its last video's (JN5)."""
    scored = lexical_scores(queries.select("query_id", T.tokens(F.col("query")).alias("q")), nodes, ["node_ord", "id"], "id", "description")
    best = top_k(scored, ["query_id"], "score", ["node_ord"], k).join(nodes.select("node_ord", "id", "source_id"), ["node_ord", "id"])
    owner = chunks.groupBy("chunk_id").agg(F.max("video_name").alias("video_name"))
    found = best.select("query_id", "score", "rank", F.posexplode(T.split_ids(F.col("source_id"))).alias("at", "chunk_id")).join(owner, "chunk_id")
    found = found.withColumn("arrival", F.col("rank") * 1_000_000 + F.col("at"))
    return resolve(found, chunks, "global_graph", F.lit(0.0), F.lit(0.0), F.col("score"))


def visual_support(queries: DataFrame, frames: DataFrame, chunks: DataFrame, k: int = Settings.frames_k) -> DataFrame:
    """Q2: chunks of the frames whose description or transcript has most of a visual query's words, k frames a video (TK5, JN6)."""
    asked = queries.where("intent.is_visual_detail").select("query_id", T.tokens(F.col("query")).alias("q"))
    words = T.tokens(F.concat_ws(" ", F.coalesce("vlm_output", F.lit("")), F.coalesce("transcript", F.lit(""))))
    key = ["video_name", "frame_key", "segment_idx"]
    rows = shared_words(asked, frames.select(*key, words.alias("words")), key)
    rows = rows.withColumn("score", F.col("common") / F.col("n_query"))
    best = top_k(rows, ["query_id", "video_name"], "score", ["frame_key"], k).where(T.strip(F.col("segment_idx")) != "")
    refs = chunks.select("video_name", "chunk_id", F.explode("video_segment_id").alias("ref"))
    found = best.withColumn("ref", F.concat("video_name", F.lit("_"), T.strip(F.col("segment_idx")))).join(refs, ["video_name", "ref"]).withColumnRenamed("rank", "arrival")
    return resolve(found, chunks, "visual_support", F.lit(0.0), F.col("score"), F.lit(0.0))


def retrieve_all(*branches: DataFrame) -> DataFrame:
    """ST1, Q3: the union of the branches' hits, in the branches' order by branch_ord."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def route_videos(queries: DataFrame, summaries: DataFrame, threshold: float = 0.4, k: int = 3) -> DataFrame:
    """The k videos whose summaries are most like the query, above the threshold (TK12). summaries: video_name, vector."""
    rows = nearest(queries, summaries.withColumn("id", F.col("video_name")), 1, threshold).drop("rank")
    return top_k(rows, ["query_id"], "score", ["video_name"], k)


def routed_query(queries: DataFrame, summaries: DataFrame, chunk_vectors: DataFrame, entity_vectors: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, chunk_k: int = 25, entity_k: int = 25, neighbour_k: int = 10, threshold: float = 0.4) -> DataFrame:
    """Q13: in the routed videos, the nearest chunks and then those of the strongest neighbours of the nearest entities; the first of a chunk id stays (TK13, TK14)."""
    routed = route_videos(queries, summaries, threshold).select("query_id", "video_name", F.col("rank").alias("video_rank"))
    near = nearest(queries, chunk_vectors, chunk_k).where(F.col("score") >= threshold).join(routed, ["query_id", "video_name"]).select("query_id", "video_name", "video_rank", F.col("id").alias("chunk_id"), "score", F.lit("vector_search").alias("type"), F.col("rank").alias("at"))
    starts = nearest(queries, entity_vectors, entity_k).where(F.col("score") >= threshold).join(routed, ["query_id", "video_name"])
    ends = edges.select("video_name", F.col("src").alias("id"), F.col("dst").alias("other"), "weight").unionByName(edges.select("video_name", F.col("dst").alias("id"), F.col("src").alias("other"), "weight"))
    summed = starts.select("query_id", "video_name", "video_rank", F.col("entity_name").alias("id")).join(ends, ["video_name", "id"]).groupBy("query_id", "video_name", "video_rank", F.col("other").alias("id")).agg(F.sum("weight").alias("w"))
    top = top_k(summed, ["query_id", "video_name"], "w", ["id"], neighbour_k)
    ids = top.join(nodes.select("video_name", "id", "source_id"), ["video_name", "id"]).select("query_id", "video_name", "video_rank", F.explode(T.split_ids(F.col("source_id"))).alias("chunk_id")).distinct()
    more = ids.withColumns({"score": F.lit(1.0), "type": F.lit("knowledge_graph"), "at": F.lit(1_000_000)})
    w = Window.partitionBy("query_id", "chunk_id").orderBy("video_rank", "at", "video_name")
    rows = near.unionByName(more).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return rows.join(chunks.select("video_name", "chunk_id", "content"), ["video_name", "chunk_id"]).orderBy("query_id", "video_rank", "at", "chunk_id")


def snippet_context(rows: DataFrame) -> DataFrame:
    """Snippets of 2000 characters with their video, or "continued" where the row before has the same (TX46). rows: query_id, ord, video_name, content."""
    w = Window.partitionBy("query_id").orderBy("ord")
    body = F.when(F.length("content") > 2000, F.concat(F.substr("content", F.lit(1), F.lit(2000)), F.lit("... (truncated)"))).otherwise(F.col("content"))
    same = F.lag("video_name").over(w) == F.col("video_name")
    line = F.when(same, F.concat(F.lit("(Continued from previous source video)\n"), body, F.lit("\n"))).otherwise(F.concat(F.lit("Source Video: "), "video_name", F.lit("\nContent:\n"), body, F.lit("\n")))
    return rows.select("query_id", "ord", line.alias("part"))


def hybrid_segments(entity_segments: DataFrame, visual_segments: DataFrame, captions: DataFrame, keep: Column) -> DataFrame:
    """Q11: the union of segments of both kinds in order of video and number, those kept by the model's answer, or all where it keeps none (ST4, TK10, JN19).

    entity_segments and visual_segments: query_id, segment_id; captions: video_name, segment_idx, content, verdict; keep tells a verdict of yes.
    """
    both = entity_segments.select("query_id", "segment_id").union(visual_segments.select("query_id", "segment_id")).distinct()
    rows = both.withColumn("s", T.segment_ref(F.col("segment_id"))).select("query_id", "segment_id", "s.video_name", "s.segment_idx").join(captions, ["video_name", "segment_idx"])
    rows = rows.withColumn("kept", keep).withColumn("any", F.max("kept").over(Window.partitionBy("query_id")))
    return rows.where("kept or not any").drop("any").orderBy("query_id", "video_name", F.col("segment_idx").try_cast("int"))
