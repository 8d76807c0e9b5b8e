"""Sanitizing before and after the graph is built: kept rows, quarantined rows and a report, each as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright import shared
from lorewright.functions import text as T
from lorewright.functions import unicode as U
from lorewright.operators import graph


@dataclass
class Sanitized:
    """What a stage keeps (by table), drops, and counts."""

    tables: dict[str, DataFrame]
    quarantine: DataFrame
    report: DataFrame


def _quarantine(rows: DataFrame, stage: str, key: str, reason: Column, value: Column) -> DataFrame:
    return rows.select("video_name", F.lit(stage).alias("stage"), F.col(key).cast("string").alias("key"), reason.alias("reason"), value.cast("string").alias("value"))


def _with(clean, rows: DataFrame, **texts: Column) -> DataFrame:
    """rows with the cleaned texts; the Unicode-wide cleaning normalises each text once."""
    return U.with_clean(rows, **texts) if clean is U.clean_text_full else rows.withColumns({name: clean(text) for name, text in texts.items()})


def pre_segments(segments: DataFrame, clean=U.clean_text_full) -> tuple[DataFrame, DataFrame]:
    """Segments with a valid time and some text, cleaned, their frame times clamped and sorted; and all rows with the reason of those dropped (FLT1 to FLT4)."""
    rows = _with(clean, segments.withColumn("span", T.parse_time(F.col("time"))), c=F.coalesce("content", F.lit("")), t=F.coalesce("transcript", F.lit("")))
    reason = F.when(F.col("span").isNull(), "invalid_time").when((F.col("c.text") == "") & (F.col("t.text") == ""), "empty_after_clean")
    rows = rows.withColumn("reason", reason).withColumn("hits", F.when(F.col("reason").isNull() | (F.col("reason") != "invalid_time"), sum_hits("c") + sum_hits("t")).otherwise(0))
    rows = shared.materialize(rows, "segments")  # several tables and counts come from it
    good = rows.where("reason is null").select(
        "video_name", "seg_ord", "segment_idx", T.render_time(F.col("span")).alias("time"), F.col("c.text").alias("content"), F.col("t.text").alias("transcript"),
        T.clamp_times(F.col("frame_times"), F.col("span")).alias("frame_times"),
    )
    return good, rows


def sum_hits(c: str) -> Column:
    return F.col(f"{c}.meta_tags_removed") + F.col(f"{c}.meta_patterns_removed")


def frames_of(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames of the segments kept; the segment is the frame's own, else its key's first part (FLT5, FLT8). Keys without an underscore go."""
    rows = frames.where(F.contains("frame_key", F.lit("_"))).withColumn("segment_idx", F.coalesce("segment_idx", F.substring_index("frame_key", "_", 1)))
    return rows.join(segments.select("video_name", "segment_idx"), ["video_name", "segment_idx"], "left_semi")


def names_of(frames: DataFrame, column: str, aliases: dict[str, list[str]], ordered: bool) -> DataFrame:
    """The frames with the canonical names in an array column: distinct, UNKNOWN left out; in order before the build, sorted after it without blanks (MV12)."""
    key = ["video_name", "frame_key"]
    names = frames.select(*key, F.posexplode(column).alias("at", "raw"))
    if not ordered:
        names = names.where(T.strip(F.col("raw")) != "")
    names = U.normalize_names(names, "raw", aliases).where("name <> 'UNKNOWN' and name <> ''")
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])) if ordered else F.array_sort(F.collect_set("name"))
    found = names.groupBy(*key).agg(listed.alias("found"))
    rows = frames.join(found, key, "left")
    return rows.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("found", F.array().cast("array<string>")))).drop("found")


def clean_frames(frames: DataFrame, aliases: dict[str, list[str]], ordered: bool, clean=U.clean_text_full) -> DataFrame:
    rows = cleaned(frames, "transcript", "vlm_output", clean=clean)
    rows = names_of(names_of(rows.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))), "entities", aliases, ordered), "partners", aliases, ordered)
    named = U.normalize_names(rows, "main_champ", aliases, out="lw_main")
    return named.withColumn("main_champ", F.when(F.col("main_champ").isNotNull(), F.col("lw_main"))).drop("lw_main")


def cleaned(rows: DataFrame, *columns: str, clean=U.clean_text_full) -> DataFrame:
    """rows with the columns' texts cleaned, null ones empty."""
    done = _with(clean, rows, **{f"lw_{c}": F.coalesce(c, F.lit("")) for c in columns})
    return done.withColumns({c: F.col(f"lw_{c}.text") for c in columns}).drop(*[f"lw_{c}" for c in columns])


def sanitize_pre(segments: DataFrame, frames: DataFrame, paths: DataFrame, aliases: dict[str, list[str]]) -> Sanitized:
    """Q7: segments, frames and paths before the build."""
    good, all_segments = pre_segments(segments)
    bad_keys = frames.where(~F.contains("frame_key", F.lit("_")))
    kept = frames_of(frames, good)
    tables = {"segments": good, "frames": clean_frames(kept, aliases, ordered=True), "video_paths": paths.where("path is not null")}
    quarantine = _quarantine(all_segments.where("reason is not null"), "pre_build", "segment_idx", F.col("reason"), F.when(F.col("reason") == "invalid_time", F.col("time")))
    quarantine = quarantine.unionByName(_quarantine(bad_keys, "pre_build", "frame_key", F.lit("invalid_key"), F.lit(None)))
    counts = file_counts({"segments": (segments, good), "frames": (frames, kept), "video_paths": (paths, tables["video_paths"])})
    hits = all_segments.groupBy("video_name").agg(F.sum("hits").alias("contamination_hits"))
    return Sanitized(tables, quarantine, counts.join(hits, "video_name", "left"))


def file_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """video_name, file, in, out and dropped of each table (AG17)."""
    rows = None
    for name, (before, after) in pairs.items():
        both = before.select("video_name", F.lit(1).alias("i"), F.lit(0).alias("o")).union(after.select("video_name", F.lit(0), F.lit(1)))
        both = both.groupBy("video_name").agg(F.sum("i").alias("in"), F.sum("o").alias("out")).withColumn("file", F.lit(name))
        rows = both if rows is None else rows.unionByName(both)
    return rows.select("video_name", "file", "in", "out", (F.col("in") - F.col("out")).alias("dropped"))


def valid_chunks(chunks: DataFrame, clean=U.clean_text_full) -> tuple[DataFrame, DataFrame]:
    """Chunks with text and with references to segments of their own video, cleaned; and all rows with the reason of those dropped (FLT6)."""
    rows = _with(clean, chunks, c=F.coalesce("content", F.lit(""))).withColumn("refs", F.filter(F.coalesce("video_segment_id", F.array().cast("array<string>")), lambda x: x.startswith(F.concat("video_name", F.lit("_")))))
    rows = rows.withColumn("reason", F.when(F.col("c.text") == "", "empty_after_clean").when(F.size("refs") == 0, "no_valid_segment_refs"))
    rows = shared.materialize(rows, "chunks")  # several tables and counts come from it
    good = rows.where("reason is null").select(
        "video_name", "chunk_id", "chunk_ord", F.greatest(F.lit(1), F.floor(F.length("c.text") / 4)).cast("long").alias("tokens"), F.col("c.text").alias("content"),
        F.coalesce("chunk_order_index", F.lit(0)).alias("chunk_order_index"), F.col("refs").alias("video_segment_id"), F.lit(True).alias("sanitized"),
    )
    return good, rows


def referenced_segments(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments that some chunk of their video refers to (FLT7)."""
    used = chunks.select("video_name", F.explode("video_segment_id").alias("ref")).select("video_name", F.substring_index("ref", "_", -1).alias("segment_idx"))
    return segments.join(used.distinct(), ["video_name", "segment_idx"], "left_semi")


def sanitize_post(chunks: DataFrame, segments: DataFrame, frames: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: dict[str, list[str]]) -> Sanitized:
    """Q8: chunks, segments, frames and one video set's graph after the build, referential across all of them.

    Names are canonical before rows are compared; vectors are rebuilt by hooks.rebuild_vectors from what this returns (MV17).
    """
    good, all_chunks = valid_chunks(chunks)
    kept = cleaned(referenced_segments(segments, good), "content", "transcript")
    shots = clean_frames(frames_of(frames, kept), aliases, ordered=False)
    named = U.normalize_names(cleaned(nodes, "description").withColumn("raw", U.dequote_id(F.col("id"))), "raw", aliases).withColumns({"id": F.col("name"), "ord": F.col("node_ord")})
    new_nodes = graph.post_merge_nodes(named.select("ord", "id", "entity_type", "description", "source_id"), good)
    links = cleaned(edges, "description").withColumn("ord", F.col("edge_ord"))
    for end in ("src", "dst"):
        links = U.normalize_names(links.withColumn("raw", U.dequote_id(F.col(end))), "raw", aliases).withColumn(end, F.col("name"))
    new_edges = graph.post_merge_edges(links.select("ord", "src", "dst", "weight", "order", "description", "source_id"), new_nodes, good)
    quarantine = _quarantine(all_chunks.where("reason is not null"), "post_build", "chunk_id", F.col("reason"), F.lit(None))
    report = file_counts({"text_chunks": (chunks, good), "segments": (segments, kept), "frames": (frames, shots)})
    return Sanitized({"chunks": good, "segments": kept, "frames": shots, "nodes": new_nodes, "edges": new_edges}, quarantine, report)


def light_global(nodes: DataFrame) -> DataFrame:
    """Global nodes with unescaped ids without their quotes; of equal ids the last (FLT19)."""
    rows = nodes.withColumn("id", U.dequote_id(F.col("id")))
    others = [c for c in rows.columns if c not in ("id", "node_ord")]
    return rows.groupBy("id").agg(F.max("node_ord").alias("node_ord"), F.max_by(F.struct(*others), "node_ord").alias("v")).select("id", "node_ord", "v.*")


def status(report: DataFrame) -> DataFrame:
    """pass, warn where something was dropped, fail where nothing came out, by video (AG17)."""
    by = report.groupBy("video_name").agg(F.sum("out").alias("out"), F.sum("dropped").alias("dropped"))
    return by.select("video_name", F.when(F.col("out") == 0, "fail").when(F.col("dropped") > 0, "warn").otherwise("pass").alias("status"))


def missing(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't stored (FLT20, JN9)."""
    return rows.join(stored.select(*key), key, "left_anti")


def fetch(ids: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """The fields of stored rows for each of ids (array column ids), in their order, null where there is none (FLT21)."""
    return ids.select(F.posexplode("ids").alias("at", "id")).join(stored.select("id", *fields), "id", "left").select("at", "id", *fields)


def store_warnings(chunks: DataFrame, chunk_vectors: DataFrame, segments: DataFrame, nodes: DataFrame, entity_vectors: DataFrame) -> DataFrame:
    """video_name and warning: other numbers of chunks and vectors, malformed or missing segment references, more than max(5, a quarter) of nodes without their vectors (FLT18)."""
    n = lambda df, name: df.groupBy("video_name").agg(F.count("*").alias(name))
    counts = n(chunks, "chunks").join(n(chunk_vectors, "chunk_vectors"), "video_name", "full_outer").join(n(nodes, "nodes"), "video_name", "full_outer").join(n(entity_vectors, "entity_vectors"), "video_name", "full_outer").na.fill(0)
    rows = counts.where("chunks <> chunk_vectors").select("video_name", F.lit("chunk count mismatch").alias("warning"))
    rows = rows.union(counts.where("abs(nodes - entity_vectors) > greatest(5, 0.25 * nodes)").select("video_name", F.lit("entity count mismatch")))
    refs = chunks.select("video_name", F.explode("video_segment_id").alias("ref"))
    bad = refs.where(~F.contains("ref", F.lit("_"))).select("video_name", F.lit("malformed segment reference"))
    gone = refs.where(F.contains("ref", F.lit("_"))).select("video_name", F.substring_index("ref", "_", -1).alias("segment_idx")).join(segments.select("video_name", "segment_idx"), ["video_name", "segment_idx"], "left_anti")
    return rows.union(bad).union(gone.select("video_name", F.lit("missing segment"))).distinct()
