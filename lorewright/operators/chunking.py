"""Chunks from ordered texts, and running budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T

def chunk_numbers(segments: DataFrame, limit: int) -> DataFrame:
    """video_name, ord and k, the chunk each segment falls in. segments: video_name, ord, n (characters).

    Each step depends on the one before it, so a video's segments are folded in one place; only an ordinal and a length of
    each go there, never a text.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        held, k, out = 0, 0, []
        for n in rows["n"].tolist():
            if held + n <= limit:
                held += 1 + n
            else:
                held, k = n, k + 1
            out.append(k)
        return pd.DataFrame({"video_name": rows["video_name"], "ord": rows["ord"], "k": out})

    kinds = dict(segments.dtypes)
    return segments.select("video_name", "ord", "n").groupBy("video_name").applyInPandas(fold, f"video_name {kinds['video_name']}, ord {kinds['ord']}, k bigint")


def chunk_pack(segments: DataFrame, max_tokens: int = 1200) -> DataFrame:
    """Chunks of a video's segments in order (AG1, AG2's id, WN6). segments: video_name, ord (one of each in a video), ref, text.

    A segment is clipped to the limit of 4 characters a token. It joins the chunk, after a space, if both lengths without that
    space are within the limit; so a first chunk counts its leading space, and a chunk may pass the limit by one.
    """
    limit = 4 * max_tokens
    docs = segments.select("video_name", "ord", "ref", F.substr(F.col("text"), F.lit(1), F.lit(limit)).alias("text"))
    docs = docs.join(chunk_numbers(docs.withColumn("n", F.length("text")), limit), ["video_name", "ord"])
    parts = docs.groupBy("video_name", "k").agg(F.array_sort(F.collect_list(F.struct("ord", "ref", "text"))).alias("d"))
    content = F.concat(F.when(F.col("k") == 0, " ").otherwise(""), F.array_join(F.transform("d", lambda x: x["text"]), " "))
    rows = parts.withColumn("content", content).where(F.col("content") != "")
    bare = T.strip(F.col("content"))
    return rows.select(
        "video_name", F.col("k").alias("chunk_order_index"), T.md5_id(bare).alias("chunk_id"), F.floor(F.length("content") / 4).cast("long").alias("tokens"),
        bare.alias("content"), F.transform("d", lambda x: x["ref"]).alias("video_segment_id"),
    )


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id: the place of the first, the values of the last (AG2). chunks: chunk_id, ord and others."""
    others = [c for c in chunks.columns if c not in ("chunk_id", "ord")]
    found = chunks.groupBy("chunk_id").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*others), "ord").alias("v"))
    return found.select("chunk_id", "ord", *[F.col(f"v.{c}").alias(c) for c in others])


def segment_windows(videos: DataFrame, length: int = 30, tail: int = 5) -> DataFrame:
    """Windows of whole videos (video_name, duration in seconds): a last one shorter than tail is joined to that before it (WN1)."""
    starts = videos.where("duration > 0").select("video_name", "duration", F.explode(F.sequence(F.lit(0), F.ceil("duration").cast("int") - 1, F.lit(length))).alias("start"))
    starts = starts.where((F.col("start") == 0) | (F.col("duration") - F.col("start") >= tail))
    w = Window.partitionBy("video_name").orderBy("start")
    return starts.select("video_name", (F.row_number().over(w) - 1).alias("segment_idx"), F.col("start").cast("double").alias("start"), F.coalesce(F.lead("start").over(w).cast("double"), F.col("duration")).alias("end"))


def frame_times(start: Column, end: Column, n: int = 5) -> Column:
    """n times from start on, evenly, the end left out (WN2)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * (end - start) / n)


def truncate_to_tokens(rows: DataFrame, key: list[str], order: list[str], text: str, max_tokens: int) -> DataFrame:
    """The first rows of each key within 4 characters a token in total (WN8)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(F.length(text)).over(w)).where(F.col("running") <= 4 * max(0, max_tokens)) if max_tokens > 0 else rows.withColumn("running", F.lit(0).cast("long")).where(F.lit(False))


def with_overlap(splits: DataFrame, overlap: int, size: int) -> DataFrame:
    """Each split of a document after the first begins with the last `overlap` tokens of the one before, clipped to size (WN10). splits: doc_id, ord, tokens."""
    before = F.lag("tokens").over(Window.partitionBy("doc_id").orderBy("ord"))
    tail = F.slice(before, F.greatest(F.lit(1), F.size(before) - overlap + 1), F.lit(overlap))
    return splits.withColumn("tokens", F.when(before.isNull() | F.lit(overlap <= 0), F.col("tokens")).otherwise(F.slice(F.concat(tail, F.col("tokens")), 1, size)))


def separator_splits(documents: DataFrame, separators: str, size: int, keep: str = "end") -> DataFrame:
    """Characters of a text (doc_id, text) as splits at any of the separator characters, merged to at most size (TX34).

    A split that alone is over the size stays whole. Each document folds by itself.
    """
    cls = "[" + "".join("\\" + c if c in "\\]^-[" else c for c in separators) + "]"
    pattern = f"(?<={cls})" if keep == "end" else f"(?={cls})"
    parts = F.filter(F.split("text", pattern, -1), lambda x: x != "")
    state = F.struct(F.lit("").alias("acc"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        joined = F.struct(F.concat(s["acc"], p).alias("acc"), s["out"].alias("out"))
        flushed = F.struct(p.alias("acc"), F.concat(s["out"], F.array(s["acc"])).alias("out"))
        return F.when((s["acc"] == "") | (F.length(s["acc"]) + F.length(p) <= size), joined).otherwise(flushed)

    merged = F.aggregate(parts, state, step, lambda s: F.when(s["acc"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["acc"]))))
    return documents.select("doc_id", F.posexplode(merged).alias("ord", "split"))


def video_rollup(chunks: DataFrame, limit: int = 12000) -> DataFrame:
    """A video's chunks in order as one text, clipped (AG23). chunks: video_name, ord, content."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "content")))
    return chunks.groupBy("video_name").agg(F.substr(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n"), F.lit(1), F.lit(limit)).alias("text"))


def caption_collect(frames: DataFrame) -> DataFrame:
    """A segment's captions in order (AG22). frames: video_name, segment_idx, frame_idx, caption."""
    ordered = F.array_sort(F.collect_list(F.struct("frame_idx", "caption")))
    return frames.groupBy("video_name", "segment_idx").agg(F.array_join(F.transform(ordered, lambda x: x["caption"]), "\n\n--- Next Segment ---\n\n").alias("captions"))


def assemble_segments(times: DataFrame, captions: DataFrame, transcripts: DataFrame, frames: DataFrame) -> DataFrame:
    """Segments from their parts, each by (video_name, segment_idx): time, caption, transcript, frame_times; what is missing is empty (JN18)."""
    key = ["video_name", "segment_idx"]
    rows = times.join(captions, key, "left").join(transcripts, key, "left").join(frames, key, "left")
    caption, transcript = F.coalesce("caption", F.lit("")), F.coalesce("transcript", F.lit(""))
    content = F.concat(F.lit("Caption:\n"), caption, F.lit("\nTranscript:\n"), transcript, F.lit("\n\n"))
    return rows.select(*key, "time", content.alias("content"), transcript.alias("transcript"), F.coalesce("frame_times", F.array().cast("array<double>")).alias("frame_times"))


def previous_description(frames: DataFrame, first: str = "None") -> DataFrame:
    """Each frame with the description of the frame before it in its segment as context (WN3)."""
    w = Window.partitionBy("video_name", "segment_idx").orderBy("frame_idx")
    return frames.withColumn("previous", F.coalesce(F.lag("description").over(w), F.lit(first)))
