"""Models as functions on DataFrames. Each has a deterministic default, so that everything around it runs without one.

A text model takes a DataFrame with a prompt column and gives it with the answer in `raw`; an embedding takes a text column
and gives it with `vector`. Real ones are given as Arrow iterator functions, which load a model once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright import shared
from lorewright.operators import graph
from lorewright.sources.log import LoggedTable

TextModel = Callable[[DataFrame], DataFrame]


def echo(rows: DataFrame) -> DataFrame:
    """Answers with the start of the context, as the final channel."""
    return rows.withColumn("raw", F.concat(F.lit("<|start|>assistant<|channel|>final<|message|>"), F.substr(F.coalesce("context", F.lit("")), F.lit(1), F.lit(200)), F.lit("<|end|>")))


def batch_model(rows: DataFrame, prompt: str, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """rows with raw = complete(prompts), batch by batch; complete is loaded and called on the executors."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(complete(list(b)))

    return rows.withColumn("raw", run(prompt))


def cached(rows: DataFrame, cache: DataFrame, prompt: str, complete: TextModel, model: str = "default") -> tuple[DataFrame, DataFrame]:
    """rows with raw, from the cache (hash, return, model) where it has the prompt, and the cache with the new answers (JN14, D17).

    Each distinct prompt that is missing is completed once: the answers are written before either result reads them.
    """
    key = F.md5(F.concat(F.lit(model), F.lit("\x1f"), F.col(prompt)).cast("binary"))
    asked = rows.withColumn("hash", key)
    misses = asked.select("hash", prompt).distinct().join(cache.select("hash"), "hash", "left_anti")
    made = shared.materialize(complete(misses).select("hash", F.col("raw").alias("return"), F.lit(model).alias("model")), "answers")
    known = cache.unionByName(made)
    return asked.join(known.select("hash", F.col("return").alias("raw")), "hash", "left").drop("hash"), known


def hashed_embedding(rows: DataFrame, text: str, size: int = 64, out: str = "vector") -> DataFrame:
    """Unit vectors of signed word hashes: texts with the same words are near. The default where no model is given."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            vectors = []
            for t in b:
                v = np.zeros(size)
                for w in (t or "").lower().split():
                    h = xxhash.xxh3_64_intdigest(w)
                    v[h % size] += 1 if h >> 63 else -1
                n = np.sqrt((v * v).sum())
                vectors.append((v / n if n else v).astype(np.float32))
            yield pd.Series(vectors)

    return rows.withColumn(out, run(text))


def upsert_vectors(stored: DataFrame, new: DataFrame, key: tuple[str, ...] = ("video_name", "namespace", "id")) -> DataFrame:
    """Stored vectors with the new ones, which replace those of the same id (MV16)."""
    return graph.compose(stored, new, list(key))


def rebuild_vectors(chunks: DataFrame, nodes: DataFrame, embed=hashed_embedding) -> DataFrame:
    """Vectors of chunks' texts and of nodes' names with descriptions after sanitizing; ids of entities are from the MD5 of their names (MV17)."""
    a = chunks.select("video_name", F.lit("chunks").alias("namespace"), F.col("chunk_id").alias("id"), F.lit(None).cast("string").alias("entity_name"), F.col("content").alias("text"))
    b = nodes.select("video_name", F.lit("entities").alias("namespace"), F.concat(F.lit("ent-"), F.md5(F.col("id").cast("binary"))).alias("id"), F.col("id").alias("entity_name"), F.trim(F.concat_ws(" ", "id", "description")).alias("text"))
    return embed(a.unionByName(b), "text").drop("text")


def glean(chunks: DataFrame, prompt: str, complete: TextModel, passes: int = 1) -> DataFrame:
    """Q9, Q10, Q18: answers of an extraction prompt and of at most `passes` more asked for what was missed; chunks without anything new stop.

    chunks: chunk_id and the prompt; the result has chunk_id and all answers as one text in raw. Each pass is written before the
    next one reads it, so that a model is called once for each chunk and pass.
    """
    out = shared.materialize(complete(chunks).select("chunk_id", prompt, "raw", F.lit(True).alias("open")), "gleaned")
    had = F.coalesce("raw", F.lit(""))
    for _ in range(passes):
        asked = out.where("open").withColumn(prompt, F.concat(prompt, F.lit("\n"), had, F.lit("\nList the entities and relationships that were missed.")))
        more = complete(asked).select("chunk_id", F.coalesce("raw", F.lit("")).alias("more"))
        new = F.coalesce((F.col("more") != "") & ~F.contains(had, F.col("more")), F.lit(False))
        out = shared.materialize(out.join(more, "chunk_id", "left").select("chunk_id", prompt, F.when(new, F.concat_ws("##", "raw", "more")).otherwise(F.col("raw")).alias("raw"), new.alias("open")), "gleaned")
    return out.select("chunk_id", "raw")


def arrow_files(paths: DataFrame, embed: Callable[[bytes], list[float]]) -> DataFrame:
    """path and vector of files (path, content) by an image embedding loaded on the executors (SRC17)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([embed(x.as_py()) for x in b.column(1)], pa.list_(pa.float32()))], ["path", "vector"])

    return paths.select("path", "content").mapInArrow(run, "path string, vector array<float>")


def attempt_rows(rows: DataFrame, prompt: str, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """rows with raw and error: a batch that fails is tried in halves until the failing rows stand alone; theirs is the error's text (S5)."""

    def tried(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = list(complete(prompts))
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return [(a, None) for a in answers]
        except Exception as e:  # whatever a model raises is the row's
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(prompts) // 2
            return tried(prompts[:half]) + tried(prompts[half:])

    @F.pandas_udf("raw string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(tried(list(b)) if len(b) else [], columns=["raw", "error"])

    return rows.withColumn("lw_tried", run(prompt)).select(*rows.columns, "lw_tried.raw", "lw_tried.error")


class FailedRows(RuntimeError):
    """Rows failed where the policy is to stop."""


def run_with_status(rows: DataFrame, key: str, prompt: str, complete: Callable[[list[str]], list[str]], status: LoggedTable, retries: int = 1, continue_on_error: bool = True) -> DataFrame:
    """One pass over the rows that are neither done nor out of retries; the status table after it (S5).

    status holds for each attempt key, attempt, state (done or failed), raw and error; a pass is one commit of it. With
    continue_on_error off, a pass in which rows failed raises after its commit, so that what was done stays done.
    """
    past = status.read()
    due = rows.withColumn("attempt", F.lit(1))
    if past is not None:
        state = past.groupBy(key).agg(F.max("attempt").alias("tried"), F.bool_or(F.col("state") == "done").alias("over"))
        due = rows.join(state, key, "left").where(~F.coalesce("over", F.lit(False)) & (F.coalesce("tried", F.lit(0)) <= retries))
        due = due.withColumn("attempt", F.coalesce("tried", F.lit(0)) + 1).drop("tried", "over")
    made = attempt_rows(due.select(key, prompt, "attempt"), prompt, complete)
    made = made.select(key, "attempt", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"), "raw", "error")
    number = max(status.log(), default=-1) + 1
    status.append(made, number, key)
    found = status.read()
    if not continue_on_error:
        failed = status.spark.read.parquet(f"{status.path}/{status.log()[number]}/rows").where("state = 'failed'").count()
        if failed:
            raise FailedRows(f"{failed} rows failed")
    return found


def outcome(status: DataFrame, key: str) -> DataFrame:
    """key, state, attempts, raw and error of each row's last attempt."""
    last = status.groupBy(key).agg(F.max_by(F.struct("state", "attempt", "raw", "error"), "attempt").alias("x"))
    return last.select(key, "x.state", F.col("x.attempt").alias("attempts"), "x.raw", "x.error")
