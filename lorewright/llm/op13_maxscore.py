r"""Exact top-k search by MaxScore over shards of an inverted index of integer components.

A vector's components become integers, floor(scale * x). A shard holds, for each dimension, the posting array of all its
rows' values and its block maxima and minima. A query's terms are its dimensions; a term's bound in a block of postings is
the largest product it can give there. Terms are ordered by bound; those whose bounds together can't lift a row over the
query's k-th best score so far are non-essential. Postings of the essential terms are traversed; rows stay while their
score plus the bounds left reaches the k-th best, and the other terms are probed for these only, a few at a time. As rows
are met in the order of their ids, and a row that only ties is never better, ties go to the smaller id. Each shard gives its
best k per query, and the shards' lists are merged.

All products are integers: in float64 where every sum stays below 2^53 by the bounds, which is exact, else in Python's
integers; scores beyond 64 bits become the nearest there and aren't told apart. Shards have SHARD rows and query blocks QUERIES, and
each of their combinations is a task's group; queries are a stated set, and every row is met in blocks.

Vectors that are null, or hold null or non-finite components, take no part, neither do those without id. Missing components
of shorter vectors count as 0. Rows that repeat an id are one vector, the least by its components. Empty tables give empty
results; fewer candidates than k are all given. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.llm.common import materialize

SHARD, QUERIES = 16_384, 4_096
#: Rows of a shard that are scored before the k-th best score is looked at again, and terms probed at a time.
STEP, PROBE = 2_048, 16


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and v (array of long) of the vectors that take part."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _stack(column, dims: int, kind) -> np.ndarray:
    out = np.zeros((len(column), dims), kind)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per query the ids and scores of its k best rows, best first, and how many products of a row and a term were made."""
    best_ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    best: list[np.ndarray] = [np.zeros(0, rows.dtype)] * len(queries)
    made = np.zeros(len(queries), np.int64)
    for lo in range(0, len(ids), STEP):
        at, postings = ids[lo : lo + STEP], np.ascontiguousarray(rows[lo : lo + STEP].T)
        bounds = np.maximum(queries * postings.max(1), queries * postings.min(1))
        order = np.argsort(-bounds, axis=1, kind="stable")
        # What terms from this place of the order on can give together.
        left = np.take_along_axis(bounds, order, 1)[:, ::-1].cumsum(1)[:, ::-1]
        for j, q in enumerate(queries):
            own = np.searchsorted(at, query_ids[j])
            own = int(own) if own < len(at) and at[own] == query_ids[j] else -1
            alive, terms, rest = None, order[j], left[j]
            if len(best[j]) < k:
                score, done = q @ postings, len(terms)
                made[j] += postings.size
            else:
                # Terms from `done` on can't lift a row over the k-th best by themselves.
                done = int(np.count_nonzero(rest > best[j][-1]))
                essential = terms[:done]
                score = q[essential] @ postings[essential] if done else np.zeros(len(at), rows.dtype)
                made[j] += done * len(at)
                if done == 0:
                    continue
            while done < len(terms):
                alive = np.flatnonzero(score + rest[done] > best[j][-1]) if alive is None else alive[score[alive] + rest[done] > best[j][-1]]
                if not len(alive):
                    break
                probed = terms[done : done + PROBE]
                score[alive] += q[probed] @ postings[np.ix_(probed, alive)]
                made[j] += len(probed) * len(alive)
                done += len(probed)
            if alive is None:
                alive = np.arange(len(at))
            if len(best[j]) == k:
                alive = alive[score[alive] > best[j][-1]]
            alive = alive[alive != own]
            if not len(alive):
                continue
            scores, found = np.concatenate((best[j], score[alive])), np.concatenate((best_ids[j], at[alive]))
            first = np.lexsort((found, -scores))[:k]
            best[j], best_ids[j] = scores[first], found[first]
    return made, best_ids, best


def _tile(k: int):
    """The best k of one shard for each query of one block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["asked"].to_numpy(bool)
        asked, rows = pdf[is_query], pdf[~is_query].sort_values("id", ignore_index=True)
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(asked) or not len(rows):
            return none
        dims = max(1, int(pdf["v"].map(len).max()))
        widest = [max(max(map(abs, v.tolist()), default=0) if len(v) else 0 for v in part["v"]) for part in (asked, rows)]
        kind = np.float64 if widest[0] * widest[1] * dims * 2 < 1 << 53 else object
        query_ids, ids = asked["id"].to_numpy(), rows["id"].to_numpy()
        _, found, scores = search_shard(query_ids, _stack(asked["v"], dims, kind), ids, _stack(rows["v"], dims, kind), k)
        limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, int(s)))
        return pd.DataFrame({"query_id": np.repeat(query_ids, [len(f) for f in found]), "vec_id": np.concatenate(found).astype(np.int64), "score": np.array([limit(s) for x in scores for s in x], np.int64)})

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best other rows. asked: which rows are queries, of column id."""
    index = materialize(quantised(vectors, id_col, vector_col, scale), "search-rows")
    counts = index.agg(F.count("*").alias("n"), F.count_if(asked).alias("m")).first()
    shards, blocks = max(1, math.ceil(counts["n"] / SHARD)), max(1, math.ceil(counts["m"] / QUERIES))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.select("id", "v", F.lit(False).alias("asked"), shard.alias("shard"), every(blocks).alias("block"))
    rows = rows.union(index.where(asked).select("id", "v", F.lit(True), every(shards).alias("shard"), block.alias("block")))
    found = rows.groupBy("shard", "block").applyInPandas(_tile(k), "query_id bigint, vec_id bigint, score bigint")
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
