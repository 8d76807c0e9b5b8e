"""Offline evaluation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lorewright import shared
from lorewright.functions import text as T


#: Values around a rank that are sorted at last; places of the summary that narrows them down, and its accuracy.
FEW, GRID, ACCURACY = 10_000, 256, 20_000


def percentile(values: DataFrame, key: list[str], column: str, q: float, out: str) -> DataFrame:
    """The value at rank round(q (n - 1)), halves to even, of each key's values in order; not interpolated (AG15).

    Selection by rounds: a mergeable summary of the values in a key's range gives a narrower range, whose values and those
    below it are counted, until FEW are left around the rank or all of them are equal. Only these are sorted.
    """
    rows = values.where(F.col(column).isNotNull()).select(*key, F.col(column).alias("lw_v"))
    same = lambda other: [F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in key]
    state = rows.groupBy(*key).agg(F.count("*").alias("lw_inside"), F.min("lw_v").alias("lw_lo"), F.max("lw_v").alias("lw_hi"))
    state = state.withColumn("lw_rank", F.rint(F.lit(q) * (F.col("lw_inside") - 1)).cast("long"))
    state = shared.materialize(state, "ranks")
    if not state.where(F.col("lw_inside") > FEW).isEmpty():
        rows = shared.materialize(rows, "values")
    while True:
        wide = state.where((F.col("lw_inside") > FEW) & (F.col("lw_lo") < F.col("lw_hi")))
        if wide.isEmpty():
            break
        within = lambda s: rows.alias("r").join(shared.checked(s).alias("s"), [*same("s"), F.col("lw_v").between(F.col("lw_lo"), F.col("lw_hi"))])
        grid = within(wide).groupBy(*[F.col(f"s.{k}").alias(k) for k in key], "lw_lo", "lw_hi", "lw_rank", "lw_inside").agg(F.percentile_approx("lw_v", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("lw_grid"))
        at = F.floor(F.col("lw_rank") * GRID / F.col("lw_inside")).cast("int")
        grid = grid.select(*key, "lw_rank", F.col("lw_inside").alias("lw_before"), F.get("lw_grid", F.greatest(at - 1, F.lit(0))).alias("lw_a"), F.get("lw_grid", F.least(at + 2, F.lit(GRID))).alias("lw_b"), "lw_lo", "lw_hi")
        counted = within(grid).groupBy(*[F.col(f"s.{k}").alias(k) for k in key], "lw_rank", "lw_before", "lw_a", "lw_b", "lw_lo", "lw_hi").agg(F.count_if(F.col("lw_v") < F.col("lw_a")).alias("lw_below"), F.count_if(F.col("lw_v").between(F.col("lw_a"), F.col("lw_b"))).alias("lw_in"))
        holds = (F.col("lw_rank") >= F.col("lw_below")) & (F.col("lw_rank") < F.col("lw_below") + F.col("lw_in")) & (F.col("lw_in") < F.col("lw_before"))
        # Where a few values make up the range, its ends may stay; then the values at the ends are settled by their counts.
        narrow = counted.where(holds).select(*key, F.col("lw_in").alias("lw_inside"), F.col("lw_a").alias("lw_lo"), F.col("lw_b").alias("lw_hi"), (F.col("lw_rank") - F.col("lw_below")).alias("lw_rank"))
        stuck = counted.where(~holds)
        tally = within(stuck).groupBy(*[F.col(f"s.{k}").alias(k) for k in key], "lw_rank", "lw_v").agg(F.count("*").alias("lw_n"))
        upto = F.sum("lw_n").over(Window.partitionBy(*key).orderBy("lw_v"))
        settled = tally.withColumn("lw_to", upto).where((F.col("lw_rank") < F.col("lw_to")) & (F.col("lw_rank") >= F.col("lw_to") - F.col("lw_n")))
        settled = settled.select(*key, F.col("lw_n").alias("lw_inside"), F.col("lw_v").alias("lw_lo"), F.col("lw_v").alias("lw_hi"), (F.col("lw_rank") - F.col("lw_to") + F.col("lw_n")).alias("lw_rank"))
        done = state.where((F.col("lw_inside") <= FEW) | (F.col("lw_lo") >= F.col("lw_hi")))
        state = shared.materialize(done.select(*key, "lw_inside", "lw_lo", "lw_hi", "lw_rank").unionByName(narrow).unionByName(settled), "ranks")
    equal = state.where("lw_lo >= lw_hi").select(*key, F.col("lw_lo").alias(out))
    rest = rows.alias("r").join(shared.checked(state.where("lw_lo < lw_hi")).alias("s"), [*same("s"), F.col("lw_v").between(F.col("lw_lo"), F.col("lw_hi"))])
    rest = rest.select(*[F.col(f"s.{k}").alias(k) for k in key], "lw_v", "lw_rank").withColumn("lw_at", F.row_number().over(Window.partitionBy(*key).orderBy("lw_v")) - 1)
    return equal.unionByName(rest.where(F.col("lw_at") == F.col("lw_rank")).select(*key, F.col("lw_v").alias(out)))


def contains_any(text: Column, keywords: Column) -> Column:
    """Whether the text holds any keyword, whatever the case (TX37)."""
    return F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))


def retrieval_proxy(answer: Column, found: Column, keywords: Column, expected: Column) -> Column:
    """Half for a keyword in the answer, half for the share of expected videos found; each is whole where nothing is expected (AG16)."""
    lower = lambda a: F.array_distinct(F.transform(a, F.lower))
    word = F.when(F.size(keywords) > 0, contains_any(answer, keywords).cast("double")).otherwise(1.0)
    video = F.when(F.size(expected) > 0, F.size(F.array_intersect(lower(found), lower(expected))) / F.size(lower(expected))).otherwise(1.0)
    return F.lit(0.5) * word + F.lit(0.5) * video


def summary(cases: DataFrame) -> DataFrame:
    """Q14: cases, mean proxy, mean supported ratio, and latencies at the median and the 95th percentile. cases: answer, found, keywords, expected, supported_ratio, latency_s."""
    rows = cases.withColumns({"proxy": retrieval_proxy(F.col("answer"), F.col("found"), F.col("keywords"), F.col("expected")), "k": F.lit(0)})
    out = rows.agg(F.count("*").alias("cases_total"), F.coalesce(F.avg("proxy"), F.lit(0.0)).alias("retrieval_recall_proxy_mean"), F.coalesce(F.avg("supported_ratio"), F.lit(0.0)).alias("groundedness_proxy_mean"))
    for q, name in ((0.5, "latency_p50_s"), (0.95, "latency_p95_s")):
        out = out.join(percentile(rows, ["k"], "latency_s", q, name).drop("k"), how="left")
    return out.na.fill(0.0)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the usual table in one integer's bits."""
    masks: dict[str, int] = {}
    for k, word in enumerate(b):
        masks[word] = masks.get(word, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for word in a:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(candidate: pd.Series, gold: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of lower-case words (Q15). Model-based measures are hooks."""

    def one(c: str | None, g: str | None) -> float:
        a, b = re.findall("[a-z0-9]+", (c or "").lower()), re.findall("[a-z0-9]+", (g or "").lower())
        return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0

    return pd.Series([one(c, g) for c, g in zip(candidate, gold, strict=True)], dtype="float64")


def compare_systems(cases: DataFrame, systems: list[str], gold: str = "answer_gold") -> DataFrame:
    """Q15's leaderboard: per system the mean overlap with the gold answers, words, and empty answers; texts are clipped as for the judges (TX36)."""
    rows = cases.select(F.explode(F.array(*[F.struct(F.lit(s).alias("system"), T.clip(F.coalesce(s, F.lit("")), 1800).alias("answer")) for s in systems])).alias("x"), T.clip(F.coalesce(gold, F.lit("")), 1800).alias("gold"))
    rows = rows.select("x.system", "x.answer", "gold")
    words = F.size(F.filter(F.split("answer", r"\s+", -1), lambda w: w != ""))
    return rows.groupBy("system").agg(F.avg(rouge_l(F.col("answer"), F.col("gold"))).alias("rouge_l"), F.avg(words).alias("mean_words"), F.count_if(T.strip(F.col("answer")) == "").alias("empty"), F.count("*").alias("cases"))


def aligned(left: DataFrame, right: DataFrame, ordinal: str, question: str) -> DataFrame:
    """Rows of both by ordinal with ok: whether both have the row and its question is the same (JN13). Callers reject a result with any row that isn't ok."""
    rows = left.alias("a").join(right.alias("b"), ordinal, "full_outer")
    return rows.select(ordinal, F.col(f"a.{question}").alias("question"), (F.coalesce(F.col(f"a.{question}") == F.col(f"b.{question}"), F.lit(False))).alias("ok"))


def fill_missing(cases: DataFrame, column: str, generate) -> DataFrame:
    """Q17: cases with the answers that are missing made by the hook; rows that have one pass through, so a rerun costs only what is left."""
    empty = F.coalesce(T.strip(F.col(column)), F.lit("")) == ""
    made = generate(cases.where(empty)).withColumn(column, F.col("raw")).select(*cases.columns)
    return cases.where(~empty).unionByName(made)


def needs_summary(description: Column, tokens: int = 500) -> Column:
    """Whether a description is long enough to be summarised by a model (Q16)."""
    return F.length(description) >= 4 * tokens
