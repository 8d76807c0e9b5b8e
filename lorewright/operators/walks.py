"""Second-order random walks and skip-gram vectors of a graph's nodes (GR10).

A step proposes one neighbour with its weight's share. The neighbours' weights lie end to end, and a node has as many places of
equal length on that line as neighbours; a draw on the line meets the neighbours that reach into its place, two of them on
average, so that a walk on a hub never meets all its neighbours. A proposal is accepted with its odds over the largest there can be: 1 / p
for the way back, 1 for a neighbour of the node before, 1 / q for any other. Those that are refused are drawn again, twice as
often each time, until all walks have moved; so steps have the exact odds, and their rounds don't depend on how much the
weights differ. Draws are hashes of walk, step and try.

Vectors are trained on counts of pairs within a window, by negative sampling. Nodes are dealt in blocks; in a sub-epoch every
block of centres meets one block of contexts, each a different one, so that tasks never share a vector and none holds more
than two blocks and the pairs between them. After as many sub-epochs as blocks every pair was met once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright import shared

#: Proposals that a walk makes before the refused ones are written and draw again, and that it makes at once at most; nodes in a block.
TRIES, MOST_TRIES, BLOCK = 4, 64, 2_048
#: Pairs whose gradients are taken together.
BATCH = 256


def adjacency(edges: DataFrame) -> DataFrame:
    """node, at (from 0), neighbour, weight, low and high (weights before it, and with it), first and last (places it reaches into),
    and degree and total (weight) of the neighbour, for edges (src, dst, weight) both ways.

    Parallel edges are one with their summed weight; loops and weights of zero or less don't count.
    """
    rows = edges.where("src <> dst and weight > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("weight"))
    rows = shared.materialize(rows.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "pairs")
    both = rows.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "weight").union(rows.select("b", "a", "weight"))
    # A node's places: sorted within ranges, then counted from where the range's own rows begin. Weights are summed likewise.
    ranged = both.repartitionByRange(F.col("node"), F.col("neighbour")).sortWithinPartitions("node", "neighbour").withColumn("at", F.monotonically_increasing_id())
    ranged = shared.materialize(ranged, "ranged").withColumn("part", F.shiftright("at", 33))
    own = Window.partitionBy("part", "node").orderBy("at")  # no more rows than a range
    summed = ranged.withColumn("high", F.sum("weight").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summed = shared.materialize(summed.withColumn("low", F.coalesce(F.lag("high").over(own), F.lit(0.0))), "summed")
    heads = summed.groupBy("node", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max("high").alias("weight"))
    parts = F.array_sort(F.collect_list(F.struct("part", "first", "n", "weight")))  # a range each
    nodes = heads.groupBy("node").agg(F.sum("n").alias("degree"), parts.alias("parts"))
    weights = lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["weight"])
    nodes = shared.materialize(nodes.withColumn("total", weights(F.col("parts"))), "degrees")
    before = F.filter("parts", lambda x: x["part"] < F.col("part"))
    first = F.filter("parts", lambda x: x["part"] == F.col("part"))[0]["first"]
    at = F.aggregate(before, F.lit(0).cast("long"), lambda s, x: s + x["n"]) + F.col("at") - first
    placed = summed.join(nodes, "node").select("node", at.alias("at"), "neighbour", "weight", (weights(before) + F.col("low")).alias("low"), (weights(before) + F.col("high")).alias("high"), "degree", "total")
    reach = [_place(c, "degree", "total").alias(name) for c, name in (("low", "first"), ("high", "last"))]
    placed = placed.select("node", "at", "neighbour", "weight", "low", "high", *reach)
    return shared.materialize(placed.join(nodes.select(F.col("node").alias("neighbour"), "degree", "total"), "neighbour"), "adjacency")


def _place(x: str, degree: str, total: str) -> Column:
    """The place of x on the line of a node's weights; it never falls as x rises."""
    return F.least(F.floor(F.col(x) * F.col(degree) / F.col(total)), F.col(degree) - 1)


def _draw(*of: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / float(1 << 52)


def walks(nodes: DataFrame, edges: DataFrame, length: int = 6, walks: int = 2, p: float = 1.0, q: float = 1.0, seed: int = 7) -> DataFrame:
    """start, walk (from 0) and path (array of ids) of `walks` walks of `length` nodes from each node (id); a node without neighbours stands alone."""
    links = adjacency(edges)
    ends = links.groupBy(F.col("neighbour").alias("id")).agg(F.first("degree").alias("degree"), F.first("total").alias("total"))
    line = links.select("node", F.explode(F.sequence("first", "last")).alias("place"), "low", "high", F.col("neighbour").alias("next"), F.col("degree").alias("next_degree"), F.col("total").alias("next_total"))
    line = shared.materialize(line, "places")
    pairs = links.select(F.col("node").alias("before"), F.col("neighbour").alias("next"), F.lit(True).alias("near"))
    largest = max(1.0, 1 / p, 1 / q)
    at = nodes.select("id").join(ends, "id", "left")
    at = at.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.array("id").alias("path"), "degree", "total")
    alone = shared.materialize(at.where("degree is null").select("start", "walk", "path"), "walks")
    at = shared.materialize(at.where("degree is not null"), "walks")
    for step in range(1, length):
        done, waiting, tries, more = [], at, 0, TRIES
        while True:
            proposed = waiting.select("*", F.explode(F.sequence(F.lit(tries), F.lit(tries + more - 1))).alias("try"))
            key = [F.col("start"), F.col("walk"), F.lit(step), F.col("try"), F.lit(seed)]
            proposed = proposed.select(F.col("start"), F.col("walk"), F.element_at("path", -1).alias("node"), F.try_element_at("path", F.lit(-2)).alias("before"), "try", "degree", "total", (_draw(*key) * F.col("total")).alias("x"), _draw(*key, F.lit(1)).alias("u"))
            offered = proposed.withColumn("place", _place("x", "degree", "total")).join(line, ["node", "place"]).where("low <= x and x < high")
            back = F.col("before").isNull() | (F.col("next") == F.col("before"))
            if q != 1:  # else all but the way back are alike
                # Only those that the odds of a neighbour of the node before, or of any other, may let through are looked up.
                offered = offered.where(back | (F.col("u") < max(1.0, 1 / q) / largest)).join(pairs, ["before", "next"], "left")
            odds = F.when(F.col("before").isNull(), largest).when(F.col("next") == F.col("before"), 1 / p).when(F.col("near") if q != 1 else F.lit(True), 1.0).otherwise(1 / q)
            taken = offered.where(F.col("u") < odds / largest)
            taken = taken.groupBy("start", "walk").agg(F.min_by(F.struct("next", "next_degree", "next_total"), "try").alias("to"))
            result = shared.materialize(waiting.join(taken, ["start", "walk"], "left"), "steps")
            moved = result.where("to is not null")
            done.append(moved.select("start", "walk", F.concat("path", F.array("to.next")).alias("path"), F.col("to.next_degree").alias("degree"), F.col("to.next_total").alias("total")))
            waiting, tries, more = result.where("to is null").drop("to"), tries + more, min(2 * more, MOST_TRIES)
            if waiting.isEmpty():
                break
        at = done[0]
        for rest in done[1:]:
            at = at.union(rest)
        at = shared.materialize(at, "walks") if len(done) > 1 else at
    return at.select("start", "walk", "path").union(alone)


def pair_counts(paths: DataFrame, window: int) -> DataFrame:
    """a, b, n: how often b stands within `window` places of a on the paths; an occurrence of a node near itself doesn't count."""
    placed = paths.select(F.posexplode("path").alias("i", "a"), "path")
    near = F.slice("path", F.greatest(F.lit(1), F.col("i") + 1 - window), F.least(F.col("i"), F.lit(window)) + 1 + window)
    return placed.select("a", F.explode(near).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def _train(size: int, negatives: int, rate: float, passes: int, seed: int):
    """One block of centres against one of contexts: rows of pairs (vector null) and of vectors (n null)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["kind"] >= 0
        held, pairs = pdf[known], pdf[~known]
        centres, contexts = held[held["kind"] == 0].sort_values("a"), held[held["kind"] == 1].sort_values("a")
        x, y = (np.stack(h["vector"].to_numpy()).astype(np.float64) if len(h) else np.zeros((0, size)) for h in (centres, contexts))
        if len(pairs) and len(x) and len(y):
            draw = np.random.default_rng((seed, int(pdf["block"].iloc[0])))
            a, b = pairs["a"].map(pd.Series(range(len(x)), centres["a"].to_numpy())).to_numpy(), pairs["b"].map(pd.Series(range(len(y)), contexts["a"].to_numpy())).to_numpy()
            seen = np.cumsum(pairs["n"].to_numpy().astype(np.float64))
            odds = contexts["n"].to_numpy().astype(np.float64) ** 0.75
            odds /= odds.sum()
            batch = max(4, min(BATCH, len(x) // 2))  # few rows of one vector in a batch
            for _ in range(passes):
                # As many pairs as were seen, each as often as it was seen on average.
                for _ in range(math.ceil(seen[-1] / batch)):
                    at = np.minimum(np.searchsorted(seen, draw.random(batch) * seen[-1], "right"), len(a) - 1)
                    i, j = a[at], b[at]
                    g = rate * (1 - 1 / (1 + np.exp(-np.clip((x[i] * y[j]).sum(1), -30, 30))))[:, None]
                    dx, dy = g * y[j], g * x[i]
                    np.add.at(y, j, dy)
                    for _ in range(negatives):
                        k = draw.choice(len(y), len(at), p=odds)
                        g = -rate / (1 + np.exp(-np.clip((x[i] * y[k]).sum(1), -30, 30)))[:, None]
                        dx += g * y[k]
                        np.add.at(y, k, g * x[i])
                    np.add.at(x, i, dx)
        out = pd.concat([centres, contexts], ignore_index=True)
        return pd.DataFrame({"kind": out["kind"], "a": out["a"], "n": out["n"], "vector": list(np.concatenate((x, y)))})

    return run


def vectors(paths: DataFrame, size: int = 32, window: int = 3, negatives: int = 5, epochs: int = 6, rate: float = 0.05, seed: int = 7) -> DataFrame:
    """id and vector (array of float) of every node on the paths (array of ids)."""
    counts = shared.materialize(pair_counts(paths, window), "pair-counts")
    nodes = shared.materialize(paths.select(F.explode("path").alias("a")).groupBy("a").agg(F.count("*").alias("n")), "nodes")
    blocks = max(1, math.ceil(nodes.count() / BLOCK))
    block = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(blocks))
    pairs = counts.select(F.lit(-1).alias("kind"), "a", "b", F.col("n").cast("long").alias("n"), F.lit(None).cast("array<double>").alias("vector"), block("a").alias("block"), F.pmod(block("b") - block("a"), F.lit(blocks)).alias("turn"))
    pairs = shared.materialize(pairs, "pairs")
    start = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: (_draw(F.col("a"), k, F.lit(seed)) - 0.5) / size)
    zero = F.array_repeat(F.lit(0.0), size)
    state = nodes.select(F.lit(0).alias("kind"), "a", "n", start.alias("vector")).union(nodes.select(F.lit(1), "a", "n", zero))
    state = shared.materialize(state, "node-vectors")
    for epoch in range(epochs):
        for turn in range(blocks):
            # Contexts of block j meet centres of block j - turn.
            dealt = state.select("kind", "a", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "n", "vector", F.when(F.col("kind") == 0, block("a")).otherwise(F.pmod(block("a") - turn, F.lit(blocks))).alias("block"))
            rows = dealt.unionByName(pairs.where(F.col("turn") == turn).drop("turn"))
            kind = state.schema["a"].dataType.simpleString()
            trained = rows.groupBy("block").applyInPandas(_train(size, negatives, rate * (1 - epoch / epochs), 2, seed + epoch), f"kind int, a {kind}, n bigint, vector array<double>")
            state = shared.materialize(trained, "node-vectors")
    return state.where("kind = 0").select(F.col("a").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
