"""Communities by a parallel Leiden method: moves by modularity gain, connected refinement, coarsening, levels by size (GR9).

All nodes move at once, yet modularity rises in every round. Each round colours the communities in two colours at random;
nodes leave those of one colour only, for those of the other only. Of the nodes that want to enter or leave a community a
hashed share is let through, so few that they take no more than half of one another's gains; each must still gain after all
that the others may add or take, counted by sums, never by listing a community's candidates. The largest gain of a round
always passes. When no node gains by moving, communities are refined: within each, nodes that are alone join a
community that they are linked to, which keeps all connected; the refined communities are the next graph's nodes, and
start from the communities found before.

Weights are sums per pair of a node and a community, so hubs cost what their neighbours' communities do. The totals of a
scope (a whole graph, or a community that is split again) stand beside its nodes. Every round is written before the next.

Scopes of at most SMALL links, by count, are each settled within one task, node after node; there may be any number of them,
as where many communities are split at once. From larger ones the nodes with one link are taken first: such a node never loses
by being with its neighbour, whatever the partition, so it goes where that one goes, and its link stays as a loop. What is left
is settled in one task if it is small now, else by the rounds above.

Tables of nodes, links and moves are joined by sorting, whatever their size: as broadcasts they would pass through the driver
in every round.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright import shared

#: Gains up to this are none. Shares of candidates that are let through: all, a half, a quarter, an eighth, a sixteenth.
LEAST, SHARES = 1e-12, 5
#: Links of a scope that one task settles by itself.
SMALL = 50_000


def _by_sort(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, even if it is small."""
    return df.hint("merge")


def _leaves(c: str, seed: int) -> Column:
    """The colour of a community: whether nodes may leave it in this round, or else enter it."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(2)) == 0


def _share(c: str, seed: int) -> Column:
    """How rare a candidate is: 0 for half of them, 1 for a quarter, and so on."""
    h = F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << (SHARES - 1)))
    share = F.lit(SHARES - 1)
    for s in range(SHARES - 2, -1, -1):
        share = F.when(h % (1 << (s + 1)) != 0, s).otherwise(share)
    return share


def _moves(nodes: DataFrame, links: DataFrame, alone: bool, seed: int) -> DataFrame:
    """Nodes that gain in another community: node, k, total, a (its own), and b and gain of the best one it may move to now (null if none).

    alone: only nodes that are a community by themselves.
    """
    of = nodes.select(F.col("node").alias("y"), F.col("c").alias("cy"))
    near = links.join(_by_sort(of), "y").groupBy(F.col("x").alias("node"), "cy").agg(F.sum("w").alias("w"))
    sizes = nodes.groupBy("c").agg(F.sum("k").alias("ks"), F.count("*").alias("n"))
    mine = nodes.join(_by_sort(sizes), "c")
    rows = near.join(_by_sort(mine.where("n = 1") if alone else mine), "node").join(_by_sort(sizes.select(F.col("c").alias("cy"), F.col("ks").alias("ky"))), "cy")
    other = F.col("cy") != F.col("c")
    score = F.struct((F.col("w") - F.col("k") * F.col("ky") / F.col("total")).alias("s"), (-F.col("cy")).alias("c"))
    open_ = _leaves("c", seed) & ~_leaves("cy", seed)
    best = rows.groupBy("node", "k", "total", "c", "ks").agg(F.max(F.when(other, score)).alias("any"), F.max(F.when(other & open_, score)).alias("best"), F.coalesce(F.max(F.when(~other, F.col("w"))), F.lit(0.0)).alias("own"))
    stays = F.col("own") - F.col("k") * (F.col("ks") - F.col("k")) / F.col("total")
    found = best.select("node", "k", "total", F.col("c").alias("a"), (F.col("any.s") - stays).alias("most"), (-F.col("best.c")).alias("b"), (F.col("best.s") - stays).alias("gain"))
    return found.where(F.col("most") > LEAST).withColumn("b", F.when(F.col("gain") > LEAST, F.col("b"))).drop("most")


def _accepted(moves: DataFrame, seed: int) -> DataFrame:
    """node and b of the moves that can be made together; each still gains after all others."""
    rows = moves.where("b is not null").withColumn("share", _share("node", seed))

    def side(column: str) -> DataFrame:
        """For each community its share, the weight that this lets through besides the best move, and that move's node."""
        sums = [F.sum(F.when(F.col("share") >= s, F.col("k")).otherwise(0.0)).alias(f"t{s}") for s in range(SHARES)]
        found = rows.groupBy(F.col(column).alias("c")).agg(*sums, F.sum(F.col("k") / F.col("total")).alias("ks"), F.sum("gain").alias("gains"), F.max(F.struct("gain", (-F.col("node")).alias("node"), "k")).alias("top"))
        level, through = F.lit(SHARES - 1), F.col(f"t{SHARES - 1}")
        for s in range(SHARES - 2, -1, -1):
            fits = F.col(f"t{s}") * F.col("ks") <= F.col("gains") / 2
            level, through = F.when(fits, s).otherwise(level), F.when(fits, F.col(f"t{s}")).otherwise(through)
        return found.select(F.col("c").alias(column), level.alias(f"level_{column}"), (through + F.col("top.k")).alias(f"weight_{column}"), (-F.col("top.node")).alias(f"top_{column}"))

    both = rows.join(_by_sort(side("a")), "a").join(_by_sort(side("b")), "b")
    first = (F.col("top_a") == F.col("node")) & (F.col("top_b") == F.col("node"))
    together = (F.col("share") >= F.col("level_a")) & (F.col("share") >= F.col("level_b")) & (F.col("gain") - F.col("k") * (F.col("weight_a") + F.col("weight_b")) / F.col("total") > LEAST)
    return both.where(first | together).select("node", "b")


def settle(nodes: DataFrame, links: DataFrame, seed: int, alone: bool = False, rounds: int = 200) -> DataFrame:
    """nodes with c after moves until none gains. nodes: node, scope, k, total, c; links: x, y, w, both ways, within scopes."""
    for r in range(rounds):
        moves = shared.materialize(_moves(nodes, links, alone, seed + r), "moves")
        left = moves.agg(F.count("*").alias("gaining"), F.count("b").alias("open")).first()
        if not left["gaining"]:
            break
        if left["open"]:
            moved = nodes.join(_by_sort(_accepted(moves, seed + r)), "node", "left").withColumn("c", F.coalesce("b", "c")).drop("b")
            nodes = shared.materialize(moved, "communities")
    return nodes


def _settle_here(near: dict, mass: dict, total: float, of: dict, draw: random.Random, within: dict | None = None) -> dict:
    """Communities after single moves until none gains; with `within`, only nodes that are alone move, and only inside theirs."""
    weight, size = {}, {}
    for a, c in of.items():
        weight[c], size[c] = weight.get(c, 0.0) + mass[a], size.get(c, 0) + 1
    todo = sorted(near)
    draw.shuffle(todo)
    waiting = set(todo)
    for a in todo:  # grows while it is read
        waiting.discard(a)
        c = of[a]
        if within is not None and size[c] > 1:
            continue
        to: dict = {}
        for b, w in near[a].items():
            if within is None or within[a] == within[b]:
                to[of[b]] = to.get(of[b], 0.0) + w
        stays = to.get(c, 0.0) - mass[a] * (weight[c] - mass[a]) / total
        gain, target = max(((w - mass[a] * weight[d] / total - stays, -d) for d, w in to.items() if d != c), default=(0.0, 0))
        if gain > LEAST:
            target = -target
            weight[c], weight[target], size[c], size[target] = weight[c] - mass[a], weight[target] + mass[a], size[c] - 1, size[target] + 1
            of[a] = target
            for b in near[a]:
                if of[b] != target and b not in waiting:
                    waiting.add(b)
                    todo.append(b)
    return of


def _leiden_here(seed: int):
    """node and c of one scope's links (scope, a, b, w)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        mass: dict = {}
        for a, b, w in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist(), strict=True):
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})
                mass[x] = mass.get(x, 0.0) + w
                if a != b:
                    near[x][y] = near[x].get(y, 0.0) + w
        total, draw = sum(mass.values()), random.Random(seed)
        part, of = {a: a for a in near}, {a: a for a in near}
        while True:
            of = _settle_here(near, mass, total, of, draw)
            fine = _settle_here(near, mass, total, {a: a for a in near}, draw, dict(of))
            if len(set(fine.values())) == len(fine):
                break
            new_near: dict = {}
            new_mass: dict = {}
            first: dict = {}
            for a, r in fine.items():
                first.setdefault(of[a], r)
                new_mass[r] = new_mass.get(r, 0.0) + mass[a]
                mine = new_near.setdefault(r, {})
                for b, w in near[a].items():
                    if fine[b] != r:
                        mine[fine[b]] = mine.get(fine[b], 0.0) + w
            of = {r: first[of[a]] for a, r in fine.items()}
            part, near, mass = {x: fine[a] for x, a in part.items()}, new_near, new_mass
        least: dict = {}
        for x in sorted(part):
            least.setdefault(of[part[x]], x)
        return pd.DataFrame({"node": list(part), "c": [least[of[a]] for a in part.values()]})

    return run


def leiden(nodes: DataFrame, edges: DataFrame, seed: int = 7) -> DataFrame:
    """node, scope and c (the least node of its community). nodes: node (long), scope; edges: scope, a, b, weight.

    Edges between scopes don't count, neither do weights of zero or less; a loop adds to its node's degree only.
    """
    links = edges.where("weight > 0").select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("w"))
    few, many, _ = _by_size(shared.materialize(links.groupBy("scope", "a", "b").agg(F.sum("w").alias("w")), "links"))
    found = few.groupBy("scope").applyInPandas(_leiden_here(seed), "node long, c long")
    if many is not None:
        hairs = shared.materialize(_hairs(many), "hairs")
        few, many, large = _by_size(shared.materialize(_trimmed(many, hairs), "links"))
        core = few.groupBy("scope").applyInPandas(_leiden_here(seed), "node long, c long")
        if many is not None:
            core = core.unionByName(_by_rounds(nodes.join(shared.checked(large), "scope", "left_semi"), many, seed))
        core = shared.materialize(core, "core")
        whole = core.unionByName(hairs.join(_by_sort(core.withColumnRenamed("node", "to")), "to").select("node", "c"))
        names = whole.groupBy("c").agg(F.min("node").alias("least"))
        found = found.unionByName(whole.join(_by_sort(names), "c").select("node", F.col("least").alias("c")))
    return nodes.select("node", "scope").join(_by_sort(found), "node", "left").select("node", "scope", F.coalesce("c", "node").alias("c"))


def _by_size(links: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Links of scopes that one task settles, those of larger ones (none if there is no such scope), and the larger scopes."""
    large = shared.materialize(links.groupBy("scope").count().where(F.col("count") > SMALL).select("scope"), "large")
    few = links.join(shared.checked(large), "scope", "left_anti")
    return few, None if large.isEmpty() else links.join(shared.checked(large), "scope", "left_semi"), large


def _hairs(links: DataFrame) -> DataFrame:
    """node and to: nodes with one link and no loop, and whom they are linked to; of two such nodes the greater is with the lesser."""
    ends = links.select("scope", F.col("a").alias("node"), F.col("b").alias("to")).union(links.where("a <> b").select("scope", "b", "a"))
    single = ends.groupBy("scope", "node").agg(F.count("*").alias("n"), F.min("to").alias("to")).where("n = 1 and to <> node").select("node", "to")
    two = _by_sort(single.select(F.col("node").alias("to"), F.col("to").alias("back")))
    return single.join(two, "to", "left").where("back is null or node > to").select("node", "to")


def _trimmed(links: DataFrame, hairs: DataFrame) -> DataFrame:
    """The links without hairs, whose own links are loops of the nodes that they are with."""
    for end in ("a", "b"):
        links = links.join(_by_sort(hairs.withColumnsRenamed({"node": end, "to": "with"})), end, "left").withColumn(end, F.coalesce("with", end)).drop("with")
    return links.groupBy("scope", "a", "b").agg(F.sum("w").alias("w"))


def _by_rounds(nodes: DataFrame, links: DataFrame, seed: int, levels: int = 20) -> DataFrame:
    """node and c of the nodes that have links (scope, a, b, w)."""
    ends = links.select("scope", F.col("a").alias("node"), "w").union(links.select("scope", F.col("b"), "w"))
    own = ends.groupBy("scope", "node").agg(F.sum("w").alias("k")).join(_by_sort(nodes.select("node")), "node", "left_semi")
    totals = links.groupBy("scope").agg((2 * F.sum("w")).alias("total"))
    own = own.join(shared.checked(shared.materialize(totals, "totals")), "scope")
    level = shared.materialize(own.select("node", "scope", "k", "total", F.col("node").alias("c")), "communities")
    two = links.where("a <> b").select("a", "b", "w")
    two = shared.materialize(two.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(two.select("b", "a", "w")), "links")
    members = level.select("node", F.col("node").alias("part"))
    for _ in range(levels):
        level = settle(level, two, seed)
        of = level.select("node", F.col("c").alias("p"))
        inside = two.join(_by_sort(of.withColumnsRenamed({"node": "x", "p": "px"})), "x").join(_by_sort(of.withColumnsRenamed({"node": "y", "p": "py"})), "y").where("px = py").select("x", "y", "w")
        inside = shared.materialize(inside, "links")
        refined = settle(level.withColumn("c", F.col("node")), inside, seed + 17, alone=True)
        refined = shared.materialize(refined.select("node", F.col("c").alias("r")).join(_by_sort(of), "node"), "refined")
        size = refined.agg(F.count("*").alias("before"), F.count_distinct("r").alias("after")).first()
        members = members.drop("p").withColumnRenamed("part", "of").join(_by_sort(refined.withColumnRenamed("node", "of")), "of")
        members = shared.materialize(members.select("node", F.col("r").alias("part"), "p"), "members")
        if size["after"] == size["before"]:
            break
        # The next graph: refined communities as nodes, each in the community that it was refined from.
        level = level.drop("c").join(_by_sort(refined), "node").groupBy(F.col("r").alias("node"), "scope", "total", F.col("p").alias("c")).agg(F.sum("k").alias("k"))
        level = shared.materialize(level.select("node", "scope", "k", "total", "c"), "communities")
        to = refined.select("node", "r")
        two = two.join(_by_sort(to.withColumnsRenamed({"node": "x", "r": "rx"})), "x").join(_by_sort(to.withColumnsRenamed({"node": "y", "r": "ry"})), "y").where("rx <> ry")
        two = shared.materialize(two.groupBy(F.col("rx").alias("x"), F.col("ry").alias("y")).agg(F.sum("w").alias("w")), "links")
    names = members.groupBy("p").agg(F.min("node").alias("c"))
    return members.join(_by_sort(names), "p").select("node", "c")


def modularity(members: DataFrame, edges: DataFrame) -> float:
    """Of a partition (node, c) of a graph (a, b, weight)."""
    of = members.select("node", "c")
    rows = edges.join(of.withColumnsRenamed({"node": "a", "c": "ca"}), "a").join(of.withColumnsRenamed({"node": "b", "c": "cb"}), "b")
    total = rows.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside")).first()
    ends = rows.select(F.explode(F.array(F.struct("ca", "weight"), F.struct(F.col("cb").alias("ca"), F.col("weight")))).alias("e")).select("e.*")
    degrees = ends.groupBy("ca").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s")).first()["s"]
    return 0.0 if not total["m"] else total["inside"] / total["m"] - degrees / (2 * total["m"]) ** 2


def hierarchy(nodes: DataFrame, edges: DataFrame, max_size: int = 10, seed: int = 7, max_levels: int = 12) -> DataFrame:
    """id, level, cluster: communities of a graph at level 0, and at each further level those parts into which larger ones fall.

    nodes: id, node_ord; edges: src, dst, weight. A cluster of up to max_size nodes, or one that doesn't fall apart, is final.
    Clusters are named by level and their least node_ord.
    """
    numbers = nodes.select("id", F.col("node_ord").cast("long").alias("node"))
    pairs = edges.join(_by_sort(numbers.withColumnsRenamed({"id": "src", "node": "a"})), "src").join(_by_sort(numbers.withColumnsRenamed({"id": "dst", "node": "b"})), "dst")
    pairs = shared.materialize(pairs.select("a", "b", F.col("weight").cast("double").alias("weight")), "edges")
    scopes = numbers.select("node", F.lit(0).cast("long").alias("scope"))
    out = None
    for level in range(max_levels):
        own = scopes.select("node", "scope")
        inside = pairs.join(_by_sort(own.withColumnsRenamed({"node": "a"})), "a").join(_by_sort(own.withColumnsRenamed({"node": "b", "scope": "other"})), "b").where("scope = other")
        found = leiden(scopes, inside.select("scope", "a", "b", "weight"), seed + level)
        sizes = found.groupBy("scope", "c").agg(F.count("*").alias("n"))
        falls = sizes.groupBy("scope").agg(F.count("*").alias("parts"))
        found = found.join(_by_sort(sizes), ["scope", "c"]).join(_by_sort(falls), "scope")
        found = shared.materialize(found if level == 0 else found.where("parts > 1"), "clusters")
        if found.isEmpty():
            break
        rows = found.join(_by_sort(numbers), "node").select("id", F.lit(level).alias("level"), F.concat(F.lit(f"{level}-"), F.col("c").cast("string")).alias("cluster"))
        out = rows if out is None else out.unionByName(rows)
        scopes = shared.materialize(found.where(F.col("n") > max_size).select("node", F.col("c").alias("scope")), "scopes")
        if scopes.isEmpty():
            break
    if out is None:
        return numbers.select("id", F.lit(0).alias("level"), F.lit("").alias("cluster")).where("false")
    return out
