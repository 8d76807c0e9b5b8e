"""Parallel Leiden against a sequential one, and the properties that every level must have."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators import communities


def graph_of(edges):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
    return near


def quality(near, of):
    m2 = sum(sum(n.values()) for n in near.values())
    inside = sum(w for a, n in near.items() for b, w in n.items() if of[a] == of[b])
    mass = {}
    for a, n in near.items():
        mass[of[a]] = mass.get(of[a], 0) + sum(n.values())
    return inside / m2 - sum(k * k for k in mass.values()) / m2**2


def sequential(edges, seed=1):
    """Plain Leiden: one node at a time, refinement, coarsening; the partition of the nodes."""
    draw = random.Random(seed)
    near = graph_of(edges)
    m2 = sum(sum(n.values()) for n in near.values())
    mass = {a: sum(n.values()) for a, n in near.items()}
    groups = {a: [a] for a in near}
    of = {a: a for a in near}

    def move(near, mass, of, merge_only=False, within=None):
        total = {}
        for a in near:
            total[of[a]] = total.get(of[a], 0) + mass[a]
        size = {c: list(of.values()).count(c) for c in set(of.values())}
        moved = True
        while moved:
            moved = False
            for a in draw.sample(sorted(near), len(near)):
                c = of[a]
                if merge_only and size[c] > 1:
                    continue
                to = {}
                for b, w in near[a].items():
                    if b != a and (within is None or within[a] == within[b]):
                        to[of[b]] = to.get(of[b], 0) + w
                gain = {d: w - to.get(c, 0) - mass[a] * (total[d] - total[c] + mass[a]) / m2 for d, w in to.items() if d != c}
                best = max(gain, key=lambda d: (gain[d], -d), default=None)
                if best is not None and gain[best] > 1e-12:
                    total[c] -= mass[a]
                    total[best] += mass[a]
                    size[c] -= 1
                    size[best] += 1
                    of[a] = best
                    moved = True
        return of

    while True:
        of = move(near, mass, of)
        fine = move(near, mass, {a: a for a in near}, True, of)
        if len(set(fine.values())) == len(near):
            return {x: of[a] for a, xs in groups.items() for x in xs}
        merged, new_mass, new_groups, new_of = {}, {}, {}, {}
        for a, c in fine.items():
            new_groups.setdefault(c, []).extend(groups[a])
            new_mass[c] = new_mass.get(c, 0) + mass[a]
            new_of[c] = of[a]
            for b, w in near[a].items():
                merged.setdefault(c, {})[fine[b]] = merged.setdefault(c, {}).get(fine[b], 0) + w
        first = {}
        for c, p in new_of.items():
            first.setdefault(p, c)
        near, mass, groups, of = merged, new_mass, new_groups, {c: first[p] for c, p in new_of.items()}


def connected(nodes, near):
    seen, todo = set(), [min(nodes)]
    while todo:
        a = todo.pop()
        if a not in seen:
            seen.add(a)
            todo += [b for b in near.get(a, {}) if b in nodes]
    return seen == set(nodes)


def found_by_spark(spark, nodes, edges):
    n = spark.createDataFrame([(a, 0) for a in nodes], "node long, scope long")
    e = spark.createDataFrame([(0, a, b, float(w)) for a, b, w in edges], "scope long, a long, b long, weight double")
    rows = communities.leiden(n, e)
    return {r["node"]: r["c"] for r in rows.collect()}, communities.modularity(rows, e)


def planted(seed, groups=6, size=12, inner=0.5, outer=0.03):
    draw = random.Random(seed)
    n = groups * size
    return n, [(a, b, draw.choice([1, 1, 2])) for a, b in itertools.combinations(range(n), 2) if draw.random() < (inner if a // size == b // size else outer)]


@pytest.mark.parametrize(("kind", "small"), [("planted", 50_000), ("star", 50_000), ("ring", 50_000), ("planted", 0), ("star", 0)])
def test_as_good_as_sequential(spark, monkeypatch, kind, small):
    """Within a task, and by rounds."""
    monkeypatch.setattr(communities, "SMALL", small)
    if kind == "planted":
        n, edges = planted(5, inner=0.7, outer=0.01) if small else planted(5, groups=2, size=12, inner=0.7, outer=0.01)
    elif kind == "star":
        edges = [(0, k, 1) for k in range(1, 30)] + [(100, k, 1) for k in range(101, 125)] + [(0, 100, 1)]
    else:
        edges = [(k, (k + 1) % 40, 1 + k % 3) for k in range(40)]
    near = graph_of(edges)
    of, q = found_by_spark(spark, sorted(near), edges)
    assert set(of) == set(near) and abs(q - quality(near, of)) < 1e-9
    for c in set(of.values()):
        own = {a for a in of if of[a] == c}
        assert min(own) == c and connected(own, near)
    plain = max(quality(near, sequential(edges, s)) for s in range(3))
    assert q >= plain - (1e-9 if kind != "ring" else 0.005)
    if kind == "planted":
        assert len(set(of.values())) == n // 12 and all(of[a] == a // 12 * 12 for a in of)


def test_edges_of_no_weight_and_lonely_nodes(spark):
    of, _ = found_by_spark(spark, [1, 2, 3, 4, 5], [(1, 2, 1), (2, 1, 1), (3, 3, 5), (4, 5, 0)])
    assert of == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_levels_split_large_clusters(spark):
    n, edges = planted(8, groups=4, size=16, inner=0.6, outer=0.02)
    # Each group is two halves with few edges between them.
    edges = [(a, b, w) for a, b, w in edges if a // 16 != b // 16 or a // 8 == b // 8 or (a + b) % 4 == 0]
    nodes = spark.createDataFrame([(f"n{a}", a) for a in range(n)], "id string, node_ord long")
    links = spark.createDataFrame([(f"n{a}", f"n{b}", float(w)) for a, b, w in edges], "src string, dst string, weight double")
    rows = communities.hierarchy(nodes, links, max_size=10).collect()
    levels = {}
    for r in rows:
        levels.setdefault(r["level"], {}).setdefault(r["cluster"], set()).add(int(r["id"][1:]))
    near = graph_of(edges)
    assert set().union(*levels[0].values()) == set(range(n)) and len(levels) > 1
    for level, clusters in levels.items():
        assert all(connected(c, near) for c in clusters.values())
        if level:
            assert all(any(c < p and len(p) > 10 for p in levels[level - 1].values()) for c in clusters.values())
    empty = communities.hierarchy(nodes.where("false"), links.where("false"))
    assert empty.columns == ["id", "level", "cluster"] and empty.isEmpty()


def test_levels_feed_the_community_schema(spark):
    from lorewright.operators import graph

    nodes = spark.createDataFrame([(f"n{a}", a, f"c{a % 3}") for a in range(24)], "id string, node_ord long, source_id string")
    pairs = [(f"n{a}", f"n{b}", 1.0) for a, b in itertools.combinations(range(24), 2) if a // 6 == b // 6] + [("n0", "n6", 1.0), ("n12", "n18", 1.0), ("n5", "n12", 0.2)]
    links = spark.createDataFrame(pairs, "src string, dst string, weight double")
    members = communities.hierarchy(nodes, links, max_size=5)
    rows = graph.community_schema(members, nodes, links).where(F.col("level") == 0).collect()
    assert len(rows) == 4 and all(len(r["nodes"]) == 6 and r["chunk_ids"] == ["c0", "c1", "c2"] for r in rows)


def test_nodes_of_one_link_take_no_rounds(spark, monkeypatch):
    """In scopes that are too large for a task, they go where their neighbours do before any round."""
    monkeypatch.setattr(communities, "SMALL", 10)

    def none(*_, **__):
        raise AssertionError("rounds")

    monkeypatch.setattr(communities, "settle", none)
    edges = [(50, k, 2) for k in range(20)] + [(60, k, 1) for k in range(61, 90)] + [(50, 60, 1), (91, 90, 3), (92, 93, 1), (93, 92, 1), (94, 95, 1), (94, 94, 1)]
    near = graph_of([(a, b, w) for a, b, w in edges if a != b])
    of, _ = found_by_spark(spark, sorted(near), edges)
    assert of == {**{k: 0 for k in (*range(20), 50)}, **{k: 60 for k in range(60, 90)}, 90: 90, 91: 90, 92: 92, 93: 92, 94: 94, 95: 94}


def test_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    write, settle = communities.shared.materialize, communities.settle
    monkeypatch.setattr(communities.shared, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    monkeypatch.setattr(communities, "settle", lambda *a, **k: settle(*a, **{**k, "rounds": 1}))
    nodes = spark.createDataFrame([(a, 0) for a in range(4)], "node long, scope long")
    links = spark.createDataFrame([(0, a, b, 1.0) for a, b in itertools.combinations(range(4), 2)], "scope long, a long, b long, w double")
    communities._by_rounds(nodes, links, 7, levels=1)
    assert {"moves", "communities", "refined", "members"} <= {n for n, _ in plans}
    # Only the scopes' totals are broadcast, by count, where the first communities are made.
    assert sum(p.count("BroadcastHashJoin") for _, p in plans) <= 1
