"""Odds of second-order walks against the exact ones, and vectors of nodes that are trained in many tasks."""

import collections

import numpy as np
from pyspark.sql import functions as F

from lorewright.operators import walks

EDGES = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "d", 4.0), ("d", "e", 1.0), ("c", "c", 3.0), ("b", "a", 1.0)]


def frames(spark, edges, nodes):
    return spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string, weight double")


def test_adjacency_has_each_place_once(spark):
    hub = [("h", f"n{k}", 1.0) for k in range(500)] + [(f"n{k}", f"n{k + 1}", 0.5) for k in range(0, 200, 2)]
    _, edges = frames(spark, hub, [])
    rows = walks.adjacency(edges).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r["node"]].append(r["at"])
    degree = {n: len(p) for n, p in places.items()}
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and degree["h"] == 500
    assert all(r["degree"] == degree[r["neighbour"]] for r in rows)


def test_steps_have_the_exact_odds(spark):
    p, q = 0.25, 2.0
    nodes, edges = frames(spark, EDGES, ["a", "b", "c", "d", "e", "lonely"])
    found = walks.walks(nodes, edges, length=3, walks=4000, p=p, q=q).collect()
    assert {tuple(r["path"]) for r in found if r["start"] == "lonely"} == {("lonely",)} and len(found) == 24_000
    weight = collections.defaultdict(dict)
    for a, b, w in EDGES:
        if a != b:
            weight[a][b] = weight[b][a] = weight[a].get(b, 0) + w
    first, second = collections.Counter(), collections.Counter()
    for r in found:
        if len(r["path"]) == 3:
            first[tuple(r["path"][:2])] += 1
            second[tuple(r["path"])] += 1
    for (a, b), n in first.items():
        share = weight[a][b] / sum(weight[a].values())
        assert abs(n / 4000 - share) < 0.04
        odds = {c: w * (1 / p if c == a else 1.0 if c in weight[a] else 1 / q) for c, w in weight[b].items()}
        for c, o in odds.items():
            assert abs(second[a, b, c] / n - o / sum(odds.values())) < 4.5 * 0.5 / np.sqrt(n)


def test_rounds_do_not_grow_with_the_weights(spark, monkeypatch):
    """One neighbour in 200 is a million times as heavy as the others: draws are by weight, so few are refused."""
    written, write = [], walks.shared.materialize
    monkeypatch.setattr(walks.shared, "materialize", lambda df, name: written.append(name) or write(df, name))
    nodes, edges = frames(spark, [("h", f"n{k}", 1e6 if k == 7 else 1.0) for k in range(200)], ["h"])
    found = [r["path"] for r in walks.walks(nodes, edges, length=2, walks=2000).collect()]
    assert written.count("steps") == 1 and len(found) == 2000 and sum(p[1] == "n7" for p in found) >= 1990


def test_places_cover_the_line(spark):
    """A node's neighbours lie end to end on its line, each in the places between its first and last, whatever their ranges."""
    _, edges = frames(spark, [("h", f"n{k:03}", 0.1 * (k % 7 + 1) + 1e-9 * k) for k in range(400)], [])
    rows = sorted((r for r in walks.adjacency(edges).collect() if r["node"] == "h"), key=lambda r: r["at"])
    assert rows[0]["low"] == 0 and all(a["high"] == b["low"] for a, b in zip(rows, rows[1:], strict=False))
    assert rows[0]["first"] == 0 and rows[-1]["last"] == 399 and all(a["last"] == b["first"] or a["last"] == 399 for a, b in zip(rows, rows[1:], strict=False))
    assert all(abs(r["high"] - r["low"] - r["weight"]) < 1e-9 for r in rows)


def test_pairs_within_the_window(spark):
    paths = spark.createDataFrame([(["a", "b", "c", "a", "d"],), (["x"],)], "path array<string>")
    path, wanted = ["a", "b", "c", "a", "d"], collections.Counter()
    for i, a in enumerate(path):
        for j, b in enumerate(path):
            if i != j and abs(i - j) <= 2 and a != b:
                wanted[a, b] += 1
    assert {(r["a"], r["b"]): r["n"] for r in walks.pair_counts(paths, 2).collect()} == dict(wanted)


def test_vectors_in_many_tasks(spark, monkeypatch):
    """Two groups of nodes with one edge between: a node's vector is nearer to its own group's, with blocks of a few nodes."""
    monkeypatch.setattr(walks, "BLOCK", 8)
    n = 24
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i in range(n // 2) for j in range(i) if (i * j + i) % 3] + [("x0", "y0", 1.0)]
    nodes, edges = frames(spark, edges, [f"{g}{i}" for g in "xy" for i in range(n // 2)])
    paths = walks.walks(nodes, edges, length=6, walks=8)
    found = {r["id"]: np.array(r["vector"]) for r in walks.vectors(paths, size=8, epochs=3).collect()}
    assert len(found) == n
    unit = {k: v / np.linalg.norm(v) for k, v in found.items()}
    mean = lambda pairs: np.mean([unit[a] @ unit[b] for a, b in pairs])
    own = mean([(a, b) for a in unit for b in unit if a < b and a[0] == b[0]])
    other = mean([(a, b) for a in unit for b in unit if a[0] == "x" and b[0] == "y"])
    assert own > other + 0.2
    assert walks.vectors(paths.where(F.lit(False))).count() == 0
