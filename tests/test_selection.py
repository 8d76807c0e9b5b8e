"""Ranks by rounds of selection, and lookups that read the buckets they need."""

import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators import evaluate, lookup


def wanted(rows, q):
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    return {k: sorted(v)[round(q * (len(v) - 1))] for k, v in held.items()}


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_ranks_by_rounds(spark, monkeypatch, q):
    """Keys of one value, of ties, of far tails and of many values; a null key; few rows are sorted at last."""
    monkeypatch.setattr(evaluate, "FEW", 20)
    monkeypatch.setattr(evaluate, "GRID", 8)
    draw = random.Random(4)
    rows = [("same", 2.5)] * 300 + [("two", draw.choice([1.0, 2.0])) for _ in range(301)] + [("tail", 10 ** draw.uniform(-200, 200)) for _ in range(500)]
    rows += [("many", draw.random()) for _ in range(3000)] + [(None, draw.gauss(0, 1)) for _ in range(200)] + [("one", 7.0), ("none", None), ("mostly", 1.0)] + [("mostly", x) for x in [0.0] * 400 + [5.0] * 30]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r["k"]: r["p"] for r in evaluate.percentile(df, ["k"], "v", q, "p").collect()} == wanted(rows, q)


def test_lookup_reads_its_buckets(spark, tmp_path):
    edges = [(f"n{k}", f"n{(k * 7) % 400}", float(k)) for k in range(400)] + [("hub", f"n{k}", 1.0) for k in range(300)]
    nodes = spark.createDataFrame([(f"n{k}", f"a{k}") for k in range(400)] + [("hub", "h")], "id string, about string")
    stored = lookup.GraphLookup.write(nodes, spark.createDataFrame(edges, "src string, dst string, weight double"), str(tmp_path / "g"), buckets=16)
    asked = spark.createDataFrame([("n0",), ("n5",), ("hub",), ("nobody",)], "id string")
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a) if a != b else near[a].append(a)
    assert {r["id"]: r["has_node"] for r in stored.has_node(asked).collect()} == {"n0": True, "n5": True, "hub": True, "nobody": False}
    assert {r["id"]: r["degree"] for r in stored.degrees(asked).collect()} == {i: len(near.get(i, [])) for i in ("n0", "n5", "hub", "nobody")}
    pairs = spark.createDataFrame([("hub", "n3"), ("n3", "hub"), ("hub", "n399"), ("n5", "n35"), ("n35", "n5"), ("x", "y")], "src string, dst string")
    assert {(r["src"], r["dst"]): r["has_edge"] for r in stored.has_edge(pairs).collect()} == {("hub", "n3"): True, ("n3", "hub"): True, ("hub", "n399"): False, ("n5", "n35"): True, ("n35", "n5"): True, ("x", "y"): False}
    found = stored.node_edges(asked.where(F.col("id") == "n5"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan and "EqualTo(node,n5)" in plan.replace("In(node, [n5])", "EqualTo(node,n5)")
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "bucket=" in f}) <= 16
    assert found.count() == len(near["n5"])


def test_embeddings_as_by_hand(spark):
    """Vectors of hashed words, component by component."""
    import numpy as np
    import xxhash

    from lorewright import hooks

    texts = ["one two two", "", None, "One é 日本", " a\tb "]
    found = [r["vector"] for r in hooks.hashed_embedding(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 16).collect()]
    for text, vector in zip(texts, found, strict=True):
        v = np.zeros(16)
        for w in (text or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            v[h % 16] += 1 if h >= 1 << 63 else -1
        n = np.linalg.norm(v)
        assert np.allclose(vector, v / n if n else v, atol=1e-6)


def test_regions_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks grow with the matches, and main names and partners are those of sorting each frame's matches."""
    import random

    from lorewright.sources import tables

    draw = random.Random(3)
    rows = [(draw.randrange(60), draw.choice(["middle", "partners", "left"]), f"n{draw.randrange(9)}", draw.choice([None, 0.0, 1.0, 2.5, 2.5, 7.0])) for _ in range(900)]
    monkeypatch.setattr(tables, "TASK_MATCHES", 50)
    found = tables.best_regions(spark.createDataFrame(rows, "frame_key int, region string, name string, score double"))
    assert "hashpartitioning(frame_key" in (plan := found._jdf.queryExecution().toString()) and ", 18)" in plan
    for r in found.collect():
        ranked = {g: list(dict.fromkeys(n for _, n in sorted((-s if s is not None else 1.0, n) for f, region, n, s in rows if f == r["frame_key"] and region == g))) for g in ("middle", "partners")}
        main = (ranked["middle"] or ["Unknown"])[0]
        assert r["main"] == main and r["partners"] == ranked["partners"][:4]
        assert r["entities"] == list(dict.fromkeys(([main] if main != "Unknown" else []) + ranked["partners"][:4]))
    assert {r["frame_key"] for r in found.collect()} == {f for f, *_ in rows}
