"""The approximate vector index against exact search, on planted rows and after insertions."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.plans import catalogue
from lorewright.sources import vector_index
from lorewright.sources.vector_index import VectorIndex, lloyd


def exact(rows, k):
    """Ids of the k nearest by cosine, for each id divisible by 100; rows: id to vector."""
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q in ids[ids % 100 == 0]:
        out[str(q)] = set(ids[np.lexsort((ids, -(x @ x[ids == q][0])))[:k]].tolist())
    return out


def recall(found, wanted):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["id"])
    return np.mean([len(got.get(q, set()) & ids) / len(ids) for q, ids in wanted.items()])


def test_recall_of_all_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    found = catalogue.QUERIES["src6_index"](spark, sf).collect()
    assert all(sum(r["query_id"] == q for r in found) == 10 for q in map(str, range(0, 500, 100)))
    assert recall(found, exact(rows, 10)) >= 0.9


@pytest.fixture(scope="module")
def planted():
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(24)] for _ in range(30)]
    return {i: [c + draw.gauss(0, 0.25) for c in centres[draw.randrange(30) if i % 3 else 0]] for i in range(4000)}


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, f"m{i}") for i, v in rows.items()], "id long, vector array<double>, meta string")


def test_build_insert_reload(spark, planted, tmp_path):
    """A third of all rows in one cell; insertions replace by id; only probed cells and codes are read."""
    path = str(tmp_path / "index")
    first = {i: v for i, v in planted.items() if i < 3000} | {5000: None, 5001: [0.0] * 24, 5002: [1.0], 5003: [float("nan")] * 24}
    built = VectorIndex.build(frame(spark, first), path, cells=40)
    assert built.rows().count() == 3000
    moved = {i: [-x for x in planted[i]] for i in range(0, 3000, 7)}
    later = {i: v for i, v in planted.items() if i >= 3000} | moved
    VectorIndex.open(spark, path).insert(frame(spark, later))
    opened = VectorIndex.open(spark, path)
    now = planted | moved
    assert opened.rows().count() == opened.rows().select("id").distinct().count() == 4000
    queries = frame(spark, {i: v for i, v in now.items() if i % 100 == 0}).select(F.col("id").cast("string").alias("query_id"), "vector")
    assert 1 <= opened.reach <= 40
    found = opened.search(queries, 10).collect()
    assert recall(found, exact(now, 10)) >= 0.9 and all(r["meta"] == f"m{r['id']}" for r in found)
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in now.items()}
    assert all(abs(r["score"] - float(x[int(r["query_id"])] @ x[r["id"]])) < 1e-5 for r in found)

    one = opened.search(queries.where("query_id = '100'"), 10, probes=3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len({f for f in one.inputFiles() if "/rows/" in f}) < len(opened.rows().inputFiles())


def test_index_of_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(frame(spark, {1: [1.0]}).where("false"), str(tmp_path / "none"))


def test_means_keep_few_rows_apart():
    x = np.repeat(np.arange(5.0)[:, None], 3, 0)
    assert lloyd(x, 8).ravel().tolist() == [0, 1, 2, 3, 4]
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.01, (50, 2)) for c in range(6)])
    assert len(np.unique(np.round(lloyd(x, 6, rounds=30).mean(1)))) == 6


def test_nearest_by_blocks_is_brute_force_with_ties(spark, monkeypatch):
    """A vector's cosine with itself is 1 and copies tie by id, in blocks of any size; other lengths, nulls and zeros take no part."""
    import math

    from lorewright.operators import retrieval

    draw = np.random.default_rng(5)
    base = draw.normal(size=(30, 9))
    rows = [(f"v{i % 3}", i, f"n{i}", [float(x) for x in base[i % 30]]) for i in range(300)]
    rows += [("v0", 900, "zero", [0.0] * 9), ("v0", 901, "null", None), ("v1", 902, "part", [None] + [1.0] * 8), ("v2", 903, "short", [1.0, 2.0])]
    asked = [(str(i), rows[i][3]) for i in range(0, 300, 7)]
    vectors = spark.createDataFrame(rows, "video_name string, id long, entity_name string, vector array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>")
    dot = lambda a, b: functools.reduce(lambda s, p: s + p[0] * p[1], zip(a, b, strict=True), 0.0)  # noqa: E731  # sum() compensates
    for k, threshold in ((4, None), (25, 0.3)):
        wanted = set()
        for q, v in asked:
            for video in ("v0", "v1", "v2"):
                found = [(-max(-1.0, min(1.0, dot(v, r[3]) / math.sqrt(dot(v, v) * dot(r[3], r[3])))), r[1], r[2]) for r in rows[:300] if r[0] == video]
                found = sorted(f for f in found if threshold is None or -f[0] > threshold)[:k]
                wanted |= {(q, video, i, name, -s, at + 1) for at, (s, i, name) in enumerate(found)}
        for block, held in ((4_096, 1_000_000), (64, 50)):
            monkeypatch.setattr(retrieval, "ROWS_BLOCK", block)
            monkeypatch.setattr(retrieval, "HELD", held)
            got = retrieval.nearest(queries, vectors, k, threshold).select("query_id", "video_name", "id", "entity_name", "score", "rank").collect()
            assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)


def test_tasks_sort_out_the_best(spark, tmp_path, monkeypatch):
    """Pairs are sorted out within tasks, and whatever a task may hold, the same rows are found."""
    rows = spark.range(600).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(97)) - 48).cast("double")).alias("vector"))
    index = vector_index.VectorIndex.build(rows, f"{tmp_path}/index", parts=4)
    asked = rows.where("id % 40 = 0").select(F.col("id").cast("string").alias("query_id"), "vector")
    found = {}
    for kept in (40, 1_000_000):
        monkeypatch.setattr(vector_index, "KEPT", kept)
        found[kept] = sorted((r["query_id"], r["rank"], r["id"]) for r in index.search(asked, 5, probes=1_000, rerank=600).collect())
    exact = {r["query_id"]: np.array(r["vector"]) for r in asked.collect()}
    x = np.array([r["vector"] for r in rows.orderBy("id").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, v in exact.items():
        score = unit @ (v / np.linalg.norm(v))
        mine = [i for k, _, i in found[40] if k == q]
        assert np.allclose(np.sort(score[mine])[::-1], np.sort(score)[::-1][:5], atol=1e-6)
    assert found[40] == found[1_000_000] and len(found[40]) == 75


def test_search_sends_few_rows_through_the_driver(spark, tmp_path, monkeypatch):
    """Neither rows for each probed cell nor many found rows are broadcast; the best by codes are those of brute force, copies by id."""
    draw = np.random.default_rng(11)
    base = draw.normal(size=(900, 16))
    vectors = {i: base[0 if i % 3 == 0 else i].tolist() for i in range(900)}  # a third are copies of one, more than are ranked again
    rows = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "index"), parts=4, cells=20)
    sent = []
    real = F.broadcast

    def told(df):
        sent.append(df.count() * sum(16 if kind == "array<float>" else 1 for _, kind in df.dtypes))
        return real(df)

    monkeypatch.setattr(F, "broadcast", told)
    asked = rows.where("id < 400").select(F.col("id").cast("string").alias("query_id"), "vector")
    for part, rerank, most in ((asked, 150, 400 * 18), (asked.where("query_id % 40 = 0"), 150, 10 * 150 * 4)):
        sent.clear()
        found = index.search(part, 12, probes=20, rerank=rerank)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(int(r["query_id"]), []).append(r["id"])
        assert all(n <= most for n in sent), sent
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString() or len(got) <= 10
        stored = index.rows().orderBy("id").collect()
        x = np.array([r["vector"] for r in stored], np.float64)
        coded = np.array([index.centroids[r["cell"]] + np.concatenate([b[c] for b, c in zip(index.books, r["codes"], strict=True)]) for r in stored])
        for q, ids in got.items():
            near = np.round(coded @ x[q], 9)
            best = np.lexsort((np.arange(900), -near))[:rerank]
            wanted = best[np.lexsort((best, -np.round(x[best] @ x[q], 9)))][:12]
            assert ids == wanted.tolist()
        assert len(got) == part.count()
