"""Every query of the library's own runs; those that SQL can express give the SQL's rows."""

import pytest
from compare import assert_same, sql_rows

from lorewright.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    assert_same(catalogue.QUERIES[name](spark, small).toPandas(), sql_rows(small, catalogue.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_whole_texts_are_described_and_named(spark, small, monkeypatch):
    """q3_engine's nodes carry whole documents, gr3_unicode's names are whole values."""
    from lorewright.plans import graph_plans, more_plans

    texts = {r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    kept = {}
    base = more_plans.engine.KnowledgeBase
    monkeypatch.setattr(more_plans.engine, "KnowledgeBase", lambda **tables: kept.update(tables) or base(**tables))
    catalogue.QUERIES["q3_engine"](spark, small)
    assert {r["description"] for r in kept["nodes"].collect()} == texts
    resolve = graph_plans.graph.resolve_entities
    monkeypatch.setattr(graph_plans.graph, "resolve_entities", lambda nodes, *more: kept.update(named=nodes) or resolve(nodes, *more))
    catalogue.QUERIES["gr3_unicode"](spark, small)
    assert {r["id"] for r in kept["named"].collect()} == texts


def test_components_of_all_orders(spark, small):
    """gr4_components against union-find over every order."""
    ids = [r[0] for r in spark.read.parquet(f"{small}/customer.parquet").select("c_custkey").collect()]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a,) in spark.read.parquet(f"{small}/orders.parquet").select("o_custkey").collect():
        b = (a * 7 + 3) % len(ids) + 1
        if a in parent and b in parent:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r["id"]: r["component"] for r in catalogue.QUERIES["gr4_components"](spark, small).collect()}
    assert found == {i: find(i) for i in ids}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_optional_part(tmp_path):
    """With the subpackage and its pipeline gone, the entry imports and serves the rest."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lorewright", tmp_path / "lorewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name", ["gr7_global", "q2_visual"])
def test_words_of_a_text_are_made_once(spark, small, name):
    """A filter on a text's words isn't moved below the projection that makes them."""
    plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.split("\n") if "regexp_extract_all" in line and "concat_ws" in line]
    assert len(made) == 1
