"""Fuzzy names by shared grams: the same rows as comparing every name with every alias, from far fewer pairs."""

import difflib
import random

from pyspark.sql import functions as F

from lorewright.functions import unicode as U


def test_as_comparing_all_pairs(spark):
    draw = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ '-É0"
    aliases = {"".join(draw.choice(letters) for _ in range(draw.randint(3, 40))).strip() or "X": [] for _ in range(1000)}
    table = {a.upper(): a.upper() for a in aliases}

    def edited(word):
        word = list(word)
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            at = draw.randint(0, len(word))
            word[at : at + draw.choice([0, 1])] = draw.choice(["", draw.choice(letters)])
        return "".join(word)

    names = [edited(draw.choice(list(aliases))) if draw.random() < 0.6 else "".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(9_990)]
    names += ["AAAA" * 10, "Z" * 5000, "", "A", *[a + a for a in list(aliases)[:6]]]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, raw string")
    found = {r["i"]: r["name"] for r in U.normalize_names(rows, "raw", aliases).collect()}
    pairs = U.candidate_pairs(rows.selectExpr("upper(raw) as lw_name").distinct(), U.alias_table(spark, aliases), 0.92).count()
    memo = {}

    def wanted(name):
        bare = name.strip().strip('"').strip("'").upper()
        if not bare:
            return "Unknown"
        if bare in table or bare.replace("É", "E") in table:
            return table.get(bare) or table[bare.replace("É", "E")]
        if bare not in memo:
            size = [a for a in table if 2 * min(len(a), len(bare)) >= 0.919 * (len(a) + len(bare))]
            close = difflib.get_close_matches(bare, size, 1, 0.92)
            memo[bare] = table[close[0]] if close else bare
        return memo[bare]

    assert found == {i: wanted(n) for i, n in enumerate(names)}
    assert sum(found[i] != n.strip().strip("'").upper() for i, n in enumerate(names)) > 1000
    assert pairs < 0.02 * len(set(names)) * len(aliases)
    print(pairs, "of", len(set(names)) * len(aliases), "pairs compared")


def test_without_aliases(spark):
    rows = spark.createDataFrame([("a",), (None,), ("",)], "raw string")
    assert sorted(r["name"] for r in U.normalize_names(rows, "raw", {"X": []}).collect()) == ["A", "Unknown", "Unknown"]


def test_entity_keys_step_by_step(spark):
    """The same keys as in one expression, each name normalised once a step; names resolve by them whatever their length."""
    from lorewright.operators import graph

    names = ['"“Pyké’s Hook”"', " \u00a0'Ａ &amp; B'\u2003\n", "Straße\u0301", "Ἀχιλλεύς x", "", "''", "é" * 70 + "a", None, "a b\u2028", "\u0085 q", "x" * 63, "x" * 64, "\"x" + "x" * 63 + '"', "y z " * 40, "Y-Z " * 40]
    rows = spark.createDataFrame(list(enumerate(names)), "node_ord long, name string").repartition(2)
    one = {r[0]: r[1] for r in rows.select("node_ord", U.entity_key(F.col("name"))).collect()}
    assert {r["node_ord"]: r["key"] for r in U.with_entity_key(rows, "name", "key").collect()} == one
    plan = U.with_entity_key(rows, "name", "key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reflect(") + plan.count("java_method(") == 3
    nodes = rows.where("name is not null").select(F.col("name").alias("id"), "node_ord", F.lit("PERSON").alias("entity_type"), F.lit("d").alias("description"), F.lit("s").alias("source_id"))
    found = graph.resolve_entities(nodes, spark.createDataFrame([], "src string, dst string"), U.entity_key, U.unquote)[0].collect()
    firsts = {}
    for k, v in sorted(one.items()):
        firsts.setdefault(v or f"none {k}", k)
    assert {r["node_ord"] for r in found} == {k for v, k in firsts.items() if names[k] is not None} and len(found) == len({r["node_ord"] for r in found})
