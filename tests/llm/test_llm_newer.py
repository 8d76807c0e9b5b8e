"""Source divergence, conversation repair and exact search against brute force, and on the edge cases."""

import hashlib
import itertools
import random
import re
from fractions import Fraction

import pytest
from llm_rows import CLASHING
from pyspark.sql import functions as F

from lorewright.llm import op11_divergence, op12_conversations, op13_maxscore

# 11 source divergence ------------------------------------------------------------------------------------------------


def divergent(rows, min_docs, top):
    """Rows of (lang, source, part, item, value, rank) by exact fractions; rows: lang, source, text."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in {r[0] for r in rows}:
        docs = [(s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for x, s, t in rows if x == lang]
        terms = {t for _, d in docs for t in d}
        kept = sorted((t for t in terms if sum(t in d for _, d in docs) >= min_docs), key=str.encode)
        count = {s: {t: sum(d.count(t) for x, d in docs if x == s) for t in kept} for s in {s for s, _ in docs}}
        total = {t: sum(c[t] for c in count.values()) for t in kept}

        def shares(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + int(Fraction(10**9 * (c[t] + 2), n + 2 * len(kept))) for t in kept}

        value = lambda p, q: int(Fraction((p - q) ** 2, p + q))
        q = shares(total)
        for s, c in count.items():
            p = shares(c)
            others = sorted(((-sum(value(p[t], o[t]) for t in kept), x) for x, o in ((x, shares(count[x])) for x in count if x != s)), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", x, -v, k + 1) for k, (v, x) in enumerate(others)]
            own = sorted(((-value(p[t], q[t]), t) for t in kept if c[t] > 0 and p[t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, t) in enumerate(own)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def tagged(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    return df.withColumns({c: F.lit("clash") for c in (*CLASHING, "term", "docs", "chunk", "totals", "block", "value")})


def random_texts(seed, n, sources=5):
    draw = random.Random(seed)
    words = ["the", "The", "é", "日本", "a1b", "zeta", "Zeta's", "\U0001f600x", "rare", "tail", *(f"w{chr(97 + k)}" for k in range(20))]
    return [(draw.choice(["en", "de", None]), draw.choice([*(f"s{k}" for k in range(sources)), None]), " ".join(draw.choice(words) for _ in range(draw.randint(0, 30)))) for _ in range(n)]


def test_divergence_as_brute_force(spark):
    rows = random_texts(1, 150)
    assert told(op11_divergence.divergences(tagged(spark, rows))) == divergent(rows, 10, 10)


def test_divergence_in_small_chunks_and_blocks(spark, monkeypatch):
    """Chunks that end anywhere, and sources in many blocks, change nothing."""
    monkeypatch.setattr(op11_divergence, "BLOCK", 2)
    rows = random_texts(2, 200, sources=9)
    counts = sorted((lang or "", source or "", term) for lang, source, text in rows for term in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)))
    assert len(counts) > 300
    wanted = divergent(rows, 3, 4)
    for size in (1, 7, 50):
        monkeypatch.setattr(op11_divergence, "ROWS", size)
        monkeypatch.setattr(op11_divergence, "HELD", size)
        assert told(op11_divergence.divergences(tagged(spark, rows), min_docs=3, top=4)) == wanted


def test_divergence_edges(spark):
    long = "word " * 50_000 + "z" * 100_000
    rows = [("en", "a", None), ("en", "b", ""), (None, None, "12 34"), ("en", "c", long), ("en", "c", long), *[("de", "a", "gut Gut"), ("de", "b", "gut schön")] * 10]
    wanted = divergent(rows, 10, 10)
    assert told(op11_divergence.divergences(tagged(spark, rows))) == wanted
    assert [r for r in wanted if r[0] == "en"] == sorted(("en", x, "pair", y, 0, k + 1) for x in "abc" for k, y in enumerate(sorted(set("abc") - {x})))
    assert told(op11_divergence.divergences(tagged(spark, rows).where("false"))) == []


def test_shares_are_exact_beyond_floats():
    import numpy as np

    counts, n, kept = np.array([0, 5, 8_999_999_999_999_000]), 8_999_999_999_999_005, 3
    assert op11_divergence.shares(counts, n, kept).tolist() == [1 + 10**9 * (int(c) + 2) // (n + 6) for c in counts]


# 12 conversations ----------------------------------------------------------------------------------------------------


def repaired_by_search(turns):
    """Cost, audit and repaired turns by trying all edits of few turns; turns: role, text, in order."""
    faults, seen = [], set()
    for role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    options = []
    for (role, text), fault in zip(turns, faults, strict=True):
        mine = [("D", 4, [])]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            mine += [("K", more, [(role, text)]), ("R", 3 + more, [("user", text)]), ("R", 3 + more, [("assistant", text)])]
        options.append([("I" * len(i) + e, 3 * len(i) + c, [(r, "") for r in i] + t) for i in inserts for e, c, t in mine])
    options.append([("I" * len(i), 3 * len(i), [(r, "") for r in i]) for i in inserts])
    for way in itertools.product(*options):
        out = [t for _, _, ts in way for t in ts]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            found = (sum(c for _, c, _ in way), "".join(e for e, _, _ in way))
            if best is None or found < best[:2]:
                best = (*found, out)
    return (*best, [faults.count(f) for f in ("blank", "duplicate", "truncated")])


def wanted_digest(rows):
    """What the query gives for one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    known = [t for t, _, _ in rows if t is not None]
    cost, audit, out, faults = repaired_by_search([r[1:] for r in rows])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def digested(df, **more):
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[f] for f in fields) for r in op12_conversations.digests(op12_conversations.repair(df, **more)).collect()}


def talks(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("clash") for c in (*CLASHING, "range", "place", "parts", "digest", "seen", "present", "cost", "audit", "turns")})


def random_talks(seed, conversations, turns):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "ok", "", " \t", None, "Why? \n", "so.\x85"]
    return [(c if c else None, draw.choice([*range(8), None]), draw.choice(roles), draw.choice(texts)) for c in range(conversations) for _ in range(draw.randint(0, turns))]


def by_conversation(rows):
    found = {}
    for c, *row in rows:
        found.setdefault(c, []).append(tuple(row))
    return found


def test_conversations_as_search(spark):
    rows = random_talks(3, 60, 4)
    assert digested(talks(spark, rows)) == {c: wanted_digest(own) for c, own in by_conversation(rows).items()}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_conversations_that_span_ranges(spark, ranges):
    """However the turns are dealt, the repair is that of a conversation in one piece."""
    rows = random_talks(4, 12, 40) + [(99, t, "user" if t % 3 else "assistant", f"turn {t % 50}" + "." * (t % 2)) for t in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        found = digested(talks(spark, rows))
        parts = {r["conv_id"]: r["n"] for r in op12_conversations.repair(talks(spark, rows)).groupBy("conv_id").agg(F.max("parts").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ranges == 1 or parts[99] > 1
    wanted = {}
    for c, own in by_conversation(rows).items():
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        _, _, _, gaps, *counts, audit, turns = op12_conversations.repair_whole(c, [(*r, True) for r in own])
        wanted[c] = (gaps, *counts, audit, hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest())
    assert found == wanted


def test_conversation_edges(spark):
    long = "a b " * 200_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, None, None, None), (3, 5, "user", "Hi."), (3, 5, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (4, 0, "system", "Be.")]
    found = digested(talks(spark, rows))
    empty = hashlib.sha256(b"").hexdigest()
    assert found[1][5:7] == (0, "KK") and found[1][7] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert found[2] == (0, 1, 0, 0, 0, 4, "D", empty) and found[None][5:7] == (0, "KK")
    assert found[3] == (0, 0, 1, 0, 1, 7, "KDI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())
    assert found[4] == (0, 0, 0, 0, 0, 4, "D", empty)
    gone = digested(talks(spark, rows), present=F.col("conv_id") > 3)
    assert gone[1] == gone[2] == gone[3] == gone[None] == (0, 0, 0, 0, 0, 0, "", empty) and gone[4][5] == 4
    assert digested(talks(spark, rows).where("false")) == {}


def test_prefixes_do_not_mislead():
    """Letters that begin others': the shorter is less, yet may be the worse start; ranks after equally many turns get it right."""
    draw = random.Random(5)
    for _ in range(150):
        turns = [(draw.choice(["user", "assistant", "system", "x"]), draw.choice(["A.", "b", ""])) for _ in range(draw.randint(0, 4))]
        cost, audit, out, _ = repaired_by_search(turns)
        row = op12_conversations.repair_whole(1, [(k, r, t, True) for k, (r, t) in enumerate(turns)])
        assert (row[8], row[9], [(t["role"], t["text"]) for t in row[10]]) == (cost, audit, out)


# 13 search -----------------------------------------------------------------------------------------------------------


def best_rows(rows, asked, k):
    """query, rank, id, score by full products; rows: id, vector. Of a repeated id the least vector counts."""
    import math

    known = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        known[i] = min(known.get(i, v), v)
    out = []
    for q in sorted(known):
        if asked(q):
            scores = sorted((-sum(a * b for a, b in zip(known[q], v, strict=False)), i) for i, v in known.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def searched(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in (*CLASHING, "v", "asked", "shard", "block", "query_id", "score", "rank")})
    return sorted(tuple(r) for r in op13_maxscore.top_k(df, F.col("id") % 50 == 0, k).collect())


@pytest.mark.parametrize(("shard", "step"), [(16_384, 2_048), (100, 16)])
def test_search_as_brute_force(spark, monkeypatch, shard, step):
    """Ties, copies and negative components, in one shard and in many."""
    monkeypatch.setattr(op13_maxscore, "SHARD", shard)
    monkeypatch.setattr(op13_maxscore, "STEP", step)
    monkeypatch.setattr(op13_maxscore, "QUERIES", 5)
    draw = random.Random(6)
    centres = [[draw.gauss(0, 1) for _ in range(20)] for _ in range(5)]
    rows = [(i, [c + draw.gauss(0, 0.3) for c in draw.choice(centres)]) for i in range(500)]
    rows += [(i, [draw.choice([-1.0, 0.0, 1.0]) for _ in range(20)]) for i in range(500, 700)] + [(i + 700, rows[i][1]) for i in range(0, 500, 10)]
    assert searched(spark, rows) == best_rows(rows, lambda i: i % 50 == 0, 5)


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (50, [0.5, 0.1]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (None, [9.0, 9.0]), (1, [1.0]), (2, []), (3, [1.0, 2.0, 3.0]), (4, [-1e-9, -0.002])]
    assert searched(spark, rows) == best_rows(rows, lambda i: i % 50 == 0, 5)
    wide = [(0, [1e10, 1e10]), (1, [1e3, 5e2]), (2, [1e3, 5e2 + 1 / 256]), (50, [-1e3, 3.0])]
    assert searched(spark, wide) == best_rows(wide, lambda i: i % 50 == 0, 5)
    assert searched(spark, []) == [] and searched(spark, [(1, [1.0])]) == [] and searched(spark, [(0, [1.0])]) == []


def test_search_skips_work():
    """Queries with a few strong terms meet far fewer products of rows and terms than there are."""
    import numpy as np

    draw = np.random.default_rng(7)
    rows = np.floor(draw.normal(size=(20_000, 64)) * 3)
    rows[::7, :4] += 400
    queries = rows[:7_000:700].copy()
    ids = np.arange(len(rows))
    made, found, scores = op13_maxscore.search_shard(ids[:7_000:700], queries, ids, rows, 5)
    every = queries @ rows.T
    for j, q in enumerate(range(0, 7_000, 700)):
        every[j, q] = -np.inf
        wanted = np.lexsort((ids, -every[j]))[:5]
        assert found[j].tolist() == wanted.tolist() and scores[j].tolist() == every[j, wanted].tolist()
    assert made.sum() < 0.5 * rows.size * len(queries)
