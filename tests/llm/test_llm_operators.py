"""Each operator against a brute-force version, on planted rows and on the edge cases."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_rows import CLASHING, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorewright.llm import op01_warc, op02_lines, op03_packing, op04_langid, op05_fingerprints, op06_minhash, op07_vectors, op08_lm, op09_bpe, op10_substrings

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(TOKENIZER)


def words(text):
    return (text or "").encode().split()


# 1 WARC ------------------------------------------------------------------------------------------------------------


def test_derivatives_are_linked(spark):
    head = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-A:  b : c \r\n\r\n"
    rows = [("<urn:1>", "http://a", "d", head + "<p>a &amp; b</p><script>x<y</script>c", 1), ("<urn:2>", None, "d", "no headers", 2), (None, "u", "d", "x", 3), ("<urn:4>", "u", "d", None, 4), ("<urn:5>", "u", "d", head, 5)]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block string, source_id int").withColumn("text", F.lit("clash"))
    found = {(r["source_id"], r["record_type"]): r for r in op01_warc.derivatives(df).collect()}
    assert sorted(found) == [(1, "conversion"), (1, "metadata"), (2, "conversion"), (2, "metadata"), (5, "conversion"), (5, "metadata")]
    meta, text = found[1, "metadata"], found[1, "conversion"]
    assert meta["refers_to"] == text["refers_to"] == "<urn:1>" and text["block"] == "a & b\nc"
    assert "http-header-x-a: b : c" in meta["block"] and f"conversion-record-id: {text['record_id']}" in meta["block"] and "http-status-line: HTTP/1.1 404 Not Found" in meta["block"]
    for r in found.values():
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
    assert found[2, "conversion"]["block"] == "" and found[5, "conversion"]["block"] == ""
    warc = op01_warc.serialized(op01_warc.derivatives(df)).where("record_type = 'conversion' and source_id = 1").first()["warc"]
    assert warc.startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and warc.endswith("a & b\nc\r\n\r\n") and "WARC-Refers-To: <urn:1>" in warc
    assert op01_warc.derivatives(df.where("false")).count() == 0


# 2 lines -----------------------------------------------------------------------------------------------------------


def alike(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 10 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def kept_lines(rows):
    seen, out = collections.defaultdict(set), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        keep = []
        for line in (text or "").split("\n"):
            if not re.search(r"[^ \t\n\x0b\f\r]", line):
                keep.append(line)
                continue
            if line not in seen[len(line)] and not any(alike(line, x) for d in (-1, 0, 1) for x in seen[len(line) + d]):
                keep.append(line)
            seen[len(line)].add(line)
        out[i] = "\n".join(keep)
    return out


def test_lines_as_brute_force(spark):
    draw = random.Random(2)
    base = ["".join(draw.choice("abcdé\U0001f600 ") for _ in range(draw.choice([3, 9, 10, 11, 12, 13, 20, 50, 100]))) for _ in range(50)]

    def edit(line):
        line = list(line)
        for _ in range(draw.choice([0, 1, 1, 2])):
            p, kind = draw.randint(0, len(line)), draw.random()
            if kind < 0.35:
                line.insert(p, draw.choice("abé\U0001f600"))
            elif p < len(line):
                line[p : p + 1] = [draw.choice("abé")] if kind < 0.7 else []
        return "".join(line)

    rows = [(k, "\n".join(edit(draw.choice(base)) for _ in range(draw.randint(0, 8)))) for k in range(120)]
    found = op02_lines.dedup_lines(documents(spark, rows)).collect()
    wanted = kept_lines(rows)
    assert all(r["text"] == wanted[r["doc_id"]] for r in found) and len(found) == len(rows)


def test_lines_edges(spark, edge):
    rows = [*edge, (None, "one"), (None, "one"), (20, "one"), (21, "\n" * 5 + "x")]
    found = op02_lines.dedup_lines(documents(spark, rows)).collect()
    wanted = kept_lines(rows)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["text"] == "one" and r["lw_removed"] == 0
        else:
            assert (r["text"] or "") == wanted[r["doc_id"]]
            assert all(r[c] == "clash" for c in CLASHING)
    assert op02_lines.dedup_lines(documents(spark, rows).where("false")).count() == 0


def test_lines_repeat_an_id(spark):
    found = op02_lines.dedup_lines(documents(spark, [(1, "a line of text"), (1, "a line of text"), (2, "a line of text")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == [(1, "a line of text"), (1, "a line of text"), (2, "")]
    # Texts of one id that differ are documents of their own: the near line goes, the other stays.
    found = op02_lines.dedup_lines(documents(spark, [(1, "a line of text A"), (2, "something else"), (2, "a line of text B")])).collect()
    assert sorted((r["doc_id"], r["text"], r["lw_removed"]) for r in found) == [(1, "a line of text A", 0), (2, "", 1), (2, "something else", 0)]


# 3 packing ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seq_len", [1, 7, 4096])
def test_packing_is_gapless(spark, edge, seq_len):
    rows = [r for r in edge if seq_len > 1 or len(r[1] or "") < 1000] + [(None, "null id"), (5, "repeated id")]
    found = op03_packing.pack(documents(spark, rows).repartition(3), TOKENIZER, seq_len).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in found:
        assert len(p["ids"]) == 4 * p["length"] > 0
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["id"]].append(p)
    last = max(by_seq)
    for s, pieces in by_seq.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == seq_len or s == last
    for i, text in rows:
        if [r[0] for r in rows].count(i) == 1:
            ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            pieces = sorted(by_doc[i], key=lambda p: p["start"])
            assert b"".join(bytes(p["ids"]) for p in pieces) == ids.tobytes() and {p["doc_tokens"] for p in pieces} == {len(ids)}
    assert sum(p["length"] for p in found) == sum(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_packing_without_end(spark):
    assert op03_packing.pack(documents(spark, [(1, None), (2, "")]), TOKENIZER, 8, None).count() == 0
    assert op03_packing.pack(documents(spark, [(1, "a")]).where("false"), TOKENIZER).count() == 0


# 4 language ID -----------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = op04_langid.fit(rows.where(crc != 1))
    found = op04_langid.predict(rows.where(crc == 1), model).join(rows.select(F.col("doc_id").alias("id"), "lang"), "id").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97
    assert found["score"].between(0, 1).all() and found["rejected"].mean() < 0.02


def test_unlearned_latin_texts_are_rejected(spark):
    """A language left out of the training, and random letters."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op04_langid.fit(rows.where("lang <> 'es'"))
    assert np.mean([r["rejected"] for r in op04_langid.predict(rows.where("lang = 'es'"), model).collect()]) > 0.9
    draw = random.Random(12)
    noise = documents(spark, [(k, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(50 * k))) for k in range(4, 60)])
    assert all(r["rejected"] for r in op04_langid.predict(noise, model).collect())


def test_language_edges(spark, edge):
    train = documents(spark, [(k, "the cat sat on the mat and then " * 3) for k in range(5)], "en").unionByName(documents(spark, [(9, "der hund und die katze sind nicht da " * 3)], "de")).unionByName(documents(spark, [(11, None)], None).withColumn("lang", F.lit(None).cast("string")))
    model = op04_langid.fit(train)
    rows = [*edge, (30, "the cat and the mat"), (31, "日本語 テキスト"), (32, "123 456"), (33, "die katze und der hund")]
    found = {r["id"]: r for r in op04_langid.predict(documents(spark, rows), model).collect()}
    assert all(found[k]["lang_pred"] == "und" and found[k]["rejected"] for k in (1, 2, 3, 32))
    assert found[30]["lang_pred"] == "en" and not found[30]["rejected"] and found[33]["lang_pred"] == "de" and found[31]["rejected"]
    flagged = op04_langid.flag(documents(spark, rows), model)
    assert {r["doc_id"]: r["lw_rejected"] for r in flagged.collect()} == {k: r["rejected"] for k, r in found.items()}
    none = op04_langid.fit(train.where("false"))
    assert {r["lang_pred"] for r in op04_langid.predict(documents(spark, rows), none).collect()} == {"und"}
    assert op04_langid.predict(documents(spark, rows).where("false"), model).count() == 0


# 5 fingerprints ----------------------------------------------------------------------------------------------------


def canon(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub("[ \t\n\x0b\x0c\r\x85\xa0  -     　]+", " ", text).strip(" ")


def check_report(found, rows):
    rows = sorted(rows, reverse=True)
    seen = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        changed, r = text[: len(text) - cut] + after[:cut], found[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for t, f in ((text, r["fingerprint"]), (changed, r["edited_fingerprint"])):
            assert seen.setdefault(canon(t), f) == f
        assert r["near_next"] == float(canon(text) == canon(after)) and r["near_edited"] == float(canon(text) == canon(changed))
    assert len(set(seen.values())) == len(seen)


def test_fingerprints(spark, edge):
    rows = [*edge, (40, "Straße  X"), (41, "STRASSE x "), (42, "fine é"), (43, "ﬁne é"), (-5, "z" * 40)]
    check_report({r["id"]: r for r in op05_fingerprints.edit_report(documents(spark, rows)).collect()}, rows)
    check_report({r["id"]: r for r in op05_fingerprints.edit_report(documents(spark, rows[:1])).collect()}, rows[:1])
    assert op05_fingerprints.edit_report(documents(spark, rows).where("false")).count() == 0


def test_fingerprints_survive_equal_hashes(spark, edge, monkeypatch):
    weak = lambda t: F.struct(F.pmod(F.xxhash64(op05_fingerprints.canonical(t)), F.lit(2)).alias("h1"), F.lit(0).cast("long").alias("h2"))
    monkeypatch.setattr(op05_fingerprints, "wide_hash", weak)
    rows = [*edge, (40, "Straße  X"), (41, "STRASSE x ")]
    check_report({r["id"]: r for r in op05_fingerprints.edit_report(documents(spark, rows)).collect()}, rows)
    found = {r["key"]: r["fingerprint"] for r in op05_fingerprints.fingerprints(documents(spark, rows)).collect()}
    assert found[40] == found[41] and len(set(found.values())) == len({canon(t) for _, t in rows})


# 6 MinHash ---------------------------------------------------------------------------------------------------------


def shingles(text):
    w = words((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows):
    sets_ = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets_}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets_ if sets_[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets_[a] & sets_[b])
            if inter and 100 * inter >= 75 * (len(sets_[a]) + len(sets_[b]) - inter):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets_[i]), find(i)) for i in sets_}


def test_minhash_as_brute_force(spark, edge):
    draw = random.Random(4)
    rows = list(edge)
    for g in range(12):
        base = [f"{draw.choice('abcdefgh')}{draw.randint(0, 400)}" for _ in range(draw.randint(30, 200))]
        for c in range(draw.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = f"new{draw.random()}"
            rows.append((100 + 20 * g + c, " ".join(copy).upper() if c % 2 else " ".join(copy)))
    found = {r["id"]: r for r in op06_minhash.near_duplicates(documents(spark, [*rows, (None, "a b c d e f")])).collect()}
    wanted = near_components(rows)
    assert all((found[i]["n_shingles"], found[i]["component_id"]) == wanted[i] and found[i]["kept"] == (wanted[i][1] == i) for i in wanted)
    assert found[None]["component_id"] is None and found[None]["kept"]
    assert op06_minhash.near_duplicates(documents(spark, rows).where("false")).count() == 0


def test_minhash_star_of_near_copies(spark):
    """Copies that are near to one text but not to each other are found through it, wherever it stands."""
    draw = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for c in range(40):
        copy = list(base)
        for k in draw.sample(range(120), 2):
            copy[k] = f"x{c}.{k}"
        rows.append((c, " ".join(copy)))
    rows.append((1000, " ".join(base)))
    found = {r["id"]: r["component_id"] for r in op06_minhash.near_duplicates(documents(spark, rows)).collect()}
    assert found == {i: c for i, (_, c) in near_components(rows).items()}


def template_group(n, pairs):
    """n texts of one template, pairwise at 0.71 and not linked, and some with a copy at 0.76 that meets them in hot buckets only."""
    texts_ = [[*(f"t{k}" for k in range(150)), *(f"u{c}.{k}" for k in range(30))] for c in range(n)]
    shingle = op06_minhash.Shingler(5)
    keys = lambda w: set(op06_minhash.band_keys(op06_minhash.signature(shingle(" ".join(w)))).tolist())
    count = collections.Counter(k for w in texts_ for k in keys(w))
    rows, copies = [(c, " ".join(w)) for c, w in enumerate(texts_)], []
    for c, w in enumerate(texts_):
        copy = [*w[:157], *(f"v{c}.{k}" for k in range(23))]
        both = keys(w) & keys(copy)
        if len(copies) < pairs and c > n // 2 and both and min(count[k] for k in both) > n // 4:
            copies.append((10_000 + c, " ".join(copy)))
    assert len(copies) == pairs
    return rows + copies


def test_minhash_pairs_in_hot_buckets(spark):
    """Near pairs within a large group that is just not linked are all found, whatever the number of pairs."""
    rows = template_group(400, 4)
    found = {r["id"]: r["component_id"] for r in op06_minhash.near_duplicates(documents(spark, rows)).collect()}
    wanted = {i: c for i, (_, c) in near_components(rows).items()}
    assert sum(i != c for i, c in wanted.items()) == 4 and found == wanted


def test_minhash_blocks(spark, monkeypatch):
    """Buckets dealt in blocks give the same links."""
    monkeypatch.setattr(op06_minhash, "BLOCK", 2000)
    monkeypatch.setattr(op06_minhash, "ROUNDS", 0)
    rows = template_group(100, 2)
    rows += [(500 + k, " ".join([*(f"s{j}" for j in range(100)), f"e{k}"])) for k in range(40)]
    found = {r["id"]: r["component_id"] for r in op06_minhash.near_duplicates(documents(spark, rows)).collect()}
    assert found == {i: c for i, (_, c) in near_components(rows).items()}


def test_circulant_signature_estimates_similarity():
    a = op06_minhash.mix(np.arange(1000, dtype=np.uint64))
    b = op06_minhash.mix(np.arange(200, 1200, dtype=np.uint64))
    same = (op06_minhash.signature(a) == op06_minhash.signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.15


# 7 vectors ---------------------------------------------------------------------------------------------------------


def test_vectors_as_brute_force(spark):
    draw = np.random.default_rng(7)
    base = draw.normal(size=(60, 16))
    vectors = [*base, *(base[:20] + draw.normal(size=(20, 16)) * 0.25), *(base[:10] * 3.0), *base[:5]]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (905, []), (906, [5.0, -1.0])]
    rows += [(910, [1.0, 2.0]), (911, [2.0, 4.0]), (912, [2.0, 4.1]), (913, [1.0]), (914, [-1.0])]  # lengths of their own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in CLASHING})
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows[:95]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = list(range(len(x)))
    for _ in range(len(x)):
        label = [min([label[k], *(label[j] for j in np.flatnonzero(links[k]))]) for k in range(len(x))]
    found = {r["id"]: r for r in op07_vectors.near_vectors(df).collect()}
    for k in range(len(x)):
        assert (found[k]["n_links"], found[k]["component_id"], found[k]["kept"]) == (int(links[k].sum()), label[k], label[k] == k)
    assert all(found[k]["n_links"] == 0 and found[k]["kept"] for k in (*range(900, 907), 913, 914)) and len(found) == len(rows)
    assert all((found[k]["n_links"], found[k]["component_id"]) == (2, 910) for k in (910, 911, 912))
    assert op07_vectors.near_vectors(df.where("false")).count() == 0 and op07_vectors.near_vectors(df.where("vec_id >= 900 and vec_id < 905")).count() == 5


def test_vectors_repeat_an_id(spark):
    """Rows of one id are one vector, whatever their order, and each row gets its result."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0])]
    both = []
    for given in (rows, rows[::-1]):
        found = op07_vectors.near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
        both.append(sorted((r["id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in found))
    assert both[0] == both[1] and len(both[0]) == len(rows)
    one = {r[0]: r for r in both[0]}
    assert one[0] == (0, 0, 0, True) and one[1][1] == (2 if one[3][2] == 1 else 1) and one[2][2] == 1


def test_vectors_in_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op07_vectors, "BLOCK", 16)
    draw = np.random.default_rng(8)
    base = draw.normal(size=(8, 6))
    x = np.concatenate([b + draw.normal(size=(40, 6)) * 0.3 for b in base])
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    assert {r["id"]: r["n_links"] for r in op07_vectors.near_vectors(df).collect()} == dict(enumerate(links.tolist()))


# 8 language model --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [1 << 19, 300])
def test_scores(spark, small, monkeypatch, head):
    """Counts and base scores as by hand, with all words held by workers or most of them joined; the model beats the base on held-out texts."""
    monkeypatch.setattr(op08_lm, "HEAD", head)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = documents(spark, rows)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    model, rare = op08_lm.fit(df.where(crc != 2))
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter(w for i in tokens if i not in held for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.words) == (n, v)
    base = score = 0.0
    for r in op08_lm.score(df, model, rare).collect():
        own = tokens[r["id"]]
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        if r["id"] in held:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base


@pytest.mark.parametrize("head", [1 << 19, 300])
def test_scores_by_hand(spark, small, monkeypatch, head):
    """The score as the sum of log10 P(class | tokens before) P(word | class), token by token, in plain arithmetic."""
    monkeypatch.setattr(op08_lm, "HEAD", head)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = documents(spark, rows)
    model, rare = op08_lm.fit(df.where("doc_id % 3 > 0"))
    counts = collections.Counter(w for i, t in rows if i % 3 > 0 for w in (t or "").encode().lower().split())
    p, wanted = model.parameters, {}
    own = len(p.context) - op08_lm.CLASSES + op08_lm.FREQUENT

    def numbers(word):
        if word is None:
            return op08_lm.END, op08_lm.END
        k = model.head.get(word, len(model.head))
        kind = 2 + k if k < min(op08_lm.FREQUENT, len(model.head)) else op08_lm.ending_class(word)
        return kind, op08_lm.CLASSES + k - op08_lm.FREQUENT if op08_lm.FREQUENT <= k < own and k < len(model.head) else kind

    for i, t in sorted(rows, key=lambda r: len(r[1] or ""))[:: max(len(rows) // 12, 1)][:8]:
        tokens, total = [*(t or "").encode().lower().split(), None], 0.0
        for at, w in enumerate(tokens):
            q = sum(p.context[numbers(tokens[at - 1 - j])[1] if at - 1 - j >= 0 else op08_lm.BEGIN] * p.position[j] for j in range(op08_lm.CONTEXT))
            logits = p.target @ q + p.bias
            kind = numbers(w)[0]
            total += (logits[kind] - np.log(np.exp(logits).sum())) / math.log(10)
            seen = model.documents if w is None else counts[w]
            total += math.log10((seen + 1) / (model.class_tokens[kind] + model.class_words[kind] + 1))
        wanted[i] = total
    found = {r["id"]: r["score"] for r in op08_lm.score(df, model, rare).collect()}
    assert {i: found[i] for i in wanted} == pytest.approx(wanted, rel=1e-4)


def test_every_token_is_trained_on(spark, small, monkeypatch):
    kept, write = {}, op08_lm.materialize
    monkeypatch.setattr(op08_lm, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    model, _ = op08_lm.fit(spark.read.parquet(f"{small}/documents.parquet"))
    assert kept["lm-parts"].agg(F.sum("seen")).first()[0] == model.tokens


def test_few_parameters_reach_the_driver(spark, small, monkeypatch):
    """However many tasks range partitions are dealt to, at most GROUP rows of parameters are left, and their mean is that of the partitions."""
    kept, write, deal = {}, op08_lm.materialize, type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(op08_lm, "GROUP", 2)
    monkeypatch.setattr(op08_lm, "materialize", lambda df, name: kept.setdefault(name if name != "lm-sums" else len(kept), write(df, name)))
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, n, *cols: deal(self, max(n, 7), *cols))
    model, _ = op08_lm.fit(spark.read.parquet(f"{small}/documents.parquet").repartition(7))
    parts, sums = kept["lm-parts"].collect(), list(kept.values())[-1].collect()
    assert len(parts) == 7 and len(sums) <= 2 and sum(r["seen"] for r in sums) == model.tokens
    mean = sum(np.frombuffer(r["flat"], np.float32).astype(np.float64) for r in parts) / model.tokens
    assert model.parameters.flat() == pytest.approx(mean, rel=1e-3, abs=1e-5)


def test_class_probabilities_are_normalised(spark, small):
    model, _ = op08_lm.fit(spark.read.parquet(f"{small}/documents.parquet"))
    context = np.array([5, 9, 200])
    total = 0.0
    for c in range(1, op08_lm.CLASSES):
        seq = np.append(context, c)
        total += 10 ** model.log10_classes(seq, np.zeros(4, np.int64))[-1]
    assert total == pytest.approx(1.0, abs=1e-4)


def test_scores_edges(spark, edge):
    df = documents(spark, [*edge, (5, "repeated id"), (None, "x")])
    model, rare = op08_lm.fit(df)
    found = op08_lm.score(df, model, rare).collect()
    assert len(found) == len(edge) + 2 and all(r["n_known"] == r["n_tokens"] and math.isfinite(r["score"]) for r in found)
    model, rare = op08_lm.fit(df.where("false"))
    assert all(r["n_known"] == 0 and r["base_score"] == 0.0 and math.isfinite(r["score"]) for r in op08_lm.score(df, model, rare).collect())
    assert op08_lm.score(df.where("false"), model, rare).count() == 0


# 9 BPE -------------------------------------------------------------------------------------------------------------


def test_bpe_as_the_library(spark, edge):
    draw = random.Random(9)
    alphabet = "aabcdeéüßñ'’.,!?-_ \t\n\x1c\x85\xa0　日本\U0001f600́Σİ019<|>"
    rows = [*edge, *((100 + k, "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))) for k in range(400)), (900, "<|startoftext|>x<|ENDOFTEXT|> don't we'LL 's"), (901, "internationalization " * 50 + "x" * 3000)]
    df = documents(spark, rows)
    full = {r["id"]: r for r in op09_bpe.bpe_round_trip(df, TOKENIZER).collect()}
    digests = {r["id"]: r for r in op09_bpe.bpe_digests(df, TOKENIZER).collect()}
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert full[i]["token_ids"] == ids and full[i]["decoded"] == LIBRARY.decode(ids, skip_special_tokens=False)
        assert digests[i]["n_tokens"] == len(ids) and digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(full[i]["decoded"].encode()).hexdigest()
    assert op09_bpe.bpe_digests(df.where("false"), TOKENIZER).count() == 0


def test_bpe_on_every_character():
    """Each code point below U+20000 between letters, and rows of random ones, as the library whatever Python's Unicode version."""
    import pyarrow as pa

    bpe = op09_bpe.BacktrackingBpe(TOKENIZER)
    draw = random.Random(90)
    points = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b" for c in points] + ["".join(draw.choice(points) if draw.random() < 0.3 else draw.choice("ab Zé'9.Σ") for _ in range(draw.randint(1, 12))) for _ in range(4000)]
    wanted = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, ids in zip(texts, wanted, strict=True) if bpe.encode(t) != ids] == []
    _, rendered, _ = bpe.round_trips(pa.array(texts))
    assert rendered == [" ".join(map(str, ids)).encode() for ids in wanted]


# 10 substrings -----------------------------------------------------------------------------------------------------


def cut_words(rows):
    seen, out = set(), {}
    for i, text in sorted(r for r in rows if r[0] is not None):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("keys", [16_000_000, -1])
def test_substrings_as_brute_force(spark, monkeypatch, keys):
    monkeypatch.setattr(op10_substrings, "BITMAP_KEYS", keys)
    draw, rows = random.Random(1), []
    for k in range(300):
        of = draw.choice([["a", "b"], ["a", "b", "c"], [str(x) for x in range(30)]])
        t = [draw.choice(of) for _ in range(draw.randint(0, 100))]
        if draw.random() < 0.3:
            t[draw.randint(0, len(t)) : 0] = ["a"] * draw.randint(15, 45)
        if rows and draw.random() < 0.5:
            other = draw.choice(rows)[1].split()
            p = draw.randint(0, len(other))
            t[draw.randint(0, len(t)) : 0] = other[p : p + draw.randint(15, 30)]
        rows.append((k, " ".join(t)))
    found = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op10_substrings.cut_digests(documents(spark, rows)).collect()}
    assert found == cut_words(rows)


def test_substrings_edges(spark, edge):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [*edge, (50, f"start {passage}\n\nend"), (51, f"other\t{passage}  tail"), (52, passage.upper()), (53, f"start {passage}\n\nend")]
    found = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op10_substrings.cut_digests(documents(spark, rows)).collect()}
    assert found == cut_words(rows)
    texts = {r["doc_id"]: (r["text"], r["lw_removed"]) for r in op10_substrings.cut(documents(spark, [*rows, (None, passage)])).collect()}
    assert texts[50] == (rows[-4][1], 0) and texts[51] == ("other\ttail", 60) and texts[53] == ("", 62) and texts[None] == (passage, 0) and texts[1] == (None, 0)
    assert op10_substrings.cut_digests(documents(spark, rows).where("false")).count() == 0


def test_substrings_repeat_an_id(spark):
    """Texts of one id that differ: the copy of an earlier document goes, the text that stands nowhere else stays."""
    p, q = (" ".join(f"{c}{k}" for k in range(60)) for c in "pq")
    rows = [(1, p), (2, q), (2, p), (3, f"{q} end")]
    found = sorted((r["id"], r["n_words"], r["n_removed"]) for r in op10_substrings.cut_digests(documents(spark, rows)).collect())
    assert found == [(1, 60, 0), (2, 60, 0), (2, 60, 60), (3, 61, 60)]
    assert sorted((r["doc_id"], r["text"]) for r in op10_substrings.cut(documents(spark, rows)).collect()) == [(1, p), (2, ""), (2, q), (3, "end")]
