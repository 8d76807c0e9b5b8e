"""The registered queries: SQL where SQL can express them, contracts elsewhere, and the pipeline by brute force."""

import collections
import hashlib

import numpy as np
import pytest
from compare import assert_same, sql_rows
from pyspark.sql import functions as F
from llm_rows import CLASHING
from test_llm_operators import LIBRARY, cut_words, kept_lines, near_components, words

from lorewright.llm import op04_langid, queries

SCHEMAS = {
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op6_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op11_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op12_conversations": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op13_maxscore": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    assert_same(queries.QUERIES[name](spark, small).toPandas(), sql_rows(small, queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_contract(spark, small, name):
    found = queries.QUERIES[name](spark, small)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in SCHEMAS[name]} == SCHEMAS[name]
    key = next(k for k in ("query_id", "vec_id", "conv_id", "doc_id", "lang") if k in kinds)
    table = spark.read.parquet(f"{small}/{ {'query_id': 'embeddings', 'vec_id': 'embeddings', 'conv_id': 'conversations'}.get(key, 'documents')}.parquet")
    if key == "query_id":
        table = table.where("vec_id % 50 = 0")
    if key in ("conv_id", "lang"):
        table = table.select(key).distinct()
    assert found.select(key).distinct().count() == table.count()


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_pipeline_stages(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet").union(spark.createDataFrame([(9001, None, None, "x", None), (9002, "12 34", "en", "x", 5), (9003, "日本語 テキスト", None, "x", 8)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = stages["language_id"](spark, docs, small)
    assert kept.columns == docs.columns and not {9001, 9002, 9003} & {i for i, _ in texts(kept)} and kept.count() > 0.95 * docs.count()
    assert op04_langid.UND == "und"

    wanted = {i: t for i, t in kept_lines(texts(kept)).items() if words(t)}
    lines = stages["line_dedup"](spark, kept, small)
    assert dict(texts(lines)) == wanted and lines.where(F.col("n_chars") != F.length("text")).count() == 0

    near = {i for i, (_, c) in near_components(texts(kept)).items() if i == c}
    assert {i for i, _ in texts(stages["minhash_dedup"](spark, kept, small))} == near

    cut = {i: n for i, n in cut_words(texts(kept)).items() if n[1] < n[0] or not n[0]}
    found = texts(stages["substring_dedup"](spark, kept, small))
    assert {i: hashlib.sha256(b" ".join(words(t))).hexdigest() for i, t in found} == {i: n[2] for i, n in cut.items()}

    pieces = collections.defaultdict(list)
    for p in stages["packing"](spark, kept, small).collect():
        pieces[p["doc_id"]].append((p["start"], bytes(p["ids"])))
    assert {i: b"".join(b for _, b in sorted(x)) for i, x in pieces.items()} == {i: np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in texts(kept)}


def test_pipeline_runs(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    found = corpus_pipeline.run(spark, small)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset", "ids"} <= set(found.columns)


def kept_words(rows):
    """Each document's words that stay where a passage of 20 words that started earlier goes."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
    return out


def packed_ids(found):
    pieces = collections.defaultdict(list)
    for p in found.collect():
        pieces[p["doc_id"]].append((p["start"], bytes(p["ids"])))
    return {i: b"".join(b for _, b in sorted(x)) for i, x in pieces.items()}


def test_pipeline_as_a_chain(spark, small, tmp_path):
    """From the documents that language ID keeps on, each stage by brute force on what the one before it kept; columns of other names change nothing."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    # Near copies, whose only lines are many edits apart, and passages of others within texts of their own.
    long = [(i, t.split()) for i, t in texts(docs.where("lang = 'en'").orderBy("doc_id")) if len(t.split()) > 200][:8]
    near_copies = [(5000 + i, " ".join(f"{w}x" if k % 60 == 59 else w for k, w in enumerate(ws))) for i, ws in long[:4]]
    passages = [(6000 + i, " ".join([*long[0][1][30:70], *ws[100:112], "and", *ws[20:60], *long[0][1][5:12]])) for i, ws in long[4:]]
    planted = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in near_copies + passages], docs.schema)
    docs = docs.union(planted)
    docs.withColumns({c: F.lit("clash") for c in CLASHING}).write.parquet(f"{tmp_path}/documents.parquet")
    kept = texts(dict(corpus_pipeline.STAGES)["language_id"](spark, docs, small))
    lines = {i: t for i, t in kept_lines(kept).items() if words(t)}
    near = [(i, lines[i]) for i, (_, c) in near_components(list(lines.items())).items() if i == c]
    left = {i: t for i, t in kept_words(near).items() if t or not words(dict(near)[i])}
    assert len(near) < len(lines) < docs.count() and any(left.get(i, "") != " ".join(t.split()) for i, t in near)
    wanted = {i: np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in left.items()}
    assert packed_ids(corpus_pipeline.run(spark, str(tmp_path))) == wanted


def test_pipeline_edges(spark, small, tmp_path):
    """No documents; rows that repeat an id, nulls, and texts of white space."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    some = docs.where("doc_id < 60")
    odd = spark.createDataFrame([(None, "a null id, with a text in plain words", "en", None, 3), (901, None, None, None, None), (902, " \n ", "en", "x", 3)], docs.schema)
    some.unionByName(some.where("doc_id < 5")).unionByName(odd).write.parquet(f"{tmp_path}/odd/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    ids = {r["doc_id"] for r in found.select("doc_id").distinct().collect()}
    assert not {901, 902} & ids and len(ids) > 20
