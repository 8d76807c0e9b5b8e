"""Golden rows of the operators' quirks, by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorewright import hooks, shared
from lorewright.functions import text as T
from lorewright.functions import unicode as U
from lorewright.functions import vectors as V
from lorewright.operators import answer, chunking, evaluate, graph, sanitize
from lorewright.schemas import HITS, Settings
from lorewright.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_intent_flags_and_terms(spark):
    i = one(spark, T.intent(F.lit("Compare across videos: when does Pyke appear and what is shown in the frame?")))
    assert i.is_cross_video and i.is_temporal and i.is_visual_detail
    assert "pyke" in i.entity_focus_terms


def test_intent_terms_are_substrings(spark):
    assert one(spark, T.intent(F.lit("a guide")))["is_visual_detail"]  # ui


def test_alias_terms(spark):
    assert one(spark, T.entity_terms(F.lit("pike pike ahry the"))) == ["pyke", "ahri"]


@pytest.mark.parametrize("text,span", [("0-30", (0.0, 30.0)), ("30-30", None), ("a-3", None), ("5", None), ("1.5 - 2e1", (1.5, 20.0)), ("-5-3", None)])
def test_parse_time(spark, text, span):
    found = one(spark, T.parse_time(F.lit(text)))
    assert (tuple(found) if found else None) == span


@pytest.mark.parametrize("x,text", [(0.0, "0"), (30.0, "30"), (30.25, "30.25"), (123456.7, "123457"), (0.1 + 0.2, "0.3"), (1234.5678, "1234.57")])
def test_short_number(spark, x, text):
    assert one(spark, T.short_number(F.lit(x))) == text == f"{x:g}"


@pytest.mark.parametrize("s,text", [(0, "0:00"), (30, "0:30"), (3661.5, "1:01:02"), (2.5, "0:02"), (-4, "0:00")])
def test_hms(spark, s, text):
    assert one(spark, T.hms(F.lit(float(s)))) == text


def test_truncation(spark):
    found = one(spark, answer.budget_blocks(F.array(F.lit("x" * 8000)), 100))
    assert len(found) == 1 and "[truncated]" in found[0]["text"] and len(found[0]["text"]) == 960


def test_clean_text(spark):
    c = one(spark, U.clean_text_full(F.lit("ﬁne<|start|> We need to go\r\n\n\n\n b\x00")))
    assert c.text == "fine go\n\nb" and c.meta_tags_removed == 1 and c.meta_patterns_removed == 1 and c.control_chars_removed == 1
    assert one(spark, T.clean_text(F.lit("Analysis")))["text"] == ""
    assert one(spark, T.clean_text(F.lit("<|x|>")))["fully_removed"] == 1


def test_names(spark):
    aliases = {"AHRI": ["ARI"], "AURELION SOL": ["AURELION"]}
    rows = spark.createDataFrame([("ari",), ("Áhri",), ("Aurelion Soll",), (" '' ",), (None,), ("other",)], "raw string")
    assert [r["name"] for r in U.normalize_names(rows, "raw", aliases).collect()] == ["AHRI", "AHRI", "AURELION SOL", "Unknown", "Unknown", "OTHER"]


def test_entity_key(spark):
    assert one(spark, U.entity_key(F.lit('"“Pyké’s Hook”"'))) == "pykeshook"
    assert one(spark, U.clean_str(F.lit(" a&amp;b\x07 "))) == "a&b"


def test_record_parse_is_greedy_and_per_line(spark):
    fields = one(spark, T.records(F.lit('("entity"<|>A<|>person<|>x (y) z)##broken##("relationship"<|>A<|>B<|>d<|>1e3)<|COMPLETE|>')))
    assert fields == [['"entity"', "A", "person", "x (y) z"], ['"relationship"', "A", "B", "d", "1e3"]]
    assert one(spark, T.relation_record(F.array(*map(F.lit, fields[1]))))["weight"] == 1.0  # no exponents
    assert one(spark, T.entity_record(F.array(F.lit("entity"), F.lit("A"), F.lit("person"), F.lit("d")))) is None  # quotes count
    assert one(spark, T.entity_record(F.array(F.lit('"entity"'), F.lit("A"), F.lit('"person"'), F.lit("d"))))["entity_type"] == "UNKNOWN"


def test_first_allowed_type(spark):
    assert one(spark, T.first_allowed_type(F.lit("UNKNOWN<SEP>PERSON"))) == "UNKNOWN"
    assert one(spark, T.first_allowed_type(F.lit('robot<SEP>"geo"'))) == "GEO"


def test_name_candidates(spark):
    assert one(spark, T.name_candidates(F.lit("Ahri aka Nine Tails. Known as: Foxy<SEP>x"))) == ["Nine Tails", "Foxy"]


def test_thoughts_and_answer(spark):
    t = one(spark, T.thoughts_and_answer(F.lit(" think <|start|>assistant<|channel|>final<|message|> yes <|end|>")))
    assert tuple(t) == ("think", "yes", True)
    assert tuple(one(spark, T.thoughts_and_answer(F.lit("<|start|>assistant<|message|>plain<|end|>")))) == ("", "plain", False)
    assert tuple(one(spark, T.thoughts_and_answer(F.lit(None).cast("string")))) == ("", "", False)


def test_chunk_pack_boundary(spark):
    rows = spark.createDataFrame([("v", 0, "v_0", "a" * 10), ("v", 1, "v_1", "b" * 10), ("v", 2, "v_2", "c" * 50), ("w", 0, "w_0", "")], "video_name string, ord long, ref string, text string")
    found = {(r["video_name"], r["chunk_order_index"]): r for r in chunking.chunk_pack(rows, max_tokens=5).collect()}
    # The first chunk's leading space counts: 11 + 10 is over 20, so the second text begins a chunk.
    assert found["v", 0]["content"] == "a" * 10 and found["v", 0]["tokens"] == 11 // 4
    assert found["v", 1]["content"] == "b" * 10 and found["v", 2]["content"] == "c" * 20
    assert found["w", 0]["content"] == ""


def test_segment_windows_tail(spark):
    rows = chunking.segment_windows(spark.createDataFrame([("a", 64.0), ("b", 66.0), ("c", 3.0)], "video_name string, duration double"))
    spans = {}
    for r in rows.orderBy("video_name", "segment_idx").collect():
        spans.setdefault(r["video_name"], []).append((r["start"], r["end"]))
    assert spans == {"a": [(0.0, 30.0), (30.0, 64.0)], "b": [(0.0, 30.0), (30.0, 60.0), (60.0, 66.0)], "c": [(0.0, 3.0)]}


def hit(arrival, video, chunk, source, sem=0.0, ent=0.0, gra=0.0, text="pyke combo", branch=0, ids=("v_1",)):
    return ("q", branch, arrival, video, chunk, source, text, list(ids), sem, ent, gra, 0.0)


def test_dedupe_and_rank(spark):
    hits = spark.createDataFrame([hit(0, "a", "c1", "dense_chunk", sem=0.8), hit(0, "a", "c1", "entity_graph", ent=0.7, gra=0.7, branch=1), hit(1, "a", "c2", "dense_chunk", sem=0.2)], HITS)
    queries = spark.createDataFrame([("q", "pyke combo")], "query_id string, query string").withColumn("intent", T.intent(F.col("query")))
    ranked = answer.rerank(hits, queries, spark.createDataFrame([("a",)], "video_name string")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in ranked] == ["c1", "c2"] and ranked[0]["source"] == "dense_chunk|entity_graph"


def test_source_append_repeats(spark):
    rows = spark.createDataFrame([hit(k, "a", "c", s) for k, s in enumerate(["x", "y", "x"])], HITS)
    assert answer.dedupe_hits(rows).first()["source"] == "x|y|x"


def test_lone_hit_keeps_its_segments_order(spark):
    assert answer.dedupe_hits(spark.createDataFrame([hit(0, "a", "c", "x", ids=("v_2", "v_1"))], HITS)).first()["segment_ids"] == ["v_2", "v_1"]


def test_diversity_is_the_greedy_pass(spark):
    draw = random.Random(5)
    rows = [("q" + str(q), 0, k, draw.choice("abc"), str(k), draw.random()) for q in range(20) for k in range(30)]
    for cap in (1, 3, 14):
        found = answer.diversify(spark.createDataFrame(rows, "query_id string, branch_ord int, arrival long, video_name string, chunk_id string, final_score double"), F.lit(cap))
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        for q in {r[0] for r in rows}:
            taken, per = [], {}
            for r in sorted((r for r in rows if r[0] == q), key=lambda r: -r[5]):
                if per.get(r[3], 0) < cap or not taken:
                    taken.append(r[4])
                    per[r[3]] = per.get(r[3], 0) + 1
                if len(taken) == Settings.final_k:
                    break
            assert got[q] == taken


def test_answer_service(spark):
    queries = spark.createDataFrame([("q", "pyke combo"), ("none", "zzz")], "query_id string, query string").withColumn("intent", T.intent(F.col("query")))
    hits = spark.createDataFrame([hit(0, "a_b", "c1", "dense_chunk", sem=0.8, ids=("a_b_0",))], HITS)
    segments = spark.createDataFrame([("a_b", "0", "0-30")], "video_name string, segment_idx string, time string")
    registry = spark.createDataFrame([("a_b", "http://u")], "video_name string, url string")
    rows = {r["query_id"]: r for r in answer.answer(queries, hits, segments, segments.select("video_name"), hooks.echo, registry).collect()}
    assert "a b (http://u)" in rows["q"]["answer"] and "time=0:00-0:30" in rows["q"]["context"] and rows["q"]["confidence"] <= 0.65
    assert not rows["none"]["enough"] and rows["none"]["confidence"] == 0.2


def test_type_mode_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(0, "A", "GEO", "x", "c1"), (1, "A", "PERSON", "y", "c0"), (2, "B", "GEO", "z", "c2")], "ord int, entity_name string, entity_type string, description string, source_id string")
    found = {r["entity_name"]: r for r in graph.merge_nodes(rows).collect()}
    assert found["A"]["entity_type"] == "GEO" and found["A"]["source_id"] == "c0<SEP>c1"


def test_an_unknown_first_node_bridges_types(spark):
    nodes = spark.createDataFrame([("Fox", 0, "UNKNOWN", "", "c0"), ("fox", 1, "PERSON", "", "c1"), ("FOX", 2, "GEO", "", "c2"), ("hen", 3, '"UNKNOWN"', "", "c3"), ("HEN", 4, "GEO", "", "c4")], "id string, node_ord long, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([("fox", "hen", 1.0), ("Fox", "hen", 2.0), ("fox", "FOX", 1.0)], "src string, dst string, weight double")
    out, moved = graph.resolve_entities(nodes, edges)
    assert sorted(r["id"] for r in out.collect()) == ["HEN", "fox", "hen"]
    assert sorted((r["src"], r["dst"], r["weight"]) for r in moved.collect()) == [("fox", "hen", 1.0), ("fox", "hen", 2.0)]
    again, _ = graph.resolve_entities(out, moved)
    assert again.count() == 3


@pytest.mark.parametrize("bound", [1_000_000, 10])
def test_components_of_chains_and_cycles(spark, monkeypatch, bound):
    monkeypatch.setattr(shared, "ONE_TASK_EDGES", bound)
    draw = random.Random(3)
    pairs = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000 + (k + 1) % 50) for k in range(50)] + [(draw.randrange(2000, 2600), draw.randrange(2000, 2600)) for _ in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    found = {r["node"]: r["component"] for r in shared.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found.get(x, x) == find(x) for x in list(parent))


def test_post_edges_take_the_largest_weight(spark):
    edges = spark.createDataFrame([(0, "A", "B", "3", "2", "x", "c1"), (1, "B", "A", "99", "y", "", "c2"), (2, "A", "A", "1", "1", "", "c1"), (3, "A", "C", "1", "1", "", "c1")], "ord int, src string, dst string, weight string, `order` string, description string, source_id string")
    nodes = spark.createDataFrame([("A",), ("B",)], "id string")
    (r,) = graph.post_merge_edges(edges, nodes, spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")).collect()
    assert (r["weight"], r["order"], r["description"], r["source_id"]) == (10.0, 1, "<SEP>x", "c1<SEP>c2")


def test_neighbour_boost(spark):
    assert one(spark, V.neighbour_boost(F.lit(0.5), F.lit(0.0))) == one(spark, V.neighbour_boost(F.lit(0.5), F.lit(1.0)))
    assert one(spark, V.neighbour_boost(F.lit(0.99), F.lit(9.0))) == 1.0


def test_rouge(spark):
    assert one(spark, evaluate.rouge_l(F.lit("the cat sat"), F.lit("the dog sat"))) == pytest.approx(2 / 3)
    assert one(spark, evaluate.rouge_l(F.lit(""), F.lit("x"))) == 0.0


def test_percentile_halves_to_even(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in range(4)], "k int, v double")
    assert evaluate.percentile(rows, ["k"], "v", 0.5, "p").first()["p"] == 2.0  # round(1.5) is 2


def test_sanitize_pre(spark):
    segments = spark.createDataFrame([("v", 0, "0", "0-30", "hello", "", [40.0, 5.0]), ("v", 1, "1", "x", "a", "", []), ("v", 2, "2", "0-5", "<|x|>", "", [])], "video_name string, seg_ord int, segment_idx string, time string, content string, transcript string, frame_times array<double>")
    frames = spark.createDataFrame([("v", "0_0", None, ["pike", "PYKE", ""], "pike"), ("v", "bad", "0", [], None), ("v", "1_0", "1", [], None)], "video_name string, frame_key string, segment_idx string, entities array<string>, main_champ string")
    frames = frames.withColumns({"transcript": F.lit("t"), "vlm_output": F.lit(""), "partners": F.lit(None).cast("array<string>")})
    done = sanitize.sanitize_pre(segments, frames, spark.createDataFrame([("v", "/p")], "video_name string, path string"), {"PYKE": ["PIKE"]})
    (s,) = done.tables["segments"].collect()
    assert s["time"] == "0-30" and s["frame_times"] == [5.0, 30.0]
    (f,) = done.tables["frames"].collect()
    assert f["entities"] == ["PYKE", "Unknown"] and f["main_champ"] == "PYKE" and f["partners"] is None
    assert sorted((r["key"], r["reason"]) for r in done.quarantine.collect()) == [("1", "invalid_time"), ("2", "empty_after_clean"), ("bad", "invalid_key")]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "seg.json").write_text('{"v":{"0":{"time":"0-30","content":"c","transcript":"t","frame_times":[1.5]},"1":{"time":"30-60"}}}')
    rows = tables.read_segments(spark, str(tmp_path / "seg.json")).orderBy("seg_ord").collect()
    assert [r["segment_idx"] for r in rows] == ["0", "1"] and rows[0]["frame_times"] == [1.5]
    (tmp_path / "chunks.json").write_text('{"chunk-a":{"tokens":1,"content":"x","chunk_order_index":0,"video_segment_id":["v_0"]},"chunk-b":{"content":"y","video_segment_id":"v_1"}}')
    assert [r["video_segment_id"] for r in tables.read_chunks(spark, str(tmp_path / "chunks.json")).orderBy("chunk_ord").collect()] == [["v_0"], ["v_1"]]
    (tmp_path / "vdb.json").write_text('{"embedding_dim":2,"data":[{"__id__":"a","entity_name":"A","__vector__":[0.5,1.0]}]}')
    assert tables.read_vectors(spark, str(tmp_path / "vdb.json")).first()["vector"] == [0.5, 1.0]
    (tmp_path / "reg.json").write_text('{"a_b":{"url":" http://u "},"c":{"url":""},"d":{}}')
    assert [tuple(r) for r in tables.read_registry(spark, str(tmp_path / "reg.json")).collect()] == [("a_b", "http://u")]
    for body in ('[{"question":"q","answer_gold":"g"}]', '{"cases":[{"question":"q","answer_gold":"g"}]}'):
        (tmp_path / "cases.json").write_text(body)
        assert tables.read_cases(spark, str(tmp_path / "cases.json")).first()["question"] == "q"
    with pytest.raises(ValueError):
        tables.guarded("/data/../etc/x", "/data")
    assert tables.guarded("/data/x", "/data") == "/data/x"


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("A & B", "PERSON", "d<x>", "c1"), ("C", "GEO", None, "c2")], "id string, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([("A & B", "C", 2.5, "e", "c1", 3)], "src string, dst string, weight double, description string, source_id string, `order` long")
    tables.graphml_rows(nodes, edges).select("line").coalesce(1).write.text(str(tmp_path / "g"))
    n, e = tables.read_graphml(spark, str(tmp_path / "g"))
    assert sorted((r["id"], r["entity_type"], r["source_id"]) for r in n.collect()) == [("A & B", "PERSON", "c1"), ("C", "GEO", "c2")]
    (r,) = e.collect()
    assert (r["src"], r["dst"], r["weight"], r["order"]) == ("A & B", "C", 2.5, 3)


def test_incremental_stream(spark, tmp_path):
    from lorewright.streaming import ingest

    folder, manifest = str(tmp_path / "in"), str(tmp_path / "manifest")
    seen = []
    sink = lambda batch, number: seen.append(sorted(r["video_name"] for r in batch.collect()))
    for names in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(n,) for n in names], "video_name string").coalesce(1).write.mode("append").parquet(folder)
        query = ingest.incremental(ingest.read_stream(spark, folder, "video_name string"), manifest, "video_name", sink, str(tmp_path / "checkpoint"))
        query.awaitTermination(60)
    assert seen == [["a", "b"], ["c"]]


def test_cache_completes_each_prompt_once(spark):
    asked = []

    def complete(rows):
        asked.extend(r["p"] for r in rows.select("p").collect())
        return rows.withColumn("raw", F.upper("p"))

    rows = spark.createDataFrame([("x",), ("x",), ("y",)], "p string")
    out, known = hooks.cached(rows, spark.createDataFrame([], "hash string, return string, model string"), "p", complete)
    assert sorted(r["raw"] for r in out.collect()) == ["X", "X", "Y"] and sorted(asked) == ["x", "y"]
    assert known.count() == 2


def test_gleaning_stops_and_asks_once(spark):
    """A chunk is asked again only while it gave something new; a model that answers differently each time is read once."""
    turns = []

    def complete(rows):
        turns.append(sorted(r["chunk_id"] for r in rows.collect()))
        draw = F.concat(F.lit(f"t{len(turns)}."), F.rand().cast("string"))
        return rows.withColumn("raw", F.when((F.col("chunk_id") == "a") & F.lit(len(turns) > 1), "").otherwise(draw))

    out = hooks.glean(spark.createDataFrame([("a", "p"), ("b", "p")], "chunk_id string, p string"), "p", complete, 2)
    first, again = ({r["chunk_id"]: r["raw"] for r in out.collect()} for _ in range(2))
    assert first == again and turns == [["a", "b"], ["a", "b"], ["b"]]
    assert [x[:2] for x in first["a"].split("##")] == ["t1"] and [x[:2] for x in first["b"].split("##")] == ["t1", "t2", "t3"]


def test_cached_answers_are_those_returned(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "p string")
    out, known = hooks.cached(rows, spark.createDataFrame([], "hash string, return string, model string"), "p", lambda r: r.withColumn("raw", F.rand().cast("string")))
    assert {r["raw"] for r in out.collect()} == {r["return"] for r in known.collect()}


def test_merged_graph_numbers_in_order(spark):
    """Nodes of the graph come before a video's, whose attributes replace theirs; a listed video changes nothing."""
    kind = "id string, node_ord long, entity_type string, description string, source_id string"
    none = spark.createDataFrame([], "src string, dst string, weight double")
    old = spark.createDataFrame([("fox", 3, "GEO", "old", "c1"), ("hen", 7, "GEO", "h", "c1")], kind)
    new = spark.createDataFrame([("FOX", 5, "GEO", "new", "c2"), ("hen", 4, "GEO", "replaced", "c3"), ("owl", 9, "GEO", "o", "c2")], kind)
    listed = spark.createDataFrame([("v1",)], "video_name string")
    nodes, _, videos = graph.merge_into_global((old, none), (new, none), listed, "v2")
    assert {r["id"]: (r["node_ord"], r["description"]) for r in nodes.collect()} == {"fox": (3, "old<SEP>new"), "hen": (7, "replaced"), "owl": (13, "o")}
    assert sorted(r[0] for r in videos.collect()) == ["v1", "v2"]
    assert graph.merge_into_global((old, none), (new, none), listed, "v1")[0] is old


def test_node_vectors(spark):
    """Each node of the walks has a vector of the size asked for, and nodes that walks never join are less alike than neighbours."""
    rings = [(f"{r}{k}", f"{r}{(k + 1) % 8}") for r in "ab" for k in range(8)]
    nodes = spark.createDataFrame([(s,) for s, _ in rings], "id string")
    walks = graph.random_walks(nodes, spark.createDataFrame(rings, "src string, dst string"), length=8, walks=10)
    found = {r["id"]: r["vector"] for r in graph.node_vectors(walks, 8).collect()}
    assert set(found) == {s for s, _ in rings} and {len(v) for v in found.values()} == {8}
    assert all(math.isfinite(x) for v in found.values() for x in v)


def test_multiple_choice_asks_again(spark):
    turns = []

    def complete(rows):
        turns.append(sorted(r["query_id"] for r in rows.collect()))
        good = F.col("query_id") < len(turns)
        return rows.withColumn("raw", F.when(good, '{"Answer":"A","Explanation":"e"}').otherwise('{"Answer":"A"}'))

    rows = spark.createDataFrame([(0, "p"), (1, "p"), (9, "p")], "query_id int, prompt string")
    found = {r["query_id"]: r["answer"] for r in answer.multiple_choice(rows, complete, 2).collect()}
    assert found == {0: "A", 1: "A", 9: "No Content"} and turns[:2] == [[0, 1, 9], [1, 9]]


def test_knowledge_base_round_trip(spark, tmp_path):
    from lorewright.engine import KnowledgeBase

    vectors = spark.createDataFrame([("v", "c1", "A", [1.0] + [0.0] * 63)], "video_name string, id string, entity_name string, vector array<float>")
    base = KnowledgeBase(
        segments=spark.createDataFrame([("v", "0", "0-30")], "video_name string, segment_idx string, time string"),
        frames=spark.createDataFrame([("v", "0_0", "0", "a red icon", "")], "video_name string, frame_key string, segment_idx string, vlm_output string, transcript string"),
        chunks=spark.createDataFrame([("v", "c1", "pyke throws a red hook", ["v_0"])], "video_name string, chunk_id string, content string, video_segment_id array<string>"),
        nodes=spark.createDataFrame([("v", 0, "A", "c1"), ("v", 1, "B", "c1")], "video_name string, node_ord long, id string, source_id string"),
        edges=spark.createDataFrame([("v", "A", "B", 2.0, "c1")], "video_name string, src string, dst string, weight double, source_id string"),
        chunk_vectors=vectors, entity_vectors=vectors, global_nodes=spark.createDataFrame([(0, "PYKE", "a fisher", "c1")], "node_ord long, id string, description string, source_id string"),
        registry=spark.createDataFrame([("v", "http://u")], "video_name string, url string"),
    )
    base.save(str(tmp_path))
    loaded = KnowledgeBase.load(spark, str(tmp_path), str(tmp_path))
    asked = spark.createDataFrame([("q", "what color icon does pyke have")], "query_id string, query string")
    found = loaded.answer(asked).first()
    assert found["enough"] and "dense_chunk|entity_graph|global_graph|visual_support" in found["context"]


def test_lcs():
    draw = random.Random(1)
    for _ in range(50):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert evaluate.lcs_length(a, b) == table[-1][-1]


def test_short_numbers_are_rendered_as_g(spark):
    given = [0.25, 7.5, -3.0, 123456.5, 123457.5, 249999.75, 999999.0, 999999.25, 999999.5, 1000000.0, 1234565.0, 1499998.75, 6000029.0, -25000000.5, 1e15, 1.5e22, 0.0001, 0.00012345678, 0.00001, 0.0000999999999, 3e-12, 100000.0]
    rows = spark.createDataFrame([(x,) for x in given], "x double").select("x", T.short_number(F.col("x")).alias("g")).collect()
    assert {r["x"]: r["g"] for r in rows} == {x: f"{x:g}" for x in given}


def test_edge_weights_round_as_the_sql_does(spark, small, tmp_path):
    """Three places of halves: the product is rounded, as DuckDB does it, not the decimal form (src4_graphml)."""
    import duckdb

    from lorewright.plans import base

    halves = [(f"Supplier#{i:09d}", i, i % 25, round(i * 0.37 + 0.5, 0) + 0.5) for i in range(3_000)]
    spark.createDataFrame(halves, "s_name string, s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{small}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    found = {r["src"]: r["weight"] for r in base.graph_tables(spark, str(tmp_path))[1].collect()}
    wanted = duckdb.connect().execute(f"SELECT s_name, round(abs(s_acctbal) / 1000, 3) FROM '{tmp_path}/supplier.parquet/*.parquet'").fetchall()
    assert found == dict(wanted)


def test_letterbox_gives_few_images_at_a_time():
    """A batch of ten thousand small images isn't one of ten thousand large ones."""
    import pandas as pd

    given = pd.Series([[float(i)] * 8 for i in range(100)]), pd.Series([4] * 100), pd.Series([2] * 100)
    pieces = list(V.letterbox.func(iter([given])))
    assert max(len(p) for p in pieces) <= V.IMAGES
    images = [g for p in pieces for g in p]
    assert len(images) == 100 and all(len(g) == 224 * 224 and g.max() == i and g.sum() == i * 224 * 112 for i, g in enumerate(images))


def test_cleaning_normalises_each_text_once(spark, small, capfd):
    """The Java method stands once in the plan, not at each of the cleaned text's mentions, and the result is the same."""
    from lorewright.plans import catalogue

    rows = spark.createDataFrame([("ﬁne<|start|> We need to go\r\n\n\n\n b\x00",), (None,), ("Analysis",)], "text string")
    found = U.with_clean(rows, c=F.col("text"))
    assert sorted(map(str, found.select("c").collect())) == sorted(map(str, rows.select(U.clean_text_full(F.col("text")).alias("c")).collect()))
    plan = catalogue.QUERIES["tx1_clean_full"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("java_method") + plan.count("reflect(") == 1


def test_marks_go_from_texts_of_any_script(spark):
    import unicodedata

    given = ["plain", "Pyké", "ȩ́x", "กุ", "ṩ ﬁ", "\U0001d165x", "日本が"]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", U.strip_diacritics(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == {t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in given}
