"""Queries of the text functions, chunking and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.operators import answer, chunking, sanitize
from lorewright.plans.base import query, segments, sql_tokens, table


@query("tx12_tokens", f"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9_''-]+')) AS n_words, len({sql_tokens('text')}) AS n_distinct FROM documents")
def tx12_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.word_list(F.col("text"))).cast("long").alias("n_words"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_distinct"))


def _sql_terms(c: str, terms) -> str:
    return " + ".join(f"CAST(contains({c}, '{t}') AS INT)" for t in terms)


@query(
    "tx15_intent",
    f"""
WITH q AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS l FROM benchmark),
words AS (SELECT item_id, unnest(regexp_extract_all(l, '[a-zA-Z][a-zA-Z0-9_''-]+')) AS w, generate_subscripts(regexp_extract_all(l, '[a-zA-Z][a-zA-Z0-9_''-]+'), 1) AS p FROM q),
named AS (SELECT item_id, p, CASE w {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.ALIASES.items())} ELSE w END AS w FROM words),
freq AS (SELECT item_id, w, count(*) AS n, min(p) AS p FROM named WHERE w NOT IN ({", ".join(f"'{w}'" for w in T.STOPWORDS)}) GROUP BY item_id, w),
top AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, p) AS r FROM freq),
terms AS (SELECT item_id, string_agg(w, ',' ORDER BY r) FILTER (r <= 12) AS terms, count(*) FILTER (r <= 12) AS n FROM top GROUP BY item_id)
SELECT q.item_id, coalesce(terms, '') AS terms,
  ({_sql_terms("l", T.CROSS_TERMS)} + CAST(coalesce(n, 0) >= 2 AND ({_sql_terms("l", T.COMPARE_CUES)}) > 0 AS INT)) >= 1 AS cross_video,
  ({_sql_terms("l", T.TEMPORAL_TERMS)} + CAST(regexp_matches(l, '\\b\\d{{1,2}}:\\d{{2}}\\b') OR ({_sql_terms("l", T.TIME_CUES)}) > 0 AS INT)) >= 1 AS temporal,
  ({_sql_terms("l", T.VISUAL_TERMS)} + CAST(({_sql_terms("l", T.SCREEN_CUES)}) > 0 AS INT)) >= 1 AS visual
FROM q LEFT JOIN terms USING (item_id)""",
)
def tx15_intent(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", T.intent(F.col("text")).alias("i"))
    return rows.select("item_id", F.array_join("i.entity_focus_terms", ",").alias("terms"), F.col("i.is_cross_video").alias("cross_video"), F.col("i.is_temporal").alias("temporal"), F.col("i.is_visual_detail").alias("visual"))


@query(
    "tx1_clean_text",
    r"""
WITH RECURSIVE a AS (SELECT page_id, nfc_normalize(html) AS t FROM pages),
b AS (SELECT page_id, len(regexp_extract_all(t, '<\|[^>]+\|>')) AS tags, regexp_replace(t, '<\|[^>]+\|>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, tags, len(regexp_extract_all(t, '(?i)(<\|start\|>|<\|end\|>|<\|channel\|>|<\|message\|>|analysis to=assistant|we need to|let''s produce|lets produce|final response|output:|reasoning:|assistant_answer)')) AS hits,
  regexp_replace(t, '(?i)(<\|start\|>|<\|end\|>|<\|channel\|>|<\|message\|>|analysis to=assistant|we need to|let''s produce|lets produce|final response|output:|reasoning:|assistant_answer)', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, tags, hits, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM c)
SELECT page_id, tags, hits, md5(regexp_replace(t, '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g')) AS text_md5 FROM d""",
)
def tx1_clean_text(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("c"))
    return rows.select("page_id", F.col("c.meta_tags_removed").cast("long").alias("tags"), F.col("c.meta_patterns_removed").cast("long").alias("hits"), F.md5(F.col("c.text").cast("binary")).alias("text_md5"))


@query("tx1_clean_full")
def tx1_clean_full(spark, sf):
    from lorewright.functions import unicode as U

    return U.with_clean(table(spark, sf, "documents").select("doc_id", "text"), c=F.col("text")).select("doc_id", "c.*")


@query(
    "tx21_times",
    """SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s % 3600 // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hms,
  (v // 3600) || ':' || (v % 3600 // 60) || ':' || (v % 60) AS plain
FROM (SELECT event_id, greatest(0, CAST(round_even(value * 50, 0) AS BIGINT)) AS s, CAST(floor(value * 50) AS BIGINT) AS v FROM events)""",
)
def tx21_times(spark, sf):
    seconds = F.col("value") * 50
    return table(spark, sf, "events").select("event_id", T.hms(seconds).alias("hms"), T.hms_plain(seconds).alias("plain"))


@query(
    "tx20_cut",
    """SELECT doc_id, md5(t) AS text_md5, CAST(ceil(length(t) / 4) AS BIGINT) AS tokens FROM (
  SELECT doc_id, CASE WHEN length(s) <= 960 THEN s ELSE regexp_replace(substring(s, 1, 960 - 12), '\\s+$', '') || ' [truncated]' END AS t
  FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents))""",
)
def tx20_cut(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.cut_to_budget(T.strip(F.col("text")), F.lit(240)).alias("c"))
    return rows.select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("text_md5"), F.col("c.tokens").alias("tokens"))


@query(
    "tx31_names",
    r"""SELECT page_id, CASE WHEN n = '' THEN 'untitled_video' ELSE n END AS file_name FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f! ]', '_', 'g'), '_{2,}', '_', 'g'), ' _') AS n FROM pages)""",
)
def tx31_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_name(F.col("url")).alias("file_name"))


@query(
    "tx32_csv",
    """SELECT string_agg('"' || n_name || '",\t"' || n_nationkey || '",\t"' || n_regionkey || '"', chr(10) ORDER BY n_nationkey) AS csv FROM nation""",
)
def tx32_csv(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", T.csv_row(F.array("n_name", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))).alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n").alias("csv"))


@query("tx43_refs", "SELECT doc_id, source AS video_name, CAST(doc_id AS VARCHAR) AS segment_idx FROM documents")
def tx43_refs(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.segment_ref(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))).alias("s"))
    return rows.select("doc_id", "s.*")


@query(
    "tx24_sentences",
    r"""WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM s)
SELECT doc_id, CAST(len(p) AS INT) AS n_sentences, md5(array_to_string(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '|')) AS joined FROM p""",
)
def tx24_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"), F.md5(F.array_join(T.sentences(F.col("text")), "|").cast("binary")).alias("joined"))


@query(
    "tx30_prompts",
    """SELECT conv_id, string_agg('<|start|>' || role || '<|message|>' || text || '<|end|>', '' ORDER BY turn) || '<|start|>user<|message|>next<|end|>' AS prompt FROM conversations GROUP BY conv_id""",
)
def tx30_prompts(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("h"))
    return rows.select("conv_id", T.chat_prompt(F.lit(None).cast("string"), F.col("h"), F.lit("next")).alias("prompt"))


@query(
    "tx26_answers",
    """SELECT part_key, thoughts, answer, has_final_marker, payload FROM (SELECT p_partkey AS part_key, CASE WHEN p_size % 2 = 0 THEN 'think ' || p_brand ELSE '' END AS thoughts, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'plain ' || p_name END AS answer,
  p_size % 2 = 0 AS has_final_marker, '{"brand":"' || p_brand || '"}' AS payload FROM part)""",
)
def tx26_answers(spark, sf):
    p = table(spark, sf, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" think "), "p_brand", F.lit("<|start|>assistant<|channel|>final<|message|> "), "p_name", F.lit("<|end|>"))).otherwise(F.concat(F.lit("<|start|>assistant<|message|>plain "), "p_name"))
    rows = p.select(F.col("p_partkey").alias("part_key"), T.thoughts_and_answer(raw).alias("t"), T.located_json(F.concat(F.lit('noise {"brand":"'), "p_brand", F.lit('"} more'))).alias("payload"))
    return rows.select("part_key", "t.*", "payload")


@query(
    "wn9_repetition",
    """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text || ' ' || text || ' ' || text || ' ' || text || ' ' || text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
c AS (SELECT conv_id, turn, w, list_filter(range(2, greatest(len(w) // 30, 2)), lambda k: k < len(w) // 30 AND w[k*30+1:k*30+30] = w[(k-1)*30+1:k*30] AND w[k*30+1:k*30+30] = w[(k-2)*30+1:(k-1)*30]) AS k FROM w)
SELECT conv_id, turn, CAST(CASE WHEN len(w) >= 120 AND len(k) > 0 THEN k[1] * 30 ELSE len(w) END AS INT) AS n_words FROM c""",
)
def wn9_repetition(spark, sf):
    text = F.concat_ws(" ", *["text"] * 5)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.filter(F.split(T.cut_repetition(text), r"\s+", -1), lambda x: x != "")).alias("n_words"))


@query(
    "ag1_chunk_pack",
    """
WITH RECURSIVE docs AS (SELECT source, doc_id, substring(text, 1, 4800) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
fold AS (
  SELECT source, r, CAST(0 AS BIGINT) AS k, ' ' || t AS acc, 1 AS n FROM docs WHERE r = 1 AND length(t) <= 4800
  UNION ALL
  SELECT f.source, d.r, CASE WHEN length(f.acc) + length(d.t) <= 4800 THEN f.k ELSE f.k + 1 END,
    CASE WHEN length(f.acc) + length(d.t) <= 4800 THEN f.acc || ' ' || d.t ELSE d.t END, CASE WHEN length(f.acc) + length(d.t) <= 4800 THEN f.n + 1 ELSE 1 END
  FROM fold f JOIN docs d ON d.source = f.source AND d.r = f.r + 1
), last AS (SELECT source, k, arg_max(acc, r) AS acc, max(n) AS n FROM fold GROUP BY source, k)
SELECT source AS video_name, k AS chunk_order_index, 'chunk-' || md5(regexp_replace(acc, '^\\s+|\\s+$', '', 'g')) AS chunk_id, length(acc) // 4 AS tokens, CAST(n AS INT) AS n_segments FROM last WHERE length(acc) > 0""",
)
def ag1_chunk_pack(spark, sf):
    return chunking.chunk_pack(segments(spark, sf)).select("video_name", "chunk_order_index", "chunk_id", "tokens", F.size("video_segment_id").alias("n_segments"))


@query(
    "ag2_chunk_dedupe",
    """SELECT 'chunk-' || md5(text) AS chunk_id, min(doc_id) AS ord, arg_max(source, doc_id) AS source FROM documents GROUP BY 1""",
)
def ag2_chunk_dedupe(spark, sf):
    return chunking.dedupe_chunks(table(spark, sf, "documents").select(T.md5_id(F.col("text")).alias("chunk_id"), F.col("doc_id").alias("ord"), "source"))


@query(
    "wn1_segments",
    """WITH v AS (SELECT event_id AS video_name, 10 + floor(value * 100) / 10 AS duration FROM events),
s AS (SELECT video_name, duration, unnest(range(0, CAST(ceil(duration) AS BIGINT), 30)) AS start FROM v),
k AS (SELECT * FROM s WHERE start = 0 OR duration - start >= 5)
SELECT video_name, CAST(row_number() OVER w - 1 AS INT) AS segment_idx, CAST(start AS DOUBLE) AS "start", coalesce(CAST(lead(start) OVER w AS DOUBLE), duration) AS "end" FROM k WINDOW w AS (PARTITION BY video_name ORDER BY start)""",
)
def wn1_segments(spark, sf):
    videos = table(spark, sf, "events").select(F.col("event_id").alias("video_name"), (F.lit(10) + F.floor(F.col("value") * 100) / 10).alias("duration"))
    return chunking.segment_windows(videos)


@query("wn2_frames", "SELECT event_id, unnest(range(5)) AS i, round(value + unnest(range(5)) * 30 / 5, 6) AS t FROM events")
def wn2_frames(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.posexplode(chunking.frame_times(F.col("value"), F.col("value") + 30)).alias("i", "t"))
    return rows.select("event_id", F.col("i").cast("long").alias("i"), F.round("t", 6).alias("t"))


@query(
    "wn3_previous",
    "SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 'None') AS previous FROM conversations",
)
def wn3_previous(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("video_name"), F.lit(0).alias("segment_idx"), F.col("turn").alias("frame_idx"), F.col("text").alias("description"))
    return chunking.previous_description(rows).select(F.col("video_name").alias("conv_id"), F.col("frame_idx").alias("turn"), "previous")


@query(
    "wn8_truncate",
    "SELECT conv_id, turn, CAST(running AS BIGINT) AS running FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM conversations) WHERE running <= 2000",
)
def wn8_truncate(spark, sf):
    return chunking.truncate_to_tokens(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", 500).select("conv_id", "turn", "running")


@query(
    "wn7_budget",
    """
WITH RECURSIVE d AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS spent FROM (SELECT DISTINCT conv_id FROM d)
  UNION ALL
  SELECT f.conv_id, d.r, f.used + s.spent, s.spent FROM f JOIN d ON d.conv_id = f.conv_id AND d.r = f.r + 1,
  LATERAL (SELECT CASE WHEN f.used >= 600 THEN 0 ELSE CAST(ceil(least(length(d.t), CASE WHEN length(d.t) <= b * 4 THEN length(d.t) ELSE length(regexp_replace(substring(d.t, 1, b * 4 - 12), '\\s+$', '')) + 12 END) / 4) AS BIGINT) END AS spent
           FROM (SELECT least(900, greatest(240, 600 - f.used)) AS b)) s
) SELECT conv_id, r - 1 AS at, spent AS tokens FROM f WHERE r > 0 AND spent > 0""",
)
def wn7_budget(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    rows = rows.select("conv_id", F.explode(answer.budget_blocks(F.col("t"), 600)).alias("b"))
    return rows.select("conv_id", F.col("b.at").cast("long").alias("at"), F.col("b.tokens").alias("tokens"))


@query(
    "wn10_overlap",
    """WITH s AS (SELECT conv_id AS doc_id, turn AS ord, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM conversations),
o AS (SELECT doc_id, ord, t, lag(t) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM s)
SELECT doc_id, ord, md5(array_to_string(CASE WHEN b IS NULL THEN t ELSE list_slice(list_concat(list_slice(b, greatest(1, len(b) - 4), len(b)), t), 1, 60) END, ' ')) AS tokens FROM o""",
)
def wn10_overlap(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.filter(F.split("text", " ", -1), lambda x: x != "").alias("tokens"))
    return chunking.with_overlap(rows, 5, 60).select("doc_id", "ord", F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens"))


@query("tx34_splitter")
def tx34_splitter(spark, sf):
    return chunking.separator_splits(table(spark, sf, "documents").select("doc_id", "text"), ".!?\n", 400)


@query("ag23_rollup", "SELECT source AS video_name, md5(substring(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), 1, 12000)) AS text_md5 FROM documents GROUP BY source")
def ag23_rollup(spark, sf):
    rows = chunking.video_rollup(table(spark, sf, "documents").select(F.col("source").alias("video_name"), F.col("doc_id").alias("ord"), F.col("text").alias("content")))
    return rows.select("video_name", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("ag22_captions", "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) || '--- Next Segment ---' || chr(10) || chr(10) ORDER BY turn)) AS captions FROM conversations GROUP BY conv_id")
def ag22_captions(spark, sf):
    rows = chunking.caption_collect(table(spark, sf, "conversations").select("conv_id", F.col("conv_id").alias("video_name"), F.lit(0).alias("segment_idx"), F.col("turn").alias("frame_idx"), F.col("text").alias("caption")))
    return rows.select(F.col("video_name").alias("conv_id"), F.md5(F.col("captions").cast("binary")).alias("captions"))


@query(
    "jn18_assemble",
    """SELECT o_custkey AS video_name, CAST(o_orderkey AS VARCHAR) AS segment_idx, 'Caption:' || chr(10) || coalesce(c_name, '') || chr(10) || 'Transcript:' || chr(10) || coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, '') || chr(10) || chr(10) AS content
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def jn18_assemble(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = [F.col("o_custkey").alias("video_name"), F.col("o_orderkey").cast("string").alias("segment_idx")]
    captions = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(*key, F.col("c_name").alias("caption"))
    transcripts = o.where(F.col("o_orderkey") % 3 == 0).select(*key, F.col("o_orderpriority").alias("transcript"))
    times = o.select(*key, F.lit("0-30").alias("time"))
    return chunking.assemble_segments(times, captions, transcripts, times.select("video_name", "segment_idx", F.array(F.lit(0.0)).alias("frame_times"))).select("video_name", "segment_idx", "content")


@query(
    "flt1_quarantine",
    """WITH s AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'x-' || event_id WHEN event_id % 5 = 0 THEN '30' ELSE CAST(event_id % 50 AS VARCHAR) || '-' || CAST(user_id % 60 AS VARCHAR) END AS time, event_id % 50 AS a, user_id % 60 AS b, CASE WHEN event_id % 11 = 0 THEN '<|x|>' ELSE event_type END AS content FROM events)
SELECT event_type AS video_name, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 OR b <= a THEN 'invalid_time' WHEN content = '<|x|>' THEN 'empty_after_clean' ELSE 'kept' END AS reason, count(*) AS n FROM s GROUP BY 1, 2""",
)
def flt1_quarantine(spark, sf):
    e = table(spark, sf, "events")
    time = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x-"), F.col("event_id").cast("string"))).when(F.col("event_id") % 5 == 0, "30").otherwise(F.concat((F.col("event_id") % 50).cast("string"), F.lit("-"), (F.col("user_id") % 60).cast("string")))
    rows = e.select(F.col("event_type").alias("video_name"), F.col("event_id").alias("seg_ord"), F.col("event_id").cast("string").alias("segment_idx"), time.alias("time"), F.when(F.col("event_id") % 11 == 0, "<|x|>").otherwise(F.col("event_type")).alias("content"), F.lit("").alias("transcript"), F.array("value").alias("frame_times"))
    _, everything = sanitize.pre_segments(rows, clean=T.clean_text)
    return everything.groupBy("video_name", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "flt3_clamp",
    """SELECT event_id, list_sort(list_transform([value, value * 3, -1.0], lambda t: greatest(10.0, least(60.0, t)))) AS times FROM events""",
)
def flt3_clamp(spark, sf):
    span = F.struct(F.lit(10.0).alias("start"), F.lit(60.0).alias("end"))
    return table(spark, sf, "events").select("event_id", T.clamp_times(F.array(F.col("value"), F.col("value") * 3, F.lit(-1.0)), span).alias("times"))
