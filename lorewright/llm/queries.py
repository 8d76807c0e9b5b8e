"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm import op01_warc, op02_lines, op03_packing, op04_langid, op05_fingerprints, op06_minhash, op07_vectors, op08_lm, op09_bpe, op10_substrings, op11_divergence, op12_conversations, op13_maxscore
from lorewright.llm.common import crc32_mod

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op01_warc.derivatives(op01_warc.responses(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return found.withColumnRenamed("source_id", "page_id")


def _sql_text(html: str) -> str:
    """plain_text() in DuckDB's SQL, from the same fixed patterns."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern in op01_warc.CUT:
        html = f"regexp_replace({html}, {quote(pattern)}, ' ', 'g')"
    html = f"regexp_replace(regexp_replace({html}, {quote(op01_warc.LINE_END)}, chr(10), 'g'), {quote(op01_warc.TAG)}, ' ', 'g')"
    for entity, character in op01_warc.ENTITIES:
        html = f"replace({html}, {quote(entity)}, {quote(character)})"
    html = f"regexp_replace({html}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({html}, ' ?\\n ?', chr(10), 'g'), '\\n+', chr(10), 'g'), ' ' || chr(10))"


def _sql_uuid(text: str) -> str:
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({text}) AS h))"


OP1_SQL = f"""
WITH made AS (
    SELECT page_id, url, html, {_sql_uuid("'response ' || page_id || ' ' || coalesce(url, '')")} AS refers_to, strlen(html) AS bytes, {_sql_text("html")} AS body FROM pages WHERE html IS NOT NULL AND page_id IS NOT NULL
), named AS (
    SELECT *, {_sql_uuid("'metadata of ' || refers_to")} AS meta_id, {_sql_uuid("'conversion of ' || refers_to")} AS text_id,
           'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || bytes || chr(13) || chr(10) || chr(13) || chr(10) || html AS response FROM made
), records AS (
    SELECT page_id, 'conversion' AS record_type, text_id AS record_id, refers_to, url, html, 'text/plain; charset=utf-8' AS content_type, body AS block FROM named
    UNION ALL
    SELECT page_id, 'metadata', meta_id, refers_to, url, html, 'application/warc-fields', array_to_string(['http-status-line: HTTP/1.1 200 OK', 'http-header-content-type: text/html; charset=utf-8', 'http-header-content-length: ' || bytes, 'response-block-digest: sha256:' || sha256(response), 'response-payload-digest: sha256:' || sha256(html), 'conversion-record-id: ' || text_id, 'conversion-length: ' || strlen(body), ''], chr(13) || chr(10)) FROM named
)
SELECT page_id, record_type, record_id, refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS date, content_type, block,
       'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(html) AS payload_digest, CAST(strlen(block) AS BIGINT) AS content_length
FROM records
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op02_lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("lw_lines").alias("n_lines"), F.col("lw_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Lines alike are those within one edit: equal up to some place, and after it but for one character of either or of one.
OP2_SQL = """
WITH lines AS (
    SELECT doc_id, no - 1 AS no, string_split(text, chr(10))[no] AS line
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents)
), solid AS (SELECT *, length(line) AS n FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
firsts AS (SELECT line, n, min(struct_pack(doc_id := doc_id, no := no)) AS pos FROM solid GROUP BY line, n),
pairs AS (
    SELECT a.line AS a, b.line AS b, b.pos AS pos FROM firsts a JOIN firsts b ON b.n = a.n AND left(a.line, a.n // 2) = left(b.line, a.n // 2) AND a.pos < b.pos WHERE a.n >= 10
    UNION SELECT a.line, b.line, b.pos FROM firsts a JOIN firsts b ON b.n = a.n AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) AND a.pos < b.pos WHERE a.n >= 10
    UNION SELECT a.line, b.line, greatest(a.pos, b.pos) FROM firsts a JOIN firsts b ON b.n = a.n + 1 AND left(a.line, a.n // 2) = left(b.line, a.n // 2) WHERE a.n >= 10
    UNION SELECT a.line, b.line, greatest(a.pos, b.pos) FROM firsts a JOIN firsts b ON b.n = a.n + 1 AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) WHERE a.n >= 10
), common AS (
    SELECT a, b, pos, list_max(list_filter(range(0, length(a) + 1), lambda k: left(a, k) = left(b, k))) AS k FROM pairs
), near AS (
    SELECT DISTINCT pos FROM common
    WHERE (length(a) = length(b) AND substring(a, k + 2) = substring(b, k + 2)) OR (length(a) < length(b) AND substring(a, k + 1) = substring(b, k + 2))
), kept AS (SELECT pos FROM firsts WHERE pos NOT IN (SELECT pos FROM near)),
marked AS (
    SELECT l.doc_id, l.no, l.line, regexp_matches(l.line, '[^ \t\n\x0B\f\r]') AS solid, k.pos IS NOT NULL AS stays
    FROM lines l LEFT JOIN kept k ON k.pos.doc_id = l.doc_id AND k.pos.no = l.no
), counted AS (
    SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (solid AND NOT stays) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays OR NOT solid), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = op03_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = op04_langid.fit(documents.where(crc32_mod("doc_id", 3) != 1))
    found = op04_langid.predict(documents, model)
    return found.select(F.col("id").alias("doc_id"), (crc32_mod("id", 3) == 1).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op5_fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_fingerprints.edit_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_vectors.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: Links with equal vectors included; components by repeated rounds over the links.
OP7_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
    SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) AS component_id, least(e.vec_id, coalesce(m.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT node, min(other) AS m FROM reach GROUP BY node) m ON m.node = e.vec_id
"""


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model, rare = op08_lm.fit(documents.where(crc32_mod("doc_id", 7) != 2))
    found = op08_lm.score(documents, model, rare)
    return found.select(F.col("id").alias("doc_id"), (crc32_mod("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


def op10_substrings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_substrings.cut_digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_divergence.divergences(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counts AS (
    SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM (SELECT d, lang, source, term, count(*) AS n FROM words GROUP BY ALL) GROUP BY lang, source, term
), kept AS (
    SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY lang, term HAVING sum(docs) >= 10
), langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (
    SELECT s.lang, s.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n
    FROM sources s LEFT JOIN (SELECT counts.* FROM counts JOIN kept USING (lang, term)) c ON c.lang = s.lang AND c.source = s.source GROUP BY s.lang, s.source
), shares AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
           1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (l.n + 2 * l.v) AS q
    FROM sizes s JOIN langs l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM sources a JOIN sources b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = op12_conversations.damage(table(spark, sf_dir, "conversations"))
    return op12_conversations.digests(op12_conversations.repair(damaged, present=F.col("present")))


#: Letters themselves are carried and compared here, turn by turn.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
    SELECT raw.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM raw, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM coded JOIN (VALUES (0), (1)) AS c(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faulty AS (
    SELECT *, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM numbered
), inserts AS (
    SELECT * FROM (VALUES ('0', '', '0', []), ('s', '', 's', []), ('u', '', 'u', []), ('a', '', 'a', []), ('0', 'I', 'u', ['user:']), ('s', 'I', 'u', ['user:']), ('a', 'I', 'u', ['user:']), ('u', 'I', 'a', ['assistant:']),
        ('0', 'II', 'a', ['user:', 'assistant:']), ('s', 'II', 'a', ['user:', 'assistant:']), ('a', 'II', 'a', ['user:', 'assistant:']), ('u', 'II', 'u', ['assistant:', 'user:'])) AS t(state, run, mid, made)
), keeps AS (
    SELECT * FROM (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')) AS t(mid, letter, after)
), edits AS (
    SELECT mid, 'K' AS edit, letter, after FROM keeps
    UNION ALL SELECT mid, 'R', NULL, CASE WHEN mid = 'u' THEN 'a' ELSE 'u' END FROM (SELECT DISTINCT mid FROM inserts)
    UNION ALL SELECT mid, 'D', NULL, mid FROM (SELECT DISTINCT mid FROM inserts)
), macros AS (
    SELECT state, run, edit, letter, after, made FROM inserts JOIN edits USING (mid)
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, state, cost, audit, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place FROM (
            SELECT w.conv_id, f.i, m.after AS state, w.audit || m.run || m.edit AS audit,
                   w.cost + 3 * length(m.run) + CASE m.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN m.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
                   list_concat(list_concat(w.lines, m.made), CASE m.edit WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE WHEN m.after = 'u' THEN 'user:' ELSE 'assistant:' END || f.text] ELSE [] END) AS lines
            FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
            JOIN macros m ON m.state = w.state AND (m.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.letter = f.letter)))
        )
    ) WHERE place = 1
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), ended AS (
    SELECT w.conv_id, w.cost + 3 * length(n.run) AS cost, w.audit || n.run AS audit, list_concat(w.lines, n.made) AS lines,
           row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * length(n.run), w.audit || n.run) AS place
    FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts n ON n.state = w.state AND n.mid IN ('0', 'a')
    WHERE w.i = coalesce(c.n, 0) AND NOT (w.state = 'a' AND n.run <> '') AND NOT (w.state = '0' AND n.run <> '')
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       e.cost, e.audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.place = 1
"""


def op13_maxscore_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP13_SQL = """
WITH good AS (
    SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(x * 256) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
    FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints_query,
    "op6_minhash": op6_minhash,
    "op7_vectors": op7_vectors,
    "op8_lm": op8_lm,
    "op9_bpe": op9_bpe,
    "op10_substrings": op10_substrings_query,
    "op11_divergence": op11_divergence_query,
    "op12_conversations": op12_conversations_query,
    "op13_maxscore": op13_maxscore_query,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_line_dedup": OP2_SQL, "op7_vectors": OP7_SQL, "op11_divergence": OP11_SQL, "op12_conversations": OP12_SQL, "op13_maxscore": OP13_SQL}
