"""WARC derivatives: a metadata record and a plain-text conversion record for each response record.

Both refer to their response by WARC-Refers-To, share its target URI and date, and carry a digest of their own block; the
metadata record (application/warc-fields) lists the response's HTTP headers, digests and the conversion's id, so the three
are linked both ways. Record ids are derived from the response's id and the record's type, so a run that is repeated gives
the same ids. All in DataFrame functions in one pass without a shuffle.

A response with a null id or no block (null) has no derivatives. A block without an empty line after its headers has no
payload: its text is empty. Blocks of any length, repeated rows (equal records) and empty tables are fine; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Entities that plain text holds as characters; the ampersand comes last. Fixed values.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: What is cut with its content, what ends a line, and any other tag. Fixed values.
CUT = (r"(?is)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>")
LINE_END = r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/title|/ul|/article|/footer|/nav)\b[^>]*>"
TAG = r"(?s)<[!/a-zA-Z][^>]*>"


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def uuid_of(text: Column) -> Column:
    """A record id from the MD5 of text."""
    h = F.md5(text.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(h, a, n), F.lit("-" if a < 21 else ">")) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def plain_text(html: Column) -> Column:
    """HTML as plain text: scripts, styles, comments and tags cut, one line per block, entities as characters."""
    text = html
    for pattern in CUT:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), TAG, " ")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n+", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, id_col: str, url_col: str, html_col: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages: record_id, target_uri, date, block (HTTP headers, an empty line, the page). For pages kept without their records."""
    html = F.col(html_col)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    record = uuid_of(F.concat(F.lit("response "), F.col(id_col).cast("string"), F.lit(" "), F.coalesce(url_col, F.lit(""))))
    return pages.select(record.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), F.concat(head, html).alias("block"), F.col(id_col).alias("source_id"))


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records (record_id, target_uri, date, block; source_id is kept).

    Columns: source_id, record_type, record_id, refers_to, target_uri, date, content_type, block, block_digest,
    payload_digest (of the response's payload), content_length (bytes of the block).
    """
    rows = records.where("record_id is not null and block is not null")
    at = F.instr("block", CRLF + CRLF)
    rows = rows.withColumns({"head": F.when(at > 0, F.substr("block", F.lit(1), at - 1)).otherwise(F.col("block")), "payload": F.when(at > 0, F.substr("block", at + 4)).otherwise("")})
    kinds = ("metadata", "conversion")
    ids = {k: uuid_of(F.concat(F.lit(f"{k} of "), F.col("record_id"))) for k in kinds}
    rows = rows.withColumns({"text": plain_text(F.col("payload")), "payload_digest": digest(F.col("payload")), "response_digest": digest(F.col("block"))})
    headers = F.array_join(F.transform(F.slice(F.split("head", CRLF), F.lit(2), F.lit(1 << 20)), lambda h: F.concat(F.lit("http-header-"), F.lower(F.substring_index(h, ":", 1)), F.lit(": "), F.btrim(F.substr(h, F.instr(h, ":") + 1)))), CRLF)
    fields = [
        F.concat(F.lit("http-status-line: "), F.substring_index("head", CRLF, 1)),
        F.when(F.instr("head", CRLF) > 0, headers),
        F.concat(F.lit("response-block-digest: "), F.col("response_digest")),
        F.concat(F.lit("response-payload-digest: "), F.col("payload_digest")),
        F.concat(F.lit("conversion-record-id: "), ids["conversion"]),
        F.concat(F.lit("conversion-length: "), F.octet_length("text").cast("string")),
    ]
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), ids["metadata"].alias("record_id"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF)).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), ids["conversion"].alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = rows.select("source_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.explode(made).alias("made"))
    return out.select(
        "source_id", "made.record_type", "made.record_id", "refers_to", "target_uri", "date", "made.content_type", "made.block",
        digest(F.col("made.block")).alias("block_digest"), "payload_digest", F.octet_length("made.block").cast("long").alias("content_length"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """Each record as WARC/1.1 text in column warc: named fields, an empty line, the block, two empty lines."""
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    fields = [
        F.lit("WARC/1.1"), named("WARC-Type", F.col("record_type")), named("WARC-Record-ID", F.col("record_id")), named("WARC-Refers-To", F.col("refers_to")),
        named("WARC-Target-URI", F.col("target_uri")), named("WARC-Date", F.col("date")), named("WARC-Block-Digest", F.col("block_digest")),
        named("WARC-Payload-Digest", F.when(F.col("record_type") == "conversion", F.col("block_digest"))), named("Content-Type", F.col("content_type")), named("Content-Length", F.col("content_length").cast("string")),
    ]
    return records.withColumn("warc", F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF + CRLF)))
