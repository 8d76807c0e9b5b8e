"""Canonical exact digests of documents, in DataFrame functions only.

A text is canonical after Unicode normalisation (NFKC), case folding, and folding of each run of white space to one space
(none at the ends). Two seeded 64-bit xxhashes of the canonical text name its bucket. Within buckets that more than one row
has, the canonical bytes are compared by their least and greatest value, which partial aggregation finds before any row
moves; where they differ, each different text of the bucket gets a number of its own after the digest. So equal canonical
texts have equal fingerprints, and different ones never do.

Copies of one text never gather in one task: buckets meet their rows by a counted broadcast or, beyond it, by a join that
Spark splits where it is skewed, and the comparison gets one row per bucket and map task.

Null texts count as empty; very long ones are handled whole. Repeated rows have equal fingerprints. The report has no row for
a null id, as these have no place in the order of ids; where texts of one id differ, the least fingerprint holds for all its
rows. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import checked, materialize, semi_join

NFKC = "com.ibm.icu.text.Normalizer", "compose"
FOLD = "com.ibm.icu.lang.UCharacter", "foldCase"


def _call(method: tuple[str, str], text: Column) -> Column:
    return F.java_method(F.lit(method[0]), F.lit(method[1]), text, F.lit(True))


def canonical(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    folded = F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(_call(NFKC, _call(FOLD, _call(NFKC, text))))
    return F.btrim(F.regexp_replace(folded, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "))


def wide_hash(text: Column) -> Column:
    """Two hashes of the canonical text, as a struct of h1 and h2."""
    c = canonical(text)
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(0x5EED), c).alias("h2"))


def _digest() -> Column:
    part = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(part("h1"), part("h2"))


def resolve(hashed: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key and fingerprint of rows (key, h1, h2). texts_of(keys) gives (key, text) of some keys; it is asked only for keys
    in buckets that several rows have."""
    crowded = materialize(hashed.groupBy("h1", "h2").agg(F.count("*").alias("rows")).where("rows > 1").select("h1", "h2"), "buckets")
    members = materialize(hashed.join(checked(crowded), ["h1", "h2"], "left_semi").select("key", "h1", "h2"), "crowded")
    texts = texts_of(members.select("key")).select("key", canonical(F.col("text")).alias("canon"))
    bytes_ = members.join(texts, "key").select("key", "h1", "h2", F.col("canon").cast("binary").alias("canon"))
    mixed = bytes_.groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("h1", "h2")
    mixed = materialize(mixed, "mixed")
    if mixed.isEmpty():
        return hashed.select("key", _digest().alias("fingerprint"))
    different = bytes_.join(mixed, ["h1", "h2"], "left_semi")
    kinds = different.select("h1", "h2", "canon").distinct()
    before = kinds.alias("x").join(kinds.alias("y"), (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")) & (F.col("y.canon") < F.col("x.canon")), "left")
    numbered = before.groupBy("x.h1", "x.h2", "x.canon").agg(F.count("y.canon").alias("number"))
    numbers = different.join(numbered, ["h1", "h2", "canon"]).select("key", "number").distinct()
    return hashed.join(numbers, "key", "left").select("key", F.when(F.col("number") > 0, F.concat(_digest(), F.lit("-"), F.col("number"))).otherwise(_digest()).alias("fingerprint"))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key (its id) and fingerprint. Ids are unique."""
    texts = documents.select(documents[id_col].alias("key"), documents[text_col].alias("text"))
    hashed = materialize(texts.select("key", wide_hash(F.col("text")).alias("h")).select("key", "h.h1", "h.h2"), "fingerprints")
    return resolve(hashed, lambda keys: semi_join(texts, keys, "key"))


def following(ids: DataFrame) -> DataFrame:
    """id and next_id: the next smaller id, and the largest after the smallest. ids: distinct ids.

    A range shuffle sorts them; each row is joined with the row after it by its number, and each partition's last one with
    the first of the next partition that has rows. Only the partitions' first rows, one for each, meet in one place.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = ids.repartitionByRange(parts, F.col("id").desc()).sortWithinPartitions(F.col("id").desc()).withColumn("number", F.monotonically_increasing_id())
    numbered = materialize(numbered, "order")
    inside = numbered.select(F.col("id").alias("next_id"), (F.col("number") - 1).alias("number"))
    heads = sorted((r["number"] >> 33, r["id"]) for r in numbered.where(F.col("number") % F.lit(1 << 33) == 0).collect())
    after = [(part, heads[(k + 1) % len(heads)][1]) for k, (part, _) in enumerate(heads)]
    wrap = ids.sparkSession.createDataFrame(after, "part bigint, head bigint")
    joined = numbered.join(inside, "number", "left").withColumn("part", F.shiftright("number", 33)).join(F.broadcast(wrap), "part")
    return joined.select("id", F.coalesce("next_id", "head").alias("next_id"))


def edited(documents: DataFrame, pairs: DataFrame, more: list[Column]) -> DataFrame:
    """id, n_chars, text, edited and next (struct of more, of the next document) of documents (id, text) in pairs (id, next_id, need)."""
    heads = documents.join(pairs.select(F.col("id").alias("lw_of"), F.col("next_id").alias("id"), "need"), "id")
    heads = heads.select("lw_of", F.struct(F.substr("text", F.lit(1), F.col("need")).alias("head"), *more).alias("next")).groupBy("lw_of").agg(F.min("next").alias("next"))
    rows = documents.join(heads, documents["id"] == heads["lw_of"]).withColumn("n_chars", F.length("text").cast("long"))
    stays = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    return rows.select("id", "n_chars", "text", F.concat(F.substr("text", F.lit(1), stays.cast("int")), F.col("next.head")).alias("edited"), "next")


def edit_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (1 for equal fingerprints, else 0).

    The edited text has its last third replaced by as much of the next document (descending id, the first after the last).
    """
    texts = documents.select(documents[id_col].cast("long").alias("id"), F.coalesce(documents[text_col], F.lit("")).alias("text")).where("id is not null")
    sizes = materialize(texts.select("id", F.floor(F.length("text") / 3).cast("int").alias("need")).groupBy("id").agg(F.max("need").alias("need")), "sizes")
    if sizes.isEmpty():
        return sizes.selectExpr("id", "0L n_chars", "'' edited_sha256", "'' fingerprint", "'' edited_fingerprint", "0D near_edited", "0D near_next")
    pairs = materialize(following(sizes.select("id")).join(sizes, "id"), "pairs")
    rows = edited(texts, pairs, [])
    rows = rows.select("id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), wide_hash(F.col("text")).alias("own"), wide_hash(F.col("edited")).alias("other"))
    rows = materialize(rows, "edited")

    def texts_of(keys: DataFrame) -> DataFrame:
        kind = lambda k: keys.where(F.col("key.kind") == k).select(F.col("key.id").alias("id")).distinct()
        own = semi_join(texts, kind(0), "id").select(F.struct(F.lit(0).alias("kind"), "id").alias("key"), "text")
        some = materialize(pairs.join(checked(materialize(kind(1), "keys")), "id", "left_semi"), "pairs")
        both = semi_join(texts, some.select(F.explode(F.array("id", "next_id")).alias("id")), "id")
        return own.union(edited(both, some, []).select(F.struct(F.lit(1).alias("kind"), "id"), "edited"))

    key = lambda k: F.struct(F.lit(k).alias("kind"), "id").alias("key")
    hashed = rows.select(key(0), "own.h1", "own.h2").union(rows.select(key(1), "other.h1", "other.h2"))
    found = materialize(resolve(hashed, texts_of), "fingerprints")
    kind = lambda k, name: found.where(F.col("key.kind") == k).select(F.col("key.id").alias("id"), "fingerprint").groupBy("id").agg(F.min("fingerprint").alias(name))
    out = rows.select("id", "n_chars", "edited_sha256").join(kind(0, "fingerprint"), "id").join(kind(1, "edited_fingerprint"), "id").join(pairs.select("id", "next_id"), "id")
    out = out.join(kind(0, "next_fingerprint").withColumnRenamed("id", "next_id"), "next_id")
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return out.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"))
