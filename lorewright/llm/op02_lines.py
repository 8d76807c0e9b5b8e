"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is removed if an earlier line (smaller doc_id, or same document and smaller line number) equals it, or if both have
at least min_fuzzy characters and the earlier one is within one edit (insertion, deletion or substitution of a character).
So of lines alike the earliest stays. Lines of white space only are never removed. Line breaks are line feeds.

Deleting every single character of every line would give as many variants as the text has characters. The same
neighbourhood is searched coarse to fine instead: a variant deletes a block that holds the edit, for blocks of a quarter of
the line first. For two lines within one edit, of which the shorter has R characters, the block of it that holds the edit
gives both the same hashed key of R, block, what stands before and what stands after it; so each line emits keys for R its
own length and one less. Only lines whose key another text shares go on, to blocks an eighth as long and then to single
characters, where lines of one length that share a key are within one substitution, and a line that equals another less one
character within one insertion. No pairs are listed: in a bucket each line is compared with the earliest one of the other
lines only, by one levenshtein() per line at the end.

Null and empty texts have no lines to remove. Rows with a null id are left as they are and remove nothing. Rows that
repeat an id and its text count as one document; where texts of one id differ, each is a document of its own, in the order
of a hash of the texts. Lines of any length are compared whole. An empty table gives no rows. Other columns are ignored,
whatever their names, but for lw_lines and lw_removed, which the result adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import anti_join, checked, checked_lists, materialize, semi_join

BLOCKS, FINER = 4, 8


def _wide(line: str) -> Column:
    """A line with four bytes for each character, so that cutting it at a character takes no search for the place."""
    return F.encode(line, "UTF-32")


def _key(n: Column, r: Column, start: Column, width: Column, *more: Column) -> Column:
    """Hash of the line in column wide, of n characters, without width of them from start on, as if it had r (the rest counts from the end)."""
    after = F.greatest(r - start - width, F.lit(0))
    return F.xxhash64(r, start, width, *more, F.substr("wide", F.lit(1), 4 * start), F.substr("wide", 4 * (n - after) + 1, 4 * after))


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (the document: the row's id, and a hash of its text) and text."""
    return documents.select(F.struct(documents[id_col].cast("long").alias("id"), F.xxhash64(documents[text_col]).alias("t")).alias("id"), documents[text_col].alias("text")).where("id.id is not null")


def line_variants(documents: DataFrame, id_col: str, text_col: str, min_fuzzy: int) -> DataFrame:
    """Per line that isn't blank: id, no, n (characters), h1 and h2 (its two hashes), keys (those of BLOCKS blocks for R = n, then R = n - 1)."""
    rows = _texts(documents, id_col, text_col)
    lines = rows.select("id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.col("line").rlike(r"\S"))
    lines = lines.withColumns({"n": F.length("line"), "wide": _wide("line")})
    keys = []
    for less in (0, 1):
        r = F.col("n") - less
        g = F.ceil(r / BLOCKS).cast("int")
        for i in range(BLOCKS):
            keys.append(F.when(r >= min_fuzzy, _key(F.col("n"), r, g * i, g)))
    return lines.select("id", "no", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.when(F.col("n") >= min_fuzzy, F.array(*keys)).alias("keys"))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two different lines have; counts nothing per key but the least and the greatest hash, on both sides of the shuffle."""
    return rows.groupBy(key).agg(F.min("h1").alias("h"), F.max("h1").alias("g")).where("h < g").select(key)


def removed_near(documents: DataFrame, variants: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h1 and h2 of lines that an earlier line within one edit removes."""
    keyed = variants.where("keys is not null").select("id", "no", "n", "h1", "h2", F.posexplode("keys").alias("at", "key")).where("key is not null")
    coarse = checked(materialize(_shared(keyed, "key"), "line-keys"))
    found = keyed.join(coarse, "key", "left_semi").groupBy("h1", "h2", "n", "at").agg(F.min(F.struct("id", "no")).alias("pos"))
    found = materialize(found.select("h1", "h2", "n", "at", F.col("pos.id").alias("id"), F.col("pos.no").alias("no")), "line-found")
    places = materialize(found.select("id", "no").distinct(), "line-places")
    lines = semi_join(_texts(documents, id_col, text_col), places, "id").select("id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    lines = lines.join(places, ["id", "no"], "left_semi").dropDuplicates(["id", "no"])
    # From here on only lines that share three quarters with another.
    r = F.col("n") - (F.col("at") >= BLOCKS).cast("int")
    g = F.ceil(r / BLOCKS).cast("int")
    rows = found.join(lines, ["id", "no"]).select("h1", "h2", "n", "id", "no", "line", r.alias("r"), (g * (F.col("at") % BLOCKS)).alias("lo"), g.alias("g"))
    rows = materialize(rows.withColumn("s", F.ceil(F.col("g") / FINER).cast("int")), "line-rows")
    rows = rows.withColumn("wide", _wide("line"))
    finer = rows.withColumn("start", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(FINER - 1)), lambda j: F.col("lo") + j * F.col("s")), lambda c: (c < F.col("lo") + F.col("g")) & (c < F.col("r")))))
    finer = finer.withColumn("key", _key(F.col("n"), F.col("r"), F.col("start"), F.col("s"), F.lit(2)))
    shared = materialize(_shared(finer, "key"), "line-keys")
    fine = materialize(finer.join(shared, "key", "left_semi").select("h1", "h2", "n", "id", "no", "line", "r", "start", "s"), "line-fine").withColumn("wide", _wide("line"))
    # Single characters: substitutions have a key with their place; an insertion's key is the shorter line itself.
    end = F.least(F.col("start") + F.col("s"), F.col("r"))
    same = fine.where("r = n").withColumn("c", F.explode(F.sequence(F.col("start"), end - 1)))
    same = same.select("h1", "h2", "id", "no", _key(F.col("n"), F.col("r"), F.col("c"), F.lit(1), F.lit(3)).alias("key"))
    shorter = fine.where("r = n").select("h1", "h2", "id", "no", F.xxhash64("r", "line").alias("key"))
    longer = fine.where("r < n").withColumn("c", F.explode(F.sequence(F.col("start"), end)))
    longer = longer.select("h1", "h2", "id", "no", F.xxhash64("r", F.concat(F.substr("line", F.lit(1), F.col("c")), F.expr("substr(line, c + 2)"))).alias("key"))
    pos = F.struct("id", "no")
    kinds = []
    for killers, victims in ((same, same), (shorter, longer), (longer, shorter)):
        earliest = killers.groupBy("key").agg(F.min(pos).alias("by"))
        kinds.append(victims.join(earliest, "key").where(pos > F.col("by")).select("h1", "h2", pos.alias("pos"), "by"))
    hits = kinds[0].union(kinds[1]).union(kinds[2]).groupBy("h1", "h2", "pos").agg(F.min("by").alias("by"))
    text = rows.select(F.struct("id", "no").alias("p"), "line").dropDuplicates(["p"])
    hits = hits.join(text.select(F.col("p").alias("pos"), F.col("line").alias("a")), "pos").join(text.select(F.col("p").alias("by"), F.col("line").alias("b")), "by")
    return hits.where((F.levenshtein("a", "b", 1) >= 0) & (F.levenshtein("a", "b", 1) <= 1)).select("h1", "h2").distinct()


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_fuzzy: int = 10) -> DataFrame:
    """The documents with repeated lines cut from text, and lw_lines and lw_removed (numbers of lines that aren't blank)."""
    variants = materialize(line_variants(documents, id_col, text_col, min_fuzzy), "lines")
    removed = materialize(removed_near(documents, variants, id_col, text_col), "line-removed")
    firsts = variants.groupBy("h1", "h2").agg(F.min(F.struct("id", "no")).alias("pos"))
    kept = firsts.join(removed, ["h1", "h2"], "left_anti").groupBy(F.col("pos.id").alias("id")).agg(F.array_sort(F.collect_list("pos.no")).alias("kept"))
    had = variants.groupBy("id").agg(F.size(F.collect_set("no")).alias("n"))
    short = had.join(kept, "id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>"))).where(F.size("kept") < F.col("n"))
    short = materialize(short.select(F.col("id.id").alias("lw_id"), F.col("id.t").alias("lw_t"), F.col("n").alias("lw_n"), F.col("kept").alias("lw_kept")), "line-kept")
    on = ["lw_id", "lw_t"]
    rows = documents.withColumns({"lw_id": documents[id_col].cast("long"), "lw_t": F.xxhash64(documents[text_col])})
    lines = F.split(text_col, "\n", -1)
    blank = lambda x: ~x.rlike(r"\S")
    counted = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: ~blank(x)))).cast("long")
    rest = anti_join(rows, short, on).withColumns({"lw_lines": counted, "lw_removed": F.lit(0).cast("long")})
    # For each kept number the false values before it and itself; so a line's flag is found by its index.
    before = lambda k: F.when(k > 0, F.get("lw_kept", k - 1)).otherwise(F.lit(-1))
    flags = F.flatten(F.transform("lw_kept", lambda x, k: F.concat(F.array_repeat(F.lit(False), x - before(k) - 1), F.array(F.lit(True)))))
    cut = rows.join(checked_lists(short, "lw_kept"), on).withColumn("lw_flags", flags)
    cut = cut.withColumns({"lw_lines": counted, text_col: F.array_join(F.filter(lines, lambda x, k: blank(x) | F.coalesce(F.get("lw_flags", k), F.lit(False))), "\n")})
    left = F.size(F.filter(lines, lambda x: ~blank(x)))
    cut = cut.withColumn("lw_removed", F.col("lw_lines") - left)
    return cut.drop("lw_n", "lw_kept", "lw_flags", *on).unionByName(rest.drop(*on))
