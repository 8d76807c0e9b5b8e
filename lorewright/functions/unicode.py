"""Unicode functions: normalisation and marks by ICU in the JVM; Arrow-batched UDFs where neither has the rule."""

from __future__ import annotations

import difflib
import html
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lorewright import shared

#: Quotes that may enclose a name. Fixed values.
QUOTES = ('"', "'", "“", "”", "‘", "’")
#: White space at either end, in Python's sense.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
EDGE_SPACE = f"^{SPACE}+|{SPACE}+$"
NORMALIZER, FOLD = "com.ibm.icu.text.Normalizer", ("com.ibm.icu.lang.UCharacter", "foldCase")


def _marks() -> str:
    """A pattern of the characters with a combining class, from Unicode's own table."""
    spans: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.combining(chr(c)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]+"


MARKS = _marks()
#: The same, tried only at characters from the first mark (U+0300) on: the class has some 200 spans, which other characters needn't meet.
MARKS_FAST = r"(?=[\x{300}-\x{10ffff}])" + MARKS


def _icu(class_name: str, method: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.java_method(F.lit(class_name), F.lit(method), text, F.lit(True)))


def nfkc(text: Column) -> Column:
    return _icu(NORMALIZER, "compose", text)


def strip_diacritics(text: Column) -> Column:
    """The compatibility decomposition without its combining marks (TX6)."""
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7f]")), F.regexp_replace(_icu(NORMALIZER, "decompose", text), MARKS_FAST, "")).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def unquote(text: Column) -> Column:
    """Without the pairs of equal quotes around it (TX4): at most as many pairs go as quotes stand at the start."""
    quotes = "".join(QUOTES)
    # strip's pattern is tried at each character, so only texts with space at an end meet it.
    ends = F.concat(F.substr(text, F.lit(1), F.lit(1)), F.right(text, F.lit(1)))
    stripped = F.when(F.rlike(ends, F.lit(SPACE)), strip(text)).otherwise(text)
    leading = F.length(F.regexp_extract(text, rf"^[{quotes}\s\p{{Z}}]*", 0))

    def peel(t: Column, _: Column) -> Column:
        first = F.substr(t, F.lit(1), F.lit(1))
        quoted = (F.length(t) >= 2) & first.isin(*QUOTES) & (first == F.right(t, F.lit(1)))
        return F.when(quoted, strip(F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))))).otherwise(t)

    return F.aggregate(F.sequence(F.lit(0), leading), stripped, peel)


@F.pandas_udf(StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Without HTML's character references; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def clean_str(text: Column) -> Column:
    """Unescaped, stripped, without control characters (TX2)."""
    return F.regexp_replace(unescape(strip(text)), r"[\x00-\x1f\x7f-\x{9f}]", "")


def entity_key(text: Column) -> Column:
    """The key under which names are one (TX3)."""
    return F.regexp_replace(strip_diacritics(_icu(*FOLD, nfkc(unquote(unescape(text))))), "[^0-9a-z]+", "")


def with_entity_key(rows: DataFrame, name: str, out: str) -> DataFrame:
    """rows with the entity_key of a column of names.

    Every step is a projection of its own, as in with_clean: each mentions the one before twice or more, so that within one
    expression a name would be unquoted and normalised a dozen times over. Marks go with all else that is no digit or letter.
    """
    plain = lambda c: F.when(F.rlike(c, F.lit(r"[^\x00-\x7f]")), _icu(NORMALIZER, "decompose", c)).otherwise(c)
    steps = (unescape, unquote, nfkc, lambda c: _icu(*FOLD, c), plain, lambda c: F.regexp_replace(c, "[^0-9a-z]+", ""))
    found = rows.withColumn("lw_key", F.col(name))
    for step in steps:
        found = found.withColumn("lw_key", step(F.col("lw_key")))
    return found.withColumn(out, F.col("lw_key")).drop("lw_key")


def dequote_id(text: Column) -> Column:
    """A node id as sanitizing reads it: unescaped, without one pair of double quotes (TX7)."""
    return F.regexp_replace(unescape(text), r'(?s)^"(.*)"$', "$1")


def alias_table(spark, aliases: dict[str, list[str]]) -> DataFrame:
    """alias and canonical of a specification {canonical: [alias]}, the canonical names among them, all in upper case (D16)."""
    rows = {name.upper(): canonical.upper() for canonical, names in aliases.items() for name in (canonical, *names)}
    return spark.createDataFrame(sorted(rows.items()), "alias string, canonical string")


#: Characters of a gram.
GRAM = 2


def _prefix(text: str, cutoff: float) -> Column:
    """The first of a text's grams in the order of a hash: so many that a text as like as the cutoff must share one.

    Two texts with a ratio of c have (1 - c) of their characters outside common blocks at most, and each of these breaks GRAM
    grams at most; the rest are in both. Equal grams of one text are told apart by how many came before.
    """
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(GRAM)))
    numbered = F.transform(grams, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g))))
    broken = F.floor(F.lit(2 * (1 - cutoff) / cutoff + 1e-9) * F.length(text)).cast("int") * GRAM
    return F.slice(F.array_sort(numbered), 1, broken + 1)


def _letters(text: str) -> Column:
    """A text's letters, equal ones told apart by how many came before."""
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
    return F.transform(each, lambda c, i: F.xxhash64(c, F.size(F.filter(F.slice(each, F.lit(1), i), lambda x: x == c))))


def candidate_pairs(names: DataFrame, table: DataFrame, cutoff: float) -> DataFrame:
    """lw_name and alias of all pairs that may be as like as the cutoff, by a join on the grams that such pairs must share.

    Lengths are held against each other first, and the letters that both have after it, wherever they stand; names longer
    than any alias allows are never cut into grams.
    """
    span = table.agg(F.min(F.length("alias")).alias("lo"), F.max(F.length("alias")).alias("hi")).first()
    if span["hi"] is None:
        return names.select("lw_name", F.lit("").alias("alias")).where("false")
    far = (2 - cutoff) / cutoff
    fits = F.length("lw_name").between(int(span["lo"] / far), int(span["hi"] * far) + 1)
    left = names.where(fits).select("lw_name", _letters("lw_name").alias("x"), F.explode(_prefix("lw_name", cutoff)).alias("gram"))
    right = table.select("alias", _letters("alias").alias("y"), F.explode(_prefix("alias", cutoff)).alias("gram"))
    met = left.join(F.broadcast(right), "gram")  # a few grams for each alias of the configuration
    a, b = F.length("lw_name"), F.length("alias")
    least = cutoff * (a + b) - 1e-9
    met = met.where(2 * F.least(a, b) >= least).where(2 * F.size(F.array_intersect("x", "y")) >= least)
    return met.select("lw_name", "alias").distinct()


@F.pandas_udf(DoubleType())
def _ratio(names: pd.Series, aliases: pd.Series) -> pd.Series:
    matcher, out, last = difflib.SequenceMatcher(), [], None
    for name, alias in zip(names, aliases, strict=True):
        if name != last:
            matcher.set_seq2(name)
            last = name
        matcher.set_seq1(alias)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def normalize_names(names: DataFrame, column: str, aliases: dict[str, list[str]], cutoff: float = 0.92, out: str = "name") -> DataFrame:
    """names with column `out`: the canonical name of an alias, of one equal but for diacritics, or of the closest one within the
    cutoff (of equally close ones the greatest alias); else the name in upper case; Unknown where it is empty (TX5, JN12).

    Two joins with the table of aliases, a configuration of bounded size. Distinct names that neither finds meet only
    aliases with which they share a gram that they must share, and only these pairs are compared letter by letter.
    """
    table = alias_table(names.sparkSession, aliases)
    bare = F.regexp_replace(F.regexp_replace(strip(nfkc(F.col(column))), '^"+|"+$', ""), "^'+|'+$", "")
    rows = names.withColumn("lw_name", F.upper(bare))
    for found, probe in (("lw_same", F.col("lw_name")), ("lw_plain", strip_diacritics(F.col("lw_name")))):
        rows = rows.withColumn("lw_probe", probe).join(F.broadcast(table.toDF("lw_probe", found)), "lw_probe", "left").drop("lw_probe")
    known = F.coalesce("lw_same", "lw_plain")
    unknown = rows.where(known.isNull() & (F.col("lw_name") != "")).select("lw_name").distinct()
    near = candidate_pairs(unknown, table, cutoff).withColumn("ratio", _ratio("lw_name", "alias")).where(F.col("ratio") >= cutoff)
    near = near.groupBy("lw_name").agg(F.max(F.struct("ratio", "alias")).alias("best")).select("lw_name", F.col("best.alias").alias("alias"))
    near = near.join(F.broadcast(table.withColumnRenamed("canonical", "lw_near")), "alias").select("lw_name", "lw_near")
    rows = rows.join(shared.checked(shared.materialize(near, "near-names")), "lw_name", "left")
    name = F.when(F.coalesce(F.col("lw_name"), F.lit("")) == "", "Unknown").otherwise(F.coalesce(known, "lw_near", "lw_name"))
    return rows.withColumn(out, name).drop("lw_name", "lw_same", "lw_plain", "lw_near")


def clean_text_full(text: Column) -> Column:
    """functions.text.clean_text of the text in NFKC (TX1)."""
    from lorewright.functions import text as T

    return T.clean_text(nfkc(text))


def with_clean(rows: DataFrame, **texts: Column) -> DataFrame:
    """rows with clean_text_full of each text as a column of its name.

    Spark takes a Java method for one that may change, so it neither shares nor joins what holds it: within clean_text_full the
    text would be normalised anew at each of the cleaned text's many mentions. In a projection of its own it is made once.
    """
    from lorewright.functions import text as T

    normal = rows.withColumns({f"lw_nfkc_{name}": nfkc(text) for name, text in texts.items()})
    return normal.withColumns({name: T.clean_text(F.col(f"lw_nfkc_{name}")) for name in texts}).drop(*[f"lw_nfkc_{name}" for name in texts])
