"""Rows that the training-data operators' tests share."""

from pyspark.sql import functions as F

#: Columns that documents may have besides, with names that operators use themselves.
CLASHING = ("id", "key", "n", "no", "line", "pos", "start", "count", "hi", "lo", "rep", "node", "component", "part", "ids", "text2", "row", "word", "keys", "at", "kept", "next", "need")


def documents(spark, rows, lang="en"):
    """Documents of (doc_id, text) rows with clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit(lang), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("clash") for c in CLASHING})
