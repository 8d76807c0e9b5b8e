"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewright.plans import graph_plans, index_plans, more_plans, retrieval_plans, text_plans  # noqa: F401
from lorewright.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From packed chunks to cited context, for the stated queries."""
    return QUERIES["flagship"](spark, sf_dir)
