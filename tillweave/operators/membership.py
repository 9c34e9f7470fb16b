"""Membership tests with SQL's NULL rules, as joins that need no broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_subquery(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """``column IN (SELECT other_column ...)``."""
    values = other.select(F.col(other_column).alias(column)).distinct()
    return df.join(values, column, "left_semi")


def not_in_subquery(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """``column NOT IN (SELECT other_column ...)``.

    A NULL in the subquery empties the result, and a NULL on the left passes only when the subquery is empty. Both facts
    about the subquery come from one aggregate; the rest is an ordinary anti-join, where a SQL ``NOT IN`` would have to
    broadcast the subquery.
    """
    values = other.select(F.col(other_column).alias(column))
    facts = values.agg(
        F.struct(
            F.coalesce(F.bool_or(F.col(column).isNull()), F.lit(False)).alias("has_null"), (F.count(F.lit(1)) == 0).alias("is_empty")
        ).alias("facts")
    ).scalar()
    has_null, is_empty = facts.getField("has_null"), facts.getField("is_empty")
    kept = df.join(values.filter(F.col(column).isNotNull()).distinct(), column, "left_anti")
    return kept.filter(~has_null & (F.col(column).isNotNull() | is_empty))
