"""Comparing two refreshes of a report, row for row, with repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each different row of either refresh with how often it occurs: ``old_count``, ``new_count``. NULLs are equal here.

    Both sides are one aggregation over a signed union, so equal rows are reduced in the tasks that read them.
    """
    if set(old.columns) != set(new.columns):
        raise ValueError("the refreshes have different columns")
    both = old.withColumns({"old_count": F.lit(1), "new_count": F.lit(0)}).unionByName(
        new.withColumns({"old_count": F.lit(0), "new_count": F.lit(1)})
    )
    return both.groupBy(*old.columns).agg(F.sum("old_count").alias("old_count"), F.sum("new_count").alias("new_count"))


def refresh_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What differs: rows with ``removed`` (occurrences only ``old`` has: EXCEPT ALL), ``added`` and ``kept`` (INTERSECT ALL)."""
    counts = row_counts(old, new)
    return counts.select(
        *old.columns,
        F.greatest(F.col("old_count") - F.col("new_count"), F.lit(0)).alias("removed"),
        F.greatest(F.col("new_count") - F.col("old_count"), F.lit(0)).alias("added"),
        F.least("old_count", "new_count").alias("kept"),
    ).where("removed > 0 or added > 0")


def _repeated(rows: DataFrame, times, columns: list[str]) -> DataFrame:
    return rows.where(times > 0).withColumn("time", F.explode(F.sequence(F.lit(1), times))).select(*columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` less those of ``right``, each occurrence counted."""
    return _repeated(row_counts(left, right), F.col("old_count") - F.col("new_count"), left.columns)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows both have, as often as both have them."""
    return _repeated(row_counts(left, right), F.least("old_count", "new_count"), left.columns)
