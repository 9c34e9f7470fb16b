"""Week columns from data, and the job audit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import add_weeks, local_timestamp, sunday_week_start


def dynamic_week_pivot(
    facts: DataFrame, dim_date: DataFrame, *, as_of: dt.date, category: str, weeks: int = 52, week_column: str = "financial_period_week"
) -> DataFrame:
    """Weekly sales of a category, one column per week of the trailing horizon, newest first.

    A week end has one label, that of its first day, so that no week is counted under two where the label changes inside it.
    Column names come from the calendar: the only thing fetched to the driver are the ``weeks`` or so week labels.
    """
    last = sunday_week_start(F.lit(as_of))
    horizon = dim_date.filter(F.col("financial_week_end_date").between(add_weeks(last, 1 - weeks), last))
    ends = horizon.groupBy("financial_week_end_date").agg(F.min_by(F.col(week_column).cast("string"), "date").alias("week"))
    labels = sorted((r["week"] for r in ends.select("week").distinct().collect()), reverse=True)
    in_horizon = facts.filter(
        (F.col("category") == category) & F.col("financial_week_end_date").between(add_weeks(last, 1 - weeks), last)
    )
    weekly = in_horizon.groupBy("article_id", "financial_week_end_date").agg(F.sum("weekly_sales").alias("sales"))
    return weekly.join(ends, "financial_week_end_date").groupBy("article_id").pivot("week", labels).agg(F.sum("sales"))


def job_audit(jobs: DataFrame, *, table_name: str, zone: str) -> DataFrame:
    """Jobs that wrote a table, newest first, with the start in local time."""
    return (
        jobs.filter(F.col("destination_table.table_id") == table_name)
        .withColumn("start_date", local_timestamp(F.col("start_time"), zone))
        .drop("start_time")
        .orderBy(F.col("start_date").desc())
    )


def unpivot_weeks(wide: DataFrame, *, keys: Sequence[str], label: str = "week", value: str = "sales", keep_empty: bool = False) -> DataFrame:
    """A week pivot back as rows: ``keys``, ``label``, ``value``. Every column that is not a key is a week.

    The weeks are read off the schema, as they are data. They must be of one type, else a text column taken for a week would
    turn all values into text. Weeks without a value are left out unless ``keep_empty``.
    """
    weeks = [f for f in wide.schema if f.name not in keys]
    odd = [f for f in weeks if f.dataType != weeks[0].dataType]
    if odd:
        raise TypeError(f"column {odd[0].name} is {odd[0].dataType.simpleString()}, {weeks[0].name} {weeks[0].dataType.simpleString()}")
    if not weeks:
        raise ValueError("no column besides the keys")
    quoted = lambda names: [f"`{n}`" for n in names]
    long = wide.unpivot(quoted(keys), quoted(f.name for f in weeks), label, value)
    return long if keep_empty else long.where(F.col(value).isNotNull())
