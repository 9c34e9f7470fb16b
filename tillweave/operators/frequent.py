"""Most frequent values from mergeable summaries of bounded size.

A summary holds the counts of at most ``items`` values of a group. Summaries of parts (tasks, weeks, stores) merge into the
summary of the whole, so they can be stored per week and put together for any span of weeks without reading the facts again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary_error(items: int) -> float:
    """Largest share of a group's rows by which a count can be too high.

    The summary's table has the power of two of at least ``items`` / 0.75 places; its counts exceed the true ones by 3.5 rows
    per place and row at most, also after merging.
    """
    return 3.5 / (1 << math.ceil(math.log2(items / 0.75)))


def value_summaries(rows: DataFrame, keys: Sequence[str], value: str, *, items: int = 256) -> DataFrame:
    """Summary of ``value`` per group: ``keys``, ``summary``, ``rows``, ``least``, ``most`` (smallest and largest value).

    Each task summarises what it reads before anything is shuffled, so a hot group sends one bounded summary per task. NULL is a
    value like any other; it has no part in ``least`` and ``most``.
    """
    return rows.groupBy(*keys).agg(
        F.expr(f"approx_top_k_accumulate(`{value}`, {items})").alias("summary"),
        F.count(F.lit(1)).alias("rows"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )


def merged_summaries(summaries: DataFrame, keys: Sequence[str], *, items: int = 256) -> DataFrame:
    """Summaries of ``value_summaries`` merged to fewer keys."""
    return summaries.groupBy(*keys).agg(
        F.expr(f"approx_top_k_combine(summary, {items})").alias("summary"),
        F.sum("rows").alias("rows"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


def most_frequent(summaries: DataFrame, keys: Sequence[str], *, items: int = 256) -> DataFrame:
    """The most frequent value of each summary, with bounds that hold for sure.

    ``value`` has the highest count, ties go to the higher value (NULL last); it is also NULL where the summary names none, as
    all values are rare. The true highest count lies between ``at_least`` and ``at_most``. The true most frequent value is NULL
    (only if ``maybe_null``) or lies between ``low`` and ``high``: among the values whose highest count reaches ``at_least``,
    or, where a value the summary does not hold could be as frequent, anywhere among the group's values. ``certain`` says that
    no other value can be as frequent. Groups of fewer than 1 / ``summary_error`` rows are exact.
    """
    held = summaries.select(*keys, "rows", "least", "most", F.expr(f"approx_top_k_estimate(summary, {items})").alias("held"))
    slack = F.floor(F.col("rows") * F.lit(summary_error(items)))
    order = F.array_sort(
        "held",
        lambda a, b: F.when(a["count"] != b["count"], F.when(a["count"] > b["count"], -1).otherwise(1))
        .when(a["item"].isNull() | b["item"].isNull(), F.when(b["item"].isNull(), -1).otherwise(1))
        .when(a["item"] > b["item"], -1)
        .when(a["item"] < b["item"], 1)
        .otherwise(0),
    )
    top = held.withColumn("slack", slack).withColumn("held", order).withColumn("best", F.get("held", F.lit(0)))
    top = top.withColumn("at_least", F.greatest(F.col("best.count") - F.col("slack"), F.lit(1)))
    rivals = F.filter("held", lambda v: v["count"] >= F.col("at_least"))
    # a value that the summary has dropped occurs up to ``slack`` times
    open_ = F.col("slack") >= F.col("at_least")
    top = top.withColumn("rivals", rivals).withColumn("open", open_)
    known = F.filter(F.transform("rivals", lambda v: v["item"]), lambda x: x.isNotNull())
    return top.select(
        *keys,
        F.col("best.item").alias("value"),
        "at_least",
        F.greatest("best.count", "slack").alias("at_most"),
        F.when(F.col("open"), F.col("least")).otherwise(F.array_min(known)).alias("low"),
        F.when(F.col("open"), F.col("most")).otherwise(F.array_max(known)).alias("high"),
        (F.col("open") | F.exists("rivals", lambda v: v["item"].isNull())).alias("maybe_null"),
        (~F.col("open") & (F.size("rivals") == 1)).alias("certain"),
        "rows",
    )
