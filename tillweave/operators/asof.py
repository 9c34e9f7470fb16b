"""As-of join: to each row the last row of the other side that is not later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.sources.staging import stage

#: Rows per task in the sample that finds frequent keys.
_SAMPLED = 400


def asof_join(
    left: DataFrame, right: DataFrame, *, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], ties: Sequence[str] = ()
) -> DataFrame:
    """``left`` with ``right_time`` and ``values`` of the last ``right`` row of equal ``on`` with ``right_time`` <= ``left_time``;
    NULL where there is none.

    Rows of ``right`` with equal time count in the order of ``ties``, then of their values; the last one holds. A row with a NULL
    in ``on`` or its time matches nothing.

    Both sides are one table, staged once, and a window per key takes the last value before each row. A key that a sample of that
    table finds frequent is cut into spans of time, so it spreads over as many tasks as it needs; the last value before a span is
    carried over to it: at most one row per span. The sample decides where the cuts are, never a result.
    """
    on, values = list(on), [right_time, *[v for v in values if v != right_time]]
    clash = [c for c in left.columns if c in values]
    if clash:
        raise ValueError(f"both sides have a column {clash[0]}")
    whole = F.lit(True)
    for column in [*on, "asof_time"]:
        whole = whole & F.col(column).isNotNull()
    # what key and time say is not kept twice, unless the union below gives them another type
    kinds, others = dict(left.dtypes), dict(right.dtypes)
    twice = [c for c in on if kinds[c] == others[c]] + ([left_time] if kinds[left_time] == others[right_time] else [])
    kept = [c for c in left.columns if c not in twice] or [left_time]
    rank = F.struct(*[F.col(c) for c in [*ties, *[v for v in values if v not in ties]]])
    dated = right.withColumn("asof_time", F.col(right_time)).where(whole)
    valid = dated.groupBy(*on, "asof_time").agg(F.max_by(F.struct(*values), rank).alias("asof_value"))
    asked = left.select(*on, F.col(left_time).alias("asof_time"), F.struct(*kept).alias("asof_row"), F.lit(1).alias("asof_side"))
    offered = valid.select(*on, "asof_time", "asof_value", F.lit(0).alias("asof_side"))
    rows = stage(asked.unionByName(offered, allowMissingColumns=True), "asof-rows")

    def matched(found: DataFrame, value: Column) -> DataFrame:
        own = {c: F.col("asof_row")[c] for c in kept} | {c: F.col(c) for c in on if c not in kept}
        own = {left_time: F.col("asof_time")} | own
        return found.select(*[own[c].alias(c) for c in left.columns], *[value[v].alias(v) for v in values])

    spans = _spans(rows.where(whole), on)
    cut = rows.where(whole)
    if spans is None:
        so_far = Window.partitionBy(*on).orderBy("asof_time", "asof_side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        local = cut.withColumn("asof_local", F.last("asof_value", ignorenulls=True).over(so_far))
        known = matched(local.where("asof_side = 1"), F.col("asof_local"))
    else:
        begun = F.filter("asof_cuts", lambda c: c <= F.col("asof_time"))
        cut = cut.join(spans, on, "left").withColumn("part", F.coalesce(F.size(begun), F.lit(0)))
        so_far = Window.partitionBy(*on, "part").orderBy("asof_time", "asof_side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        local = cut.drop("asof_cuts").withColumn("asof_local", F.last("asof_value", ignorenulls=True).over(so_far))
        last = cut.where("asof_cuts is not null and asof_side = 0").groupBy(*on, "part").agg(F.max_by("asof_value", "asof_time").alias("asof_value"))
        # each span's last value holds for all later spans of the key up to the next one that has a value
        numbers = spans.select(*on, F.explode(F.sequence(F.lit(0), F.size("asof_cuts"))).alias("part"))
        earlier = Window.partitionBy(*on).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = numbers.join(last, [*on, "part"], "left").withColumn("asof_carried", F.last("asof_value", ignorenulls=True).over(earlier))
        carried = stage(carried.where("asof_carried is not null").select(*on, "part", "asof_carried"), "asof-carried")
        found = local.where("asof_side = 1").join(carried, [*on, "part"], "left")
        known = matched(found, F.coalesce("asof_local", "asof_carried"))
    nothing = rows.where(~whole).withColumn("asof_value", F.lit(None).cast(rows.schema["asof_value"].dataType))
    return known.unionByName(matched(nothing, F.col("asof_value")))


def _spans(rows: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """Keys with more than a quarter of a task's rows and the times at which to cut them (``asof_cuts``, ascending), or None.

    Counted in a sample of some hundred rows per task, so there are at most a few keys and cuts per task.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, _SAMPLED * tasks / max(1, rows.count()))
    sample = rows.sample(share, seed=0) if share < 1 else rows
    times = sample.groupBy(*on).agg(F.sort_array(F.collect_list("asof_time")).alias("times"))
    step = _SAMPLED // 4
    cuts = F.array_distinct(F.filter("times", lambda _, at: (at > 0) & (at % step == 0)))
    spans = times.where(F.size("times") > step).select(*on, cuts.alias("asof_cuts"))
    spans = stage(spans, "asof-spans")
    return None if spans.isEmpty() else spans
