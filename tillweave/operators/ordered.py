"""Window functions over one order of a whole table, without gathering the table in one task.

The rows are range-partitioned by the order. Each partition computes its own part; what it needs from its neighbours is either
one figure per partition (row counts, totals) or a few rows at their edges.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tillweave.sources.staging import stage


def ranged(df: DataFrame, order: Sequence[Column | str], *, partitions: int | None = None) -> DataFrame:
    """``df`` in range partitions of ``order``, with ``part``, the partition's number in that order; staged.

    ``order`` should name a row by itself, or equal rows come in any order.
    """
    many = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(many, *order).withColumn("part", F.spark_partition_id())
    return stage(dealt, "ordered-rows")


def _per_part(rows: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Per partition: row count ``n`` and the sums, each also as ``before_<name>``, the total of the partitions before it.

    One row per partition comes to the driver.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in sums.items()])
    found = sorted(totals.collect(), key=lambda r: r.part)
    names = ["n", *sums]
    before = dict.fromkeys(names)
    lines = []
    for row in found:
        lines.append((row.part, *[row[c] for c in names], *[before[c] for c in names]))
        before = {c: row[c] if before[c] is None else before[c] if row[c] is None else before[c] + row[c] for c in names}
    kinds = {f.name: f.dataType.simpleString() for f in totals.schema}
    schema = ", ".join(["part int", *[f"`{c}` {kinds[c]}" for c in names], *[f"`before_{c}` {kinds[c]}" for c in names]])
    return spark.createDataFrame(lines, schema)


def numbered(df: DataFrame, order: Sequence[Column | str], *, name: str = "number", running: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with each row's number in ``order`` (from 1) and running sums (``running``: new name -> column), NULLs left out."""
    running = dict(running or {})
    rows = ranged(df, order)
    parts = _per_part(rows, {c: F.sum(column) for c, column in running.items()})
    parts = parts.select("part", F.coalesce("before_n", F.lit(0)).alias("before_n"), *[f"before_{c}" for c in running])
    within = Window.partitionBy("part").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", F.row_number().over(within).alias("row_here"), *[F.sum(column).over(so_far).alias(f"here_{c}") for c, column in running.items()])
    joined = local.join(parts, "part")
    sums = [F.when(F.col(f"before_{c}").isNull(), F.col(f"here_{c}")).otherwise(F.col(f"before_{c}") + F.coalesce(f"here_{c}", F.lit(0))).alias(c) for c in running]
    return joined.select(*df.columns, (F.col("before_n") + F.col("row_here")).alias(name), *sums)


def windowed(
    df: DataFrame, order: Sequence[Column | str], build: Callable[[WindowSpec], Mapping[str, Column]], *, before: int = 0, after: int = 0
) -> DataFrame:
    """``df`` with columns computed over one order of all rows: LAG, LEAD, ROWS frames.

    ``build`` gets the window to use. Its functions may reach ``before`` rows back and ``after`` rows ahead; each partition is
    lent the rows it so needs from its neighbours, also where these are shorter than that.
    """
    rows = numbered(df, order, name="place")
    rows = ranged(rows, ["place"])
    spark = df.sparkSession
    counts = sorted(rows.groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last")).collect(), key=lambda r: r["first"])
    ends = spark.createDataFrame([(r.part, r["first"], r["last"]) for r in counts], "part int, first long, last long")
    # which partitions borrow from which: neighbours only, unless they are shorter than the reach
    loans = []
    for at, owner in enumerate(counts):
        for to in counts[at + 1 :]:
            if to["first"] - before > owner["last"]:
                break
            loans.append((owner.part, to.part, max(owner["first"], to["first"] - before), owner["last"]))
        for to in reversed(counts[:at]):
            if to["last"] + after < owner["first"]:
                break
            loans.append((owner.part, to.part, owner["first"], min(owner["last"], to["last"] + after)))
    lent = spark.createDataFrame(loans, "part int, borrower int, low long, high long")
    borrowed = rows.join(lent, "part").where(F.col("place").between(F.col("low"), F.col("high")))
    own = rows.join(ends.select("part"), "part").select(*df.columns, "place", "part", F.lit(True).alias("own"))
    guests = borrowed.select(*df.columns, "place", F.col("borrower").alias("part"), F.lit(False).alias("own"))
    window = Window.partitionBy("part").orderBy("place")
    columns = dict(build(window))
    computed = own.unionByName(guests).withColumns(columns)
    return computed.where("own").select(*df.columns, *columns)
