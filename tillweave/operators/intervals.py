"""Joins of rows whose spans of time or numbers overlap, without unfolding the spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.sources.staging import stage

_SHIFT = 3  # a level's bins are 2 ** 3 times as wide as those of the level below
_LEVELS = 21  # enough for any 64-bit span
_FAR = (1 << 62) - 1

Span = tuple[str, str]


def _number(df: DataFrame, column: str) -> Column:
    """A column as a 64-bit number that keeps its order: days of a date, microseconds of a timestamp, integers as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    raise TypeError(f"{column} is {kind.simpleString()}, not a date, a timestamp or an integer")


def _spanned(df: DataFrame, span: Span, name: str, open_ends: bool) -> DataFrame:
    """Rows with a span that is not empty, with ``begin``, ``end`` and the level whose bins are at least as wide as it."""
    begin, end = (_number(df, c) for c in span)
    if open_ends:
        begin, end = F.coalesce(begin, F.lit(-_FAR)), F.coalesce(end, F.lit(_FAR))
    numbered = df.withColumns({f"{name}_begin": begin, f"{name}_end": end}).where(F.col(f"{name}_begin") <= F.col(f"{name}_end"))
    length = F.col(f"{name}_end") - F.col(f"{name}_begin")
    level = sum(((length >= F.lit(1 << (_SHIFT * k))).cast("int") for k in range(_LEVELS)), F.lit(0))
    return numbered.withColumn(f"{name}_level", level)


def _levels(df: DataFrame, name: str) -> list[int]:
    """Levels that occur: at most 22 numbers."""
    return sorted(r[0] for r in df.select(f"{name}_level").distinct().collect())


def _binned(df: DataFrame, name: str, own: list[int], others: list[int]) -> DataFrame:
    """Each row once for each bin it touches (two at most) in each level in which it can meet the other side: its own, if the
    other side has spans as short, and the wider ones the other side has."""
    wider = F.array(*[F.lit(o) for o in others]) if others else F.array().cast("array<int>")
    level = F.col(f"{name}_level")
    at = F.concat(F.when(level >= min(others, default=_LEVELS + 1), F.array(level)).otherwise(F.array().cast("array<int>")), F.filter(wider, lambda o: o > level))
    rows = df.withColumn("bin_level", F.explode(at))
    first, last = (F.expr(f"shiftright({name}_{side}, {_SHIFT} * bin_level)") for side in ("begin", "end"))
    return rows.withColumn("bin", F.explode(F.sequence(first, last)))


def interval_join(
    left: DataFrame, right: DataFrame, *, left_span: Span, right_span: Span, on: Sequence[str] = (), how: str = "inner", open_ends: bool = False
) -> DataFrame:
    """Pairs of rows with equal ``on`` whose spans (first and last column, both included) overlap.

    A point is a span whose two columns are one. Spans are dates, timestamps or integers, of one kind on both sides. Each span
    goes to the bins of a level as wide as itself, so it touches at most two, whatever its length: how much is shuffled depends
    on the number of rows and of different levels, not on how long spans are. Two rows meet in the wider one's level, and are
    reported in the bin in which the later of the two begins, so every pair comes once. A hot bin is a hot key of a plain join
    that adaptive execution splits.

    ``how="left"`` keeps left rows that meet none. A NULL bound overlaps nothing, or is open with ``open_ends``; spans that end
    before they begin overlap nothing; a NULL in ``on`` matches nothing. Other columns must have different names on both sides.
    """
    on = list(on)
    clash = [c for c in left.columns if c in right.columns and c not in on]
    if clash:
        raise ValueError(f"both sides have a column {clash[0]}")
    if how not in ("inner", "left"):
        raise ValueError(f"how is {how}, not inner or left")
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    if how == "left":
        left = stage(left.withColumn("left_row", F.monotonically_increasing_id()), "interval-left")
    a, b = _spanned(left, left_span, "left", open_ends), _spanned(right, right_span, "right", open_ends)
    levels_a, levels_b = _levels(a, "left"), _levels(b, "right")
    a, b = _binned(a, "left", levels_a, levels_b), _binned(b, "right", levels_b, levels_a)
    met = a.join(b, [*on, "bin_level", "bin"]).where(
        (F.greatest("left_level", "right_level") == F.col("bin_level"))
        & (F.greatest("left_begin", "right_begin") <= F.least("left_end", "right_end"))
        & (F.expr(f"shiftright(greatest(left_begin, right_begin), {_SHIFT} * bin_level)") == F.col("bin"))
    )
    if how == "inner":
        return met.select(*columns)
    met = stage(met.select("left_row", *columns), "interval-met")
    alone = left.join(met.select("left_row").distinct(), "left_row", "left_anti")
    return met.select(*columns).unionByName(alone.drop("left_row"), allowMissingColumns=True).select(*columns)
