"""Totals at several levels from one pass over the facts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.sources.staging import stage

_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def grouping_sets(
    df: DataFrame, keys: Sequence[str], sets: Iterable[Sequence[str]], measures: Mapping[str, tuple[str, str | Column]]
) -> DataFrame:
    """One row per group of each set of ``keys``: the keys (NULL where the set lacks one), ``grouping_id``, the measures.

    ``measures``: name -> (sum, count, min or max; column). The facts are aggregated once, by all keys; every coarser set is
    aggregated from the smallest finer one there is, whose rows are as few as its groups, while the built-in operator repeats
    each fact once per set. ``grouping_id`` has a bit for each key, the first key's highest, set where the key is left out: it
    tells a NULL key from a total. The set without keys has one row, also of an empty table.
    """
    keys = list(keys)
    wanted = [tuple(k for k in keys if k in set(s)) for s in sets]
    for s in sets:
        unknown = set(s) - set(keys)
        if unknown:
            raise ValueError(f"{sorted(unknown)[0]} is none of the keys")
    done: dict[tuple[str, ...], DataFrame] = {}
    base = df.groupBy(*keys).agg(*[_FIRST[kind](column).alias(name) for name, (kind, column) in measures.items()])
    done[tuple(keys)] = stage(base, "grouping-base")
    for s in sorted(set(wanted), key=len, reverse=True):
        if s not in done:
            finer = min((t for t in done if set(s) <= set(t)), key=len)
            merged = done[finer].groupBy(*s).agg(*[_MERGE[kind](name).alias(name) for name, (kind, _) in measures.items()])
            if not s:
                merged = merged.withColumns({name: F.coalesce(name, F.lit(0)) for name, (kind, _) in measures.items() if kind == "count"})
            done[s] = stage(merged, "grouping-set")
    result = None
    for s in dict.fromkeys(wanted):
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        columns = [F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
        rows = done[s].select(*columns, F.lit(mask).cast("long").alias("grouping_id"), *measures)
        result = rows if result is None else result.unionByName(rows)
    return result


def rollup(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, str | Column]], *, within: Sequence[str] = ()) -> DataFrame:
    """Totals of each level of a hierarchy, ``keys`` from the top down, and over all of it; each within the ``within`` columns."""
    levels = [list(keys[:i]) for i in range(len(keys), -1, -1)]
    return grouping_sets(df, [*within, *keys], [[*within, *level] for level in levels], measures)


def cube(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
    """Totals of every combination of ``keys``."""
    combinations = [[k for i, k in enumerate(keys) if mask >> i & 1] for mask in range(1 << len(keys))]
    return grouping_sets(df, keys, sorted(combinations, key=len, reverse=True), measures)
