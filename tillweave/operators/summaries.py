"""Distinct counts and quantiles from mergeable states: stored per week, merged for any span of weeks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_error(log2_buckets: int = 12) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / math.sqrt(1 << log2_buckets)


def rank_error(k: int = 200) -> float:
    """Error of a quantile as a share of the rows, at 99 in 100: the value returned has a rank this close to the one asked for."""
    return 2.446 / k**0.9433


def period_states(
    rows: DataFrame, keys: Sequence[str], *, distinct: str, value: str, log2_buckets: int = 12, k: int = 200
) -> DataFrame:
    """Per group of ``keys``: ``visitors`` (state of the distinct ``distinct``), ``spread`` (state of the quantiles of ``value``)
    and ``rows``. A state is a few KB, however large or skewed the group; tasks merge theirs before anything is shuffled."""
    return rows.groupBy(*keys).agg(
        F.hll_sketch_agg(distinct, log2_buckets).alias("visitors"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("spread"),
        F.count(F.lit(1)).alias("rows"),
    )


def merged_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States merged to fewer keys."""
    return states.groupBy(*keys).agg(
        F.hll_union_agg("visitors").alias("visitors"), F.kll_merge_agg_double("spread").alias("spread"), F.sum("rows").alias("rows")
    )


def estimates(states: DataFrame, keys: Sequence[str], *, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Distinct count and quantiles (``q50``, ``q90``, ...) of each state."""
    return states.select(
        *keys,
        F.hll_sketch_estimate("visitors").alias("distinct_estimate"),
        *[F.kll_sketch_get_quantile_double("spread", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in quantiles],
        "rows",
    )
