"""The market-share report from the own ledger and the market data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tillweave.operators import market as ops
from tillweave.sources.staging import stage


def matched_market(
    market: DataFrame,
    *,
    as_of: dt.date,
    markets: Mapping[str, str],
    departments: Sequence[str],
    segments: Sequence[str],
    levels: Sequence[str] = ("department", "segment"),
    scope_level: str = "segment",
) -> DataFrame:
    """Market rows spread by market and matched to canonical descriptions; the rows in scope, which both read, and both inputs of
    the match are staged."""
    scope = {"departments": departments, "segments": segments, "scope_level": scope_level}
    market = stage(ops.market_in_scope(market, as_of=as_of, levels=levels, **scope), "market-rows")
    spread = stage(ops.market_by_segment(market, as_of=as_of, markets=markets, levels=levels, **scope), "market-spread")
    canonical = stage(ops.canonical_description(market, as_of=as_of, **scope), "market-canonical")
    return ops.two_way_match(spread, canonical)


def own_against_market(
    profit: DataFrame,
    market: DataFrame,
    dim_date: DataFrame,
    products: DataFrame,
    *,
    as_of: dt.date,
    sales_org: str,
    markets: Mapping[str, str],
    departments: Sequence[str],
    segments: Sequence[str],
    levels: Sequence[str] = ("department", "segment"),
    measures: Sequence[str] = ("sales", "interim_gp", "manual_claims", "quantity"),
    scope_level: str = "segment",
    excluded: str | None = None,
    attributes: Sequence[str] = ("price_family_id",),
) -> DataFrame:
    """Own and market sales per article and week."""
    scope = {"departments": departments, "segments": segments, "scope_level": scope_level}
    own = ops.weekly_own_profit(profit, as_of=as_of, sales_org=sales_org, levels=levels, measures=measures, excluded=excluded, **scope)
    # the match is read twice: rows with a product id meet the own side, the others stand alone
    matched = stage(matched_market(market, as_of=as_of, markets=markets, levels=levels, **scope), "market-matched")
    return ops.own_vs_market(own, matched, ops.report_calendar(dim_date, as_of=as_of), products, levels=levels, attributes=attributes)


def market_share(
    profit: DataFrame,
    market: DataFrame,
    dim_date: DataFrame,
    products: DataFrame,
    *,
    as_of: dt.date,
    sales_org: str,
    markets: Mapping[str, str],
    departments: Sequence[str],
    segments: Sequence[str],
    levels: Sequence[str],
    excluded_prefix: str | None = None,
    measures: Sequence[str] = ("sales", "interim_gp"),
    scope_level: str = "segment",
    excluded: str | None = None,
) -> DataFrame:
    """Market figures against the own hierarchy per week and node of the ``levels``, all of them keys of the match."""
    combined = own_against_market(
        profit, market, dim_date, products, as_of=as_of, sales_org=sales_org, markets=markets, departments=departments, segments=segments,
        levels=levels, scope_level=scope_level, excluded=excluded,
    )
    calendar = ops.report_calendar(dim_date, as_of=as_of)
    hierarchy = ops.own_hierarchy(
        profit, calendar, as_of=as_of, sales_org=sales_org, levels=levels, excluded_prefix=excluded_prefix, measures=measures, excluded=excluded
    )
    return ops.market_share_report(combined, hierarchy, levels=levels, markets=list(markets.values()), as_of=as_of, measures=measures)
