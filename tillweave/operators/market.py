"""Own sales against market data: matching products, aligning weeks, rolling up the hierarchy."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import add_weeks, monday_week_start


def _weeks_back(as_of: dt.date, weeks: int) -> tuple[Column, Column]:
    """First and last week start of a horizon that ends one week ago."""
    return add_weeks(F.lit(as_of), -weeks), add_weeks(F.lit(as_of), -1)


#: Levels of the product hierarchy, from the top down.
LEVELS = ("department", "category", "sub_category", "segment")
#: The measures of the own ledger; the margin net of manual claims is computed besides.
LEDGER = ("sales", "interim_gp", "trading_gp", "dumps", "stock_loss", "markdowns", "manual_claims", "cogs")


def in_scope(departments: Sequence[str], segments: Sequence[str], level: str = "segment") -> Column:
    """Rows of the listed departments, or of the listed segments (or another ``level``'s nodes) of any department."""
    return F.upper("department").isin([d.upper() for d in departments]) | F.upper(level).isin([x.upper() for x in segments])


def _ledger_rows(profit: DataFrame, as_of: dt.date, weeks: int, sales_org: str, excluded: str | None) -> DataFrame:
    """Ledger rows of an organisation within the horizon, but for the ``excluded`` ones; unknown whether excluded is excluded."""
    first, last = _weeks_back(as_of, weeks)
    week = monday_week_start(F.col("calendar_day"))
    # the plain day range lets the scan skip data; the week test decides
    rows = profit.filter(F.col("calendar_day").between(first, F.date_add(last, 6)) & week.between(first, last) & (F.col("sales_org") == sales_org))
    return rows if excluded is None else rows.filter(~F.expr(excluded))


def _ledger_sums(measures: Sequence[str]) -> list[Column]:
    return [*[F.sum(m).alias(m) for m in measures], F.sum(F.col("interim_gp") - F.col("manual_claims")).alias("interim_gp_net")]


def weekly_own_profit(
    profit: DataFrame,
    *,
    as_of: dt.date,
    departments: Sequence[str],
    segments: Sequence[str] = (),
    sales_org: str,
    weeks: int = 104,
    levels: Sequence[str] = ("department", "segment"),
    measures: Sequence[str] = ("sales", "interim_gp", "manual_claims", "quantity"),
    scope_level: str = "segment",
    excluded: str | None = None,
) -> DataFrame:
    """Own sales and margin by article and Monday week for the departments or segments in scope.

    The article's ``levels`` stand beside it. ``measures`` are summed, as is the margin net of manual claims. ``excluded`` rows
    are left out, e.g. ``"category = 'X'"``; rows without a category then are, too.
    """
    week = monday_week_start(F.col("calendar_day"))
    rows = _ledger_rows(profit, as_of, weeks, sales_org, excluded).filter(in_scope(departments, segments, scope_level))
    return rows.groupBy("article_id", *levels, week.alias("week_start")).agg(*_ledger_sums(measures))


def _market_rows(
    market: DataFrame, as_of: dt.date, weeks: int, departments: Sequence[str], segments: Sequence[str], scope_level: str
) -> DataFrame:
    dated = market.withColumn("week_start", F.col("week_start").cast("date"))
    return dated.filter(F.col("week_start").between(*_weeks_back(as_of, weeks)) & in_scope(departments, segments, scope_level))


def market_in_scope(
    market: DataFrame, *, as_of: dt.date, departments: Sequence[str], segments: Sequence[str] = (), weeks: int = 105, scope_level: str = "segment",
    levels: Sequence[str] = ("department", "segment"),
) -> DataFrame:
    """Market rows within the longest horizon of the operators below and in scope, with the columns these need."""
    rows = _market_rows(market, as_of, weeks, departments, segments, scope_level)
    nodes = dict.fromkeys(["department", *levels, scope_level])
    return rows.select("week_start", "product_ref", "product_description", *nodes, "market", "value_excl_tax", "units")


def market_by_segment(
    market: DataFrame,
    *,
    as_of: dt.date,
    markets: Mapping[str, str],
    departments: Sequence[str],
    segments: Sequence[str] = (),
    weeks: int = 104,
    levels: Sequence[str] = ("segment", "department"),
    scope_level: str = "segment",
) -> DataFrame:
    """Market sales and units per product and week, one pair of columns per market (``markets``: name -> column prefix)."""
    rows = _market_rows(market, as_of, weeks, departments, segments, scope_level).filter(F.col("market").isin(list(markets)))

    def measure(name: str, column: str) -> Column:
        return F.sum(F.when(F.col("market") == name, F.col(column)).otherwise(0.0))

    columns = []
    for name, prefix in markets.items():
        columns += [measure(name, "value_excl_tax").alias(f"{prefix}_sales"), measure(name, "units").alias(f"{prefix}_units")]
    return rows.groupBy("week_start", "product_ref", *levels, "product_description").agg(*columns)


def canonical_description(
    market: DataFrame, *, as_of: dt.date, departments: Sequence[str], segments: Sequence[str] = (), weeks: int = 105, scope_level: str = "segment"
) -> DataFrame:
    """Best-selling description of each product id; descriptions without an id stand for themselves.

    Equal sales (to the cent) go to the first description in text order.
    """
    rows = _market_rows(market, as_of, weeks, departments, segments, scope_level)
    described = rows.groupBy("product_ref", "product_description").agg(F.round(F.sum("value_excl_tax"), 2).alias("value"))
    best = F.min_by("product_description", F.struct(-F.col("value"), F.col("product_description")))
    with_id = described.filter(F.col("product_ref").isNotNull()).groupBy("product_ref").agg(best.alias("description"))
    without = described.filter(F.col("product_ref").isNull()).select("product_ref", F.col("product_description").alias("description"))
    return with_id.unionByName(without.distinct())


def two_way_match(market: DataFrame, canonical: DataFrame) -> DataFrame:
    """Market rows under their canonical description: by product id, and by description for those known without an id.

    The id branch joins on the id alone, so the canonical description replaces the raw one. The description branch takes
    every row whose description is listed without an id, also when that row has one. Both are summed together.
    """
    by_id = market.drop("product_description").join(canonical.filter(F.col("product_ref").isNotNull()), "product_ref")
    nameless = canonical.filter(F.col("product_ref").isNull()).select(F.col("description").alias("product_description"))
    by_text = market.join(nameless, "product_description", "left_semi").withColumnRenamed("product_description", "description")
    measures = [c for c in market.columns if c.endswith(("_sales", "_units"))]
    keys = [*[c for c in market.columns if c not in measures and c != "product_description"], "description"]
    return by_id.unionByName(by_text).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def report_calendar(dim_date: DataFrame, *, as_of: dt.date, weeks: int = 104) -> DataFrame:
    """Days of the horizon with the rank of their week, latest week first.

    The rank is the position in the sorted list of week starts, so no window gathers all days in one partition.
    """
    days = dim_date.filter(F.col("financial_week_start_date").between(*_weeks_back(as_of, weeks)))
    latest_first = days.agg(F.sort_array(F.collect_set("financial_week_start_date"), asc=False)).scalar()
    return days.select(
        F.array_position(latest_first, F.col("financial_week_start_date")).cast("int").alias("latest_week_order"),
        "pel_week",
        "date",
        F.col("financial_week_end_date").alias("week_end_date"),
        "financial_year",
        "calendar_year",
        "financial_week_start_date",
    )


def own_vs_market(
    own: DataFrame,
    market: DataFrame,
    calendar: DataFrame,
    products: DataFrame,
    *,
    attributes: Sequence[str] = ("price_family_id",),
    levels: Sequence[str] = ("department", "segment"),
) -> DataFrame:
    """Own and market rows of the same article and week side by side, with calendar and product attributes.

    Market rows without a product id can match nothing; they are set aside, so that they do not gather in one partition of
    the join.
    """
    own_side = own.withColumnsRenamed({"week_start": "own_week", **{level: f"own_{level}" for level in levels}})
    market_side = market.withColumnsRenamed({"week_start": "market_week", **{level: f"market_{level}" for level in levels}})
    with_id = market_side.filter(F.col("product_ref").isNotNull())
    same = (F.col("article_id") == F.col("product_ref")) & (F.col("own_week") == F.col("market_week"))
    joined = own_side.join(with_id, same, "full")
    everything = joined.unionByName(market_side.filter(F.col("product_ref").isNull()), allowMissingColumns=True)
    described = products.select(F.col("article_id").alias("any_article"), *attributes).distinct()
    return (
        everything.withColumn("date", F.coalesce("market_week", "own_week"))
        .withColumn("any_article", F.coalesce("article_id", "product_ref"))
        .join(calendar, "date", "left")
        .join(described, "any_article", "left")
        .drop("date", "any_article")
    )


def own_hierarchy(
    profit: DataFrame, calendar: DataFrame, *, as_of: dt.date, sales_org: str, levels: Sequence[str], weeks: int = 104,
    excluded_prefix: str | None = None, measures: Sequence[str] = ("sales", "interim_gp"), excluded: str | None = None,
) -> DataFrame:
    """Own ledger rolled up to the upper-cased hierarchy and week; days outside the calendar have no week.

    Articles whose id starts with ``excluded_prefix`` (default: none) are left out, as are ``excluded`` rows.
    """
    rows = _ledger_rows(profit, as_of, weeks, sales_org, excluded)
    if excluded_prefix is not None:
        rows = rows.filter(~F.startswith("article_id", F.lit(excluded_prefix)))
    keys = [F.upper(level).alias(f"{level}_combined") for level in levels]
    days = calendar.select(F.col("date").alias("calendar_day"), "week_end_date", "pel_week", "latest_week_order")
    daily = rows.groupBy("calendar_day", *keys).agg(*_ledger_sums(measures))
    return (
        daily.join(days, "calendar_day", "left")
        .groupBy(*[f"{level}_combined" for level in levels], "week_end_date", "pel_week", "latest_week_order")
        .agg(*[F.sum(m).alias(m) for m in (*measures, "interim_gp_net")])
    )


def market_share_report(
    combined: DataFrame, hierarchy: DataFrame, *, levels: Sequence[str], markets: Sequence[str], as_of: dt.date,
    measures: Sequence[str] = ("sales", "interim_gp"),
) -> DataFrame:
    """Market figures of the combined relation against the own hierarchy, per week and hierarchy node.

    Both sides meet on week and hierarchy; nodes of one side only stay, and rows without a week match nothing. Columns that
    have no source any more are kept as blanks for the dashboards that still read them.
    """
    rolled = combined.groupBy(
        "pel_week",
        "week_end_date",
        *[F.upper(F.coalesce(f"market_{level}", f"own_{level}")).alias(f"{level}_combined") for level in levels],
        "latest_week_order",
    ).agg(*[F.sum(f"{m}_sales").alias(f"{m}_sales") for m in markets], F.sum("own_units").alias("own_units"))
    keys = ["week_end_date", *[f"{level}_combined" for level in levels]]
    own = hierarchy.withColumnsRenamed({"pel_week": "own_pel_week", "latest_week_order": "own_week_order"})
    report = rolled.join(own, keys, "full")
    return report.select(
        F.coalesce("pel_week", "own_pel_week").alias("pel_week"),
        *keys,
        F.coalesce("latest_week_order", "own_week_order").alias("latest_week_order"),
        *measures,
        "interim_gp_net",
        *[f"{m}_sales" for m in markets],
        "own_units",
        F.lit("").alias("category_manager"),
        F.lit("").alias("merchandise_manager"),
        F.lit(as_of).alias("refresh_date"),
    ).orderBy("pel_week", "week_end_date")
