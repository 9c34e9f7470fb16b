"""Queries of the operators that any report can use: summaries, versions, intervals, as-of joins, totals, ordered windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.clock import RunClock
from tillweave.operators import asof, intervals, ordered, pricing, refreshes, reshape, rollups, similar, summaries
from tillweave.plans import partner_strategy
from tillweave.queries import NOT_PRICED, STRATEGY, STRATEGY_LABELS, config_of, fuel_of, non_fuel_of, query
from tillweave.sources.staging import new_path, stage
from tillweave.sources.standin import AS_OF, StandIn
from tillweave.sources.versions import VersionedTable

#: The instant of the fixed run: still the day before AS_OF in UTC, already AS_OF in the zone.
RUN = RunClock(dt.datetime(2001, 8, 1, 15, 30, tzinfo=dt.timezone.utc), "Asia/Tokyo")


@query
def approx_modal_price(s: StandIn) -> DataFrame:
    weekly = stage(pricing.weekly_price_summaries(s.store_articles(), s.stores(), excluded_categories=NOT_PRICED, active="is_store_active"), "price-summaries")
    return pricing.approx_modal_price(weekly, as_of=AS_OF, weeks=104)


def weekly_sales_of(s: StandIn) -> DataFrame:
    days = s.dim_date().select(F.col("date").alias("receipt_date"), "financial_week_start_date")
    sold = s.lines().groupBy("store_id", "receipt_date", "l_returnflag").agg(F.sum("gst_included_amount").alias("sales"), F.sum("quantity").alias("quantity"))
    return sold.join(days, "receipt_date")


@query
def replaced_weekly_sales(s: StandIn) -> DataFrame:
    """Weekly sales per store, written once, replaced in whole, and replaced again for the last year, without returns there."""
    sold = stage(weekly_sales_of(s).withColumn("year", F.year("financial_week_start_date")), "weekly-sales")
    keys, sums = ["year", "financial_week_start_date", "store_id"], [F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity")]
    table = VersionedTable(s.spark, new_path(s.spark, "weekly-sales-table"), by=["year"])
    table.replace(sold.groupBy(*keys).agg(*sums).where("sales > 100000"))
    table.replace(sold.groupBy(*keys).agg(*sums))
    table.replace_partitions(sold.where("l_returnflag <> 'R' and year = 2001").groupBy(*keys).agg(*sums))
    return table.read()


@query
def merged_price_table(s: StandIn) -> DataFrame:
    """The price list of the end of 2000, brought up to date by key; prices that have run out are taken off."""
    columns = ["sales_org", "site", "article_id", "rrp", "valid_from", "valid_to"]
    keys = ["sales_org", "site", "article_id"]
    latest = F.max(F.struct("valid_to", "valid_from", "sell_price"))
    priced = s.prices().where(F.col("purchase_cost").isNotNull())

    def listed(rows: DataFrame) -> DataFrame:
        top = rows.groupBy(*keys).agg(latest.alias("top"))
        return top.select(*keys, F.col("top.sell_price").alias("rrp"), "top.valid_from", "top.valid_to").select(*columns)

    table = VersionedTable(s.spark, new_path(s.spark, "price-table"), by=["sales_org"])
    table.replace(listed(priced.where(F.col("valid_from") < dt.date(2001, 1, 1))))
    changes = listed(priced.where(F.col("valid_from") >= dt.date(2001, 1, 1))).withColumn("gone", F.col("valid_to") < AS_OF)
    changes = stage(changes, "price-changes")
    table.merge(changes, keys, deleted="gone")
    table.merge(changes, keys, deleted="gone")  # again, as a job that is run twice does
    return table.read()


@query
def receipts_in_windows(s: StandIn) -> DataFrame:
    """Receipts, customers' known share and sales of all receipts that fall into an offer's span, by offer."""
    spans = config_of(s).select("offer_id", "long_start_date", "post_end_date")
    receipts = s.headers().select("receipt_id", "scv_id", "receipt_date", "gst_included_amount")
    met = intervals.interval_join(receipts, spans, left_span=("receipt_date", "receipt_date"), right_span=("long_start_date", "post_end_date"))
    return met.groupBy("offer_id").agg(
        F.count(F.lit(1)).alias("receipts"), F.count("scv_id").alias("receipts_with_id"), F.sum("gst_included_amount").alias("sales")
    )


@query
def offer_days(s: StandIn) -> DataFrame:
    """Days of every offer's windows; an offer without any stays, with no day."""
    spans = config_of(s).select("offer_id", "pre_start_date", "post_end_date")
    late = spans.select(F.concat("offer_id", F.lit("-later")).alias("offer_id"), *[F.add_months(c, 1200).alias(c) for c in ("pre_start_date", "post_end_date")])
    days = s.dim_date().select("date", "pel_week")
    return intervals.interval_join(
        spans.unionByName(late), days, left_span=("pre_start_date", "post_end_date"), right_span=("date", "date"), how="left"
    )


@query
def events_after_signup(s: StandIn) -> DataFrame:
    """Events of a user within 36 hours after each of the user's sign-ups."""
    events = s.tables["events"]
    signups = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").cast("timestamp").alias("begin"))
    signups = signups.withColumn("finish", F.timestamp_add("HOUR", F.lit(36), F.col("begin")))
    others = events.where("event_type <> 'signup'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), "value")
    met = intervals.interval_join(others, signups, left_span=("at", "at"), right_span=("begin", "finish"), on=["user_id"])
    return met.select("signup_id", "event_id", "user_id", "value")


@query
def segmentation_strategy_run(s: StandIn) -> DataFrame:
    """The strategy of one run: its date and its stamp come from one instant."""
    return partner_strategy.partner_strategy(
        fuel_of(s), non_fuel_of(s), s.partners(), s.customers(), s.preferences(), s.risk_cohort(), s.email_sends(), s.communications(), s.email_clicks(),
        partner_id="2", partner_name="NATION_2", prefs_required=["allow_all", "allow_partner"], thresholds=STRATEGY, labels=STRATEGY_LABELS, **RUN.arguments(),
    )


@query
def price_at_till(s: StandIn) -> DataFrame:
    """The price that was last valid from, for each till line, where the store had one by then."""
    lines = s.pos_lines().select("article_id", "store_id", "receipt_id", "unit_of_measure", "receipt_date", "quantity")
    prices = s.prices().select("article_id", F.col("site").alias("store_id"), "valid_from", "valid_to", "sell_price")
    return asof.asof_join(
        lines, prices, on=["article_id", "store_id"], left_time="receipt_date", right_time="valid_from", values=["valid_to", "sell_price"], ties=["valid_to"]
    )


@query
def market_rollup(s: StandIn) -> DataFrame:
    """Market sales at four levels and in total, per market: one pass over the market rows."""
    rows = s.market().select("market", "department", "category", "sub_category", "segment", "value_excl_tax", "units", "week_start")
    measures = {
        "sales": ("sum", "value_excl_tax"), "units": ("sum", "units"), "lines": ("count", "value_excl_tax"),
        "first_week": ("min", "week_start"), "last_week": ("max", "week_start"),
    }
    return rollups.rollup(rows, ["department", "category", "sub_category", "segment"], measures, within=["market"])


@query
def visitor_summaries(s: StandIn) -> DataFrame:
    """Customers and basket values per channel over 52 weeks, from weekly states, held against the exact figures: whether the
    distinct count is within four standard errors and the median's rank within the stated error."""
    weeks = s.dim_date().select(F.col("date").alias("receipt_date"), "financial_week_end_date")
    last = dt.date(2001, 7, 29)
    rows = s.headers().join(weeks, "receipt_date").where(F.col("financial_week_end_date").between(last - dt.timedelta(weeks=51), last))
    rows = stage(rows.where("scv_id <> ''"), "visitor-rows")
    weekly = summaries.period_states(rows, ["is_online_order", "financial_week_end_date"], distinct="scv_id", value="gst_included_amount")
    yearly = summaries.merged_states(stage(weekly, "visitor-states"), ["is_online_order"])
    found = stage(summaries.estimates(yearly, ["is_online_order"]), "visitor-estimates")
    exact = rows.groupBy("is_online_order", "scv_id").agg(F.count(F.lit(1)).alias("n")).groupBy("is_online_order").agg(F.count(F.lit(1)).alias("customers"))
    below = rows.join(found.select("is_online_order", "q50"), "is_online_order").groupBy("is_online_order").agg(
        F.count_if(F.col("gst_included_amount") < F.col("q50")).alias("below"), F.count_if(F.col("gst_included_amount") <= F.col("q50")).alias("up_to")
    )
    slack = F.col("rows") * F.lit(summaries.rank_error()) + 1
    return found.join(exact, "is_online_order").join(below, "is_online_order").select(
        "is_online_order",
        "rows",
        "customers",
        (F.abs(F.col("distinct_estimate") - F.col("customers")) <= 4 * summaries.distinct_error() * F.col("customers") + 1).alias("customers_close"),
        ((F.col("below") <= F.col("rows") / 2 + slack) & (F.col("up_to") >= F.col("rows") / 2 - slack)).alias("median_close"),
    )


@query
def receipt_trail(s: StandIn) -> DataFrame:
    """All receipts in one order: number, sales so far, the receipts before and after, the mean of the last 50."""
    receipts = s.headers().select("receipt_id", "receipt_date", F.round("gst_included_amount", 2).alias("amount"))
    order = ["receipt_date", "receipt_id"]
    trail = ordered.numbered(receipts, order, running={"amount_so_far": "amount"})
    return ordered.windowed(
        trail,
        order,
        lambda w: {
            "amount_before": F.lag("amount").over(w),
            "amount_after": F.lead("amount").over(w),
            "days_since_tenth": F.datediff(F.col("receipt_date"), F.lag("receipt_date", 10).over(w)),
            "mean_of_50": F.avg("amount").over(w.rowsBetween(-49, 0)),
        },
        before=49,
        after=1,
    )


def list_until(s: StandIn, day: dt.date) -> DataFrame:
    return pricing.current_price_list(
        s.prices().where(F.col("valid_from") <= day), s.stores(), orgs=["ORG1", "ORG3"], banner_contains=["GreenCart"], banner_prefixes=["ValueBarn"]
    ).select("site", "unit_of_measure", "rrp", "valid_to")


@query
def price_list_changes(s: StandIn) -> DataFrame:
    """Prices per site that the list of one day has and that of a month before has not, and the other way round, with repeats."""
    return refreshes.refresh_changes(list_until(s, AS_OF - dt.timedelta(days=30)), list_until(s, AS_OF))


@query
def week_pivot_rows(s: StandIn) -> DataFrame:
    """The week pivot turned back into rows."""
    return reshape.unpivot_weeks(reshape.dynamic_week_pivot(s.store_articles(), s.dim_date(), as_of=AS_OF, category="Brand#3"), keys=["article_id"])


@query
def similar_descriptions(s: StandIn) -> DataFrame:
    """Descriptions of market products without an id that are, up to two characters, those of a product with one."""
    rows = s.market().select("product_ref", "product_description").distinct()
    return similar.similar_pairs(
        rows.where("product_ref is null").select("product_description"), rows.where("product_ref is not null").select("product_description")
    )
