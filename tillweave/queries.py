"""Every operator and report wired to the stand-in inputs: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.functions import dates, values
from tillweave.operators import (
    audiences,
    baskets,
    brand_rules,
    campaigns,
    invoicing,
    market,
    membership,
    partners,
    performance,
    pricing,
    redeemers,
    reshape,
    seasonal,
    sites,
)
from tillweave.operators.brand_rules import BrandRule, Clause
from tillweave.plans import campaign_reports, market_report, partner_strategy
from tillweave.plans import seasonal_report as seasonal_plan
from tillweave.session import tune
from tillweave.sources.staging import stage
from tillweave.sources.standin import AS_OF, SEASON_AS_OF, StandIn

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[StandIn], DataFrame]) -> Callable[[StandIn], DataFrame]:
    """Register a query under the function's name; doubles are rounded so that sums in any order compare equal."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return rounded(build(StandIn(tune(spark), directory)))

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles half up; eight digits first, so that the order of a sum does not decide a half."""
    return df.select(
        [
            F.round(F.round(f"`{f.name}`", 8), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


# ---- campaign core ----


def shared(s: StandIn, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A relation several branches of one query read: staged once."""
    if name not in s.built:
        s.built[name] = stage(build(), name)
    return s.built[name]


def plain_config(s: StandIn, **kwargs) -> DataFrame:
    options = {"campaign_code": "CAMP-1", "exclude_ids": ["1"], "prefix": "BOOST_"} | kwargs
    return campaigns.campaign_config(s.offers(), s.allocations(), **options)


def config_of(s: StandIn, weeks: int | None = None) -> DataFrame:
    return shared(s, f"config-{weeks}", lambda: plain_config(s, pre_weeks=weeks, post_weeks=weeks))


def calendar_of(s: StandIn, *, horizon: str = "campaign", weeks: int | None = None) -> DataFrame:
    name = f"calendar-{horizon}-{weeks}"
    return shared(s, name, lambda: campaigns.campaign_calendar(config_of(s, weeks), s.dim_date(), horizon=horizon))


def sales_of(s: StandIn) -> DataFrame:
    return campaigns.campaign_sales(s.lines(), config_of(s), s.brand_articles())


def campaign_rewards(s: StandIn) -> DataFrame:
    return s.rewards().join(config_of(s).select("offer_id"), "offer_id", "left_semi")


def plain_redemptions(s: StandIn) -> DataFrame:
    return campaign_rewards(s).withColumnRenamed("quantity", "redemptions")


def channel_redemptions(s: StandIn) -> DataFrame:
    return campaigns.offer_redemptions(campaign_rewards(s), s.brand_articles(), s.headers(), calendar_of(s))


def weekly_activity(s: StandIn) -> DataFrame:
    return redeemers.weekly_shopper_activity(s.lines(), s.dim_date(), config_of(s), s.brand_articles())


def segments_of(s: StandIn, activity: DataFrame) -> DataFrame:
    return redeemers.redeemer_segments(redeemers.brand_redeemers(plain_redemptions(s), s.brand_articles()), activity)


@query
def campaign_config(s: StandIn) -> DataFrame:
    return plain_config(s)


@query
def campaign_config_fixed_weeks(s: StandIn) -> DataFrame:
    return plain_config(s, pre_weeks=4, post_weeks=4, exclude_ids=[])


@query
def campaign_calendar(s: StandIn) -> DataFrame:
    return calendar_of(s, horizon="history")


@query
def campaign_sales(s: StandIn) -> DataFrame:
    return sales_of(s)


@query
def offer_redemptions(s: StandIn) -> DataFrame:
    return channel_redemptions(s)


@query
def redeemer_segments(s: StandIn) -> DataFrame:
    return segments_of(s, redeemers.shopper_activity(sales_of(s)))


@query
def redeemer_segments_by_week(s: StandIn) -> DataFrame:
    return segments_of(s, weekly_activity(s))


@query
def campaign_performance(s: StandIn) -> DataFrame:
    sales = shared(s, "sales", lambda: sales_of(s))
    redemptions = shared(s, "redemptions", lambda: plain_redemptions(s))
    redeemed = redeemers.brand_redeemers(redemptions, s.brand_articles())
    segments = redeemers.redeemer_segments(redeemed, redeemers.shopper_activity(sales))
    return performance.campaign_performance(redemptions, s.brand_articles(), sales, segments)


@query
def shopper_retention(s: StandIn) -> DataFrame:
    activity = shared(s, "activity", lambda: redeemers.shopper_activity(sales_of(s)))
    return redeemers.shopper_retention(activity, segments_of(s, activity))


@query
def non_boosters(s: StandIn) -> DataFrame:
    activity = weekly_activity(s)
    return redeemers.non_boosters(activity, s.activations())


@query
def total_activations(s: StandIn) -> DataFrame:
    return redeemers.total_activations(s.activations(), config_of(s))


@query
def campaign_uplift(s: StandIn) -> DataFrame:
    return performance.campaign_uplift(sales_of(s), config_of(s))


@query
def scan_tag_rates(s: StandIn) -> DataFrame:
    return performance.scan_tag_rates(s.lines(), calendar_of(s), s.brand_articles())


def boosted_of(s: StandIn) -> DataFrame:
    calendar = calendar_of(s, weeks=4)
    redemptions = campaigns.offer_redemptions(campaign_rewards(s), s.brand_articles(), s.headers(), calendar)
    return campaigns.boosted_sales_lines(s.lines(), calendar, s.brand_articles(), redemptions)


@query
def boosted_sales_lines(s: StandIn) -> DataFrame:
    return boosted_of(s)


@query
def weekly_uplift_by_brand(s: StandIn) -> DataFrame:
    return performance.weekly_uplift(boosted_of(s), ["offer_id", "brand"])


@query
def weekly_uplift_by_article(s: StandIn) -> DataFrame:
    return performance.weekly_uplift(boosted_of(s), ["offer_id", "brand", "article_id", "article_description"])


CATEGORIES = ["automobile", "building", "furniture", "household", "no_segment"]


@query
def segment_profile_wide(s: StandIn) -> DataFrame:
    segments = segments_of(s, redeemers.shopper_activity(sales_of(s)))
    return redeemers.segment_profile_wide(segments, config_of(s), s.feature_history(), categories=CATEGORIES)


@query
def segment_profile_share(s: StandIn) -> DataFrame:
    redeemed = shared(s, "redeemers", lambda: redeemers.brand_redeemers(plain_redemptions(s), s.brand_articles()))
    segments = redeemers.redeemer_segments(redeemed, weekly_activity(s))
    return redeemers.segment_profile_share(segments, s.customers(), redeemed)


@query
def brand_week_article_channel(s: StandIn) -> DataFrame:
    redemptions = shared(s, "channel-redemptions", lambda: channel_redemptions(s))
    return performance.brand_week_article_channel(redemptions, s.lines())


@query
def basket_kpis(s: StandIn) -> DataFrame:
    return baskets.basket_kpis(s.headers(), calendar_of(s, horizon="history"), s.rewards(), s.brand_articles())


@query
def week_article_channel_facts(s: StandIn) -> DataFrame:
    calendar = calendar_of(s, weeks=4)
    return baskets.week_article_channel_facts(s.headers(), s.lines(), calendar, s.brand_articles(), campaign_rewards(s))


@query
def campaign_master_report(s: StandIn) -> DataFrame:
    return campaign_reports.campaign_master_report(
        config_of(s), s.lines(), s.brand_articles(), s.rewards(), s.activations(), s.feature_history(), categories=CATEGORIES
    )


@query
def brand_metrics(s: StandIn) -> DataFrame:
    return campaign_reports.brand_metrics(
        config_of(s), s.lines(), s.headers(), s.dim_date(), s.brand_articles(), s.rewards(), s.activations()
    )


# ---- brand rules, invoicing ----

RULES = [
    BrandRule("Ringworks", [Clause(name_has=["ring"], name_lacks=["old"])]),
    BrandRule("Widget & Co", [Clause(name_has=["widget", "gizmo"]), Clause(brand_is=["Brand#7"], name_lacks=["widget"])], deny_ids=["7", "70"]),
    BrandRule("Twelve", [Clause(brand_has=["#12"], brand_lacks=["#125"])], allow_ids=["3", "30", "300"], disputed_ids=["30"]),
    BrandRule("Hot Line", [Clause(name_has=["hot "], brand_lacks=["#1"])]),
]


@query
def brand_rule_classifier(s: StandIn) -> DataFrame:
    return brand_rules.brand_rule_classifier(s.articles(), RULES, s.lines())


@query
def duplicate_brand_check(s: StandIn) -> DataFrame:
    return brand_rules.duplicate_brand_check(brand_rules.brand_rule_classifier(s.articles(), RULES, s.lines()))


def vendor_arrays_of(s: StandIn) -> DataFrame:
    return invoicing.offer_vendor_arrays(redeemed_of(s), s.article_vendors())


def redeemed_of(s: StandIn) -> DataFrame:
    return shared(s, "redeemed-articles", lambda: invoicing.redeemed_offer_articles(s.rewards(), s.offers()))


@query
def offer_vendor_arrays(s: StandIn) -> DataFrame:
    lists = vendor_arrays_of(s)
    return lists.select("offer_id", "vendor_count", *[F.to_json(c).alias(c) for c in ("articles", "vendor_ids", "vendor_descriptions")])


@query
def offer_vendor_arrays_by_name(s: StandIn) -> DataFrame:
    """The lists of the offers whose name fits a pattern."""
    redeemed = invoicing.redeemed_offer_articles(s.rewards(), invoicing.offers_like(s.offers(), "offer_name", "SKU|%A|x"))
    lists = invoicing.offer_vendor_arrays(redeemed, s.article_vendors())
    return lists.select("offer_id", "vendor_count", *[F.to_json(c).alias(c) for c in ("articles", "vendor_ids", "vendor_descriptions")])


@query
def invoice_feed(s: StandIn) -> DataFrame:
    own_brand = invoicing.offer_own_brand(redeemed_of(s), s.article_vendors())
    return invoicing.invoice_feed(s.kpis(), vendor_arrays_of(s), own_brand, as_of=AS_OF, excluded_name="pinned")


# ---- loyalty, audiences ----


def fuel_of(s: StandIn) -> DataFrame:
    return s.partner_transactions().filter(F.col("source") == "fuel")


def non_fuel_of(s: StandIn) -> DataFrame:
    rows = s.partner_transactions().filter(F.col("source") == "shop")
    return rows.withColumn("reference", F.concat_ws("-", "partner_id", "txn_date"))


def points_of(s: StandIn) -> DataFrame:
    fuel = fuel_of(s).withColumn("transaction_id", F.col("receipt_id"))
    other = non_fuel_of(s).withColumn("transaction_id", F.col("reference"))
    return partners.partner_points(fuel, other)


@query
def partner_points_summary(s: StandIn) -> DataFrame:
    return partners.partner_points_summary(points_of(s), partner_id="2")


@query
def partner_points_by_partner(s: StandIn) -> DataFrame:
    return points_of(s)


@query
def partner_breadth(s: StandIn) -> DataFrame:
    return partners.partner_breadth(points_of(s), s.partners(), partner_name="NATION_2")


@query
def engagement_recency(s: StandIn) -> DataFrame:
    return partners.engagement_recency(fuel_of(s), as_of=AS_OF, partner_id="2")


@query
def nearest_site(s: StandIn) -> DataFrame:
    stores = s.sites().filter(F.col("site_type") == "STORE").select(F.col("site_id").alias("store_id"), "lat", "lon")
    return sites.nearest_site(stores, s.sites(), site_filter=F.col("site_type") == "FUEL")


@query
def customer_nearest_site(s: StandIn) -> DataFrame:
    stores = s.sites().filter(F.col("site_type") == "STORE").select(F.col("site_id").alias("store_id"), "lat", "lon")
    nearest = sites.nearest_site(stores, s.sites(), site_filter=F.col("site_type") == "FUEL")
    return sites.customer_nearest_site(s.customers(), nearest, default_store_id="28")


@query
def dedup_reference_sales(s: StandIn) -> DataFrame:
    return partners.dedup_reference_sales(non_fuel_of(s))


@query
def contactable_customers(s: StandIn) -> DataFrame:
    return audiences.contactable_customers(s.customers(), s.preferences(), prefs_required=["allow_all", "allow_partner"])


@query
def first_event_cohort(s: StandIn) -> DataFrame:
    return partners.first_event_cohort(fuel_of(s), start=dt.date(2000, 2, 1), end=dt.date(2000, 6, 17), partner_id="2")


@query
def unsubscribed_customers(s: StandIn) -> DataFrame:
    return audiences.unsubscribed_customers(s.email_sends(), s.communications(), s.email_clicks())


@query
def segmentation_strategy(s: StandIn) -> DataFrame:
    return partner_strategy.partner_strategy(
        fuel_of(s), non_fuel_of(s), s.partners(), s.customers(), s.preferences(), s.risk_cohort(),
        s.email_sends(), s.communications(), s.email_clicks(),
        as_of=AS_OF, partner_id="2", partner_name="NATION_2", prefs_required=["allow_all", "allow_partner"], thresholds=STRATEGY, labels=STRATEGY_LABELS,
    )


# the stand-in customers deal with up to seven partners and spend more than grocery customers do
STRATEGY = audiences.Thresholds(
    high_sales=30000, mid_sales=9000, many_partners=7, engaged_visits=0.2, engaged_recent_days=400, engaged_min_transactions=3,
    frequent_visits=0.3, frequent_sales=8000, infrequent_visits=0.1, infrequent_sales=2000, mid_transactions=0.4,
)


STRATEGY_LABELS = {
    "lapsed_protect": ("Lapsed partner customer - loyal", "Re-engage"),
    "lapsed_grow": ("Lapsed partner customer - cross-shopper", "Re-engage"),
    "stranger_protect": ("Non partner customer - loyal", "Win"),
    "stranger_grow": ("Non partner customer - cross-shopper", "Win"),
    "stranger_high": ("Non partner customer - high volume", "Win"),
    "engaged": ("Already engaged", "Protect"),
    "risk_partner": ("Infrequent partner customer - at risk", "Grow"),
    "risk_stranger": ("Non partner customer - at risk", "Re-engage"),
    "partner_mid": ("Infrequent partner customer - mid volume", "Grow"),
    "stranger_mid": ("Non partner customer - mid volume", "Win"),
    "partner_low": ("Infrequent partner customer - low engagement", "Grow"),
    "stranger_low": ("Non partner customer - low engagement", "Win"),
}


@query
def lifecycle_audience(s: StandIn) -> DataFrame:
    return audiences.lifecycle_audience(
        s.customers(), s.preferences(), fuel_of(s), s.seeds(),
        as_of=AS_OF, partner_id="2", seed_partner_id="1", prefs_required=["allow_all", "allow_partner"],
        campaign_id="CAMPAIGN_A", execution_id="EXECUTION_A", zone="Pacific/Auckland", seed_source="Partner Seed List",
    )


# ---- seasonal ----


def plan_weeks_of(s: StandIn) -> DataFrame:
    return seasonal.explode_week_ranges(s.plan())


def scaffold_of(s: StandIn) -> DataFrame:
    return seasonal.days_to_event(plan_weeks_of(s), s.profit(), s.dim_date(), as_of=SEASON_AS_OF, sales_org="ORG2")


@query
def explode_week_ranges(s: StandIn) -> DataFrame:
    return plan_weeks_of(s)


@query
def days_to_event(s: StandIn) -> DataFrame:
    return scaffold_of(s).drop("is_this_year", "is_last_year")


@query
def ty_ly_aligned(s: StandIn) -> DataFrame:
    scaffold = shared(s, "season-scaffold", lambda: scaffold_of(s))
    return seasonal.ty_ly_aligned(scaffold, plan_weeks_of(s), as_of=SEASON_AS_OF)


@query
def first_vendor_per_article(s: StandIn) -> DataFrame:
    return seasonal.first_vendor_per_article(s.article_sites(), sales_org="ORG2")


@query
def latest_vendor_per_article(s: StandIn) -> DataFrame:
    return seasonal.latest_vendor_per_article(s.article_sites(), sales_org="ORG2")


@query
def latest_vendor_of_season(s: StandIn) -> DataFrame:
    """Latest vendors of the articles planned for the last nine weeks of a year."""
    planned = seasonal.planned_articles(s.plan(), first_week=44, last_week=52)
    return seasonal.latest_vendor_per_article(s.article_sites(), sales_org="ORG2", planned=planned)


@query
def seasonal_report(s: StandIn) -> DataFrame:
    return seasonal_plan.seasonal_report(
        s.plan(), s.profit(), s.dim_date(), s.articles(), s.article_sites(), as_of=SEASON_AS_OF, sales_org="ORG2"
    )


# ---- market share ----

SCOPE = {"departments": ["economy", "standard", "promo", "large"], "segments": ["brand#3", "brand#11"]}
MARKETS = {"Total": "total", "Competitor": "competitor", "Own": "own", "Franchise": "franchise"}
LEVELS = ["department", "segment"]


@query
def weekly_own_profit(s: StandIn) -> DataFrame:
    return market.weekly_own_profit(s.profit(), as_of=AS_OF, sales_org="ORG2", **SCOPE)


@query
def market_by_segment(s: StandIn) -> DataFrame:
    return market.market_by_segment(s.market(), as_of=AS_OF, markets=MARKETS, **SCOPE)


@query
def canonical_description(s: StandIn) -> DataFrame:
    return market.canonical_description(s.market(), as_of=AS_OF, **SCOPE)


@query
def two_way_match(s: StandIn) -> DataFrame:
    return market_report.matched_market(s.market(), as_of=AS_OF, markets=MARKETS, **SCOPE)


@query
def own_vs_market(s: StandIn) -> DataFrame:
    return market_report.own_against_market(
        s.profit(), s.market(), s.dim_date(), s.articles(), as_of=AS_OF, sales_org="ORG2", markets=MARKETS, **SCOPE
    )


@query
def market_share_report(s: StandIn) -> DataFrame:
    return market_report.market_share(
        s.profit(), s.market(), s.dim_date(), s.articles(), as_of=AS_OF, sales_org="ORG2", markets=MARKETS, levels=LEVELS, **SCOPE
    )


# the whole hierarchy, all measures of the ledger, and a category that does not count
WIDE_SCOPE = {"departments": ["economy", "standard"], "segments": ["ring", "anvil"], "scope_level": "sub_category"}
WIDE = {"sales_org": "ORG2", "levels": market.LEVELS, "excluded": "category = 'Range 4'", **WIDE_SCOPE}


@query
def weekly_own_profit_wide(s: StandIn) -> DataFrame:
    return market.weekly_own_profit(s.profit(), as_of=AS_OF, measures=[*market.LEDGER, "quantity"], **WIDE)


@query
def own_vs_market_wide(s: StandIn) -> DataFrame:
    return market_report.own_against_market(
        s.profit(), s.market(), s.dim_date(), s.articles(), as_of=AS_OF, markets=MARKETS, measures=market.LEDGER,
        attributes=["price_family_id", "price_family_name", "category_manager"], **WIDE,
    )


@query
def market_share_report_wide(s: StandIn) -> DataFrame:
    return market_report.market_share(
        s.profit(), s.market(), s.dim_date(), s.articles(), as_of=AS_OF, markets=MARKETS, excluded_prefix="Z",
        measures=["sales", "interim_gp", "trading_gp", "stock_loss"], **WIDE,
    )


# ---- pricing ----

NOT_PRICED = ["Brand#5", "Brand#21"]


def price_list_of(s: StandIn) -> DataFrame:
    return pricing.current_price_list(
        s.prices(), s.stores(), orgs=["ORG1", "ORG3"], banner_contains=["GreenCart"], banner_prefixes=["ValueBarn"],
        attributes=["price_list", "life_cycle_status", "life_cycle_date"],
    )


def shelf_of(s: StandIn) -> DataFrame:
    return pricing.modal_shelf_price(
        s.store_articles(), s.stores(), s.article_uoms(), as_of=AS_OF, excluded_categories=NOT_PRICED, active="is_store_active"
    )


def standard_shelf_of(s: StandIn) -> DataFrame:
    return pricing.modal_shelf_price(
        s.store_articles(), s.stores(), s.article_uoms(), as_of=AS_OF, excluded_categories=NOT_PRICED, flags=[], districts=["UPPER"],
        active="is_store_active", price=F.coalesce("standard_price", "retail_price"),
    )


def recommended_of(s: StandIn) -> DataFrame:
    return pricing.recommended_price(
        s.prices(), s.stores(), s.articles(), s.article_uoms(),
        sales_org="ORG2", districts=["UPPER", "LOWER"], excluded_categories=NOT_PRICED, excluded_stores=["27"],
        closed_mark="Closed", current="is_current",
    )


def wholesale_of(s: StandIn) -> DataFrame:
    return pricing.latest_wholesale_cost(s.purchases(), s.dim_date(), s.article_uoms(), attributes=["sourcing_dc", "sourcing_dc_name"])


def pos_of(s: StandIn, lines: DataFrame | None = None) -> DataFrame:
    return pricing.latest_pos_price(lines or s.pos_lines(), s.article_uoms(), as_of=AS_OF, excluded_categories=NOT_PRICED, time="receipt_time")


def trailing_of(s: StandIn, lines: DataFrame | None = None) -> DataFrame:
    return pricing.trailing_sales(lines or s.pos_lines(), s.article_uoms(), as_of=AS_OF)


@query
def current_price_list(s: StandIn) -> DataFrame:
    return price_list_of(s)


@query
def modal_shelf_price(s: StandIn) -> DataFrame:
    return shelf_of(s)


@query
def modal_standard_price(s: StandIn) -> DataFrame:
    return standard_shelf_of(s)


@query
def recommended_price(s: StandIn) -> DataFrame:
    return recommended_of(s)


@query
def latest_wholesale_cost(s: StandIn) -> DataFrame:
    return wholesale_of(s)


@query
def latest_pos_price(s: StandIn) -> DataFrame:
    return pos_of(s)


@query
def trailing_sales_13w(s: StandIn) -> DataFrame:
    return trailing_of(s)


@query
def price_comparison_report(s: StandIn) -> DataFrame:
    # the till lines of the weeks that the latest prices and the trailing sales read
    first, last = dates.add_weeks(dates.sunday_week_start(F.lit(AS_OF)), -12), dates.reporting_week_end(F.lit(AS_OF))
    recent = shared(s, "recent-till-lines", lambda: s.pos_lines().where(F.col("financial_week_end_date").between(first, last)))
    return pricing.price_comparison_report(
        price_list_of(s), pos_of(s, recent), shelf_of(s), recommended_of(s), wholesale_of(s), trailing_of(s, recent), s.articles(), s.stores(),
        s.price_families(), s.price_promises(), excluded_categories=NOT_PRICED, excluded_sub_categories=["old rod", "cold rod"],
        article_attributes=[
            "article_name", "price_family_id", "price_family_name", "department", "category", "sub_category", "segment", "category_manager",
            "vendor_description", "own_brand",
        ],
        store_attributes=["store_name", "store_brand"],
    )


@query
def price_source_reconcile(s: StandIn) -> DataFrame:
    return pricing.price_source_reconcile(standard_shelf_of(s), recommended_of(s))


# ---- reshape, operations ----


@query
def dynamic_week_pivot(s: StandIn) -> DataFrame:
    return reshape.dynamic_week_pivot(s.store_articles(), s.dim_date(), as_of=AS_OF, category="Brand#3")


@query
def job_audit(s: StandIn) -> DataFrame:
    jobs = reshape.job_audit(s.jobs(), table_name="table_3", zone="Pacific/Auckland")
    return jobs.select("start_date", "user_email", "statement_type", "total_slot_ms", "destination_table.table_id")


# ---- primitives that no report exercises on these tables ----


@query
def week_functions(s: StandIn) -> DataFrame:
    day, as_of = F.col("receipt_date"), F.lit(AS_OF)
    return s.lines().select("receipt_id", "receipt_date").distinct().select(
        "receipt_id",
        "receipt_date",
        dates.sunday_weeks_between(as_of, day).alias("sunday_weeks"),
        dates.sunday_week_start(day).alias("sunday_start"),
        dates.monday_week_start(day).alias("monday_start"),
        dates.reporting_week_end(day).alias("report_week_end"),
        dates.is_monday(day).alias("monday"),
        dates.add_weeks(day, -12).alias("twelve_weeks_before"),
        F.add_months(day, -2).alias("two_months_before"),
        F.datediff(as_of, day).alias("days_ago"),
        dates.per_month(F.lit(100), day, as_of).alias("hundred_per_month"),
    )


@query
def text_functions(s: StandIn) -> DataFrame:
    name, code = F.col("article_name"), F.col("article_id")
    piped = F.concat_ws("|", "article_id", "article_name", "online_brand")
    return s.articles().select(
        "article_id",
        F.upper(name).alias("upper_name"),
        F.lower("online_brand").alias("lower_brand"),
        F.concat(code, F.lit(","), name).alias("joined"),
        F.replace("online_brand", F.lit("Brand#"), F.lit("")).alias("brand_number"),
        F.substring("article_name", 2, 3).alias("middle"),
        F.left(name, F.lit(3)).alias("start"),
        F.length("article_name").alias("name_length"),
        values.two_digits(F.col("article_size")).alias("padded_size"),
        values.split_field(piped, "|", 2).alias("third_field"),
        values.contains_any(name, ["ring", "rod"]).alias("ring_or_rod"),
        F.format_string("'%s'", code).alias("quoted"),
    )


@query
def null_and_ratio_functions(s: StandIn) -> DataFrame:
    share = values.ratio(F.sum(F.when(values.is_present(F.col("scv_id")), F.col("quantity"))), F.sum("quantity"))
    online = F.sum(F.when(F.col("is_online_order"), F.col("quantity")).otherwise(0.0))
    return s.lines().groupBy(values.blank_to_null(F.col("scv_id")).alias("scv_id")).agg(
        share.alias("known_share"),
        values.ratio(F.sum("quantity"), online).alias("per_online_unit"),
        values.relative_change(online, F.sum("quantity")).alias("change"),
        F.count_if(values.is_false(F.col("is_online_order"))).alias("store_lines"),
        values.any_true(F.col("is_online_order_completed")).alias("any_completed"),
        F.countDistinct("receipt_id").alias("receipts"),
    )


@query
def ordered_text_list(s: StandIn) -> DataFrame:
    pairs = s.articles().select("department", "category").distinct()
    return pairs.groupBy("department").agg(F.expr("listagg(category, ',') WITHIN GROUP (ORDER BY category DESC)").alias("categories"))


@query
def not_in_subquery(s: StandIn) -> DataFrame:
    # customers who never shopped online; the list is cleaned of its NULLs, as a NULL would empty the result
    online = s.lines().filter(F.col("is_online_order") & F.col("scv_id").isNotNull())
    return membership.not_in_subquery(s.customers().select("scv_id", "strategy_segment"), "scv_id", online, "scv_id")


@query
def in_subquery(s: StandIn) -> DataFrame:
    return membership.in_subquery(s.customers().select("scv_id", "strategy_segment"), "scv_id", s.rewards(), "scv_id")
