"""Campaign windows, the campaign calendar and the facts that fall into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import add_weeks, sunday_weeks_between
from tillweave.functions.values import any_true, blank_to_null, is_present, is_true
from tillweave.sources.staging import stage

# fixed values: names of the campaign windows
PRE, DURING, POST = "Pre Campaign", "Campaign Period", "Post Campaign"


def campaign_config(
    offers: DataFrame,
    allocations: DataFrame,
    *,
    campaign_code: str,
    statuses: Sequence[str] = ("active", "expired"),
    exclude_ids: Sequence[str] = (),
    prefix: str = "CAMPAIGN_",
    name_excludes: str = "test",
    pre_weeks: int | None = None,
    post_weeks: int | None = None,
    recent_weeks: int = 26,
    long_weeks: int = 52,
) -> DataFrame:
    """One row per campaign offer with its label and all date windows.

    The label number is the dense rank of the offer's start date among *all* offers of the campaign code, taken before
    ``exclude_ids`` are dropped, so labels keep their gaps. The rank is looked up in the sorted list of start dates (a list
    no longer than the calendar), not computed by a window over one partition. Campaign start and end come from the active
    allocations; the duration counts Sundays. ``pre_weeks`` / ``post_weeks`` default to the duration.
    """
    chosen = offers.filter(
        is_true(F.col("is_current"))
        & (F.col("campaign_code") == campaign_code)
        & F.lower("offer_status_description").isin([s.lower() for s in statuses])
        & ~F.contains(F.lower("offer_name"), F.lit(name_excludes))
    )
    start_dates = chosen.agg(F.array_sort(F.collect_set("offer_start_date"))).scalar()
    rank = F.array_position(start_dates, F.col("offer_start_date")).cast("string")
    labelled = chosen.select("offer_id", "offer_name", F.concat(F.lit(prefix), rank).alias("campaign_name")).distinct()
    if exclude_ids:
        labelled = labelled.filter(~F.col("offer_id").isin(list(exclude_ids)))

    dated = (
        allocations.filter(F.upper("allocation_status") == "ACTIVE")
        .groupBy("offer_id")
        .agg(
            F.min(F.to_date("allocation_start")).alias("campaign_start_date"),
            F.max(F.to_date("allocation_end")).alias("campaign_end_date"),
        )
    )
    start, end = F.col("campaign_start_date"), F.col("campaign_end_date")
    weeks = sunday_weeks_between(end, start)
    before = weeks if pre_weeks is None else F.lit(pre_weeks)
    after = weeks if post_weeks is None else F.lit(post_weeks)
    return labelled.join(dated, "offer_id").select(
        "offer_id",
        "offer_name",
        "campaign_name",
        "campaign_start_date",
        "campaign_end_date",
        weeks.alias("campaign_duration_weeks"),
        add_weeks(start, -before).alias("pre_start_date"),
        F.date_sub(start, 1).alias("pre_end_date"),
        F.date_add(end, 1).alias("post_start_date"),
        add_weeks(end, after).alias("post_end_date"),
        add_weeks(start, -recent_weeks).alias("recent_start_date"),
        add_weeks(start, -long_weeks).alias("long_start_date"),
    )


def period_of(day: Column) -> Column:
    """Name of the campaign window a date lies in; NULL between the history start and the pre window."""
    return (
        F.when(day.between(F.col("pre_start_date"), F.col("pre_end_date")), PRE)
        .when(day.between(F.col("campaign_start_date"), F.col("campaign_end_date")), DURING)
        .when(day.between(F.col("post_start_date"), F.col("post_end_date")), POST)
    )


def campaign_calendar(config: DataFrame, dim_date: DataFrame, *, horizon: str = "campaign") -> DataFrame:
    """One row per (offer, date) with the calendar's columns and the campaign window the date lies in.

    ``horizon="campaign"`` spans pre to post window; ``"history"`` starts at the long history window. Campaigns may overlap,
    so a date can belong to several offers. Each offer's span is unfolded to its days and joined on the date, which keeps
    the range condition an equi-join.
    """
    first = {"campaign": "pre_start_date", "history": "long_start_date"}[horizon]
    days = config.withColumn("date", F.explode(F.sequence(F.col(first), F.col("post_end_date"))))
    return days.join(dim_date, "date").select(
        "offer_id",
        "offer_name",
        "campaign_name",
        *[dim_date[c] if c != "date" else F.col("date") for c in dim_date.columns],
        period_of(F.col("date")).alias("campaign_period"),
    )


def within_dates(df: DataFrame, column: str, calendar: DataFrame, first: str = "date", last: str = "date") -> DataFrame:
    """Keep the rows between the earliest ``first`` and the latest ``last`` of a small table.

    The two bounds are scalar subqueries: they run before the scan, which can then skip files and row groups by date.
    """
    low = calendar.agg(F.min(first)).scalar()
    high = calendar.agg(F.max(last)).scalar()
    return df.filter(F.col(column).between(low, high))


def lines_of_articles(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Keep the lines of some articles. Done before lines are aggregated, it spares their shuffle; a line is never repeated."""
    return lines.join(articles.select("article_id").distinct(), "article_id", "left_semi")


def campaign_sales(lines: DataFrame, config: DataFrame, offer_articles: DataFrame, *, tail_weeks: int = 2) -> DataFrame:
    """Receipt x article sales of each offer's articles from the long history window to the post window.

    Store sales count by receipt date, completed online orders by order date; receipts are read ``tail_weeks`` further, as
    online orders are invoiced late. Customers without an id are kept as NULL. The result carries one flag per window, so
    nothing downstream needs the window dates again. Lines meet the offers' articles on the article, with the windows as a
    condition of that join; the articles are staged, so that Spark knows their size. Nothing else is joined on the article, so
    that adaptive execution can split a hot one.
    """
    articles = stage(offer_articles.select("offer_id", "brand", "article_id").distinct().join(config, "offer_id"), "campaign-articles")
    scanned = within_dates(lines, "receipt_date", config.withColumn("last_date", add_weeks(F.col("post_end_date"), tail_weeks)), "long_start_date", "last_date")
    receipt, ordered = F.col("receipt_date"), F.col("online_order_date")
    first, last = F.col("long_start_date"), F.col("post_end_date")
    online = is_true(F.col("is_online_order"))
    in_store_sale = (F.col("is_online_order") == F.lit(False)) & receipt.between(first, last)
    online_sale = (F.col("is_online_order_completed") == F.lit(True)) & ordered.between(first, last)
    matched = scanned.join(articles, "article_id").filter(
        receipt.between(first, add_weeks(last, tail_weeks)) & (in_store_sale | online_sale)
    )
    day = F.col("txn_date")
    return (
        matched.withColumn("txn_date", F.when(online, ordered).otherwise(receipt))
        .withColumn("scv_id", blank_to_null(F.col("scv_id")))
        .withColumns(
            {
                "in_recent": day.between(F.col("recent_start_date"), F.col("pre_end_date")),
                "in_long": day.between(F.col("long_start_date"), F.col("pre_end_date")),
                "in_pre": day.between(F.col("pre_start_date"), F.col("pre_end_date")),
                "in_campaign": day.between(F.col("campaign_start_date"), F.col("campaign_end_date")),
                "in_post": day.between(F.col("post_start_date"), F.col("post_end_date")),
            }
        )
        .groupBy(
            "offer_id", "brand", "article_id", "receipt_id", "scv_id", "txn_date",
            "in_recent", "in_long", "in_pre", "in_campaign", "in_post",
        )
        .agg(
            F.sum("gst_included_amount").alias("gst_included_amount"),
            F.sum("quantity").alias("quantity"),
            any_true(F.col("gst_included_amount") > 0).alias("has_positive_line"),
        )
    )


def offer_redemptions(
    rewards: DataFrame,
    brand_articles: DataFrame,
    receipts: DataFrame,
    calendar: DataFrame,
    *,
    offer_ids: Sequence[str] | None = None,
    channel_dates: tuple[str, str] | None = None,
) -> DataFrame:
    """Reward rows with brand, week and channel, points summed over exact duplicates.

    A reward is ``Online`` when its receipt is an online receipt of the same customer, else ``In Store`` (also when no
    receipt is found). Receipts are reduced to one row per customer and receipt, so a repeated header cannot repeat points.
    """
    if offer_ids is not None:
        rewards = rewards.filter(F.col("offer_id").isin(list(offer_ids)))
    if channel_dates is not None:
        receipts = receipts.filter(F.col("receipt_date").between(*channel_dates))
    online = (
        receipts.filter(is_present(F.col("scv_id")) & is_true(F.col("is_online_order")))
        .select("scv_id", "receipt_id", F.lit("Online").alias("online_channel"))
        .distinct()
    )
    weeks = calendar.select("offer_id", F.col("date").alias("redemption_date"), "pel_week").distinct()
    brands = brand_articles.select("offer_id", "article_id", "brand", "article_description").distinct()
    return (
        rewards.join(brands, ["offer_id", "article_id"], "left")
        .join(weeks, ["offer_id", "redemption_date"], "left")
        .join(online, ["scv_id", "receipt_id"], "left")
        .groupBy(
            "offer_id", "scv_id", "redemption_date", "pel_week", "receipt_id",
            F.coalesce("online_channel", F.lit("In Store")).alias("channel"),
            "article_id", "brand", "article_description",
            F.col("quantity").alias("redemptions"),
            "store_id",
            F.col("total_item_sales_amount").alias("basket_redemption_total"),
        )
        .agg(
            F.sum("base_points_earn").alias("base_points_earn"),
            F.sum("bonus_points_earn").alias("bonus_points_earn"),
            F.sum("reward_value").alias("reward_value"),
        )
    )


def receipt_article_lines(lines: DataFrame, calendar: DataFrame, articles: DataFrame) -> DataFrame:
    """Lines of some articles and the calendar's days summed to receipt x article; NULL customers become ``''``."""
    return (
        lines_of_articles(within_dates(lines, "receipt_date", calendar), articles)
        .groupBy("receipt_id", "article_id")
        .agg(
            F.max("receipt_date").alias("receipt_date"),
            F.max(F.coalesce("scv_id", F.lit(""))).alias("scv_id"),
            F.sum("gst_included_amount").alias("sales"),
            F.sum("quantity").alias("units"),
            F.avg("unit_price_paid").alias("unit_price_paid"),
        )
    )


def boosted_sales_lines(
    lines: DataFrame,
    calendar: DataFrame,
    brand_articles: DataFrame,
    redemptions: DataFrame,
    *,
    collapse_redemptions: bool = True,
) -> DataFrame:
    """Receipt x article sales with the part that was boosted, i.e. has a redemption of the same customer and receipt.

    Several redemption rows of one sale would repeat it; they are collapsed first unless ``collapse_redemptions`` is off.
    """
    keys = ["offer_id", "scv_id", "receipt_id", "article_id"]
    redeemed = redemptions.select(*keys, F.lit(True).alias("redeemed"))
    if collapse_redemptions:
        redeemed = redeemed.distinct()
    days = calendar.select("offer_id", F.col("date").alias("receipt_date"), "financial_week_start_date", "pel_week", "campaign_period")
    brands = brand_articles.select("offer_id", "article_id", "brand", "article_description").distinct()
    boosted = F.col("redeemed").isNotNull()
    return (
        receipt_article_lines(lines, calendar, brands)
        .join(brands, "article_id")
        .join(days, ["offer_id", "receipt_date"])
        .join(redeemed, keys, "left")
        .select(
            "offer_id", "financial_week_start_date", "campaign_period", "pel_week", "brand", "receipt_id", "article_id",
            "article_description", "receipt_date", "scv_id", "sales", "units", "unit_price_paid",
            F.when(boosted, F.col("units")).alias("boosted_units"),
            F.when(boosted, F.col("sales")).alias("boosted_sales"),
        )
    )
