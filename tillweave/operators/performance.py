"""Campaign results: sales, cost, uplift, scan and tag rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import any_true, is_present, ratio, relative_change, sum_if
from tillweave.operators.campaigns import DURING, PRE, lines_of_articles, within_dates
from tillweave.operators.redeemers import NEW, REACTIVATED, REPEAT, SHOPPER

POINT_VALUE = 0.0091  # fixed value: money value of one loyalty point


def redeemed_item_sales(sales: DataFrame, redemptions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sales per item for the items that were redeemed.

    The semi-join leaves only redeemed items to sum up; all three steps (it, the sum and the join that follows) work on one
    partitioning by the item key.
    """
    redeemed = redemptions.select(*key).distinct()
    return sales.join(redeemed, list(key), "left_semi").groupBy(*key).agg(F.sum("gst_included_amount").alias("item_sales"))


def campaign_performance(
    redemptions: DataFrame,
    offer_articles: DataFrame,
    sales: DataFrame,
    segments: DataFrame,
    *,
    point_value: float = POINT_VALUE,
) -> DataFrame:
    """Per offer and brand: redemptions, redeemers, sales of the redeemed items, points, their cost, and segments.

    Sales are summed to one row per redeemed item before the join, so several sales rows cannot multiply redemptions.
    The other way round they do: ``boosted_sales`` counts an item's sales once for each of its redemption rows, as each
    redeemer is credited with the item. Where reward rows repeat, pass ``offer_redemptions``, which sums exact repeats, or
    reduce them to one row per customer and item. Redemptions are first reduced to customers; the second step then only adds up and counts rows.
    """
    brands = offer_articles.select("offer_id", "article_id", "brand").distinct()
    item = ["offer_id", "brand", "receipt_id", "article_id"]
    branded = redemptions.join(brands, ["offer_id", "article_id"])
    by_customer = (
        branded.join(redeemed_item_sales(sales, branded, item), item, "left")
        .groupBy(*SHOPPER)
        .agg(
            F.sum("redemptions").alias("redemptions"),
            F.sum("item_sales").alias("sales"),
            F.sum("bonus_points_earn").alias("points"),
        )
    )
    kind = F.col("redeemer_type")
    cost = F.col("bonus_points") * point_value
    return (
        by_customer.join(segments, SHOPPER, "left")
        .groupBy("offer_id", "brand")
        .agg(
            F.sum("redemptions").alias("redemptions"),
            F.count("scv_id").alias("unique_redeemers"),
            F.sum("sales").alias("boosted_sales"),
            F.sum("points").alias("bonus_points"),
            F.count_if(kind == NEW).alias("new_to_brand_redeemers"),
            F.count_if(kind == REACTIVATED).alias("reactivated_redeemers"),
            F.count_if(kind == REPEAT).alias("repeat_redeemers"),
        )
        .withColumn("points_cost", cost)
        .withColumn("sales_to_cost_ratio", ratio(F.col("boosted_sales"), F.col("points_cost")))
    )


def campaign_uplift(sales: DataFrame, config: DataFrame, *, pre_weeks: int = 4) -> DataFrame:
    """Campaign against pre window per offer and brand: baskets, sales, units, and the uplifts of sales, units, scan rate
    and tag rate.

    Campaign figures are averaged over the campaign's own weeks, pre figures over ``pre_weeks``, whatever the length of the
    pre window. A brand without baskets in a window has NULL rates, not an error. Baskets are reduced to one row per
    receipt before they are counted.
    """
    swiped = F.col("scv_id").isNotNull()
    amount, units = F.col("gst_included_amount"), F.col("quantity")
    pre, during = F.col("in_pre"), F.col("in_campaign")
    baskets = (
        sales.filter(pre | during)
        .groupBy("offer_id", "brand", "receipt_id")
        .agg(
            any_true(pre).alias("pre_basket"),
            any_true(pre & swiped).alias("pre_swiped_basket"),
            any_true(during).alias("basket"),
            any_true(during & swiped).alias("swiped_basket"),
            sum_if(pre, amount).alias("pre_sales"),
            sum_if(pre & swiped, amount).alias("pre_swiped_sales"),
            sum_if(during, amount).alias("campaign_sales"),
            sum_if(during & swiped, amount).alias("campaign_swiped_sales"),
            sum_if(pre, units).alias("pre_units"),
            sum_if(during, units).alias("campaign_units"),
        )
    )
    figures = baskets.groupBy("offer_id", "brand").agg(
        F.count_if("pre_basket").alias("pre_baskets"),
        F.count_if("pre_swiped_basket").alias("pre_swiped_baskets"),
        F.count_if("basket").alias("campaign_baskets"),
        F.count_if("swiped_basket").alias("campaign_swiped_baskets"),
        *[
            F.sum(c).alias(c)
            for c in ("pre_sales", "pre_swiped_sales", "campaign_sales", "campaign_swiped_sales", "pre_units", "campaign_units")
        ],
    )
    weeks = F.col("campaign_duration_weeks")

    def weekly_change(name: str):
        return relative_change(ratio(F.col(f"campaign_{name}"), weeks), ratio(F.col(f"pre_{name}"), F.lit(pre_weeks)))

    def rate_change(part: str, whole: str):
        return relative_change(
            ratio(F.col(f"campaign_{part}"), F.col(f"campaign_{whole}")), ratio(F.col(f"pre_{part}"), F.col(f"pre_{whole}"))
        )

    return figures.join(config.select("offer_id", "campaign_duration_weeks"), "offer_id").select(
        *figures.columns,
        weeks,
        weekly_change("sales").alias("sales_uplift"),
        weekly_change("units").alias("units_uplift"),
        rate_change("swiped_baskets", "baskets").alias("scan_rate_uplift"),
        rate_change("swiped_sales", "sales").alias("tag_rate_uplift"),
    )


def scan_tag_rates(lines: DataFrame, calendar: DataFrame, brand_articles: DataFrame) -> DataFrame:
    """Weekly scan rate (swiped / all transactions) and tag rate (swiped / all sales) of each brand, with period averages.

    An online transaction goes by its order id, a store one by its receipt id. The averages are unweighted means of the
    weekly rates per brand and period, over all offers. Transactions are first reduced to one row per brand and week.
    """
    brands = brand_articles.select("offer_id", "article_id", "brand").distinct()
    days = calendar.filter(F.col("campaign_period").isNotNull()).select(
        "offer_id", F.col("date").alias("receipt_date"), "financial_week_start_date", "pel_week", "campaign_period"
    )
    items = (
        lines_of_articles(within_dates(lines, "receipt_date", calendar), brands)
        .groupBy("receipt_id", "commercial_id", "article_id")
        .agg(
            F.sum("gst_included_amount").alias("amount"),
            F.max("receipt_date").alias("receipt_date"),
            # a flag, not the id itself: text has no place in a hash aggregation's buffer
            any_true(is_present(F.col("scv_id"))).alias("swiped"),
        )
    )
    cell = ["offer_id", "financial_week_start_date", "pel_week", "campaign_period", "brand"]
    transactions = (
        items.join(brands, "article_id")
        .join(days, ["offer_id", "receipt_date"])
        .withColumn("transaction", F.when(F.col("commercial_id") == "", F.col("receipt_id")).otherwise(F.col("commercial_id")))
        .groupBy(*cell, "transaction")
        .agg(
            any_true(F.col("swiped")).alias("swiped"),
            F.sum("amount").alias("amount"),
            F.sum(F.when(F.col("swiped"), F.col("amount")).otherwise(0.0)).alias("swiped_amount"),
        )
    )
    named = F.col("transaction").isNotNull()
    rates = transactions.groupBy(*cell).agg(
        ratio(F.count_if(named & F.col("swiped")), F.count_if(named)).alias("scan_rate"),
        ratio(F.sum("swiped_amount"), F.sum("amount")).alias("tag_rate"),
    )
    period = Window.partitionBy("brand", "campaign_period")
    return rates.select(
        "*", F.avg("scan_rate").over(period).alias("avg_scan_rate"), F.avg("tag_rate").over(period).alias("avg_tag_rate")
    ).orderBy("financial_week_start_date", "brand", "offer_id")


def weekly_uplift(boosted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average weekly sales and units before and during the campaign, side by side, and their relative change.

    Weeks are those with sales, not calendar weeks; post-campaign rows and rows outside any window take no part.
    """
    weekly = (
        boosted.filter(F.col("campaign_period").isin(PRE, DURING))
        .groupBy(*keys, "campaign_period", "pel_week")
        .agg(F.sum("sales").alias("sales"), F.sum("units").alias("units"))
    )
    averages = weekly.groupBy(*keys, "campaign_period").agg(
        ratio(F.sum("sales"), F.count("pel_week")).alias("weekly_sales"),
        ratio(F.sum("units"), F.count("pel_week")).alias("weekly_units"),
    )
    wide = (
        averages.groupBy(*keys)
        .pivot("campaign_period", [PRE, DURING])
        .agg(F.max("weekly_sales").alias("weekly_sales"), F.max("weekly_units").alias("weekly_units"))
    )
    return wide.select(
        *keys,
        F.col(f"{PRE}_weekly_sales").alias("weekly_sales_pre"),
        F.col(f"{DURING}_weekly_sales").alias("weekly_sales_campaign"),
        F.col(f"{PRE}_weekly_units").alias("weekly_units_pre"),
        F.col(f"{DURING}_weekly_units").alias("weekly_units_campaign"),
        relative_change(F.col(f"{DURING}_weekly_sales"), F.col(f"{PRE}_weekly_sales")).alias("sales_uplift"),
        relative_change(F.col(f"{DURING}_weekly_units"), F.col(f"{PRE}_weekly_units")).alias("units_uplift"),
    )


def brand_week_article_channel(redemptions: DataFrame, lines: DataFrame, *, point_value: float = POINT_VALUE) -> DataFrame:
    """Redemptions, sales of the redeemed items and points cost by brand, article, week and channel."""
    key = ["scv_id", "receipt_id", "article_id"]
    bought = redeemed_item_sales(lines.filter(is_present(F.col("scv_id"))), redemptions, key)
    return (
        redemptions.join(bought, key, "left")
        .groupBy("offer_id", "brand", "article_description", "pel_week", "channel")
        .agg(
            F.sum("redemptions").alias("redemptions"),
            F.sum("item_sales").alias("gst_included_amount"),
            (F.sum("bonus_points_earn") * point_value).alias("points_cost"),
        )
    )
