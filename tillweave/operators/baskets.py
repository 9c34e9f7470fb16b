"""Basket figures by campaign period, and the week x channel x article facts of the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import is_present, is_true, ratio
from tillweave.operators.campaigns import lines_of_articles, within_dates
from tillweave.operators.performance import POINT_VALUE
from tillweave.sources.staging import stage


def basket_kpis(headers: DataFrame, calendar: DataFrame, rewards: DataFrame, offer_articles: DataFrame) -> DataFrame:
    """Per offer, period and redeemer flag: customers, baskets per week, average basket value and quantity.

    Every basket counts for every offer whose window covers its day. A basket is an online order or a store receipt; only
    known customers take part. Rows are reduced to one per customer, basket and week, and staged; customers, baskets and weeks
    are then each counted by two plain aggregations, which multiply no rows.
    """
    days = calendar.filter(F.col("campaign_period").isNotNull()).select(
        F.col("date").alias("receipt_date"), "offer_id", "campaign_period", "pel_week"
    )
    offers = offer_articles.select("offer_id").distinct()
    redeemers = (
        rewards.join(offers, "offer_id", "left_semi")
        .select("offer_id", "scv_id")
        .distinct()
        .withColumn("redeemer", F.lit("Redeemer"))
    )
    online = is_true(F.col("is_online_order"))
    baskets = (
        within_dates(headers, "receipt_date", calendar)
        .filter(is_present(F.col("scv_id")))
        .groupBy("scv_id", F.when(online, F.col("commercial_id")).otherwise(F.col("receipt_id")).alias("basket_id"), "receipt_date")
        .agg(F.sum("gst_included_amount").alias("amount"), F.sum("quantity").alias("quantity"))
    )
    cell = ["offer_id", "campaign_period", "redeemer_group"]
    customer_baskets = stage(
        baskets.join(days, "receipt_date")
        .join(redeemers, ["offer_id", "scv_id"], "left")
        .withColumn("redeemer_group", F.coalesce("redeemer", F.lit("Non Redeemer")))
        .groupBy(*cell, "scv_id", "basket_id", "pel_week")
        .agg(F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity")),
        "customer-baskets",
    )

    def counted(of: str, name: str) -> DataFrame:
        return customer_baskets.groupBy(*cell, of).agg(F.count(F.lit(1))).groupBy(*cell).agg(F.count(of).alias(name))

    per_cell = (
        customer_baskets.groupBy(*cell)
        .agg(F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"))
        .join(counted("scv_id", "unique_customers"), cell)
        .join(counted("basket_id", "baskets"), cell)
        .join(counted("pel_week", "weeks"), cell)
    )
    baskets_counted = F.col("baskets")
    return per_cell.select(
        "offer_id",
        "campaign_period",
        "redeemer_group",
        "unique_customers",
        ratio(baskets_counted, F.col("weeks")).alias("baskets_per_week"),
        ratio(F.col("amount"), baskets_counted).alias("avg_basket_size"),
        ratio(F.col("quantity"), baskets_counted).alias("avg_basket_qty"),
    ).orderBy(F.col("offer_id").desc(), "campaign_period")


def week_article_channel_facts(
    headers: DataFrame,
    lines: DataFrame,
    calendar: DataFrame,
    offer_articles: DataFrame,
    rewards: DataFrame,
    *,
    point_value: float = POINT_VALUE,
) -> DataFrame:
    """Per offer, period, week, channel and article: boosted and total sales and units, redemptions, points cost, average
    price, transactions, swiped lines and sales.

    Lines meet their header on receipt *and* customer: a NULL customer drops out, a blank one stays as not swiped.
    ``swiped_lines`` counts receipt x article rows; ``swiped_transactions`` is the distinct-receipt count beside it.
    """
    days = calendar.filter(F.col("campaign_period").isNotNull())
    swipes = (
        within_dates(headers, "receipt_date", days)
        .select(
            "receipt_id",
            "scv_id",
            F.when(is_true(F.col("is_online_order")), "Online").otherwise("In Store").alias("channel"),
            F.when(is_present(F.col("scv_id")), 1).otherwise(0).alias("is_swiped"),
        )
        .distinct()
    )
    items = (
        lines_of_articles(within_dates(lines, "receipt_date", days), offer_articles)
        .groupBy("receipt_id", "scv_id", "article_id", "receipt_date")
        .agg(
            F.sum("gst_included_amount").alias("sales"),
            F.sum("quantity").alias("units"),
            F.avg("unit_price_paid").alias("unit_price_paid"),
        )
        .join(swipes, ["receipt_id", "scv_id"])
    )
    key = ["offer_id", "scv_id", "receipt_id", "article_id"]
    redeemed = rewards.groupBy(*key).agg(
        F.sum("quantity").alias("redemption_quantity"), F.sum("bonus_points_earn").alias("bonus_points_earn"), F.lit(True).alias("redeemed")
    )
    articles = offer_articles.select("offer_id", "article_id", "brand", "article_description").distinct()
    weeks = days.select(
        "offer_id", F.col("date").alias("receipt_date"), "campaign_name", "campaign_period", "pel_week",
        "financial_week_start_date", "financial_week_end_date",
    )
    cell = [
        "campaign_name", "offer_id", "campaign_period", "pel_week", "financial_week_end_date", "financial_week_start_date",
        "channel", "article_id", "article_description", "brand",
    ]
    boosted = F.col("redeemed").isNotNull()
    swiped = F.col("is_swiped") == 1
    by_receipt = (
        items.join(articles, "article_id")
        .join(weeks, ["offer_id", "receipt_date"])
        .join(redeemed, key, "left")
        .groupBy(*cell, "receipt_id")
        .agg(
            F.sum(F.when(boosted, F.col("units")).otherwise(0.0)).alias("boosted_units"),
            F.sum(F.when(boosted, F.col("sales")).otherwise(0.0)).alias("boosted_sales"),
            F.sum("sales").alias("sales"),
            F.sum("units").alias("units"),
            F.sum("redemption_quantity").alias("redemptions"),
            F.sum("bonus_points_earn").alias("points"),
            F.sum("unit_price_paid").alias("price_total"),
            F.count("unit_price_paid").alias("prices"),
            F.sum("is_swiped").alias("swiped_lines"),
            F.max("is_swiped").alias("swiped"),
            F.sum(F.when(swiped, F.col("sales")).otherwise(0.0)).alias("swiped_sales"),
        )
    )
    return (
        by_receipt.groupBy(*cell)
        .agg(
            F.sum("boosted_units").alias("boosted_units"),
            F.sum("boosted_sales").alias("boosted_sales"),
            F.sum("sales").alias("total_sales"),
            F.sum("units").alias("total_units"),
            F.sum("redemptions").alias("total_redemptions"),
            (F.sum("points") * point_value).alias("points_cost"),
            ratio(F.sum("price_total"), F.sum("prices")).alias("avg_unit_price_paid"),
            F.count("receipt_id").alias("total_transactions"),
            F.sum("swiped_lines").alias("swiped_lines"),
            F.sum("swiped").alias("swiped_transactions"),
            F.sum("swiped_sales").alias("swiped_sales"),
        )
        .withColumn("weeks_in_period", F.when(F.col("pel_week").isNotNull(), 1).otherwise(0))
        .orderBy("campaign_name", "pel_week", "channel", "brand", "article_id")
    )
