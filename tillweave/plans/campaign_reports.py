"""The campaign reports: all campaigns at brand level, and the metrics of single campaigns by financial week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import is_present, ratio
from tillweave.operators import campaigns, performance, redeemers
from tillweave.sources.staging import stage


def campaign_master_report(
    config: DataFrame,
    lines: DataFrame,
    offer_articles: DataFrame,
    rewards: DataFrame,
    activations: DataFrame,
    feature_history: DataFrame,
    *,
    categories: Sequence[str],
) -> DataFrame:
    """Every campaign offer and brand with performance, activations, retention, uplift and segment profile.

    The sales of the campaign articles are read from the lines once and staged; shopper activity and redeemer segments,
    which three branches need, are staged too.
    """
    sales = stage(campaigns.campaign_sales(lines, config, offer_articles), "campaign-sales")
    activity = stage(redeemers.shopper_activity(sales), "shopper-activity")
    redemptions = rewards.join(config.select("offer_id"), "offer_id", "left_semi").select(
        "offer_id", "scv_id", "receipt_id", "article_id", F.col("quantity").alias("redemptions"), "bonus_points_earn"
    )
    redemptions = stage(redemptions, "redemptions")
    segments = stage(
        redeemers.redeemer_segments(redeemers.brand_redeemers(redemptions, offer_articles), activity), "redeemer-segments"
    )
    brand_key = ["offer_id", "brand"]
    uplift = performance.campaign_uplift(sales, config).select(
        *brand_key, "sales_uplift", "units_uplift", "scan_rate_uplift", "tag_rate_uplift"
    )
    return (
        config.join(performance.campaign_performance(redemptions, offer_articles, sales, segments), "offer_id", "left")
        .join(redeemers.total_activations(activations, config), "offer_id", "left")
        .join(redeemers.shopper_retention(activity, segments), brand_key, "left")
        .join(uplift, brand_key, "left")
        .join(redeemers.segment_profile_wide(segments, config, feature_history, categories=categories), brand_key, "left")
        .orderBy(*brand_key)
    )


def brand_metrics(
    config: DataFrame,
    lines: DataFrame,
    receipts: DataFrame,
    dim_date: DataFrame,
    brand_articles: DataFrame,
    rewards: DataFrame,
    activations: DataFrame,
    *,
    point_value: float = performance.POINT_VALUE,
) -> DataFrame:
    """Brand summary of a campaign by financial weeks: boosted sales, cost, redeemer segments, shoppers, retention.

    Sales of redeemed items are looked up in the weeks from the first campaign start to the last post window's end.
    Purchases count with a positive amount only. A redeemer is retained on a purchase in the post window alone.
    """
    calendar = campaigns.campaign_calendar(config, dim_date)
    redemptions = stage(
        campaigns.offer_redemptions(rewards.join(config.select("offer_id"), "offer_id", "left_semi"), brand_articles, receipts, calendar),
        "channel-redemptions",
    )
    activity = stage(redeemers.weekly_shopper_activity(lines, dim_date, config, brand_articles), "weekly-activity")
    bought_by = redemptions.select("offer_id", "brand", "scv_id").distinct()
    segments = stage(redeemers.redeemer_segments(bought_by, activity), "weekly-segments")

    item = ["scv_id", "receipt_id", "article_id"]
    windows = config.withColumn("last_receipt_date", F.date_add("post_end_date", 6))
    weeks = dim_date.select(F.col("date").alias("receipt_date"), "financial_week_start_date")
    in_weeks = campaigns.within_dates(lines, "receipt_date", windows, "campaign_start_date", "last_receipt_date").join(weeks, "receipt_date")
    bought = campaigns.within_dates(in_weeks, "financial_week_start_date", windows, "campaign_start_date", "post_end_date")
    item_sales = performance.redeemed_item_sales(bought.filter(is_present(F.col("scv_id"))), redemptions, item)
    by_customer = (
        redemptions.join(item_sales, item, "left")
        .groupBy("offer_id", "brand", "scv_id")
        .agg(
            F.sum("redemptions").alias("redemptions"), F.sum("item_sales").alias("sales"), F.sum("bonus_points_earn").alias("points")
        )
    )
    summary = by_customer.groupBy("offer_id", "brand").agg(
        F.sum("redemptions").alias("redemptions"),
        F.count("scv_id").alias("unique_redeemers"),
        F.sum("sales").alias("boosted_sales"),
        (F.sum("points") * point_value).alias("points_cost"),
    )
    kinds = segments.groupBy("offer_id", "brand").agg(
        F.count_if(F.col("redeemer_type") == redeemers.NEW).alias("new_to_brand_redeemers"),
        F.count_if(F.col("redeemer_type") == redeemers.REACTIVATED).alias("reactivated_redeemers"),
        F.count_if(F.col("redeemer_type") == redeemers.REPEAT).alias("repeat_redeemers"),
    )
    kept = redeemers.shopper_retention(activity, segments, campaign_shoppers_only=False).drop("non_redeemers")
    key = ["offer_id", "brand"]
    return (
        summary.withColumn("sales_to_cost_ratio", ratio(F.col("boosted_sales"), F.col("points_cost")))
        .join(kinds, key, "left")
        .join(kept, key, "left")
        .join(redeemers.non_boosters(activity, activations), key, "left")
        .orderBy(*key)
    )
