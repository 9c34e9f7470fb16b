"""Who redeemed, who shopped, who came back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.values import any_true, is_present, ratio
from tillweave.operators.campaigns import lines_of_articles, within_dates

# fixed values: redeemer types
NEW, REACTIVATED, REPEAT = "New", "Reactivated", "Repeat"
SHOPPER = ["offer_id", "brand", "scv_id"]


def shopper_activity(sales: DataFrame, *, positive_only: bool = False) -> DataFrame:
    """One row per (offer, brand, customer): in which windows the customer bought the brand.

    ``positive_only`` counts only receipts with a line of a positive amount (returns alone are then no purchase).
    """
    known = sales.filter(F.col("scv_id").isNotNull())
    if positive_only:
        known = known.filter("has_positive_line")
    return known.groupBy(*SHOPPER).agg(
        any_true(F.col("in_recent")).alias("shopped_recent"),
        any_true(F.col("in_long")).alias("shopped_long"),
        any_true(F.col("in_campaign")).alias("shopped_campaign"),
        any_true(F.col("in_post")).alias("shopped_post"),
    )


def weekly_shopper_activity(
    lines: DataFrame, dim_date: DataFrame, config: DataFrame, brand_articles: DataFrame, *, positive_only: bool = True
) -> DataFrame:
    """``shopper_activity`` judged by the start of the financial week a receipt falls in, straight from the lines."""
    weeks = dim_date.select(F.col("date").alias("receipt_date"), "financial_week_start_date")
    articles = brand_articles.select("offer_id", "brand", "article_id").distinct().join(config, "offer_id")
    # a week starts at most six days before its receipts, so the last week of a window may hold receipts six days later
    spans = config.withColumn("last_date", F.date_add("post_end_date", 6))
    bought = within_dates(lines, "receipt_date", spans, "long_start_date", "last_date").filter(is_present(F.col("scv_id")))
    if positive_only:
        bought = bought.filter(F.col("gst_included_amount") > 0)
    bought = lines_of_articles(bought, brand_articles)
    week = F.col("financial_week_start_date")
    return (
        bought.select("scv_id", "article_id", "receipt_date")
        .distinct()
        .join(weeks, "receipt_date")
        .join(articles, "article_id")
        .filter(week.between(F.col("long_start_date"), F.col("post_end_date")))
        .groupBy(*SHOPPER)
        .agg(
            any_true(week.between(F.col("recent_start_date"), F.col("pre_end_date"))).alias("shopped_recent"),
            any_true(week.between(F.col("long_start_date"), F.col("pre_end_date"))).alias("shopped_long"),
            any_true(week.between(F.col("campaign_start_date"), F.col("campaign_end_date"))).alias("shopped_campaign"),
            any_true(week.between(F.col("post_start_date"), F.col("post_end_date"))).alias("shopped_post"),
        )
    )


def brand_redeemers(redemptions: DataFrame, brand_articles: DataFrame) -> DataFrame:
    """Distinct (offer, brand, customer) of the redemptions."""
    brands = brand_articles.select("offer_id", "article_id", "brand").distinct()
    bare = redemptions.select("offer_id", "article_id", "scv_id").distinct()
    return bare.join(brands, ["offer_id", "article_id"]).select(*SHOPPER).distinct()


def redeemer_segments(redeemers: DataFrame, activity: DataFrame) -> DataFrame:
    """Each redeemer as Repeat (bought in the recent window), Reactivated (only in the long one) or New."""
    return redeemers.join(activity.select(*SHOPPER, "shopped_recent", "shopped_long"), SHOPPER, "left").select(
        *SHOPPER,
        F.when(F.col("shopped_recent"), REPEAT).when(F.col("shopped_long"), REACTIVATED).otherwise(NEW).alias("redeemer_type"),
    )


def _retained(kind: str):
    return F.count_if((F.col("redeemer_type") == kind) & F.col("shopped_post"))


def shopper_retention(activity: DataFrame, segments: DataFrame, *, campaign_shoppers_only: bool = True) -> DataFrame:
    """Per offer and brand: campaign shoppers, those who did not redeem, and redeemers seen again in the post window.

    ``campaign_shoppers_only=False`` counts a redeemer as retained on a post-window purchase alone, also without a campaign
    purchase by the window's own dates.
    """
    seen = activity.filter(F.col("shopped_campaign")) if campaign_shoppers_only else activity
    return (
        seen.join(segments, SHOPPER, "left")
        .groupBy("offer_id", "brand")
        .agg(
            F.count_if("shopped_campaign").alias("brand_shoppers"),
            F.count_if(F.col("shopped_campaign") & F.col("redeemer_type").isNull()).alias("non_redeemers"),
            _retained(NEW).alias("retained_new_to_brand_shoppers"),
            _retained(REACTIVATED).alias("retained_reactivated_shoppers"),
            _retained(REPEAT).alias("retained_repeat_shoppers"),
        )
    )


def non_boosters(activity: DataFrame, activations: DataFrame) -> DataFrame:
    """Per offer and brand: campaign shoppers who never *activated* the offer (not the same as never having redeemed)."""
    activated = activations.select("offer_id", "scv_id").distinct()
    return (
        activity.filter(F.col("shopped_campaign"))
        .join(activated, ["offer_id", "scv_id"], "left_anti")
        .groupBy("offer_id", "brand")
        .agg(F.count("scv_id").alias("non_boosters"))
    )


def total_activations(activations: DataFrame, config: DataFrame) -> DataFrame:
    """Distinct activating customers of each campaign offer."""
    return (
        activations.join(config.select("offer_id"), "offer_id", "left_semi")
        .groupBy("offer_id")
        .agg(F.countDistinct("scv_id").alias("total_activations"))
    )


def segment_profile_wide(segments: DataFrame, config: DataFrame, feature_history: DataFrame, *, categories: Sequence[str]) -> DataFrame:
    """Redeemers by type and lifestyle segment at campaign start, one column per combination.

    A redeemer occurs once per offer and brand, so plain conditional counts replace as many distinct counts.
    """
    starts = config.select("offer_id", F.col("campaign_start_date").alias("at_date"))
    history = feature_history.select("scv_id", "at_date", "segment_group").distinct()
    profiles = (
        segments.join(starts, "offer_id", "left")
        .join(history, ["scv_id", "at_date"], "left")
        .withColumn("category", F.lower(F.coalesce("segment_group", F.lit("no_segment"))))
        .select(*SHOPPER, "redeemer_type", "category")
        .distinct()
    )
    labels = ((REPEAT, "repeat"), (REACTIVATED, "reactivated"), (NEW, "new_to_brand"))
    counts = [
        F.count_if((F.col("redeemer_type") == kind) & (F.col("category") == category)).alias(f"{label}_{category}_customers")
        for category in categories
        for kind, label in labels
    ]
    return profiles.groupBy("offer_id", "brand").agg(*counts)


def segment_profile_share(segments: DataFrame, features: DataFrame, redemptions: DataFrame) -> DataFrame:
    """Per offer, brand and current lifestyle segment: redeemers of each type and their share of the brand's total.

    Every brand with redemptions gets a row for every segment, zero where nobody falls in it. Redeemers without a segment
    match no row and are left out of the shares. The segment list (a handful of labels) is one scalar, unfolded per brand.
    """
    labelled = features.filter(F.col("segment_group").isNotNull()).select("scv_id", "segment_group")
    all_segments = labelled.agg(F.array_sort(F.collect_set("segment_group"))).scalar()
    base = redemptions.select("offer_id", "brand").distinct().withColumn("segment_group", F.explode(all_segments))
    kind = F.col("redeemer_type")
    counted = (
        segments.join(labelled, "scv_id")
        .groupBy("offer_id", "brand", "segment_group")
        .agg(
            F.count_if(kind == REPEAT).alias("repeat_customers"),
            F.count_if(kind == REACTIVATED).alias("reactivated_customers"),
            F.count_if(kind == NEW).alias("new_to_brand_customers"),
        )
    )
    names = ["repeat", "reactivated", "new_to_brand"]
    filled = base.join(counted, ["offer_id", "brand", "segment_group"], "left").fillna(0, [f"{n}_customers" for n in names])
    brand = Window.partitionBy("offer_id", "brand")  # as many rows as there are segments
    totals = {f"total_{n}": F.sum(f"{n}_customers").over(brand) for n in names}
    shares = [ratio(F.col(f"{n}_customers"), F.col(f"total_{n}")).alias(f"{n}_share") for n in names]
    return filled.withColumns(totals).select("*", *shares)
