"""Vendors behind an offer and the weekly invoice feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import json_text, split_field


def offers_like(offers: DataFrame, column: str, pattern: str) -> DataFrame:
    """Distinct ids of the offers whose ``column`` fits a LIKE pattern; a missing value fits none, and a missing id is left out."""
    return offers.filter(F.like(column, F.lit(pattern)) & F.col("offer_id").isNotNull()).select("offer_id").distinct()


def redeemed_offer_articles(rewards: DataFrame, offers: DataFrame) -> DataFrame:
    """Distinct (offer, article) pairs redeemed under the given offers."""
    return (
        rewards.join(offers.select("offer_id").distinct(), "offer_id", "left_semi").select("offer_id", "article_id").distinct()
    )


def offer_vendor_arrays(offer_articles: DataFrame, article_vendor: DataFrame) -> DataFrame:
    """Per offer: sorted lists of its articles, vendor ids and vendor names, and the number of vendor names.

    Articles without a vendor name count as vendor ``'0'``. Pairs are made distinct before they are collected, so a list is
    as long as the offer has articles or vendors, never as its redemptions.
    """
    supplied = offer_articles.join(article_vendor.select("article_id", "vendor_id", "vendor_description"), "article_id", "left")
    named = supplied.select("offer_id", "vendor_id", F.coalesce("vendor_description", F.lit("0")).alias("vendor_description")).distinct()
    vendors = named.groupBy("offer_id").agg(
        # wrapped in a struct, a missing vendor id stays in the list instead of being skipped
        F.transform(F.array_sort(F.collect_set(F.struct("vendor_id"))), lambda v: v["vendor_id"]).alias("vendor_ids"),
        F.array_sort(F.collect_set("vendor_description")).alias("vendor_descriptions"),
    )
    articles = offer_articles.groupBy("offer_id").agg(F.array_sort(F.collect_set("article_id")).alias("articles"))
    return articles.join(vendors, "offer_id").withColumn("vendor_count", F.size("vendor_descriptions"))


def offer_own_brand(offer_articles: DataFrame, article_vendor: DataFrame) -> DataFrame:
    """Distinct (offer, own-brand flag) pairs; an offer with both kinds of article has two rows."""
    return (
        offer_articles.join(article_vendor.select("article_id", "own_brand"), "article_id", "left").select("offer_id", "own_brand").distinct()
    )


def invoice_feed(
    kpis: DataFrame, offer_vendor: DataFrame, own_brand: DataFrame, *, as_of: dt.date, offer_type: str = "product offer",
    excluded_name: str | None = None,
) -> DataFrame:
    """Offer x week redemptions and points of started offers, with vendor and article lists as JSON text.

    Invalid allocations, rows without a week and offers whose lower-cased name holds ``excluded_name``
    (default: none) are left out. The offer name is the second field of the
    piped name. An offer with own-brand and other articles appears once per flag.
    """
    keys = ["offer_id", "offer_name", "offer_type", "offer_target_type", "product_offer_type", "pel_week"]
    totals = (
        kpis.filter(
            F.col("offer_id").isNotNull()
            & (F.col("offer_start_date") < F.lit(as_of))
            & ~F.col("allocated_scv_id").isin("Invalid")
            & F.col("week_number").isNotNull()
            & (F.lit(True) if excluded_name is None else ~F.contains(F.lower("offer_name"), F.lit(excluded_name)))
            & (F.col("offer_type") == offer_type)
        )
        .groupBy(*keys)
        .agg(F.sum("offer_redeemed_count").alias("total_redeemed"), F.sum("bonus_points_earn").alias("total_bonus_points"))
    )
    return (
        totals.join(offer_vendor, "offer_id", "left")
        .join(own_brand, "offer_id", "left")
        .select(
            "offer_id",
            "pel_week",
            split_field(F.col("offer_name"), "|", 1).alias("offer_name"),
            "offer_type",
            "offer_target_type",
            "product_offer_type",
            "own_brand",
            "vendor_count",
            json_text(F.col("articles")).alias("articles_json"),
            json_text(F.col("vendor_ids")).alias("vendor_ids_json"),
            json_text(F.col("vendor_descriptions")).alias("vendor_descriptions_json"),
            "total_redeemed",
            "total_bonus_points",
        )
    )
