"""The partner programme strategy: every feature of the ladder from the base tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.operators import audiences, partners
from tillweave.sources.staging import stage


def partner_strategy(
    fuel: DataFrame,
    non_fuel: DataFrame,
    partner_names: DataFrame,
    customers: DataFrame,
    preferences: DataFrame,
    risk: DataFrame,
    sends: DataFrame,
    communications: DataFrame,
    clicks: DataFrame,
    *,
    as_of: dt.date,
    partner_id: str,
    partner_name: str,
    prefs_required: Sequence[str],
    thresholds: audiences.Thresholds = audiences.Thresholds(),
    labels: Mapping[str, tuple[str, str]] | None = None,
    run_at: Column | None = None,
) -> DataFrame:
    """Segment and treatment of every customer of the partner programme.

    Points per customer and partner, which totals and breadth both read, are staged. Date and stamp of a run come from
    one instant: ``**RunClock(...).arguments()``.
    """
    fuel_rows = fuel.withColumn("transaction_id", F.col("receipt_id"))
    other_rows = non_fuel.withColumn("transaction_id", F.col("reference"))
    points = stage(partners.partner_points(fuel_rows, other_rows), "partner-points")
    return audiences.segmentation_strategy(
        partners.partner_breadth(points, partner_names, partner_name=partner_name),
        partners.engagement_recency(fuel, as_of=as_of, partner_id=partner_id),
        partners.partner_points_summary(points, partner_id=partner_id),
        customers,
        risk,
        partners.dedup_reference_sales(non_fuel),
        audiences.contactable_customers(customers, preferences, prefs_required=prefs_required),
        audiences.unsubscribed_customers(sends, communications, clicks),
        as_of=as_of,
        thresholds=thresholds,
        labels=labels,
        run_at=run_at,
    )
