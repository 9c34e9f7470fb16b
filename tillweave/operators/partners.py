"""Customers' dealings with loyalty partners."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import add_weeks
from tillweave.functions.values import any_true, is_false, ratio, sum_if

DISCOUNT = "cpl discount"  # fixed value: redemption type of a fuel discount row


def _earned(column: str):
    return F.lower(column).isin("base", "bonus")


def partner_points(fuel: DataFrame, non_fuel: DataFrame) -> DataFrame:
    """Points, distinct transactions and first/last dates per customer and partner, fuel and other partners unioned.

    Both inputs carry ``transaction_id``. Only base and bonus rows earn (any letter case); behaviour offers of the other
    partners do not count. Each source is reduced to transactions first, then to customer and partner.
    """

    def one_source(rows: DataFrame) -> DataFrame:
        per_transaction = rows.groupBy("scv_id", "partner_id", "transaction_id").agg(
            F.sum(F.coalesce("base_points", F.lit(0))).alias("base_points"),
            F.sum(F.coalesce("bonus_points", F.lit(0))).alias("bonus_points"),
            F.min("txn_date").alias("first_date"),
            F.max("txn_date").alias("last_date"),
        )
        return per_transaction.groupBy("scv_id", "partner_id").agg(
            F.sum("base_points").alias("base_points"),
            F.sum("bonus_points").alias("bonus_points"),
            F.count("transaction_id").alias("transactions"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )

    earned_fuel = fuel.filter(_earned("redemption_type"))
    earned_other = non_fuel.filter(_earned("redemption_type") & is_false(F.col("behaviour_offer")))
    return one_source(earned_fuel).unionByName(one_source(earned_other))


def partner_points_summary(points: DataFrame, *, partner_id: str) -> DataFrame:
    """Per customer: since when, until when and how often points were earned, and how many, everywhere and at one partner (NULL
    without dealings with it). ``points`` are base points and bonus points together."""
    kinds = {"base_points": F.col("base_points"), "bonus_points": F.col("bonus_points"), "points": F.col("base_points") + F.col("bonus_points")}
    one = F.col("partner_id") == partner_id
    return points.groupBy("scv_id").agg(
        F.min("first_date").alias("member_since"),
        F.max("last_date").alias("last_earned"),
        F.sum("transactions").alias("transactions"),
        *[F.sum(earned).alias(name) for name, earned in kinds.items()],
        *[sum_if(one, earned).alias(f"{name}_at_partner") for name, earned in kinds.items()],
    )


def partner_breadth(points: DataFrame, partners: DataFrame, *, partner_name: str, suffix: str = "_NZ") -> DataFrame:
    """Per customer: how many different partners (by name without its country suffix), and whether one of them is the named."""
    names = partners.select("partner_id", F.replace("partner_name", F.lit(suffix), F.lit("")).alias("partner_name"))
    dealings = points.select("scv_id", "partner_id").distinct().join(names, "partner_id").select("scv_id", "partner_name").distinct()
    return dealings.groupBy("scv_id").agg(
        F.max(F.when(F.col("partner_name") == partner_name, 1).otherwise(0)).alias("partner_customer"),
        F.count("partner_name").alias("different_partners"),
    )


def engagement_recency(transactions: DataFrame, *, as_of: dt.date, partner_id: str) -> DataFrame:
    """Per customer of one partner: sales, fuel and shop split, litres, visits, days per visit, activity by age, dates.

    Identical rows count once. Recency sums count those distinct rows, not transactions. Shop figures are total minus fuel
    and therefore NULL when either is missing; a zero quantity gives no discount per litre instead of an error. Rows are
    reduced to transactions first, so counting transactions needs no distinct.
    """
    day, fuel = F.col("txn_date"), F.col("redemption_type") == DISCOUNT
    today = F.lit(as_of)
    eight, sixteen = add_weeks(today, -8), add_weeks(today, -16)
    rows = (
        transactions.filter(F.col("partner_id") == partner_id)
        .select(
            "scv_id",
            "receipt_id",
            "txn_date",
            F.when(fuel, day).alias("fuel_date"),
            F.when(_earned("redemption_type"), F.col("sales")).alias("sales_total"),
            F.when(fuel, F.col("sales")).alias("sales_fuel"),
            F.when(fuel, F.col("quantity")).alias("litres"),
            F.when(fuel, F.try_divide("discount", "quantity")).alias("discount_per_litre"),
            F.when(fuel, F.col("receipt_id")).alias("fuel_receipt_id"),
        )
        .distinct()
    )
    recent, before = day >= eight, (day >= sixteen) & (day < eight)
    per_receipt = rows.groupBy("scv_id", "receipt_id").agg(
        any_true(F.col("fuel_receipt_id").isNotNull()).alias("has_fuel"),
        *[F.sum(c).alias(c) for c in ("sales_total", "sales_fuel", "litres", "discount_per_litre")],
        F.min("fuel_date").alias("first_fuel_date"),
        F.count_if(recent).alias("last_2m"),
        F.count_if(before).alias("previous_2m"),
        F.count_if(day < sixteen).alias("before_4m"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
    )
    known = F.col("receipt_id").isNotNull()
    totals = per_receipt.groupBy("scv_id").agg(
        F.sum("sales_total").alias("total_sales"),
        F.sum("sales_fuel").alias("total_sales_fuel"),
        F.count_if(known).alias("transactions"),
        F.count_if(known & F.col("has_fuel")).alias("fuel_transactions"),
        F.sum("litres").alias("total_litres"),
        F.sum("discount_per_litre").alias("discount_total"),
        F.sum("last_2m").alias("last_2m"),
        F.sum("previous_2m").alias("previous_2m_to_last_2m"),
        F.sum("before_4m").alias("before_4m"),
        F.min("first_fuel_date").alias("first_fuel_date"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    shop = F.col("transactions") - F.col("fuel_transactions")
    return totals.select(
        "scv_id",
        "total_sales",
        "total_sales_fuel",
        (F.col("total_sales") - F.col("total_sales_fuel")).alias("total_sales_shop"),
        "transactions",
        "fuel_transactions",
        shop.alias("shop_transactions"),
        "total_litres",
        ratio(F.col("total_litres"), F.col("fuel_transactions")).alias("average_litres"),
        ratio(F.datediff(today, "first_fuel_date"), F.col("fuel_transactions")).alias("days_to_fuel"),
        ratio(F.datediff(today, "first_date"), shop).alias("days_to_shop"),
        "discount_total",
        "last_2m",
        "previous_2m_to_last_2m",
        "before_4m",
        "first_date",
        "last_date",
    )


def dedup_reference_sales(rewards: DataFrame) -> DataFrame:
    """Sales per customer with one row per transaction reference: the largest amount, then the lowest customer id."""
    pick = F.min_by(
        F.struct("scv_id", "sales"), F.struct(F.coalesce(-F.col("sales"), F.lit(float("inf"))).alias("a"), F.col("scv_id").alias("b"))
    ).alias("kept")
    return (
        rewards.groupBy("reference")
        .agg(pick)
        .select("kept.scv_id", "kept.sales")
        .groupBy("scv_id")
        .agg(F.sum("sales").alias("non_fuel_sales"))
    )


def first_event_cohort(transactions: DataFrame, *, start: dt.date, end: dt.date, partner_id: str) -> DataFrame:
    """Customers with a discounted purchase at the partner between two dates.

    The window is applied before the first purchase is looked for, so "first in the window" is "any in the window".
    """
    return (
        transactions.filter(
            (F.col("partner_id") == partner_id)
            & (F.col("redemption_type") == DISCOUNT)
            & F.col("txn_date").between(F.lit(start), F.lit(end))
        )
        .select("scv_id")
        .distinct()
    )
