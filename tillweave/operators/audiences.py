"""Audiences: who may be contacted, who asked not to be, and which treatment each customer gets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import local_date, per_month
from tillweave.functions.values import is_true


def active_customers(customers: DataFrame) -> DataFrame:
    """Current, active, not deleted customers with a valid email address."""
    return customers.filter(
        F.col("scv_id").isNotNull()
        & (F.col("customer_status") == "Active")
        & (F.col("is_current") == F.lit(True))
        & (F.col("is_deleted") == F.lit(False))
        & (F.col("is_valid_email") == F.lit(True))
    )


def opted_in(preferences: DataFrame, prefs_required: Sequence[str]) -> DataFrame:
    """Distinct customers whose named preferences are all on."""
    for name in prefs_required:
        preferences = preferences.filter(is_true(F.col(name)))
    return preferences.select("scv_id").distinct()


def contactable_customers(customers: DataFrame, preferences: DataFrame, *, prefs_required: Sequence[str]) -> DataFrame:
    """Active customers with the required opt-ins."""
    return active_customers(customers).select("scv_id").distinct().join(opted_in(preferences, prefs_required), "scv_id", "left_semi")


def unsubscribed_customers(sends: DataFrame, communications: DataFrame, clicks: DataFrame, *, word: str = "unsubscribe") -> DataFrame:
    """Customers who clicked a link whose name holds the word (any letter case) in one of the emails sent.

    Only clicks on emails known to the send log count; sends and communications are reduced to their ids before they meet.
    """
    jobs = sends.select("job_id").distinct().join(
        communications.select(F.col("send_id").alias("job_id")).distinct(), "job_id", "left_semi"
    )
    wanted = clicks.filter(F.contains(F.lower("alias"), F.lit(word.lower()))).select("scv_id", F.col("send_id").alias("job_id")).distinct()
    return wanted.join(jobs, "job_id", "left_semi").select("scv_id").distinct()


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the strategy ladder; rates are per 30-day month."""

    # fixed values: the programme's own cut-offs
    high_sales: float = 300
    mid_sales: float = 100
    engaged_visits: float = 1
    engaged_recent_days: int = 30
    engaged_min_transactions: int = 10
    many_partners: int = 4
    frequent_visits: float = 3
    frequent_sales: float = 200
    infrequent_visits: float = 0.5
    infrequent_sales: float = 30
    mid_transactions: float = 1


def _ladder(as_of: dt.date, t: Thresholds) -> dict[str, Column]:
    """Name and condition of the rules, first match wins."""
    partner = F.col("partner_customer") == 1
    stranger = F.col("partner_customer") != 1
    strategy = F.col("strategy_segment")
    lapsed = partner & (F.col("last_2m") == 0)
    visits = per_month(F.col("partner_transactions"), F.col("first_partner_date"), F.col("last_partner_date"))
    spend = per_month(F.col("partner_sales"), F.col("first_partner_date"), F.col("last_partner_date"))
    both_sales = F.coalesce("non_fuel_sales", F.lit(0.0)) + F.coalesce("partner_sales", F.lit(0.0))
    all_spend = per_month(both_sales, F.col("member_since"), F.col("last_earned"))
    all_visits = per_month(F.col("all_transactions"), F.col("member_since"), F.col("last_earned"))
    engaged = (
        (visits >= t.engaged_visits)
        & (F.datediff(F.lit(as_of), "last_partner_date") <= t.engaged_recent_days)
        & (F.col("partner_transactions") >= t.engaged_min_transactions)
    )
    at_risk = F.col("cohort") == "Risk"
    return {
        "lapsed_protect": lapsed & (strategy == "PROTECT"),
        "lapsed_grow": lapsed & (strategy == "GROW"),
        "stranger_protect": stranger & (strategy == "PROTECT"),
        "stranger_grow": stranger & (strategy == "GROW"),
        "stranger_high": stranger & (all_spend >= t.high_sales),
        # no partner test here: also customers of many other partners count as engaged
        "engaged": engaged | (F.col("different_partners") >= t.many_partners) | (visits >= t.frequent_visits) | (spend >= t.frequent_sales),
        "risk_partner": at_risk & partner,
        "risk_stranger": at_risk & stranger,
        "partner_mid": (visits >= t.infrequent_visits) | (spend >= t.infrequent_sales),
        "stranger_mid": stranger & ((all_visits >= t.mid_transactions) | (all_spend > t.mid_sales)),
        "partner_low": partner,
        "stranger_low": stranger,
    }


def segmentation_strategy(
    breadth: DataFrame,
    recency: DataFrame,
    points: DataFrame,
    customers: DataFrame,
    risk: DataFrame,
    reference_sales: DataFrame,
    contactable: DataFrame,
    unsubscribed: DataFrame,
    *,
    as_of: dt.date,
    thresholds: Thresholds = Thresholds(),
    labels: Mapping[str, tuple[str, str]] | None = None,
    others: str = "Others",
    statuses: tuple[str, str] = ("Partner customer", "Non partner customer"),
    run_at: Column | None = None,
) -> DataFrame:
    """Segment and treatment of every partner-programme customer by a first-match ladder, with contact flags.

    ``labels`` gives each rule's (segment, treatment), so the two cannot drift apart; by default both are the rule's name. A
    comparison with a missing figure is not met and falls through to the next rule; who meets none is one of the ``others``.
    ``run_at`` adds the time of the run (``functions.clock.RunClock.stamp``).
    """
    rules = _ladder(as_of, thresholds)
    unknown = set(labels or ()) ^ set(rules) if labels is not None else ()
    if unknown:
        raise ValueError(f"labels and rules differ in {sorted(unknown)[0]}")
    features = (
        breadth.join(
            recency.select(
                "scv_id",
                "last_2m",
                F.col("transactions").alias("partner_transactions"),
                F.col("total_sales").alias("partner_sales"),
                F.col("first_date").alias("first_partner_date"),
                F.col("last_date").alias("last_partner_date"),
            ),
            "scv_id",
            "left",
        )
        .join(points.select("scv_id", F.col("transactions").alias("all_transactions"), "member_since", "last_earned"), "scv_id", "left")
        .join(customers.select("scv_id", "strategy_segment"), "scv_id", "left")
        .join(risk.select("scv_id", "cohort"), "scv_id", "left")
        .join(reference_sales, "scv_id", "left")
        .join(contactable.select("scv_id", F.lit(True).alias("contactable")), "scv_id", "left")
        .join(unsubscribed.select("scv_id", F.lit(1).alias("unsubscribed")), "scv_id", "left")
    )
    matched = F.coalesce(*[F.when(condition, F.lit(i)) for i, condition in enumerate(rules.values())])
    named = [(labels or {}).get(rule, (rule, rule)) for rule in rules]
    segments = F.array(*[F.lit(segment) for segment, _ in named])
    treatments = F.array(*[F.lit(treatment) for _, treatment in named])
    return features.withColumn("rule", matched).select(
        "scv_id",
        F.when(F.col("partner_customer") == 1, statuses[0]).otherwise(statuses[1]).alias("partner_status"),
        F.coalesce(F.get(segments, F.col("rule")), F.lit(others)).alias("segment"),
        F.coalesce(F.get(treatments, F.col("rule")), F.lit(others)).alias("treatment"),
        F.when(F.col("contactable"), "Contactable").otherwise("Non contactable").alias("contactability"),
        F.coalesce("unsubscribed", F.lit(0)).alias("unsubscribed"),
        *([] if run_at is None else [run_at.alias("model_run_at")]),
    )


def lifecycle_audience(
    customers: DataFrame,
    preferences: DataFrame,
    partner_txns: DataFrame,
    seeds: DataFrame,
    *,
    as_of: dt.date,
    partner_id: str,
    seed_partner_id: str,
    prefs_required: Sequence[str],
    campaign_id: str,
    execution_id: str,
    zone: str,
    tenure_months: int = 2,
    seed_source: str | None = None,
) -> DataFrame:
    """Tenured, opted-in customers who never dealt with the partner, plus the partner's seed list (of ``seed_source``,
    default: of any), with campaign columns.

    The list of partner customers holds no NULL, so "not in" is an anti-join.
    """
    joined = local_date(F.col("created_at"), zone)
    tenured = active_customers(customers).filter(joined <= F.add_months(F.lit(as_of), -tenure_months)).select("scv_id").distinct()
    buyers = partner_txns.filter(F.col("scv_id").isNotNull() & (F.col("partner_id") == partner_id)).select("scv_id").distinct()
    fresh = tenured.join(buyers, "scv_id", "left_anti").join(opted_in(preferences, prefs_required), "scv_id", "left_semi")
    seeded = seeds.filter((F.lit(True) if seed_source is None else F.col("list_source") == seed_source) & (F.col("partner_id") == seed_partner_id)).select("scv_id")
    return (
        fresh.unionByName(seeded)
        .distinct()
        .select("scv_id", F.lit(campaign_id).alias("campaign_id"), F.lit(execution_id).alias("execution_id"), F.lit(" ").alias("segment"))
    )
