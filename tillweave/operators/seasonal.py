"""Seasonal plans and the alignment of this year's and last year's days around an event."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.dates import add_weeks, ascending_range
from tillweave.functions.values import two_digits


def explode_week_ranges(plan: DataFrame) -> DataFrame:
    """Plan rows ``[start week, finish week]`` as one row per article and two-digit week, purchases summed."""
    weeks = plan.withColumn("week", F.explode(ascending_range(F.col("start_week"), F.col("finish_week"))))
    return weeks.groupBy("article_id", two_digits(F.col("week")).alias("week")).agg(
        F.sum("ty_purchase").alias("ty_purchase"), F.sum("ly_purchase").alias("ly_purchase")
    )


def event_calendar(dim_date: DataFrame, *, as_of: dt.date, holiday: str = "Christmas Day") -> DataFrame:
    """Days of this and last financial year with their signed distance to each year's event.

    Last year is the financial year of 365 days ago. Years and event dates are scalar subqueries on the calendar.
    """

    def year_of(day: dt.date):
        return dim_date.filter(F.col("date") == F.lit(day)).agg(F.max("financial_year")).scalar()

    this_year, last_year = year_of(as_of), year_of(as_of - dt.timedelta(days=365))

    def event_in(year):
        held = dim_date.filter((F.col("holiday_name") == holiday) & (F.col("financial_year") == year))
        return held.agg(F.max("date")).scalar()

    year = F.col("financial_year")
    return dim_date.filter((year == this_year) | (year == last_year)).select(
        "date",
        "financial_year",
        "pel_week",
        two_digits(F.col("week_of_financial_year")).alias("week"),
        F.datediff("date", event_in(this_year)).alias("days_out_ty"),
        F.datediff("date", event_in(last_year)).alias("days_out_ly"),
        (year == this_year).alias("is_this_year"),
        (year == last_year).alias("is_last_year"),
    )


def days_to_event(
    plan_weeks: DataFrame,
    facts: DataFrame,
    dim_date: DataFrame,
    *,
    as_of: dt.date,
    holiday: str = "Christmas Day",
    weeks: int = 106,
    sales_org: str | None = None,
    excluded_articles: Sequence[str] = (),
) -> DataFrame:
    """Every planned article on every day of its planned weeks, this and last year, with its sales where there are any.

    The scaffold is dense: days without sales stay, with NULL measures. Facts older than ``weeks``, of ``excluded_articles``
    (default: none) or of articles that no week plans are not aggregated.
    """
    recent = facts.filter((F.col("calendar_day") > add_weeks(F.lit(as_of), -weeks)) & ~F.col("article_id").isin(list(excluded_articles)))
    if sales_org is not None:
        recent = recent.filter(F.col("sales_org") == sales_org)
    recent = recent.join(plan_weeks.select("article_id").distinct(), "article_id", "left_semi")
    daily = recent.groupBy("article_id", F.col("calendar_day").alias("date")).agg(
        F.sum("interim_gp").alias("interim_gp"), F.sum("quantity").alias("quantity"), F.sum("sales").alias("sales")
    )
    scaffold = plan_weeks.select("article_id", "week").distinct().join(event_calendar(dim_date, as_of=as_of, holiday=holiday), "week")
    return scaffold.join(daily, ["article_id", "date"], "left").select(
        "article_id", "date", "financial_year", "pel_week", "week", "days_out_ty", "days_out_ly", "is_this_year", "is_last_year",
        "interim_gp", "quantity", "sales",
    )


def ty_ly_aligned(scaffold: DataFrame, plan_weeks: DataFrame, *, as_of: dt.date) -> DataFrame:
    """This year and last year side by side by article and days to the event, with running quantities and an is-TY flag.

    Days that exist in one year only stay (a last-year row then lends its date and days-out). The running totals share one
    value among equal order keys. ``is_ty`` marks days before ``as_of`` not further on than yesterday's days-out.
    """
    measures = ["sales", "quantity", "interim_gp"]
    this = scaffold.filter("is_this_year AND days_out_ty IS NOT NULL").select(
        "article_id", F.col("days_out_ty").alias("days_out"),
        *[F.col(c).alias(f"{c}_a") for c in ("date", "week", "financial_year", "pel_week")],
        *[F.col(m).alias(f"ty_{m}") for m in measures],
    )
    last = scaffold.filter("is_last_year AND days_out_ly IS NOT NULL").select(
        "article_id", F.col("days_out_ly").alias("days_out"), F.col("days_out_ly"),
        *[F.col(c).alias(f"{c}_b") for c in ("date", "week", "financial_year", "pel_week")],
        *[F.col(m).alias(f"ly_{m}") for m in measures],
    )
    both = this.join(last, ["article_id", "days_out"], "full").select(
        "article_id",
        "days_out",
        "days_out_ly",
        *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("date", "week", "financial_year", "pel_week")],
        F.col("date_a").isNotNull().alias("from_this_year"),
        *[f"ty_{m}" for m in measures],
        *[f"ly_{m}" for m in measures],
    )
    yesterday = scaffold.filter(F.col("is_this_year") & (F.col("date") == F.date_sub(F.lit(as_of), 1))).agg(F.max("days_out_ty")).scalar()
    by_day = Window.partitionBy("article_id", "financial_year").orderBy("date")
    by_days_out = Window.partitionBy("article_id").orderBy("days_out")
    planned = both.join(plan_weeks, ["article_id", "week"])
    return planned.select(
        "article_id", "days_out", "days_out_ly", "date", "week", "financial_year", "pel_week",
        *[f"ty_{m}" for m in measures], "ty_purchase",
        *[f"ly_{m}" for m in measures], "ly_purchase",
        F.sum(F.when(F.col("from_this_year"), F.col("ty_quantity"))).over(by_day).alias("cumulative_ty"),
        F.sum("ly_quantity").over(by_days_out).alias("cumulative_ly"),
        F.coalesce((F.col("days_out") <= yesterday) & (F.col("date") < F.lit(as_of)), F.lit(False)).alias("is_ty"),
    )


def first_vendor_per_article(article_sites: DataFrame, *, sales_org: str) -> DataFrame:
    """One vendor per article: the lowest vendor code of the sales organisation, then the lowest name."""
    vendor = F.struct("vendor_code", "vendor_description")
    return (
        article_sites.filter(F.col("sales_org") == sales_org)
        .groupBy("article_id")
        .agg(F.min(vendor).alias("vendor"))
        .select("article_id", "vendor.vendor_code", "vendor.vendor_description")
    )


def planned_articles(plan: DataFrame, *, first_week: int, last_week: int) -> DataFrame:
    """Distinct articles planned in at least one of the weeks ``first_week`` to ``last_week``.

    A plan row without a week (it ends before it starts, or an end is missing) plans nothing.
    """
    touches = (F.col("start_week") <= F.col("finish_week")) & (F.col("start_week") <= last_week) & (F.col("finish_week") >= first_week)
    return plan.filter(touches).select("article_id").distinct()


def latest_vendor_per_article(article_sites: DataFrame, *, sales_org: str, planned: DataFrame | None = None) -> DataFrame:
    """One vendor per article: the one supplying until the latest date, then the highest code.

    Only articles in ``planned`` count (default: all). The semi-join and the aggregation work on one partitioning, unless
    the planned articles are few enough to be broadcast.
    """
    vendor = F.struct("valid_to", "vendor_code", "vendor_description")
    supplied = article_sites.filter(F.col("sales_org") == sales_org)
    if planned is not None:
        supplied = supplied.join(planned.select("article_id"), "article_id", "left_semi")
    return (
        supplied.groupBy("article_id")
        .agg(F.max(vendor).alias("vendor"))
        .select("article_id", "vendor.vendor_code", "vendor.vendor_description", "vendor.valid_to")
    )
