"""The seasonal report: planned articles around the event, this year against last year, with article and vendor."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tillweave.operators import seasonal
from tillweave.sources.staging import stage


def seasonal_report(
    plan: DataFrame,
    facts: DataFrame,
    dim_date: DataFrame,
    articles: DataFrame,
    article_sites: DataFrame,
    *,
    as_of: dt.date,
    sales_org: str,
    holiday: str = "Christmas Day",
    attributes: Sequence[str] = ("article_name", "department", "category", "sub_category", "segment"),
) -> DataFrame:
    """Days around the event with both years' figures, running totals, article attributes and one vendor per article.

    Articles unknown to the article master drop out; a missing vendor does not. The dense scaffold, which both years and
    the is-TY bound read, is staged.
    """
    plan_weeks = seasonal.explode_week_ranges(plan)
    scaffold = stage(
        seasonal.days_to_event(plan_weeks, facts, dim_date, as_of=as_of, holiday=holiday, sales_org=sales_org), "season-scaffold"
    )
    vendors = seasonal.first_vendor_per_article(article_sites, sales_org=sales_org).select("article_id", "vendor_description")
    return (
        seasonal.ty_ly_aligned(scaffold, plan_weeks, as_of=as_of)
        .join(articles.select("article_id", *attributes).distinct(), "article_id")
        .join(vendors, "article_id", "left")
    )
