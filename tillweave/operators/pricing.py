"""Prices from several sources, and how they compare."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.dates import add_weeks, reporting_week_end, sunday_week_start
from tillweave.functions.values import is_false, is_true
from tillweave.operators.frequent import merged_summaries, most_frequent, value_summaries


def article_units(uoms: DataFrame, *, current: str | None = None) -> DataFrame:
    """One row per article and unit of measure from the nested unit list; articles without units drop out.

    With ``current``, the name of a flag of the list's entries, only entries that have it count.
    """
    units = uoms.select("article_id", F.inline("uom"))
    return _current(units, current).select("article_id", "unit_of_measure", "pack_size")


def _current(rows: DataFrame, flag: str | None) -> DataFrame:
    """Rows whose ``flag`` is true; all without a flag."""
    return rows if flag is None else rows.filter(is_true(F.col(flag)))


def _named(name: Column, contains: Sequence[str], prefixes: Sequence[str]) -> Column:
    condition = F.lit(False)
    for text in contains:
        condition = condition | F.contains(name, F.lit(text))
    for text in prefixes:
        condition = condition | (F.left(name, F.lit(len(text))) == text)
    return condition


def current_price_list(
    price_history: DataFrame,
    stores: DataFrame,
    *,
    orgs: Sequence[str],
    banner_contains: Sequence[str] = (),
    banner_prefixes: Sequence[str] = (),
    excluded_word: str = "Test",
    attributes: Sequence[str] = (),
) -> DataFrame:
    """Price with the latest validity per organisation, site and article, for stores of the named banners.

    Equal validity ends go to the later start, then the higher price, then the unit in text order, then the ``attributes``
    (further columns of the price, e.g. its list and life-cycle status), highest first.
    """
    name = F.col("store_name")
    banner = stores.filter(_named(name, banner_contains, banner_prefixes) & ~F.contains(name, F.lit(excluded_word)))
    usable = price_history.filter(
        F.col("purchase_cost").isNotNull()
        & F.col("valid_to").isNotNull()
        & F.col("valid_from").isNotNull()
        & F.col("sales_org").isin(list(orgs))
    )
    latest = F.max(F.struct("valid_to", "valid_from", "sell_price", "unit_of_measure", *attributes)).alias("price")
    return (
        usable.join(banner.select(F.col("store_id").alias("site")).distinct(), "site", "left_semi")
        .groupBy("sales_org", "site", "article_id")
        .agg(latest)
        .select("sales_org", "site", "article_id", "price.unit_of_measure", F.col("price.sell_price").alias("rrp"), "price.valid_from", "price.valid_to", *[f"price.{a}" for a in attributes])
    )


def _ordinary_stores(stores: DataFrame) -> DataFrame:
    return stores.filter(is_false(F.col("is_metro_store")) & is_false(F.col("is_neighbourhood_store")))


def modal_shelf_price(
    store_articles: DataFrame,
    stores: DataFrame,
    uoms: DataFrame,
    *,
    as_of: dt.date,
    price: Column | None = None,
    flags: Sequence[str] = ("is_clearance", "is_multibuy", "is_great_price"),
    excluded_categories: Sequence[str] = (),
    districts: Sequence[str] | None = None,
    active: str | None = None,
) -> DataFrame:
    """Most frequent price per article in the reporting week, over ordinary stores, by selling unit and promotion flags.

    With ``active``, the name of a flag, only rows of stores that are active then count.

    Frequencies are exact; equal ones go to the higher price (a missing one comes last), then to the first unit and the first flags.
    ``price`` defaults to the shelf price.
    """
    price = F.col("shelf_price") if price is None else price
    chosen = _ordinary_stores(stores)
    if districts is not None:
        chosen = chosen.filter(F.col("district_id").isin(list(districts)))
    rows = _current(store_articles, active).filter(
        (is_true(F.col("is_new")) | is_true(F.col("is_ranged")))
        & (F.col("financial_week_end_date") == reporting_week_end(F.lit(as_of)))
        & ~F.col("category").isin(list(excluded_categories))
    )
    # counted before the units join in: an article has few prices, however many stores sell it
    counted = (
        rows.join(chosen.select("store_id").distinct(), "store_id", "left_semi")
        .groupBy("article_id", "unit_of_measure", "financial_week_end_date", *flags, price.alias("price"))
        .agg(F.count(F.lit(1)).alias("stores"))
        .join(article_units(uoms), ["article_id", "unit_of_measure"])
    )
    row = F.struct("pack_size", "unit_of_measure", "financial_week_end_date", *flags, "price", "stores")
    order = F.struct(-F.col("stores"), F.col("price").isNull(), -F.col("price"), "unit_of_measure", "pack_size", *flags)
    return counted.groupBy("article_id").agg(F.min_by(row, order).alias("top")).select("article_id", "top.*")


def weekly_price_summaries(
    store_articles: DataFrame,
    stores: DataFrame,
    *,
    price: str = "shelf_price",
    items: int = 256,
    excluded_categories: Sequence[str] = (),
    active: str | None = None,
) -> DataFrame:
    """Summary of the prices of each article, unit and reporting week over ordinary stores (see ``operators.frequent``).

    One row per article, unit and week, whatever the number of stores: what a job would store each week, to be merged later.
    """
    rows = _current(store_articles, active).filter(
        (is_true(F.col("is_new")) | is_true(F.col("is_ranged"))) & ~F.col("category").isin(list(excluded_categories))
    ).join(_ordinary_stores(stores).select("store_id").distinct(), "store_id", "left_semi")
    return value_summaries(rows, ["article_id", "unit_of_measure", "financial_week_end_date"], price, items=items)


def approx_modal_price(summaries: DataFrame, *, as_of: dt.date, weeks: int = 13, items: int = 256) -> DataFrame:
    """Most frequent price per article and unit over the last ``weeks`` reporting weeks, from their stored summaries, with bounds.

    See ``frequent.most_frequent``: the true count of ``price`` lies between ``at_least`` and ``at_most``, and the true modal
    price between ``low`` and ``high``.
    """
    last = reporting_week_end(F.lit(as_of))
    keys = ["article_id", "unit_of_measure"]
    recent = summaries.filter(F.col("financial_week_end_date").between(add_weeks(last, 1 - weeks), last))
    return most_frequent(merged_summaries(recent, keys, items=items), keys, items=items).withColumnRenamed("value", "price")


def recommended_price(
    prices: DataFrame,
    stores: DataFrame,
    articles: DataFrame,
    uoms: DataFrame,
    *,
    sales_org: str,
    districts: Sequence[str],
    excluded_categories: Sequence[str] = (),
    excluded_stores: Sequence[str] = (),
    closed_mark: str | None = None,
    current: str | None = None,
) -> DataFrame:
    """Price with the latest start per article and unit; equal starts go to the price most stores have, then the higher.

    Ordinary, physical stores of the given districts count; those whose name holds ``closed_mark`` (default: none) do not.
    ``current`` names the flag that marks the current version of a store, an article and a unit (default: all rows count).
    """
    chosen = _ordinary_stores(_current(stores, current)).filter(
        is_false(F.col("is_online_store"))
        & ~F.col("store_id").isin(list(excluded_stores))
        & F.col("district_id").isin(list(districts))
        & (F.lit(True) if closed_mark is None else ~F.contains("store_name", F.lit(closed_mark)))
    )
    kept_articles = _current(articles, current).filter(~F.col("category").isin(list(excluded_categories))).select("article_id").distinct()
    counted = (
        prices.filter(F.col("sales_org") == sales_org)
        .join(chosen.select(F.col("store_id").alias("site")).distinct(), "site", "left_semi")
        .groupBy("article_id", "unit_of_measure", "sell_price", "valid_from")
        .agg(F.count("sell_price").alias("stores"))
        .join(kept_articles, "article_id", "left_semi")
        .join(article_units(uoms, current=current), ["article_id", "unit_of_measure"])
    )
    best = F.max(F.struct("valid_from", "stores", "sell_price", "pack_size")).alias("best")
    return (
        counted.groupBy("article_id", "unit_of_measure")
        .agg(best)
        .select("article_id", "best.pack_size", "unit_of_measure", F.col("best.sell_price").alias("price"), "best.stores")
    )


def latest_wholesale_cost(
    purchases: DataFrame, dim_date: DataFrame, uoms: DataFrame, *, tax: float = 1.15, attributes: Sequence[str] = ("sourcing_dc",)
) -> DataFrame:
    """Unit cost and price of each article's latest invoice (then lowest charge), with tax, rounded to cents, and the invoice's
    ``attributes``.

    The unit of measure is the article's first in text order, as the invoice does not name one.
    """
    weeks = dim_date.select(F.col("date").alias("invoice_date"), "financial_week_end_date")
    units = article_units(uoms).groupBy("article_id").agg(F.min("unit_of_measure").alias("unit_of_measure"))

    def per_unit(column: str) -> Column:
        return F.try_divide(F.try_divide(F.col(column), F.col("multiple_despatched")), F.col("order_multiple").cast("double"))

    def in_cents(column: str) -> Column:
        # six digits first: half a cent must not be lost to the binary representation
        return F.round(F.round(F.col(column) * tax, 6), 2)

    invoices = purchases.filter(F.col("base_cost") != 0).select(
        "article_id", "invoice_date", "cost_charge", "store_id", *attributes,
        per_unit("cost_charge").alias("cost_price"), per_unit("base_cost").alias("unit_price"),
    )
    row = F.struct("invoice_date", *attributes, "cost_price", "unit_price")
    order = F.struct(-F.unix_date("invoice_date"), "cost_charge", "store_id", "cost_price", "unit_price", *attributes)
    latest = invoices.groupBy("article_id").agg(F.min_by(row, order).alias("last")).select("article_id", "last.*")
    return (
        latest.join(units, "article_id")
        .join(weeks, "invoice_date", "left")
        .select(
            "article_id", "unit_of_measure", "financial_week_end_date", *attributes,
            in_cents("cost_price").alias("wholesale_cost_price"),
            in_cents("unit_price").alias("wholesale_unit_price"),
        )
    )


def latest_pos_price(
    lines: DataFrame, uoms: DataFrame, *, as_of: dt.date, excluded_categories: Sequence[str] = (), time: str | None = None
) -> DataFrame:
    """Last store till row per article and store of the reporting week, with the week's totals.

    One week only is read, so totals "running by week" are plain totals. Returns and online orders are left out. Rows of
    the same day go by the column ``time`` (the time of day; default: none), then by receipt (longer numbers are higher), unit
    and price.
    """
    rows = lines.filter(
        is_false(F.col("is_online_order"))
        & (F.col("return_reason_id") == "")
        & (F.col("financial_week_end_date") == reporting_week_end(F.lit(as_of)))
        & ~F.col("category").isin(list(excluded_categories))
    )
    totals = ("total_discount", "gst_excluded_amount", "quantity")
    clock = () if time is None else (time,)
    last = F.struct(
        "receipt_date", *clock, F.length("receipt_id").alias("digits"), "receipt_id", "unit_of_measure", "unit_price_paid", "retail_price", "financial_week_end_date"
    )
    by_unit = (
        rows.groupBy("article_id", "store_id", "unit_of_measure")
        .agg(F.max(last).alias("last"), *[F.sum(t).alias(t) for t in totals])
        .join(article_units(uoms), ["article_id", "unit_of_measure"])
    )
    return (
        by_unit.groupBy("article_id", "store_id")
        .agg(F.max(F.struct("last", "pack_size")).alias("top"), *[F.sum(t).alias(t) for t in totals])
        .select(
            "article_id", "store_id", "top.last.unit_of_measure", "top.pack_size", "top.last.receipt_date",
            "top.last.financial_week_end_date", "top.last.unit_price_paid", "top.last.retail_price", *totals,
        )
    )


def trailing_sales(lines: DataFrame, uoms: DataFrame, *, as_of: dt.date, weeks: int = 13) -> DataFrame:
    """Sales per article, store and unit over the last ``weeks`` reporting weeks."""
    last = sunday_week_start(F.lit(as_of))
    return (
        lines.filter(F.col("financial_week_end_date").between(add_weeks(last, 1 - weeks), last))
        .groupBy("article_id", "store_id", "unit_of_measure")
        .agg(F.sum("gst_excluded_amount").alias("trailing_sales"))
        .join(article_units(uoms).select("article_id", "unit_of_measure"), ["article_id", "unit_of_measure"], "left_semi")
        .select("article_id", "store_id", "unit_of_measure", "trailing_sales")
    )


def price_comparison_report(
    price_list: DataFrame,
    pos_prices: DataFrame,
    shelf_prices: DataFrame,
    recommended: DataFrame,
    wholesale: DataFrame,
    trailing: DataFrame,
    articles: DataFrame,
    stores: DataFrame,
    price_families: DataFrame,
    price_promises: DataFrame,
    *,
    excluded_categories: Sequence[str] = (),
    excluded_sub_categories: Sequence[str] = (),
    article_attributes: Sequence[str] = ("article_name", "price_family_id", "department", "category", "sub_category", "segment"),
    store_attributes: Sequence[str] = ("store_name",),
) -> DataFrame:
    """One row per site and article of the price list with every other price source beside it, and the hand-kept flags.

    All columns of the price list and of the wholesale prices come along, and the named ones of articles and stores (the
    article's price family must be one). Articles unknown to the article master drop out, as do the excluded categories. All
    other sources are optional.
    """
    unit = ["article_id", "unit_of_measure"]
    shelf_columns = [c for c in shelf_prices.columns if c.startswith("is_")]
    primary = price_families.filter(F.col("price_family_id").isNotNull()).select("price_family_id", "primary_line").distinct()
    promised = price_promises.select("article_id", "price_promise").distinct()
    master = articles.filter(
        ~F.col("category").isin(list(excluded_categories)) & ~F.col("sub_category").isin(list(excluded_sub_categories))
    ).select("article_id", *article_attributes)
    # narrow sources first: the names and descriptions of articles and stores go through no shuffle but their own
    narrow = (
        price_list.withColumnRenamed("site", "store_id")
        .join(
            pos_prices.select(
                *unit, "store_id", "pack_size", "retail_price", "receipt_date", F.col("financial_week_end_date").alias("pos_week_end_date")
            ),
            [*unit, "store_id"],
            "left",
        )
        .join(trailing, [*unit, "store_id"], "left")
        .join(
            shelf_prices.select(*unit, F.col("price").alias("shelf_price"), F.col("financial_week_end_date").alias("shelf_week_end_date"), *shelf_columns),
            unit,
            "left",
        )
        .join(recommended.select(*unit, F.col("price").alias("recommended_price")), unit, "left")
        .join(wholesale.drop("financial_week_end_date"), unit, "left")
    )
    report = (
        narrow.join(promised, "article_id", "left")
        .join(master, "article_id")
        .join(primary, "price_family_id", "left")
        .join(stores.select("store_id", *store_attributes), "store_id", "left")
    )
    described = [c for c in article_attributes if c != "price_family_id"]
    listed = [c for c in price_list.columns if c not in ("site", *unit)]
    found = [c for c in narrow.columns if c not in ("store_id", *unit, *listed)]
    keys = ["store_id", "article_id", "price_family_id", "unit_of_measure"]
    report = report.select(*keys, *listed, *described, *found, "primary_line", "price_promise", *store_attributes)
    return report.withColumns(
        {"primary_line": F.coalesce("primary_line", F.lit("N")), "price_promise": F.coalesce("price_promise", F.lit("N"))}
    )


def price_source_reconcile(source_a: DataFrame, source_b: DataFrame, keys: Sequence[str] = ("article_id", "unit_of_measure")) -> DataFrame:
    """Compare two price sources on their keys: missing on either side, different price, different count, or match."""

    def side(source: DataFrame, name: str) -> DataFrame:
        return source.select(
            *keys,
            F.col("pack_size").alias(f"pack_size_{name}"),
            F.col("price").cast("double").alias(f"price_{name}"),
            F.col("stores").alias(f"stores_{name}"),
            F.lit(True).alias(f"in_{name}"),
        )

    return (
        side(source_a, "a")
        .join(side(source_b, "b"), list(keys), "full")
        .select(
            *keys,
            F.coalesce("pack_size_a", "pack_size_b").alias("pack_size"),
            "price_a",
            "price_b",
            "stores_a",
            "stores_b",
            F.when(F.col("in_a").isNull(), "missing in a")
            .when(F.col("in_b").isNull(), "missing in b")
            .when(F.col("price_a") != F.col("price_b"), "price mismatch")
            .when(F.col("stores_a") != F.col("stores_b"), "count mismatch")
            .otherwise("match")
            .alias("difference"),
        )
    )
