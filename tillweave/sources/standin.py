"""The library's logical inputs, derived from the driver tables.

Each method gives one logical table (see ``FIXTURES.md``). NULL and blank ids are put in on purpose, because the operators
have to tell them apart.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.sources.tables import TableBook

FIRST_DAY = dt.date(1995, 1, 1)
CALENDAR_DAYS = 2557
FIRST_OFFER_START = dt.date(1997, 1, 6)
AS_OF = dt.date(2001, 8, 2)
SEASON_AS_OF = dt.date(2001, 6, 15)


def _text(name: str):
    return F.col(name).cast("string")


def _middle_levels():
    """Category and sub-category of an article, between its department and its segment."""
    category = F.concat(F.lit("Range "), F.floor(F.col("p_size") / 10).cast("string"))
    return category.alias("category"), F.element_at(F.split("p_name", " "), -1).alias("sub_category")


def _once(build: Callable[[StandIn], DataFrame]) -> Callable[[StandIn], DataFrame]:
    """Build a logical table once per instance, so that every use shares one plan."""

    @functools.wraps(build)
    def get(self: StandIn) -> DataFrame:
        if build.__name__ not in self.built:
            self.built[build.__name__] = build(self)
        return self.built[build.__name__]

    return get


class StandIn:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.tables = TableBook(spark, directory)
        self.built: dict[str, DataFrame] = {}

    @_once
    def dim_date(self) -> DataFrame:
        n = F.col("id")
        year = F.floor((n + 183) / 365.25)
        day = F.date_add(F.lit(FIRST_DAY), n.cast("int"))
        monday = F.date_add(F.lit(FIRST_DAY), (F.floor((n - 1) / 7) * 7 + 1).cast("int"))
        financial_year = (year + 1995).cast("int")
        financial_week = F.floor((n + 183 - year * 365.25) / 7).cast("int") + 1
        return self.spark.range(CALENDAR_DAYS).select(
            day.alias("date"),
            F.date_format(day, "yyyyMMdd").alias("date_key"),
            F.year(day).alias("calendar_year"),
            financial_year.alias("financial_year"),
            financial_week.alias("week_of_financial_year"),
            (financial_year * 100 + financial_week).alias("financial_period_week"),
            monday.alias("financial_week_start_date"),
            F.date_add(monday, 6).alias("financial_week_end_date"),
            (F.floor((n - 1) / 7).cast("int") + 1000).alias("pel_week"),
            F.when((F.month(day) == 12) & (F.day(day) == 25), "Christmas Day").alias("holiday_name"),
        )

    @_once
    def _receipts(self) -> DataFrame:
        online = F.col("o_orderstatus") == "O"
        return self.tables["orders"].select(
            "o_orderkey",
            F.to_date("o_orderdate").alias("receipt_date"),
            F.when(F.col("o_orderpriority") == "5-LOW", None)
            .when(F.col("o_orderkey") % 11 == 0, "")
            .otherwise(_text("o_custkey"))
            .alias("scv_id"),
            online.alias("is_online_order"),
            (F.col("o_orderkey") % 5 != 0).alias("is_online_order_completed"),
            F.when(online, F.concat(F.lit("C"), _text("o_orderkey"))).otherwise("").alias("commercial_id"),
        )

    def _with_lines(self, receipts: DataFrame, *more: str) -> DataFrame:
        """Lines of the receipts, with ``more`` of their columns."""
        joined = self.tables["lineitem"].join(receipts, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            _text("l_orderkey").alias("receipt_id"),
            _text("l_partkey").alias("article_id"),
            _text("l_suppkey").alias("store_id"),
            "scv_id",
            "is_online_order",
            "is_online_order_completed",
            "commercial_id",
            "receipt_date",
            F.date_sub("receipt_date", (F.col("l_orderkey") % 3).cast("int")).alias("online_order_date"),
            F.col("l_extendedprice").alias("gst_included_amount"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price_paid"),
            "l_returnflag",
            "l_linestatus",
            "l_linenumber",
            *more,
        )

    @_once
    def lines(self) -> DataFrame:
        return self._with_lines(self._receipts())

    @_once
    def _dated_lines(self) -> DataFrame:
        """Lines with their financial week. The receipts meet the calendar first, so a filter on weeks cuts them before the lines join."""
        weeks = self.dim_date().select(F.col("date").alias("receipt_date"), "financial_week_start_date", "financial_week_end_date")
        return self._with_lines(self._receipts().join(weeks, "receipt_date"), "financial_week_start_date", "financial_week_end_date")

    @_once
    def headers(self) -> DataFrame:
        """One row per receipt; an order has one row, so its lines are summed before they meet it."""
        totals = self.tables["lineitem"].groupBy("l_orderkey").agg(
            F.sum("l_extendedprice").alias("gst_included_amount"), F.sum("l_quantity").alias("quantity")
        )
        return totals.join(self._receipts(), F.col("l_orderkey") == F.col("o_orderkey")).select(
            _text("l_orderkey").alias("receipt_id"),
            "commercial_id",
            "scv_id",
            "receipt_date",
            "is_online_order",
            "gst_included_amount",
            "quantity",
        )

    @_once
    def offers(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.tables["region"].select(
            _text("r_regionkey").alias("offer_id"),
            F.concat(F.lit("SKU|"), F.col("r_name"), F.lit("|x")).alias("offer_name"),
            F.lit("CAMP-1").alias("campaign_code"),
            F.date_add(F.lit(FIRST_OFFER_START), (key * 168).cast("int")).alias("offer_start_date"),
            F.when(key < 3, "Expired").otherwise("Active").alias("offer_status_description"),
            F.lit(True).alias("is_current"),
        )

    @_once
    def _customers_by_region(self) -> DataFrame:
        return self.tables["customer"].join(self.tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))

    @_once
    def allocations(self) -> DataFrame:
        start = F.lit(FIRST_OFFER_START)
        shift = F.col("n_regionkey") * 168
        return self._customers_by_region().select(
            _text("n_regionkey").alias("offer_id"),
            _text("c_custkey").alias("scv_id"),
            F.date_add(start, (shift + F.col("c_custkey") % 3).cast("int")).alias("allocation_start"),
            F.date_add(start, (shift + 83).cast("int")).alias("allocation_end"),
            F.when(F.col("c_custkey") % 10 == 9, "Inactive").otherwise("Active").alias("allocation_status"),
        )

    @_once
    def brand_articles(self) -> DataFrame:
        return self.tables["part"].select(
            (F.col("p_partkey") % 5).cast("string").alias("offer_id"),
            F.col("p_type").alias("brand"),
            _text("p_partkey").alias("article_id"),
            F.col("p_name").alias("article_description"),
        )

    @_once
    def rewards(self) -> DataFrame:
        lines = self.lines().filter((F.col("l_returnflag") == "R") & (F.col("scv_id") != ""))
        offers = self.offers().select("offer_id", "offer_start_date")
        articles = self.brand_articles().select("offer_id", "article_id").join(offers, "offer_id")
        in_window = F.col("receipt_date").between(F.col("offer_start_date"), F.date_add("offer_start_date", 83))
        return (
            lines.join(articles, "article_id")
            .filter(in_window)
            .select(
                "offer_id",
                "scv_id",
                "receipt_id",
                "article_id",
                "store_id",
                F.col("receipt_date").alias("redemption_date"),
                "quantity",
                F.col("quantity").alias("base_points_earn"),
                (F.col("quantity") * 100).alias("bonus_points_earn"),
                (F.col("quantity") * 2).alias("reward_value"),
                F.col("gst_included_amount").alias("total_item_sales_amount"),
            )
        )

    @_once
    def activations(self) -> DataFrame:
        return (
            self._customers_by_region()
            .filter(F.col("c_acctbal") > 0)
            .select(_text("c_custkey").alias("scv_id"), _text("n_regionkey").alias("offer_id"))
        )

    @_once
    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.tables["customer"].select(
            _text("c_custkey").alias("scv_id"),
            F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("segment_group"),
            F.when(key % 3 == 0, "PROTECT").when(key % 3 == 1, "GROW").otherwise("OTHER").alias("strategy_segment"),
            (key % 100).cast("string").alias("preferred_store_id"),
            F.when(key % 7 != 0, (key % 100).cast("string")).alias("main_store_id"),
            F.when(key % 8 == 0, "Closed").otherwise("Active").alias("customer_status"),
            F.lit(True).alias("is_current"),
            F.lit(False).alias("is_deleted"),
            (key % 6 != 0).alias("is_valid_email"),
            F.timestamp_add("DAY", -(key % 365).cast("int"), F.to_timestamp(F.lit("2001-08-02 13:00:00"))).alias("created_at"),
        )

    @_once
    def preferences(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.tables["customer"].select(
            _text("c_custkey").alias("scv_id"),
            (key % 4 != 0).alias("allow_all"),
            (key % 5 != 0).alias("allow_partner"),
        )

    @_once
    def feature_history(self) -> DataFrame:
        dated = self.allocations().select("scv_id", F.col("allocation_start").alias("at_date"))
        return dated.join(self.customers().select("scv_id", "segment_group"), "scv_id")

    @_once
    def risk_cohort(self) -> DataFrame:
        return self.tables["customer"].select(
            _text("c_custkey").alias("scv_id"), F.when(F.col("c_acctbal") < 0, "Risk").otherwise("Stable").alias("cohort")
        )

    @_once
    def partners(self) -> DataFrame:
        return self.tables["nation"].select(
            _text("n_nationkey").alias("partner_id"), F.concat("n_name", F.lit("_NZ")).alias("partner_name")
        )

    @_once
    def partner_transactions(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return (
            self.lines()
            .filter(F.col("scv_id") != "")
            .select(
                F.when(F.col("l_linestatus") == "F", "fuel").otherwise("shop").alias("source"),
                "scv_id",
                _text("l_linenumber").alias("partner_id"),
                "receipt_id",
                F.when(flag == "A", "Base").when(flag == "R", "Bonus").otherwise("cpl discount").alias("redemption_type"),
                (F.col("l_linenumber") == 5).alias("behaviour_offer"),
                F.col("receipt_date").alias("txn_date"),
                F.col("quantity").alias("base_points"),
                (F.col("quantity") * 10).alias("bonus_points"),
                F.col("gst_included_amount").alias("sales"),
                "quantity",
                (F.col("gst_included_amount") * 0.05).alias("discount"),
            )
        )

    @_once
    def seeds(self) -> DataFrame:
        return self.tables["supplier"].select(
            F.concat(F.lit("seed-"), _text("s_suppkey")).alias("scv_id"),
            F.when(F.col("s_acctbal") > 0, "Partner Seed List").otherwise("Other").alias("list_source"),
            (F.col("s_nationkey") % 3).cast("string").alias("partner_id"),
        )

    @_once
    def sites(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.tables["supplier"].select(
            _text("s_suppkey").alias("site_id"),
            F.col("s_name").alias("site_name"),
            F.when(key % 2 == 0, "STORE").otherwise("FUEL").alias("site_type"),
            (F.lit(-36.5) - (key % 97).cast("double") / 25).alias("lat"),
            (F.lit(174.0) + (key % 89).cast("double") / 25).alias("lon"),
        )

    @_once
    def stores(self) -> DataFrame:
        key, nation = F.col("s_suppkey"), F.col("s_nationkey")
        name = F.when(nation < 8, "GreenCart ").when(nation < 14, "ValueBarn ").when(nation < 16, "Test GreenCart ").otherwise("Mainway ")
        return self.tables["supplier"].select(
            _text("s_suppkey").alias("store_id"),
            F.concat(name, _text("s_suppkey")).alias("store_name"),
            F.when(nation < 12, "UPPER").otherwise("LOWER").alias("district_id"),
            (F.col("s_acctbal") < 0).alias("is_metro_store"),
            (F.col("s_acctbal") > 9000).alias("is_neighbourhood_store"),
            F.when(key % 13 == 0, None).otherwise(key % 17 == 0).alias("is_online_store"),
            F.element_at(F.split(name, " "), 1).alias("store_brand"),
            (key % 19 != 0).alias("is_current"),
        )

    @_once
    def articles(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.tables["part"].select(
            _text("p_partkey").alias("article_id"),
            F.col("p_name").alias("article_name"),
            F.col("p_brand").alias("online_brand"),
            F.col("p_type").alias("department"),
            F.col("p_brand").alias("category"),
            F.col("p_name").alias("sub_category"),
            F.upper("p_name").alias("segment"),
            (key % 40).cast("string").alias("price_family_id"),
            F.concat(F.lit("Family "), (key % 40).cast("string")).alias("price_family_name"),
            F.when(key % 9 != 0, F.concat(F.lit("Manager "), (key % 6).cast("string"))).alias("category_manager"),
            F.when(key % 7 != 0, F.concat(F.lit("V"), (key % 7).cast("string"))).alias("vendor_description"),
            F.when(key % 4 == 0, "Y").otherwise("N").alias("own_brand"),
            (key % 23 != 0).alias("is_current"),
            F.col("p_size").alias("article_size"),
        )

    @_once
    def article_uoms(self) -> DataFrame:
        """Articles with their units of measure as an array of structs: every article by the each, larger ones by the carton."""
        current = F.col("p_partkey") % 29 != 0
        each = F.struct(F.lit("EA").alias("unit_of_measure"), F.lit(1).alias("pack_size"), F.lit(True).alias("is_current"))
        carton = F.struct(F.lit("CT").alias("unit_of_measure"), F.col("p_size").alias("pack_size"), current.alias("is_current"))
        return self.tables["part"].select(
            _text("p_partkey").alias("article_id"),
            F.when(F.col("p_size") >= 20, F.array(each, carton)).otherwise(F.array(each)).alias("uom"),
        )

    @_once
    def article_vendors(self) -> DataFrame:
        """Vendors of the articles; the smallest sizes have none."""
        code = (F.col("p_partkey") % 7).cast("string")
        return self.tables["part"].filter(F.col("p_size") > 2).select(
            _text("p_partkey").alias("article_id"),
            code.alias("vendor_id"),
            F.when(code != "0", F.concat(F.lit("V"), code)).alias("vendor_description"),
            F.when(F.col("p_partkey") % 4 == 0, "Y").otherwise("N").alias("own_brand"),
        )

    @_once
    def article_sites(self) -> DataFrame:
        """Article x site supply rows with the vendor and the end of the supply agreement."""
        supply = self.tables["lineitem"].join(self.tables["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        return supply.select(
            _text("l_partkey").alias("article_id"),
            _text("l_suppkey").alias("vendor_code"),
            F.col("s_name").alias("vendor_description"),
            F.to_date("l_shipdate").alias("valid_to"),
            F.when(F.col("l_suppkey") % 2 == 0, "ORG1").otherwise("ORG2").alias("sales_org"),
        )

    @_once
    def prices(self) -> DataFrame:
        shipped = F.to_date("l_shipdate")
        priced = self.tables["lineitem"].join(self.tables["part"], F.col("l_partkey") == F.col("p_partkey"))
        return priced.select(
            _text("l_partkey").alias("article_id"),
            _text("l_suppkey").alias("site"),
            F.when(F.col("l_linenumber") == 7, "CT").otherwise("EA").alias("unit_of_measure"),
            (F.col("p_retailprice") + (F.col("l_suppkey") % 3).cast("double") / 2).alias("sell_price"),
            shipped.alias("valid_from"),
            F.date_add(shipped, 90).alias("valid_to"),
            F.when(F.col("l_suppkey") % 2 == 0, "ORG1").otherwise("ORG2").alias("sales_org"),
            F.when(F.col("l_tax") < 0.02, None).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("purchase_cost"),
            F.col("p_brand").alias("category"),
            F.concat(F.lit("List "), (F.col("l_suppkey") % 5).cast("string")).alias("price_list"),
            F.when(F.col("l_linenumber") < 6, "Ranged").when(F.col("l_linenumber") == 6, "Deleted").alias("life_cycle_status"),
            F.date_sub(shipped, 10).alias("life_cycle_date"),
        )

    @_once
    def store_articles(self) -> DataFrame:
        """Weekly article x store rows: shelf, standard and retail price, promotion flags, life-cycle flags."""
        sold = self._dated_lines().join(
            self.tables["part"].select(_text("p_partkey").alias("article_id"), "p_retailprice", F.col("p_brand").alias("category")),
            "article_id",
        )
        store = F.col("store_id").cast("int")
        price = F.col("p_retailprice") + (store % 3).cast("double") / 2
        return sold.select(
            "article_id",
            "store_id",
            "category",
            "financial_week_end_date",
            F.when(F.col("l_linenumber") == 7, "CT").otherwise("EA").alias("unit_of_measure"),
            price.alias("shelf_price"),
            F.when(store % 4 != 0, price + 1).alias("standard_price"),
            F.col("p_retailprice").alias("retail_price"),
            (F.col("l_returnflag") == "A").alias("is_clearance"),
            (F.col("l_linenumber") == 2).alias("is_multibuy"),
            (F.col("l_linestatus") == "O").alias("is_great_price"),
            F.col("is_online_order_completed").alias("is_ranged"),
            (F.col("l_linenumber") == 1).alias("is_new"),
            F.when(store % 11 != 0, store % 12 != 0).alias("is_store_active"),
            F.col("gst_included_amount").alias("weekly_sales"),
        )

    @_once
    def pos_lines(self) -> DataFrame:
        """Till lines with the unit sold, discount and financial week."""
        parts = self.tables["part"].select(_text("p_partkey").alias("article_id"), "p_retailprice", F.col("p_brand").alias("category"))
        return (
            self._dated_lines()
            .join(parts, "article_id")
            .select(
                "article_id",
                "store_id",
                "receipt_id",
                "category",
                "receipt_date",
                F.date_format(F.timestamp_seconds(F.col("receipt_id").cast("long") * 7919 % 86400), "HH:mm:ss").alias("receipt_time"),
                "financial_week_end_date",
                "is_online_order",
                F.when(F.col("l_linenumber") == 7, "CT").otherwise("EA").alias("unit_of_measure"),
                F.when(F.col("l_linenumber") == 6, "R1").otherwise("").alias("return_reason_id"),
                "unit_price_paid",
                F.col("p_retailprice").alias("retail_price"),
                (F.col("gst_included_amount") * 0.1).alias("total_discount"),
                (F.col("gst_included_amount") / 1.15).alias("gst_excluded_amount"),
                "quantity",
            )
        )

    @_once
    def price_families(self) -> DataFrame:
        """Hand-kept list of primary price families."""
        return self.tables["nation"].select(
            _text("n_nationkey").alias("price_family_id"), F.when(F.col("n_regionkey") < 3, "Y").otherwise(None).alias("primary_line")
        )

    @_once
    def price_promises(self) -> DataFrame:
        """Hand-kept list of articles under the price promise, with repeated rows."""
        return self.tables["lineitem"].filter(F.col("l_discount") > 0.09).select(_text("l_partkey").alias("article_id"), F.lit("Y").alias("price_promise"))

    @_once
    def purchases(self) -> DataFrame:
        return self.tables["lineitem"].select(
            _text("l_partkey").alias("article_id"),
            _text("l_suppkey").alias("store_id"),
            (F.col("l_suppkey") % 4).cast("string").alias("sourcing_dc"),
            F.concat(F.lit("Centre "), (F.col("l_suppkey") % 4).cast("string")).alias("sourcing_dc_name"),
            F.to_date("l_shipdate").alias("invoice_date"),
            F.col("l_extendedprice").alias("cost_charge"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("base_cost"),
            F.col("l_quantity").alias("multiple_despatched"),
            F.col("l_linenumber").alias("order_multiple"),
        )

    @_once
    def profit(self) -> DataFrame:
        """Own ledger: sales that were not returned."""
        amount = F.col("gst_included_amount")
        parts = self.tables["part"].select(
            _text("p_partkey").alias("article_id"), F.col("p_type").alias("department"), *_middle_levels(), F.col("p_brand").alias("segment")
        )
        return (
            self.lines()
            .filter(F.col("l_returnflag") != "R")
            .join(parts, "article_id")
            .select(
                "article_id",
                "department",
                "category",
                "sub_category",
                "segment",
                F.col("receipt_date").alias("calendar_day"),
                F.when(F.col("store_id").cast("int") % 2 == 0, "ORG1").otherwise("ORG2").alias("sales_org"),
                amount.alias("sales"),
                (amount * 0.3).alias("interim_gp"),
                (amount * 0.01).alias("manual_claims"),
                (amount * 0.25).alias("trading_gp"),
                (F.col("quantity") * 0.125).alias("dumps"),
                (F.col("quantity") * 0.5).alias("stock_loss"),
                (amount * 0.06).alias("markdowns"),
                (amount * 0.69).alias("cogs"),
                "quantity",
            )
        )

    @_once
    def market(self) -> DataFrame:
        part = F.col("p_partkey")
        parts = self.tables["part"].select(
            _text("p_partkey").alias("article_id"),
            F.when(part % 11 != 0, _text("p_partkey")).alias("product_ref"),
            F.concat(F.col("p_name"), F.lit(" "), (part % 2).cast("string")).alias("name"),
            F.col("p_type").alias("department"),
            *_middle_levels(),
            F.col("p_brand").alias("segment"),
        )
        store = F.col("store_id").cast("int") % 4
        return (
            self._dated_lines()
            .join(parts, "article_id")
            .select(
                F.col("financial_week_start_date").alias("week_start"),
                "product_ref",
                F.when(F.col("l_linenumber") == 3, F.concat("name", F.lit(" alt"))).otherwise(F.col("name")).alias("product_description"),
                "department",
                "category",
                "sub_category",
                "segment",
                F.when(store == 0, "Total").when(store == 1, "Competitor").when(store == 2, "Own").otherwise("Franchise").alias("market"),
                F.col("gst_included_amount").alias("value_excl_tax"),
                F.col("quantity").alias("units"),
            )
        )

    @_once
    def plan(self) -> DataFrame:
        return self.tables["part"].select(
            _text("p_partkey").alias("article_id"),
            F.col("p_size").alias("start_week"),
            (F.col("p_size") + (F.col("p_partkey") % 4).cast("int") - 1).alias("finish_week"),
            F.col("p_retailprice").alias("ty_purchase"),
            (F.col("p_retailprice") * 0.9).alias("ly_purchase"),
        )

    @_once
    def kpis(self) -> DataFrame:
        """Offer x customer redemption counts per week, as a campaign KPI table holds them."""
        offers = self.offers().select("offer_id", "offer_name", "offer_start_date")
        weeks = self.dim_date().select(F.col("date").alias("redemption_date"), "pel_week")
        return (
            self.rewards()
            .join(offers, "offer_id")
            .join(weeks, "redemption_date")
            .select(
                "offer_id",
                "offer_name",
                F.when(F.col("offer_id").isin("1", "4"), "basket offer").otherwise("product offer").alias("offer_type"),
                F.when(F.col("quantity") > 25, "mass").otherwise("targeted").alias("offer_target_type"),
                F.when(F.col("store_id").cast("int") % 2 == 0, "single").otherwise("multi").alias("product_offer_type"),
                "pel_week",
                F.col("quantity").alias("offer_redeemed_count"),
                "bonus_points_earn",
                "offer_start_date",
                F.when(F.col("quantity") == 50, "Invalid").otherwise(F.col("scv_id")).alias("allocated_scv_id"),
                F.when(F.col("quantity") > 1, F.floor(F.datediff("redemption_date", "offer_start_date") / 7)).alias("week_number"),
            )
        )


    @_once
    def email_sends(self) -> DataFrame:
        return (
            self.tables["events"]
            .filter(F.col("event_type") == "signup")
            .select(F.concat(F.lit("mail "), (F.col("event_id") % 7).cast("string")).alias("email_name"), (F.col("event_id") % 7).cast("string").alias("job_id"))
        )

    @_once
    def communications(self) -> DataFrame:
        return self.tables["events"].filter(F.col("event_type") == "view").select((F.col("event_id") % 5).cast("string").alias("send_id"))

    @_once
    def email_clicks(self) -> DataFrame:
        return (
            self.tables["events"]
            .filter(F.col("event_type").isin("click", "purchase"))
            .select(
                _text("user_id").alias("scv_id"),
                (F.col("event_id") % 7).cast("string").alias("send_id"),
                F.when(F.col("value") < 2, "UnSubscribe link").otherwise("Shop now").alias("alias"),
            )
        )

    @_once
    def jobs(self) -> DataFrame:
        return self.tables["events"].select(
            F.col("ts").cast("timestamp").alias("start_time"),
            _text("user_id").alias("user_email"),
            F.col("event_type").alias("statement_type"),
            F.col("value").alias("total_slot_ms"),
            F.struct(F.concat(F.lit("table_"), (F.col("event_id") % 9).cast("string")).alias("table_id")).alias("destination_table"),
        )
