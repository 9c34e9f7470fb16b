"""What the plans must look like at scale, and that results do not depend on partitioning."""

import contextlib
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tests.oracle_check import spark_rows
from tillweave import queries
from tillweave.operators import campaigns
from tillweave.plans import market_report
from tillweave.sources import staging
from tillweave.sources.standin import AS_OF, StandIn
from tillweave.sources.tables import TableBook, replace_files, replace_table

DIRECTORY = "/root/testdata/sf0.001"


@contextlib.contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.autoBroadcastJoinThreshold": -1}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_no_pairwise_joins_and_no_python(spark, name):
    """Also when nothing can be broadcast, no plan pairs everything with everything or leaves the JVM."""
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(entry_module.queries()[name](spark, DIRECTORY))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "PythonUDF", "ArrowEvalPython", "ObjectType"):
        assert word not in plan, word


CONFIG = (
    "offer_id string, offer_name string, campaign_name string, campaign_start_date date, campaign_end_date date, campaign_duration_weeks int, pre_start_date date, "
    "pre_end_date date, post_start_date date, post_end_date date, recent_start_date date, long_start_date date"
)


@pytest.fixture(scope="module")
def config(spark):
    d = dt.date
    row = ("b", "n", "P_1", d(2025, 3, 31), d(2025, 4, 27), 4, d(2025, 3, 3), d(2025, 3, 30), d(2025, 4, 28), d(2025, 5, 25), d(2024, 9, 30), d(2024, 4, 1))
    return spark.createDataFrame([row], CONFIG)


@pytest.fixture(scope="module")
def hot_lines(spark, tmp_path_factory):
    """A third of all lines are one article, a third belong to no customer."""
    n = F.col("id")
    path = str(tmp_path_factory.mktemp("lines"))
    spark.range(300_000).select(
        F.concat(F.lit("r"), (n / 2).cast("long").cast("string")).alias("receipt_id"),
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), (n % 997).cast("string"))).alias("article_id"),
        F.when(n % 3 == 1, None).otherwise((n % 5000).cast("string")).alias("scv_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (n % 500).cast("int")).alias("receipt_date"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (n % 500).cast("int")).alias("online_order_date"),
        (n % 4 == 0).alias("is_online_order"),
        F.lit(True).alias("is_online_order_completed"),
        F.lit("").alias("commercial_id"),
        F.lit(2.0).alias("gst_included_amount"),
        F.lit(1.0).alias("quantity"),
        F.lit(2.0).alias("unit_price_paid"),
        F.sha2(n.cast("string"), 256).alias("unused"),
    ).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_hot_article_is_split(spark, hot_lines, config):
    articles = spark.createDataFrame([("b", "x", "hot")] + [("b", "y", f"a{i}") for i in range(997)], "offer_id string, brand string, article_id string")
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    with settings(spark, **NO_BROADCAST, **small):
        sales = campaigns.campaign_sales(hot_lines, config, articles)
        totals = sales.groupBy("brand").agg(F.sum("quantity").alias("q"))
        got = {r.brand: r.q for r in totals.collect()}
        assert "skew=true" in plan_of(totals)
    window = hot_lines.filter(F.col("receipt_date").between(dt.date(2024, 4, 1), dt.date(2025, 5, 25)))
    assert got["x"] == window.filter("article_id = 'hot'").count()
    assert sum(got.values()) == window.count()


def test_scan_is_pruned_and_bounded(spark, hot_lines, config):
    articles = spark.createDataFrame([("b", "x", "hot")], "offer_id string, brand string, article_id string")
    plan = campaigns.campaign_sales(hot_lines, config, articles)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "unused" not in scan and "commercial_id" not in scan
    assert "receipt_date" in scan.split("DataFilters")[1] and "subquery" in scan.split("DataFilters")[1].lower()


@pytest.mark.parametrize("name", ["scan_tag_rates", "modal_shelf_price", "canonical_description", "dedup_reference_sales", "basket_kpis"])
def test_result_does_not_depend_on_partitions(spark, name):
    run = entry_module.queries()[name]
    with settings(spark, spark__sql__shuffle__partitions=3):
        few = spark_rows(run(spark, DIRECTORY))
    with settings(spark, spark__sql__shuffle__partitions=29, spark__sql__adaptive__coalescePartitions__enabled="false"):
        many = spark_rows(run(spark, DIRECTORY))
    assert few == many


def test_segments_add_up(spark):
    rows = entry_module.queries()["campaign_performance"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r.new_to_brand_redeemers + r.reactivated_redeemers + r.repeat_redeemers == r.unique_redeemers for r in rows)


def test_shares_add_up(spark):
    shares = entry_module.queries()["segment_profile_share"](spark, "/root/testdata/sf0.01")
    for kind in ("repeat", "reactivated", "new_to_brand"):
        sums = shares.groupBy("offer_id", "brand").agg(F.sum(f"{kind}_share").alias("s"), F.max(f"total_{kind}").alias("n")).collect()
        assert all(abs(r.s - 1) < 1e-3 if r.n else r.s is None for r in sums)


def test_staging_uses_the_session_folder(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert staging.stage(df, "t").agg(F.sum("x")).first()[0] == 20
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert staging.shared_root(spark) == root.rstrip("/")


def test_sinks_replace_and_book_finds_tables(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 2):
        replace_files(spark.range(n), path)
    book = TableBook(spark, paths={"numbers": path})
    assert book["numbers"].count() == 2
    with pytest.raises(KeyError):
        TableBook(spark)["nothing"]


def test_table_is_replaced(spark):
    name = "tillweave_sink_test"
    try:
        for n in (3, 2):
            replace_table(spark.range(n), name)
        assert TableBook(spark, catalog={"numbers": name})["numbers"].count() == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_weekly_uplift_equals_direct_aggregation(spark):
    from tillweave.queries import boosted_of
    from tillweave.sources.standin import StandIn

    directory = "/root/testdata/sf0.01"
    boosted = boosted_of(StandIn(spark, directory))
    direct = boosted.filter("campaign_period = 'Campaign Period'").groupBy("offer_id", "brand").agg(
        (F.sum("sales") / F.countDistinct("pel_week")).alias("direct")
    )
    uplift = entry_module.queries()["weekly_uplift_by_brand"](spark, directory)
    pairs = uplift.join(direct, ["offer_id", "brand"], "left").select("weekly_sales_campaign", "direct").collect()
    assert pairs and all(abs(a - b) < 1e-3 for a, b in pairs)


def test_market_rows_are_joined_once(spark, tmp_path, monkeypatch):
    """The spread and the canonical descriptions read the staged rows in scope, not the joins that give them."""
    staged = {}

    def written(df, name):
        staged[name] = plan_of(df)
        df.write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"file://{tmp_path}/{name}")

    monkeypatch.setattr(market_report, "stage", written)
    market_report.matched_market(StandIn(spark, DIRECTORY).market(), as_of=AS_OF, markets={"Total": "total"}, departments=["economy"], segments=["brand#3"])
    assert "Join" not in staged["market-spread"] + staged["market-canonical"]


@pytest.mark.parametrize("table, week", [("market", "week_start"), ("pos_lines", "financial_week_end_date"), ("store_articles", "financial_week_end_date")])
def test_weeks_cut_receipts_before_their_lines(spark, table, week):
    """The calendar's join lies below that of the lines."""
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(getattr(StandIn(spark, DIRECTORY), table)().where(F.col(week) == dt.date(2001, 7, 29)))
    assert 0 < plan.index("Join [l_orderkey") < plan.index("Join [receipt_date")


def test_price_report_joins_narrow_sources_first(spark, tmp_path, monkeypatch):
    """Names and descriptions join after the price sources, and the till lines are joined once."""

    def written(df, name):
        df.write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"file://{tmp_path}/{name}")

    monkeypatch.setattr(queries, "stage", written)
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(entry_module.queries()["price_comparison_report"](spark, DIRECTORY))
    assert plan.count("Join [l_orderkey") == 1  # that of the shelf prices
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Join \[([^\]]*)\]", plan)]
    assert keys[:5] == ["store_id", "price_family_id", "article_id", "article_id", "article_id, unit_of_measure"]
