"""Hand-made frames for the campaign rules that the stand-in tables do not reach."""

import datetime as dt

import pytest

from tillweave.operators import campaigns, performance, redeemers

D = dt.date


@pytest.fixture(scope="module")
def config(spark):
    offers = spark.createDataFrame(
        [
            ("a", "first", "X", D(2025, 1, 6), "Expired", True),
            ("b", "second", "X", D(2025, 3, 31), "ACTIVE", True),
            ("b2", "twin", "X", D(2025, 3, 31), "active", True),
            ("c", "third", "X", D(2025, 4, 14), "active", True),
            ("t", "a test offer", "X", D(2024, 1, 1), "active", True),
            ("d", "draft", "X", D(2024, 2, 1), "draft", True),
            ("o", "other", "Y", D(2024, 3, 1), "active", True),
            ("h", "old version", "X", D(2024, 4, 1), "active", False),
        ],
        "offer_id string, offer_name string, campaign_code string, offer_start_date date, offer_status_description string, is_current boolean",
    )
    allocations = spark.createDataFrame(
        [
            ("b", D(2025, 3, 31), D(2025, 4, 20), "Active"),
            ("b", D(2025, 4, 1), D(2025, 4, 27), "active"),
            ("b", D(2025, 1, 1), D(2025, 12, 31), "Inactive"),
            ("c", D(2025, 4, 14), D(2025, 5, 11), "Active"),
            ("a", D(2025, 1, 6), D(2025, 2, 2), "Active"),
        ],
        "offer_id string, allocation_start date, allocation_end date, allocation_status string",
    )
    return campaigns.campaign_config(offers, allocations, campaign_code="X", exclude_ids=["a"], prefix="P_").cache()


@pytest.fixture(scope="module")
def dim_date(spark):
    days = [D(2024, 1, 1) + dt.timedelta(n) for n in range(700)]
    return spark.createDataFrame([(d, d - dt.timedelta(d.weekday()), d.isocalendar()[1]) for d in days], "date date, financial_week_start_date date, pel_week int")


def test_config_labels_keep_gaps_and_windows_touch(config):
    rows = {r.offer_id: r for r in config.collect()}
    assert set(rows) == {"b", "c"}  # b2 has no allocation, a is excluded
    assert (rows["b"].campaign_name, rows["c"].campaign_name) == ("P_2", "P_3")
    b = rows["b"]
    assert (b.campaign_start_date, b.campaign_end_date, b.campaign_duration_weeks) == (D(2025, 3, 31), D(2025, 4, 27), 4)
    assert (b.pre_start_date, b.pre_end_date) == (D(2025, 3, 3), D(2025, 3, 30))
    assert (b.post_start_date, b.post_end_date) == (D(2025, 4, 28), D(2025, 5, 25))
    assert (b.recent_start_date, b.long_start_date) == (D(2024, 9, 30), D(2024, 4, 1))


def test_calendar_overlaps_and_periods_are_disjoint(config, dim_date):
    calendar = campaigns.campaign_calendar(config, dim_date, horizon="history")
    rows = calendar.collect()
    assert len({(r.offer_id, r.date) for r in rows}) == len(rows)
    on_day = {r.offer_id: r.campaign_period for r in rows if r.date == D(2025, 4, 20)}
    assert on_day == {"b": "Campaign Period", "c": "Campaign Period"}
    assert [r.campaign_period for r in rows if r.offer_id == "b" and r.date == D(2025, 1, 1)] == [None]
    for offer in ("b", "c"):
        inside = sorted((r.date, r.campaign_period) for r in rows if r.offer_id == offer and r.campaign_period)
        assert [d for d, _ in inside] == [inside[0][0] + dt.timedelta(n) for n in range(len(inside))]
        labels = [p for _, p in inside]
        assert labels == sorted(labels, key=["Pre Campaign", "Campaign Period", "Post Campaign"].index)


LINE = (
    "receipt_id string, article_id string, scv_id string, receipt_date date, online_order_date date, is_online_order boolean, "
    "is_online_order_completed boolean, commercial_id string, gst_included_amount double, quantity double, unit_price_paid double"
)


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(
        [("b", "milk", "1", "m1"), ("b", "milk", "1", "m1"), ("b", "tea", "2", "t2"), ("c", "milk", "1", "m1")],
        "offer_id string, brand string, article_id string, article_description string",
    )


@pytest.fixture(scope="module")
def lines(spark):
    shop = lambda r, a, c, d, amount, q=1.0: (r, a, c, d, None, False, None, "", amount, q, amount / q)
    web = lambda r, a, c, d, o, done, amount: (r, a, c, d, o, True, done, "W" + r, amount, 1.0, amount)
    return spark.createDataFrame(
        [
            shop("r1", "1", "k1", D(2025, 4, 1), 10.0),
            shop("r1", "1", "k1", D(2025, 4, 1), 5.0),
            shop("r2", "1", "", D(2025, 4, 2), 7.0),
            shop("r3", "2", None, D(2025, 3, 10), 4.0),
            shop("r4", "1", "k2", D(2024, 6, 1), 3.0),  # long history of b only
            shop("r5", "1", "k3", D(2025, 3, 5), -2.0),  # a return
            shop("r6", "2", "k2", D(2025, 4, 28), 8.0),
            web("o1", "1", "k4", D(2025, 6, 3), D(2025, 5, 24), True, 20.0),  # ordered in b's post window, invoiced later
            web("o2", "1", "k4", D(2025, 4, 10), D(2025, 4, 9), False, 30.0),  # never completed
            shop("r9", "9", "k1", D(2025, 4, 1), 99.0),
        ],
        LINE,
    )


def test_campaign_sales(lines, config, articles):
    rows = campaigns.campaign_sales(lines, config, articles).collect()
    milk = {(r.offer_id, r.receipt_id): r for r in rows if r.brand == "milk"}
    assert milk["b", "r1"].gst_included_amount == 15.0 and milk["b", "r1"].in_campaign
    assert milk["b", "r2"].scv_id is None
    assert milk["b", "r4"].in_long and not milk["b", "r4"].in_recent
    assert milk["b", "o1"].txn_date == D(2025, 5, 24) and milk["b", "o1"].in_post
    assert not any(r.receipt_id in ("o2", "r9") for r in rows)
    assert not milk["b", "r5"].has_positive_line


def test_segments_and_retention(spark, lines, config, articles):
    sales = campaigns.campaign_sales(lines, config, articles)
    redeemed = spark.createDataFrame([("b", "milk", k) for k in ("k1", "k2", "k3")], "offer_id string, brand string, scv_id string")
    loose = redeemers.redeemer_segments(redeemed, redeemers.shopper_activity(sales))
    strict = redeemers.redeemer_segments(redeemed, redeemers.shopper_activity(sales, positive_only=True))
    assert {r.scv_id: r.redeemer_type for r in loose.collect()} == {"k1": "New", "k2": "Reactivated", "k3": "Repeat"}
    assert {r.scv_id: r.redeemer_type for r in strict.collect()} == {"k1": "New", "k2": "Reactivated", "k3": "New"}
    kept = {(r.offer_id, r.brand): r for r in redeemers.shopper_retention(redeemers.shopper_activity(sales), loose).collect()}
    assert kept["b", "milk"].brand_shoppers == 1 and kept["b", "milk"].non_redeemers == 0
    activations = spark.createDataFrame([("b", "k9")], "offer_id string, scv_id string")
    idle = redeemers.non_boosters(redeemers.shopper_activity(sales), activations).collect()
    assert {(r.offer_id, r.brand): r.non_boosters for r in idle}["b", "milk"] == 1  # k1 redeemed but never activated


def test_performance_is_not_multiplied_by_sales_rows(spark, config, articles):
    # two customers on one receipt and article: two sales rows for one redemption
    lines = spark.createDataFrame(
        [
            ("r1", "1", "k1", D(2025, 4, 1), None, False, None, "", 10.0, 1.0, 10.0),
            ("r1", "1", "k2", D(2025, 4, 1), None, False, None, "", 6.0, 1.0, 6.0),
        ],
        LINE,
    )
    sales = campaigns.campaign_sales(lines, config, articles)
    redemptions = spark.createDataFrame(
        [("b", "k1", "r1", "1", 2.0, 100.0)], "offer_id string, scv_id string, receipt_id string, article_id string, redemptions double, bonus_points_earn double"
    )
    segments = redeemers.redeemer_segments(redeemers.brand_redeemers(redemptions, articles), redeemers.shopper_activity(sales))
    row = performance.campaign_performance(redemptions, articles, sales, segments, point_value=0.01).first()
    assert (row.redemptions, row.unique_redeemers, row.boosted_sales, row.points_cost) == (2.0, 1, 16.0, 1.0)


def test_performance_credits_an_item_to_each_redemption_row(spark, lines, config, articles):
    sales = campaigns.campaign_sales(lines, config, articles)
    schema = "offer_id string, scv_id string, receipt_id string, article_id string, redemptions double, bonus_points_earn double"
    segments = redeemers.redeemer_segments(
        spark.createDataFrame([("b", "milk", "k1"), ("b", "milk", "k2")], "offer_id string, brand string, scv_id string"), redeemers.shopper_activity(sales)
    )

    def result(rows):
        row = performance.campaign_performance(spark.createDataFrame(rows, schema), articles, sales, segments).first()
        return row.redemptions, row.unique_redeemers, row.boosted_sales, row.bonus_points

    one = ("b", "k1", "r1", "1", 1.0, 50.0)
    assert result([one]) == (1.0, 1, 15.0, 50.0)
    assert result([one, ("b", "k2", "r1", "1", 1.0, 50.0)]) == (2.0, 2, 30.0, 100.0)
    assert result([one, one]) == (2.0, 1, 30.0, 100.0)  # repeated reward rows repeat the sales too


def test_uplift_without_pre_baskets_is_null(lines, config, articles):
    rows = {(r.offer_id, r.brand): r for r in performance.campaign_uplift(campaigns.campaign_sales(lines, config, articles), config).collect()}
    tea = rows["b", "tea"]
    assert tea.pre_baskets == 1 and tea.campaign_baskets == 0 and tea.scan_rate_uplift is None and tea.sales_uplift is None
    assert rows["b", "milk"].campaign_swiped_baskets == 1 and rows["b", "milk"].campaign_baskets == 2


def test_redemption_rows_do_not_repeat_boosted_sales(spark, lines, config, dim_date, articles):
    calendar = campaigns.campaign_calendar(config, dim_date)
    redemptions = spark.createDataFrame(
        [("b", "k1", "r1", "1"), ("b", "k1", "r1", "1")], "offer_id string, scv_id string, receipt_id string, article_id string"
    )
    once = campaigns.boosted_sales_lines(lines, calendar, articles, redemptions).filter("boosted_sales IS NOT NULL")
    raw = campaigns.boosted_sales_lines(lines, calendar, articles, redemptions, collapse_redemptions=False).filter("boosted_sales IS NOT NULL")
    assert [r.boosted_sales for r in once.collect()] == [15.0]
    assert [r.boosted_sales for r in raw.collect()] == [15.0, 15.0]


def test_channel_defaults_to_store(spark, config, dim_date, articles):
    rewards = spark.createDataFrame(
        [("b", "k1", "r1", "1", "s", D(2025, 4, 1), 1.0, 1.0, 5.0, 2.0, 9.0), ("b", "k1", "r1", "1", "s", D(2025, 4, 1), 1.0, 1.0, 5.0, 2.0, 9.0),
         ("b", "k2", "r2", "7", "s", D(2026, 4, 1), 1.0, 1.0, 5.0, 2.0, 9.0)],
        "offer_id string, scv_id string, receipt_id string, article_id string, store_id string, redemption_date date, quantity double, "
        "base_points_earn double, bonus_points_earn double, reward_value double, total_item_sales_amount double",
    )
    receipts = spark.createDataFrame(
        [("k1", "r1", True, D(2025, 4, 1)), ("k1", "r1", True, D(2025, 4, 1)), ("", "r2", True, D(2025, 4, 1))],
        "scv_id string, receipt_id string, is_online_order boolean, receipt_date date",
    )
    rows = {r.receipt_id: r for r in campaigns.offer_redemptions(rewards, articles, receipts, campaigns.campaign_calendar(config, dim_date)).collect()}
    assert (rows["r1"].channel, rows["r1"].bonus_points_earn, rows["r1"].brand) == ("Online", 10.0, "milk")
    assert (rows["r2"].channel, rows["r2"].brand, rows["r2"].pel_week) == ("In Store", None, None)
