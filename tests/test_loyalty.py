import datetime as dt

import pytest

from tillweave.operators import audiences, membership, partners
from tillweave.queries import STRATEGY_LABELS

D = dt.date
TXN = (
    "scv_id string, partner_id string, receipt_id string, redemption_type string, txn_date date, base_points double, bonus_points double, "
    "sales double, quantity double, discount double"
)


def test_engagement_counts_rows_for_recency_and_transactions_for_visits(spark):
    as_of = D(2025, 5, 1)
    rows = [
        ("k", "p", "r1", "Base", D(2025, 4, 30), 1.0, 0.0, 10.0, 1.0, 0.0),
        ("k", "p", "r1", "Base", D(2025, 4, 30), 1.0, 0.0, 10.0, 1.0, 0.0),  # same row again: once
        ("k", "p", "r1", "cpl discount", D(2025, 4, 30), 0.0, 0.0, 40.0, 20.0, 2.0),
        ("k", "p", "r2", "cpl discount", D(2025, 2, 1), 0.0, 0.0, 5.0, 0.0, 2.0),  # no litres: no rate, no error
        ("k", "p", "r2", "CPL DISCOUNT", D(2024, 2, 1), 0.0, 0.0, 5.0, 1.0, 2.0),  # discount rows match by exact case
        ("k", "q", "r3", "Base", D(2025, 4, 30), 1.0, 0.0, 99.0, 1.0, 0.0),
        ("j", "p", "r4", "bonus", D(2025, 4, 30), 1.0, 0.0, 7.0, 1.0, 0.0),
    ]
    found = {r.scv_id: r for r in partners.engagement_recency(spark.createDataFrame(rows, TXN), as_of=as_of, partner_id="p").collect()}
    k = found["k"]
    assert (k.total_sales, k.total_sales_fuel, k.total_sales_shop) == (10.0, 45.0, -35.0)
    assert (k.transactions, k.fuel_transactions, k.shop_transactions) == (2, 2, 0)
    assert (k.last_2m, k.previous_2m_to_last_2m, k.before_4m) == (2, 1, 1)
    assert (k.average_litres, k.discount_total, k.days_to_shop) == (10.0, 0.1, None)
    assert found["j"].total_sales_shop is None and found["j"].average_litres is None


def test_reference_sales_pick_largest_then_lowest_customer(spark):
    rows = spark.createDataFrame([("x", "b", 5.0), ("x", "a", 5.0), ("x", "c", None), ("y", "a", 1.0), ("z", "d", None)], "reference string, scv_id string, sales double")
    assert {r.scv_id: r.non_fuel_sales for r in partners.dedup_reference_sales(rows).collect()} == {"a": 6.0, "d": None}


def test_breadth_counts_names(spark):
    points = spark.createDataFrame([("k", "1"), ("k", "2"), ("k", "2"), ("j", "3"), ("l", "9")], "scv_id string, partner_id string")
    names = spark.createDataFrame([("1", "Gas_NZ"), ("2", "Gas"), ("3", "Air_NZ")], "partner_id string, partner_name string")
    rows = {r.scv_id: (r.partner_customer, r.different_partners) for r in partners.partner_breadth(points, names, partner_name="Gas").collect()}
    assert rows == {"k": (1, 1), "j": (0, 1)}


def test_unsubscribe_link_any_case(spark):
    sends = spark.createDataFrame([("m", "1"), ("m", "2"), ("m", None)], "email_name string, job_id string")
    sent = spark.createDataFrame([("1",), ("1",), (None,)], "send_id string")
    clicks = spark.createDataFrame([("a", "1", "UnSubscribe here"), ("b", "1", "Shop"), ("c", "2", "unsubscribe"), ("d", "1", None)], "scv_id string, send_id string, alias string")
    assert [r.scv_id for r in audiences.unsubscribed_customers(sends, sent, clicks).collect()] == ["a"]


def test_ladder_first_match_and_missing_figures(spark):
    breadth = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 0, 4), ("d", 0, 1), ("e", 1, 1)], "scv_id string, partner_customer int, different_partners long")
    recency = spark.createDataFrame(
        [("a", 0, 3, 10.0, D(2024, 1, 1), D(2024, 3, 1)), ("b", 0, 30, 10.0, D(2025, 1, 1), D(2025, 4, 30))],
        "scv_id string, last_2m long, transactions long, total_sales double, first_date date, last_date date",
    )
    points = spark.createDataFrame([("d", 5, D(2025, 1, 1), D(2025, 1, 31))], "scv_id string, transactions long, member_since date, last_earned date")
    customers = spark.createDataFrame([("a", "PROTECT"), ("b", "OTHER")], "scv_id string, strategy_segment string")
    risk = spark.createDataFrame([("e", "Risk")], "scv_id string, cohort string")
    sales = spark.createDataFrame([("d", 50.0)], "scv_id string, non_fuel_sales double")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "scv_id string")
    rows = audiences.segmentation_strategy(breadth, recency, points, customers, risk, sales, ids("a"), ids("b"), as_of=D(2025, 5, 1), labels=STRATEGY_LABELS).collect()
    got = {r.scv_id: (r.segment, r.treatment, r.contactability, r.unsubscribed) for r in rows}
    assert got["a"] == ("Lapsed partner customer - loyal", "Re-engage", "Contactable", 0)
    assert got["b"] == ("Already engaged", "Protect", "Non contactable", 1)
    assert got["c"][:2] == ("Already engaged", "Protect")  # many partners, though none is the named one
    assert got["d"][:2] == ("Non partner customer - mid volume", "Win")
    with pytest.raises(ValueError, match="engaged"):
        audiences.segmentation_strategy(
            breadth, recency, points, customers, risk, sales, ids("a"), ids("b"), as_of=D(2025, 5, 1), labels={k: v for k, v in STRATEGY_LABELS.items() if k != "engaged"}
        )
    assert got["e"][:2] == ("Infrequent partner customer - at risk", "Grow")  # no partner rows: "lapsed" is not met


def test_audience_tenure_and_seeds(spark):
    customers = spark.sql(
        "SELECT id AS scv_id, 'Active' AS customer_status, true AS is_current, false AS is_deleted, true AS is_valid_email, CAST(t AS TIMESTAMP) AS created_at "
        "FROM VALUES ('old', '2025-02-28 10:00:00'), ('edge', '2025-02-28 11:30:00'), ('buyer', '2020-01-01 00:00:00'), ('out', '2020-01-01 00:00:00') v(id, t)"
    )
    prefs = spark.createDataFrame([("old", True), ("edge", True), ("buyer", True), ("out", None)], "scv_id string, allow_all boolean")
    txns = spark.createDataFrame([("buyer", "p"), (None, "p"), ("old", "q")], "scv_id string, partner_id string")
    seeds = spark.createDataFrame([("seed", "Partner Seed List", "s"), ("no", "Other", "s"), ("old", "Partner Seed List", "s")], "scv_id string, list_source string, partner_id string")
    found = audiences.lifecycle_audience(
        customers, prefs, txns, seeds, as_of=D(2025, 4, 30), zone="Pacific/Auckland", partner_id="p", seed_partner_id="s", seed_source="Partner Seed List", prefs_required=["allow_all"], campaign_id="c", execution_id="e"
    ).collect()
    # 11:30 UTC is already 1 March in New Zealand, a day too late for two months before 30 April (clamped to 28 February)
    assert sorted(r.scv_id for r in found) == ["old", "seed"]


def test_not_in_follows_sql_null_rules(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")

    def kept(values):
        other = spark.createDataFrame([(v,) for v in values], "v string")
        return sorted(str(r.k) for r in membership.not_in_subquery(left, "k", other, "v").collect())

    assert kept(["a"]) == ["b"]
    assert kept(["a", None]) == []
    assert kept([]) == ["None", "a", "b"]
    other = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert [r.k for r in membership.in_subquery(left, "k", other, "v").collect()] == ["a"]
