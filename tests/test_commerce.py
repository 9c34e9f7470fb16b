"""Hand-made frames for pricing, market, seasonal, brand rule and reshape rules."""

import datetime as dt


from tillweave.operators import brand_rules, invoicing, market, pricing, reshape, seasonal
from tillweave.operators.brand_rules import BrandRule, Clause

D = dt.date


def test_price_list_takes_latest_validity(spark):
    history = spark.createDataFrame(
        [
            ("ORG1", "s1", "a", "EA", 5.0, 4.0, D(2025, 1, 1), D(2025, 6, 1)),
            ("ORG1", "s1", "a", "EA", 6.0, 4.0, D(2025, 2, 1), D(9999, 12, 31)),
            ("ORG1", "s1", "a", "EA", 9.0, None, D(2025, 3, 1), D(9999, 12, 31)),
            ("ORG1", "s2", "a", "EA", 7.0, 4.0, D(2025, 2, 1), D(9999, 12, 31)),
            ("ORG1", "s3", "a", "EA", 8.0, 4.0, D(2025, 2, 1), D(9999, 12, 31)),
            ("ORG2", "s1", "a", "EA", 1.0, 4.0, D(2025, 2, 1), D(9999, 12, 31)),
        ],
        "sales_org string, site string, article_id string, unit_of_measure string, sell_price double, purchase_cost double, valid_from date, valid_to date",
    )
    stores = spark.createDataFrame([("s1", "My GreenCart"), ("s2", "Test GreenCart"), ("s3", "The ValueBarn")], "store_id string, store_name string")
    rows = pricing.current_price_list(history, stores, orgs=["ORG1"], banner_contains=["GreenCart"], banner_prefixes=["ValueBarn"]).collect()
    assert [(r.site, r.rrp) for r in rows] == [("s1", 6.0)]


def test_modal_price_ties_and_flags(spark):
    stores = spark.createDataFrame(
        [(f"s{i}", False, False) for i in range(5)] + [("m", True, False), ("u", None, False)],
        "store_id string, is_metro_store boolean, is_neighbourhood_store boolean",
    )
    week = D(2025, 5, 11)
    row = lambda s, p, promo=False, w=week, ranged=True: ("a", s, "EA", "food", w, p, promo, ranged, False)
    sold = spark.createDataFrame(
        [row("s0", 3.0), row("s1", 3.0), row("s2", 4.0), row("s3", 4.0), row("s4", 2.0, True), row("m", 3.0), row("u", 3.0),
         row("s0", 9.0, w=D(2025, 5, 4)), row("s1", 9.0, ranged=False)],
        "article_id string, store_id string, unit_of_measure string, category string, financial_week_end_date date, shelf_price double, promo boolean, is_ranged boolean, is_new boolean",
    )
    uoms = spark.sql("SELECT 'a' AS article_id, array(named_struct('unit_of_measure', 'EA', 'pack_size', 1)) AS uom")
    top = pricing.modal_shelf_price(sold, stores, uoms, as_of=D(2025, 5, 7), flags=["promo"]).collect()
    assert [(r.price, r.stores, r.promo) for r in top] == [(4.0, 2, False)]
    # run on the Monday after, the finished week is reported
    assert pricing.modal_shelf_price(sold, stores, uoms, as_of=D(2025, 5, 12), flags=["promo"]).first().price == 4.0


def test_units_drop_articles_without_any(spark):
    uoms = spark.sql(
        "SELECT 'a' AS article_id, array(named_struct('unit_of_measure', 'EA', 'pack_size', 1), named_struct('unit_of_measure', 'CT', 'pack_size', 6)) AS uom "
        "UNION ALL SELECT 'b', NULL UNION ALL SELECT 'c', array()"
    )
    assert sorted((r.article_id, r.unit_of_measure) for r in pricing.article_units(uoms).collect()) == [("a", "CT"), ("a", "EA")]


def test_wholesale_cost_keeps_half_cents(spark):
    purchases = spark.createDataFrame(
        [("a", "s", "d", D(2025, 1, 2), 29.0, 28.0, 10.0, 1), ("a", "s", "d", D(2025, 1, 2), 30.0, 28.0, 10.0, 1), ("a", "s", "d", D(2025, 1, 3), 9.0, 0.0, 1.0, 1),
         ("z", "s", "d", D(2025, 1, 2), 9.0, 1.0, 0.0, 1)],
        "article_id string, store_id string, sourcing_dc string, invoice_date date, cost_charge double, base_cost double, multiple_despatched double, order_multiple int",
    )
    days = spark.createDataFrame([(D(2025, 1, 2), D(2025, 1, 5))], "date date, financial_week_end_date date")
    uoms = spark.sql(
        "SELECT article_id, array(named_struct('unit_of_measure', 'EA', 'pack_size', 1), named_struct('unit_of_measure', 'CT', 'pack_size', 6)) AS uom FROM VALUES ('a'), ('z') t(article_id)"
    )
    rows = {r.article_id: r for r in pricing.latest_wholesale_cost(purchases, days, uoms).collect()}
    assert (rows["a"].wholesale_cost_price, rows["a"].unit_of_measure, rows["a"].financial_week_end_date) == (3.34, "CT", D(2025, 1, 5))
    assert rows["z"].wholesale_cost_price is None


def test_reconcile(spark):
    schema = "article_id string, unit_of_measure string, pack_size int, price double, stores long"
    a = spark.createDataFrame([("1", "EA", 1, 2.0, 3), ("2", "EA", 1, 2.0, 3), ("3", "EA", 1, 2.0, 3), ("4", "EA", 1, 2.0, 3)], schema)
    b = spark.createDataFrame([("1", "EA", 1, 2.0, 3), ("2", "EA", 1, 2.5, 3), ("3", "EA", 1, 2.0, 4), ("5", "EA", 6, 2.0, 3)], schema)
    outcome = {r.article_id: r.difference for r in pricing.price_source_reconcile(a, b).collect()}
    assert outcome == {"1": "match", "2": "price mismatch", "3": "count mismatch", "4": "missing in b", "5": "missing in a"}
    assert {r.difference for r in pricing.price_source_reconcile(a, a).collect()} == {"match"}


MARKET = "week_start date, product_ref string, product_description string, department string, segment string, market string, value_excl_tax double, units double"


def test_canonical_description_and_two_way_match(spark):
    week = D(2025, 4, 28)
    rows = spark.createDataFrame(
        [
            (week, "1", "milk", "d", "s", "A", 5.0, 1.0),
            (week, "1", "milk 1l", "d", "s", "A", 5.0, 1.0),  # a tie: text order decides
            (week, None, "loose", "d", "s", "A", 2.0, 1.0),
            (week, "2", "loose", "d", "s", "B", 4.0, 2.0),  # has an id, but its text is listed without one
            (week, "3", "other", "x", "y", "A", 4.0, 2.0),  # out of scope
        ],
        MARKET,
    )
    scope = {"departments": ["D"], "segments": []}
    canonical = market.canonical_description(rows, as_of=D(2025, 5, 7), **scope)
    assert sorted((r.product_ref or "", r.description) for r in canonical.collect()) == [("", "loose"), ("1", "milk"), ("2", "loose")]
    spread = market.market_by_segment(rows, as_of=D(2025, 5, 7), markets={"A": "a", "B": "b"}, **scope)
    matched = {(r.product_ref, r.description): (r.a_sales, r.b_sales) for r in market.two_way_match(spread, canonical).collect()}
    assert matched == {("1", "milk"): (10.0, 0.0), (None, "loose"): (2.0, 0.0), ("2", "loose"): (0.0, 8.0)}


def test_own_vs_market_keeps_rows_without_id(spark):
    week = D(2025, 4, 28)
    own = spark.createDataFrame([("1", "d", "s", week, 9.0), ("7", "d", "s", week, 1.0)], "article_id string, department string, segment string, week_start date, sales double")
    theirs = spark.createDataFrame(
        [(week, "1", "s", "d", "x", 5.0, 1.0), (week, None, "s", "d", "y", 4.0, 1.0), (week, None, "s", "d", "z", 3.0, 1.0)],
        "week_start date, product_ref string, segment string, department string, description string, own_sales double, own_units double",
    )
    days = spark.createDataFrame([(D(2025, 4, 28) + dt.timedelta(n), week, D(2025, 5, 4), 18, 2025, 2025) for n in range(7)],
                                 "date date, financial_week_start_date date, financial_week_end_date date, pel_week int, financial_year int, calendar_year int")
    calendar = market.report_calendar(days, as_of=D(2025, 5, 7))
    products = spark.createDataFrame([("1", "f1")], "article_id string, price_family_id string")
    rows = market.own_vs_market(own, theirs, calendar, products).collect()
    assert sorted((r.article_id or "-", r.description or "-", r.latest_week_order) for r in rows) == [("-", "y", 1), ("-", "z", 1), ("1", "x", 1), ("7", "-", 1)]


def test_week_ranges_backwards_are_empty(spark):
    plan = spark.createDataFrame([("a", 8, 10, 1.0, 2.0), ("a", 10, 11, 1.0, 2.0), ("b", 5, 4, 1.0, 2.0)], "article_id string, start_week int, finish_week int, ty_purchase double, ly_purchase double")
    rows = {(r.article_id, r.week): r.ty_purchase for r in seasonal.explode_week_ranges(plan).collect()}
    assert rows == {("a", "08"): 1.0, ("a", "09"): 1.0, ("a", "10"): 2.0, ("a", "11"): 1.0}


def test_brand_rules(spark):
    articles = spark.createDataFrame(
        [("1", "Blue Tea", "Acme"), ("2", "blue tea tray", "Acme"), ("3", "coffee", None), ("4", None, "Blue House"), ("5", "soap", "Zed"), ("6", "blue soap", "Zed")],
        "article_id string, article_name string, online_brand string",
    )
    rules = [
        BrandRule("Blue", [Clause(name_has=["blue"], name_lacks=["tray"]), Clause(brand_has=["blue"])], deny_ids=["6"], allow_ids=["5"], disputed_ids=["5"]),
        BrandRule("Acme", [Clause(brand_is=["acme"])]),
    ]
    ranged = spark.createDataFrame([(str(i),) for i in (1, 1, 2, 3, 4, 5, 6)], "article_id string")
    found = brand_rules.brand_rule_classifier(articles, rules, ranged)
    assert sorted((r.article_id, r.brand) for r in found.collect()) == [("1", "Acme"), ("1", "Blue"), ("2", "Acme"), ("4", "Blue"), ("5", "DISPUTED")]
    assert [(r.article_id, r.brands) for r in brand_rules.duplicate_brand_check(found).collect()] == [("1", 2)]


def test_vendor_lists_keep_missing_ids(spark):
    pairs = spark.createDataFrame([("o", "1"), ("o", "2")], "offer_id string, article_id string")
    vendors = spark.createDataFrame([("1", "v1", None, "Y")], "article_id string, vendor_id string, vendor_description string, own_brand string")
    row = invoicing.offer_vendor_arrays(pairs, vendors).first()
    assert (row.articles, row.vendor_ids, row.vendor_descriptions, row.vendor_count) == (["1", "2"], [None, "v1"], ["0"], 1)


def test_week_pivot_has_every_week_newest_first(spark):
    days = [D(2025, 1, 5) + dt.timedelta(7 * n) for n in range(10)]
    # the label changes inside the newest week, which counts under the label of its first day only
    labels = [(d, d - dt.timedelta(6), 202500 + n) for n, d in enumerate(days)] + [(days[9], days[9], 202510)]
    calendar = spark.createDataFrame(labels, "financial_week_end_date date, date date, financial_period_week int")
    facts = spark.createDataFrame([("a", days[9], "news", 3.0), ("a", days[9], "news", 4.0), ("a", days[1], "news", 9.0), ("b", days[8], "food", 1.0)],
                                  "article_id string, financial_week_end_date date, category string, weekly_sales double")
    wide = reshape.dynamic_week_pivot(facts, calendar, as_of=days[9], category="news", weeks=3)
    assert wide.columns == ["article_id", "202509", "202508", "202507"]
    assert [tuple(r) for r in wide.collect()] == [("a", 7.0, None, None)]


def test_job_audit_orders_newest_first(spark):
    jobs = spark.sql(
        "SELECT timestamp'2025-01-01 00:00:00' AS start_time, 'x' AS query, named_struct('table_id', 't') AS destination_table "
        "UNION ALL SELECT timestamp'2025-01-02 00:00:00', 'y', named_struct('table_id', 't') UNION ALL SELECT timestamp'2025-01-03 00:00:00', 'z', NULL"
    )
    rows = reshape.job_audit(jobs, table_name="t", zone="Pacific/Auckland").collect()
    assert [(r.query, r.start_date.hour) for r in rows] == [("y", 13), ("x", 13)]


def test_running_totals_share_peers_and_empty_event(spark):
    calendar = spark.createDataFrame(
        [(D(2024, 12, 25), 2025, 26, 1, "Christmas Day"), (D(2024, 12, 24), 2025, 26, 1, None), (D(2023, 12, 24), 2024, 26, 2, None), (D(2023, 12, 25), 2024, 26, 2, "Christmas Day"),
         (D(2025, 1, 10), 2025, 28, 3, None), (D(2024, 1, 11), 2024, 29, 3, None)],
        "date date, financial_year int, week_of_financial_year int, pel_week int, holiday_name string",
    )
    plan = spark.createDataFrame([("a", "26", 5.0, 4.0)], "article_id string, week string, ty_purchase double, ly_purchase double")
    facts = spark.createDataFrame([("a", D(2024, 12, 24), 2.0, 3.0, 1.0), ("a", D(2023, 12, 25), 4.0, 6.0, 1.0)], "article_id string, calendar_day date, quantity double, sales double, interim_gp double")
    scaffold = seasonal.days_to_event(plan, facts, calendar, as_of=D(2025, 1, 10))
    rows = {r.days_out: r for r in seasonal.ty_ly_aligned(scaffold, plan, as_of=D(2025, 1, 10)).collect()}
    assert set(rows) == {-1, 0}
    assert (rows[-1].ty_quantity, rows[-1].ly_quantity, rows[0].ly_quantity, rows[0].cumulative_ly) == (2.0, None, 4.0, 4.0)
    assert rows[0].date == D(2024, 12, 25)


def test_latest_vendor_of_planned_articles(spark):
    sites = spark.createDataFrame(
        [("a", "v1", "one", D(2025, 1, 1), "O"), ("a", "v2", "two", D(2025, 3, 1), "O"), ("a", "v3", "three", D(2025, 9, 1), "P"),
         ("b", "v1", "one", D(2025, 1, 1), "O"), ("c", "v1", "one", D(2025, 1, 1), "O"), ("d", "v1", "one", D(2025, 1, 1), "O"), (None, "v1", "one", D(2025, 1, 1), "O")],
        "article_id string, vendor_code string, vendor_description string, valid_to date, sales_org string",
    )
    plan = spark.createDataFrame(
        [("a", 40, 44), ("a", 50, 52), ("b", 30, 43), ("c", 50, 49), ("d", None, 52), (None, 44, 52), ("z", 44, 52)],
        "article_id string, start_week int, finish_week int",
    )
    planned = seasonal.planned_articles(plan, first_week=44, last_week=52)
    assert {r.article_id for r in planned.collect()} == {"a", "z", None}
    rows = seasonal.latest_vendor_per_article(sites, sales_org="O", planned=planned).collect()
    assert [(r.article_id, r.vendor_code) for r in rows] == [("a", "v2")]
    assert seasonal.latest_vendor_per_article(sites, sales_org="O").count() == 5


def test_offers_by_pattern(spark):
    offers = spark.createDataFrame(
        [("1", "x ITM y"), ("1", "ITM"), ("2", "itm"), ("3", None), (None, "ITM"), ("4", "IT_M")], "offer_id string, campaign_code string"
    )
    like = lambda pattern: {r.offer_id for r in invoicing.offers_like(offers, "campaign_code", pattern).collect()}
    assert like("%ITM%") == {"1"} and like("IT\\_M") == {"4"} and like("%") == {"1", "2", "4"}
