"""The grid search against brute force: clusters, copies, ties, far places, poles, date line."""

import math
import random

from pyspark.sql import functions as F

from tillweave.operators.sites import home_store, nearest_site

PLACE = "{} string, lat double, lon double"


def km(a, b):
    (la, oa), (lb, ob) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - oa) / 2) ** 2
    return 2 * 6371.01 * math.asin(min(1.0, math.sqrt(h)))


def test_matches_brute_force(spark):
    rng = random.Random(7)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    # a dense town far from most stores, two copies of one place, one place on each side of the date line
    spots += [(-36.85 + rng.uniform(-0.02, 0.02), 174.76 + rng.uniform(-0.02, 0.02)) for _ in range(120)]
    spots += [(-45.0, 170.5), (-45.0, 170.5), (10.0, 179.9), (10.0, -179.8), (89.9, 0.0)]
    sites = [(f"s{i:03d}", lat, lon) for i, (lat, lon) in enumerate(spots)]
    homes = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    homes += [(-36.85 + rng.uniform(-0.03, 0.03), 174.76 + rng.uniform(-0.03, 0.03)) for _ in range(40)]
    homes += [(-45.0, 170.5), (10.0, 180.0), (10.0, -179.95), (89.95, 179.0), (-90.0, 0.0), (-36.5, 170.0), (-36.5, 170.0)]
    stores = [(f"h{i:03d}", lat, lon) for i, (lat, lon) in enumerate(homes)]
    found = nearest_site(
        spark.createDataFrame(stores, PLACE.format("store_id")),
        spark.createDataFrame([(i, i, a, b) for i, a, b in sites], "site_id string, site_name string, lat double, lon double"),
    ).collect()
    assert len(found) == len(stores)
    for row in found:
        distance, site = min((round(km((row.lat, row.lon), (a, b)), 6), i) for i, a, b in sites)
        assert row.site_id == site and abs(row.distance_km - distance) < 1e-5, (row, distance, site)


def test_filter_and_no_site(spark):
    stores = spark.createDataFrame([("h", 1.0, 2.0)], PLACE.format("store_id"))
    sites = spark.createDataFrame([("a", "near", 1.0, 2.0), ("b", "far", 5.0, 2.0)], "site_id string, site_name string, lat double, lon double")
    assert nearest_site(stores, sites, site_filter=F.col("site_name") == "far").first().site_id == "b"
    row = nearest_site(stores, sites, site_filter=F.col("site_name") == "none").first()
    assert row.store_id == "h" and row.site_id is None and row.distance_km is None


def test_home_store(spark):
    customers = spark.createDataFrame(
        [("a", "9", None), ("b", "9", "9"), ("c", "5", None), ("d", None, None)], "scv_id string, preferred_store_id string, main_store_id string"
    )
    assert {r.scv_id: r.store_id for r in home_store(customers, default_store_id="9").collect()} == {"a": None, "b": "9", "c": "5", "d": None}
