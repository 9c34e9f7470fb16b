"""Nearest site of each store, without pairing every store with every site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.geo import haversine_km, unit_vector
from tillweave.sources.staging import stage

_AXES = ("x", "y", "z")
_SPLIT = 4  # a cell has this many children along each axis
_DEEPEST = 12  # cells of about 80 cm
_LEAF_SITES = 16
_SLACK = 1e-9  # in earth radii, about 6 mm: covers rounding in the bounds


def _cell_size(level: Column) -> Column:
    return F.lit(2.0) / F.pow(F.lit(float(_SPLIT)), level)


def _cells(level: Column) -> list[Column]:
    last = F.pow(F.lit(float(_SPLIT)), level) - 1  # a coordinate of exactly 1 belongs to the last cell
    return [F.least(F.floor((F.col(a) + 1) / _cell_size(level)), last).cast("long").alias(f"c{a}") for a in _AXES]


def _square(value: Column) -> Column:
    return value * value


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _located(points: DataFrame) -> DataFrame:
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    return points.withColumns({"x": x, "y": y, "z": z})


def _grid(site_places: DataFrame) -> DataFrame:
    """Occupied cells of every level, each with its number of places and one of them as its representative."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(_DEEPEST))).alias("level")
    leveled = site_places.select("x", "y", "z", levels).select("level", *_cells(F.col("level")), "x", "y", "z")
    return leveled.groupBy("level", "cx", "cy", "cz").agg(
        F.count("x").alias("places"), F.min(F.struct("x", "y", "z")).alias("one")
    )


def _to_cell(level: Column) -> Column:
    """Smallest squared chord from the store to any point of the cell."""
    size = _cell_size(level)
    gaps = []
    for axis in _AXES:
        low = F.col(f"c{axis}") * size - 1
        gaps.append(_square(F.greatest(F.lit(0.0), low - F.col(axis), F.col(axis) - (low + size))))
    return F.sqrt(_sum(gaps))


def _to_representative() -> Column:
    return F.sqrt(_sum(_square(F.col(a) - F.col(f"one.{a}")) for a in _AXES))


def nearest_site(stores: DataFrame, sites: DataFrame, *, site_filter: Column | None = None) -> DataFrame:
    """Nearest qualifying site of every store, with the distance in km; equal distances go to the lowest site id.

    Places are points on the unit sphere, where the straight-line order is the great-circle order, and are indexed in a grid
    whose cells split by four along each axis. A store's search starts from an upper bound (the closest representative of
    the cells it lies in, on any level), opens the cells of matching size that could hold something as close, and goes down level by
    level, keeping the cells whose nearest possible point is within the best distance so far. That is exact, and a store
    meets only the few sites of its last cells. Stores stay, with NULLs, when no site qualifies.
    """
    qualified = sites if site_filter is None else sites.filter(site_filter)
    placed = _located(qualified.select("site_id", "site_name", "lat", "lon"))
    grid = stage(_grid(placed.select("x", "y", "z").distinct()), "site-grid")
    fullest = {r["level"]: r["fullest"] for r in grid.groupBy("level").agg(F.max("places").alias("fullest")).collect()}
    depth = next((level for level in sorted(fullest) if fullest[level] <= _LEAF_SITES), _DEEPEST)

    store_places = _located(stores.select("lat", "lon").distinct())
    around = F.sequence(F.lit(-1), F.lit(1))
    def own_cell(places: DataFrame, level: Column) -> DataFrame:
        return places.withColumn("level", level).select("*", *_cells(F.col("level")))

    def neighbourhood(places: DataFrame, level: Column) -> DataFrame:
        """The 27 cells around each place on its level."""
        own = own_cell(places, level)
        for a in _AXES:
            own = own.withColumn(f"d{a}", F.explode(around))
        moved = own.withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"d{a}") for a in _AXES})
        return moved.drop(*[f"d{a}" for a in _AXES])

    cell = ["cx", "cy", "cz"]
    place = ["lat", "lon", "x", "y", "z"]
    every_level = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    bounds = (
        own_cell(store_places, every_level)
        .join(grid.drop("places"), ["level", *cell])
        .groupBy(*place)
        .agg(F.min(_to_representative()).alias("best"))
    )
    # the level whose cells are just wider than the bound: the 27 cells around the place hold everything that close
    fitting = F.floor(F.log(2.0 / F.greatest(F.col("best") + _SLACK, F.lit(1e-12))) / F.log(F.lit(float(_SPLIT))))
    start = bounds.withColumn("start", F.greatest(F.lit(0), F.least(F.lit(depth), fitting)).cast("int"))
    opened = neighbourhood(start, F.col("start")).join(grid.select("level", *cell), ["level", *cell])
    opened = opened.filter(_to_cell(F.col("level")) <= F.col("best") + _SLACK).select(*place, "best", "level", *cell)
    opened = stage(opened, "opened-cells")
    starts = {r["level"] for r in opened.select("level").distinct().collect()}
    first = min(starts, default=depth)

    frontier = opened.filter(F.col("level") == first)
    for level in range(first + 1, depth + 1):
        parent = [F.floor(F.col(c) / _SPLIT).alias(f"p{c}") for c in cell]
        children = grid.filter(F.col("level") == level).select(*parent, *cell, "one")
        down = frontier.select(*place, "best", *[F.col(c).alias(f"p{c}") for c in cell]).join(children, [f"p{c}" for c in cell])
        mine = Window.partitionBy("lat", "lon")
        tightened = down.withColumn("best", F.least("best", F.min(_to_representative()).over(mine)))
        kept = tightened.filter(_to_cell(F.lit(level)) <= F.col("best") + _SLACK)
        frontier = kept.select(*place, "best", F.lit(level).alias("level"), *cell)
        if level in starts:
            frontier = frontier.unionByName(opened.filter(F.col("level") == level))

    leaf_sites = placed.select("site_id", "site_name", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), *_cells(F.lit(depth)))
    # sites at one place differ only by id: the lowest stands for all
    leaf_sites = leaf_sites.groupBy("site_lat", "site_lon", *cell).agg(
        F.min_by(F.struct("site_id", "site_name"), "site_id").alias("site")
    )
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon")), 6)
    found = (
        frontier.join(leaf_sites, cell)
        .groupBy("lat", "lon")
        .agg(F.min(F.struct(km.alias("distance_km"), F.col("site.site_id").alias("site_id"), F.col("site.site_name").alias("site_name"))).alias("hit"))
    )
    return stores.join(found, ["lat", "lon"], "left").select(
        *stores.columns, F.col("hit.site_id").alias("site_id"), F.col("hit.site_name").alias("site_name"), F.col("hit.distance_km").alias("distance_km")
    )


def home_store(customers: DataFrame, *, default_store_id: str) -> DataFrame:
    """Each customer's preferred store; the default store counts only for customers who really shop there."""
    assigned_by_default = (F.col("preferred_store_id") == default_store_id) & F.col("main_store_id").isNull()
    return customers.select("scv_id", F.when(~assigned_by_default, F.col("preferred_store_id")).alias("store_id"))


def customer_nearest_site(customers: DataFrame, store_sites: DataFrame, *, default_store_id: str) -> DataFrame:
    """The site nearest to each customer's home store."""
    return home_store(customers, default_store_id=default_store_id).join(
        store_sites.select("store_id", "site_id", "distance_km"), "store_id", "left"
    )
