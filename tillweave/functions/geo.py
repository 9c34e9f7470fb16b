"""Distances on a spherical earth, as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.01


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in kilometres between two points in degrees."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(chord))) * (2 * EARTH_RADIUS_KM)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point as x, y, z on the unit sphere. Straight-line order equals great-circle order."""
    return (
        F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
        F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
        F.sin(F.radians(lat)),
    )
