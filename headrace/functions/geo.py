"""Distances, bands and coordinate names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headrace.functions.core import ColumnLike, col

EARTH_KM = 6371.0


def haversine_km(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """X-2: great-circle distance on a sphere of 6371 km."""
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlon = a2 - a1, F.radians(col(lon2) - col(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def unit_vector(lat: ColumnLike, lon: ColumnLike) -> list[Column]:
    """Point on the unit sphere; chord length there orders like great-circle distance."""
    a, o = F.radians(col(lat)), F.radians(col(lon))
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def net_evaporation_mm(lat: ColumnLike) -> Column:
    """P-15: net open-water evaporation by absolute latitude, mm per year (fixed values)."""
    a = F.abs(col(lat))
    return (F.when(a <= 15, 1200.0).when(a <= 30, 1500.0).when(a <= 45, 600.0)
            .when(a <= 55, 300.0).otherwise(150.0))


def climate_zone(lat: ColumnLike) -> Column:
    """P-15: climate zone by absolute latitude (fixed limits)."""
    a = F.abs(col(lat))
    return (F.when(a < 23.5, "tropical").when(a < 35, "subtropical")
            .when(a < 55, "temperate").when(a.isNotNull(), "boreal"))


def utm_epsg(lat: ColumnLike, lon: ColumnLike) -> Column:
    """X-14: EPSG code of the UTM zone that holds a point."""
    zone = F.floor((col(lon) + 180) / 6).cast("int") + 1
    return F.when(col(lat) >= 0, 32600 + zone).otherwise(32700 + zone)


def grid_station_name(lat: ColumnLike, lon: ColumnLike) -> Column:
    """P-28: ``s15000n102000e``: thousandths of a degree with hemisphere letters."""
    la, lo = col(lat), col(lon)
    return F.concat(
        F.lit("s"),
        F.bround(F.abs(la) * 1000, 0).cast("int").cast("string"), F.when(la >= 0, "n").otherwise("s"),
        F.bround(F.abs(lo) * 1000, 0).cast("int").cast("string"), F.when(lo >= 0, "e").otherwise("w"),
    )


STATION_NAME = r"^s(\d+)([ns])(\d+)([ew])$"


def grid_station_coords(name: ColumnLike) -> list[Column]:
    """P-28 inverse: latitude and longitude of a station name, NULL if it is not one."""
    n = F.lower(F.trim(col(name)))

    def part(value: int, letter: int, negative: str) -> Column:
        digits = F.nullif(F.regexp_extract(n, STATION_NAME, value), F.lit("")).cast("double") / 1000
        return F.when(F.regexp_extract(n, STATION_NAME, letter) == negative, -digits).otherwise(digits)

    return [part(1, 2, "s").alias("lat"), part(3, 4, "w").alias("lon")]
