"""Gridded weather to station series and climate statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrace.functions.core import clip, small_side
from headrace.operators.ranking import running_totals
from headrace.operators.spatial import nearest

FILL_LIMIT = 1e10


def normalise_units(grid: DataFrame, keys: Sequence[str], first_hours: int = 24) -> DataFrame:
    """P-20: fill values out, kg/m2/s to mm/h, K to C, % to a share, bounds.

    ``grid``: keys, var, units, ts, lat, lon, value. Whether a file is in K or in %
    shows in its mean over the first day, one small aggregate joined back.
    """
    known = F.when(F.abs("value") <= FILL_LIMIT, F.col("value"))
    rows = grid.withColumn("value", known)
    judged = rows.filter(F.col("var").isin("tas", "hurs"))
    start = judged.groupBy(*keys, "var").agg(F.min("ts").alias("__t0"))
    early = judged.join(small_side(start), [*keys, "var"]).filter(
        F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("__t0").cast("timestamp"))
        < first_hours * 3600)
    means = early.groupBy(*keys, "var").agg(F.avg("value").alias("__mean"))
    at = rows.join(small_side(means), [*keys, "var"], "left")
    v = F.col("value")
    rate = F.col("units").rlike(r"kg|s-1|s\^-1")
    out = (F.when(F.col("var") == "pr", clip(F.when(rate, v * 3600.0).otherwise(v), 0.0))
           .when(F.col("var") == "tas", F.when(F.col("__mean") > 100, v - 273.15).otherwise(v))
           .when(F.col("var") == "hurs", clip(F.when(F.col("__mean") > 5, v / 100.0).otherwise(v), 0.0, 1.0))
           .when(F.col("var") == "sfcwind", clip(v, 0.0)).otherwise(v))
    return at.withColumn("value", out).drop("__mean")


def derive_weather(raw: DataFrame, keys: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """P-21: rain in mm, temperature in C, humidity by the Magnus formula, radiation in MJ, wind speed."""
    t, d = F.col("t2m") - 273.15, F.col("d2m") - 273.15
    a, b = 17.625, 243.04
    humidity = clip(F.exp(a * d / (b + d)) / F.exp(a * t / (b + t)), 0.0, 1.0)
    return raw.select(
        *keys, "ts", clip(F.col("tp") * 1000.0, 0.0).alias("pcp_mm"), t.alias("tmp_c"),
        humidity.alias("hmd"), clip(F.col("ssrd") / 1e6, 0.0).alias("slr_mj"),
        F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10")).alias("wnd"))


def daily_weather(hourly: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """A-4: daily extremes, sums and means; the hourly rain maximum is kept."""
    return hourly.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        F.max("tmp_c").alias("tmax"), F.min("tmp_c").alias("tmin"), F.sum("pcp_mm").alias("pcp"),
        F.max("pcp_mm").alias("pcp_hour_max"), F.sum("slr_mj").alias("slr"), F.avg("hmd").alias("hmd"),
        F.avg("wnd").alias("wnd"))


def generator_stats(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L-2: monthly generator statistics; months without data take the stated defaults."""
    def or_default(c, default):
        return F.coalesce(c, F.lit(default))
    wet = F.count_if(F.col("pcp") > 0.1)
    share = F.least(wet / F.count(F.lit(1)), F.lit(0.95))
    low = F.lit(0.1)
    stats = days.groupBy(*keys, F.month("date").alias("month")).agg(
        or_default(F.avg("tmax"), 30.0).alias("tmax_ave"), or_default(F.avg("tmin"), 22.0).alias("tmin_ave"),
        F.greatest(low, or_default(F.stddev_pop("tmax"), 1.5)).alias("tmax_sd"),
        F.greatest(low, or_default(F.stddev_pop("tmin"), 1.0)).alias("tmin_sd"),
        or_default(F.sum("pcp"), 0.0).alias("pcp_sum"), F.greatest(low, or_default(F.stddev_pop("pcp"), 5.0)).alias("pcp_sd"),
        share.alias("wet_dry"), share.alias("wet_wet"), F.greatest(low, wet.cast("double")).alias("pcp_days"),
        F.greatest(low, or_default(F.max("pcp_hour_max"), 10.0)).alias("pcp_hour_max"),
        or_default(F.avg("slr"), 18.0).alias("slr_ave"), or_default(F.avg("hmd"), 0.75).alias("dew_ave"),
        or_default(F.avg("wnd"), 2.0).alias("wnd_ave"))
    empty = {"tmax_ave": 32.0, "tmin_ave": 23.0, "tmax_sd": 1.5, "tmin_sd": 1.0, "pcp_sum": 150.0, "pcp_sd": 10.0,
             "wet_dry": 0.4, "wet_wet": 0.6, "pcp_days": 15.0, "pcp_hour_max": 30.0, "slr_ave": 18.0,
             "dew_ave": 0.75, "wnd_ave": 2.0}
    months = stats.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return months.join(stats, [*keys, "month"], "left").fillna(empty)


def land_mask(grid: DataFrame, keys: Sequence[str], variables: Sequence[str], min_share: float = 0.5) -> DataFrame:
    """L-1: cells where every variable is present in at least half of the steps, numbered by position."""
    shares = grid.groupBy(*keys, "lat", "lon").agg(
        F.least(*[F.avg(F.col(v).isNotNull().cast("int")) for v in variables]).alias("min_valid"))
    kept = shares.filter(F.col("min_valid") >= min_share)
    numbered = running_totals(kept, keys, ["lat", "lon"], {}, row_number="cell_no")
    return numbered.withColumn("cell_id", F.format_string("s%05d", "cell_no"))


def nearest_land_cell(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """J-10: the nearest cell if it is land, else the nearest land cell.

    ``stations``: station, lat, lon. ``cells``: cell, lat, lon, is_land.
    """
    any_cell = nearest(stations, cells, "station", "cell", ["lat", "lon"]).join(cells.select("cell", "is_land"), "cell")
    wet = any_cell.filter(~F.col("is_land")).select("station")
    again = nearest(stations.join(wet, "station", "left_semi"), cells.filter("is_land"), "station", "cell", ["lat", "lon"])
    return any_cell.filter("is_land").select("station", "cell", F.lit(False).alias("remapped")).unionByName(
        again.select("station", "cell", F.lit(True).alias("remapped")))


def grid_to_station_series(hourly: DataFrame, station_cells: DataFrame) -> DataFrame:
    """L-3: daily weather of each station's cell; cells are aggregated once, then joined to many stations."""
    return station_cells.select("station", "cell").join(daily_weather(hourly, ["cell"]), "cell")
