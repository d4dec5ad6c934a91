"""Hourly load profiles from many kinds of sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.functions.core import clip, weighted_mean
from headrace.operators.series import roll_hours

FIRST_YEAR, LAST_YEAR = 2027, 2040


def utc_shift(offset_h: str):
    """Hours to move a local profile to UTC; half hours round to the even hour."""
    return -F.bround(F.col(offset_h), 0).cast("int")


def profile_table(load: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "load_mw") -> DataFrame:
    """L-4, first half: load over its 99th percentile, averaged by day of year and hour.

    Also carries the overall mean, used for slots without data. A region's hourly
    series is bounded by the calendar, so the built-in percentile is safe.
    """
    rows = load.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
    peak = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.99)).alias("p99"), F.avg(value).alias("mean"))
    slots = rows.groupBy(*keys, F.dayofyear(ts).alias("doy"), F.hour(ts).alias("hod")).agg(F.avg(value).alias("slot"))
    return slots.join(peak, list(keys)).select(
        *keys, "doy", "hod", F.try_divide("slot", "p99").alias("l_norm"), F.try_divide("mean", "p99").alias("l_mean"))


def load_profile(load: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "load_mw",
                 offsets: DataFrame | None = None, years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR)) -> DataFrame:
    """L-4: normalised profile on every hour of the horizon; day 366 repeats day 365.

    Each slot emits its own hours; slots without data take the overall mean.
    """
    table = profile_table(load, keys, ts, value)
    grid = table.groupBy(*keys).agg(F.max("l_mean").alias("l_mean")).select(
        *keys, "l_mean", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("year"))
    hours = grid.select(*keys, "l_mean", "year",
                        F.explode(F.sequence(F.lit(0), cal.hours_in_year("year") - 1)).alias("hoy"))
    at = hours.withColumn("doy", F.least(cal.day_of_year("hoy"), F.lit(365))).withColumn("hod", F.col("hoy") % 24)
    filled = at.join(table.drop("l_mean"), [*keys, "doy", "hod"], "left").select(
        *keys, "year", "hoy", F.coalesce("l_norm", "l_mean").alias("l_norm"))
    if offsets is None:
        return filled
    moved = filled.join(offsets, list(keys), "left").withColumn(
        "__s", F.coalesce(utc_shift("offset_h"), F.lit(0)))
    return roll_hours(moved, "__s").select(*keys, "year", "hoy", "l_norm")


def profile_from_shape(shapes: DataFrame, keys: Sequence[str],
                       years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR)) -> DataFrame:
    """L-5: 24 hourly x 12 monthly factors on the calendar, over the year's 99th percentile.

    ``shapes``: keys, hourly ARRAY(24), monthly ARRAY(12).
    """
    grid = shapes.select(*keys, "hourly", "monthly", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("year"))
    hours = grid.select("*", F.explode(F.sequence(F.lit(0), cal.hours_in_year("year") - 1)).alias("hoy"))
    raw = F.element_at("hourly", (F.col("hoy") % 24 + 1).cast("int")) * F.element_at(
        "monthly", cal.month_of("year", "hoy"))
    at = hours.select(*keys, "year", "hoy", raw.alias("v"))
    p99 = at.groupBy(*keys, "year").agg(F.percentile("v", F.lit(0.99)).alias("p99"))
    return at.join(p99, [*keys, "year"]).select(*keys, "year", "hoy", F.try_divide("v", "p99").alias("l_norm"))


def seasonal_factors(profile: DataFrame, keys: Sequence[str], value: str = "l_norm") -> DataFrame:
    """L-6: mean of each 730-hour month over the mean of the monthly means."""
    month = F.least(F.floor(F.col("hoy") / 730), F.lit(11)).cast("int")
    means = profile.groupBy(*keys, month.alias("month")).agg(F.avg(value).alias("m"))
    return means.select(*keys, "month", F.try_divide(F.col("m"), F.avg("m").over(Window.partitionBy(*keys))).alias("factor"))


def repeat_year_profile(typical: DataFrame, keys: Sequence[str], value: str = "l_norm",
                        years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR)) -> DataFrame:
    """L-7: one year of 8760 values on every year; leap hours start over at hour 0."""
    year = F.explode(F.sequence(F.lit(years[0]), F.lit(years[1])))
    at = typical.filter("hoy < 8760").select(*keys, year.alias("year"), "hoy", value)
    leap = cal.is_leap("year") & (F.col("hoy") < 24)
    both = F.when(leap, F.array("hoy", F.col("hoy") + 8760)).otherwise(F.array("hoy"))
    return at.select(*keys, "year", F.explode(both).alias("hoy"), value)


def average_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str = "l_norm") -> DataFrame:
    """L-7: row mean of several year columns, NULLs skipped."""
    known = F.filter(F.array(*columns), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    return df.select(*keys, mean.alias(out))


def aggregate_areas(load: DataFrame, mapping: DataFrame, area: str = "area", ts: str = "ts",
                    value: str = "load_mw") -> DataFrame:
    """L-8, A-2: areas summed to regions hour by hour; an area may feed several regions."""
    return load.join(mapping, area).groupBy("region", ts).agg(F.sum(value).alias(value))


def proxy_profile(profile: DataFrame, proxies: DataFrame, offsets: DataFrame) -> DataFrame:
    """L-9: copy a similar region's UTC profile, moved by the difference of the offsets.

    ``proxies``: target, source. ``offsets``: region, offset_h.
    """
    own = offsets.select(F.col("region").alias("target"), F.col("offset_h").alias("__t"))
    src = offsets.select(F.col("region").alias("source"), F.col("offset_h").alias("__s"))
    pairs = proxies.join(own, "target", "left").join(src, "source", "left")
    delta = F.coalesce(F.bround(F.col("__t") - F.col("__s"), 0).cast("int"), F.lit(0))
    at = profile.withColumnRenamed("region", "source").join(pairs, "source")
    return roll_hours(at.withColumn("__d", -delta), "__d").select(
        F.col("target").alias("region"), "year", "hoy", "l_norm")


def floor_filter(load: DataFrame, floors: Mapping[str, float], source: str = "source",
                 value: str = "load_mw") -> DataFrame:
    """P-22: drop loads at or below the floor of their source."""
    limit = F.lit(None).cast("double")
    for name, floor in floors.items():
        limit = F.when(F.col(source) == name, floor).otherwise(limit)
    return load.filter(F.col(value) > F.coalesce(limit, F.lit(float("-inf"))))


def monthly_coverage(hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V-3: monthly firm energy over monthly load, in percent, within 0..100."""
    sums = hourly.groupBy(*keys, "year", cal.month_of("year", "hoy").alias("month")).agg(
        F.sum("firm_mw").alias("firm"), F.sum("load_mw").alias("load"))
    pct = 100 * F.try_divide("firm", "load")
    return sums.select(*keys, "year", "month", clip(pct, 0.0, 100.0).alias("coverage_pct"))


def demand_weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """V-1, V-8: weighted mean and median by group."""
    return df.groupBy(*keys).agg(
        weighted_mean(value, clip(weight, 1e-6)).alias("weighted"), F.percentile(value, F.lit(0.5)).alias("median"))
