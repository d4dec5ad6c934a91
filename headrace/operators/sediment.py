"""Sediment transport indicators of regulated against natural flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrace.functions.core import number
from headrace.functions.hydraulics import SECONDS_PER_YEAR
from headrace.functions.text import LITHOLOGY_RULES, keyword_class
from headrace.operators.ranking import exact_quantiles

EXPONENTS = ("b_low", "b_central", "b_high")

# Rating exponent by rock class (low, central, high).
EXPONENT_BY_CLASS = {
    "clastic_sed": (1.7, 2.2, 2.7),
    "crystalline": (1.3, 1.8, 2.3),
    "unconsolidated": (1.5, 2.0, 2.5),
    "volcanic": (1.5, 2.0, 2.5),
    "carbonate": (1.5, 2.0, 2.5),
    "default": (1.5, 2.0, 2.5),
}


def rating_exponents(stations: DataFrame, text: str) -> DataFrame:
    """D-5: rock class from descriptive text and its three exponents."""
    out = stations.withColumn("litho_class", keyword_class(text, LITHOLOGY_RULES))
    for i, name in enumerate(EXPONENTS):
        chosen: Column = F.lit(EXPONENT_BY_CLASS["default"][i])
        for label, values in EXPONENT_BY_CLASS.items():
            chosen = F.when(F.col("litho_class") == label, values[i]).otherwise(chosen)
        out = out.withColumn(name, chosen)
    return out


def fill_exponents(stations: DataFrame) -> DataFrame:
    """D-5: exponents read from a table; unreadable or absent ones take the default."""
    out = stations
    for i, name in enumerate(EXPONENTS):
        have = number(name) if name in stations.columns else F.lit(None).cast("double")
        out = out.withColumn(name, F.coalesce(have, F.lit(EXPONENT_BY_CLASS["default"][i])))
    return out


def transport_ratio(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-1: per year sum(q_reg^b)/sum(q_nat^b), then the mean of the years.

    ``pairs`` holds q_nat, q_reg and the three exponents of the station. Both
    steps are map-side aggregates; the exponents become rows only at the end.
    """
    sums = []
    for b in EXPONENTS:
        sums += [F.sum(F.pow("q_reg", b)).alias(f"r_{b}"), F.sum(F.pow("q_nat", b)).alias(f"n_{b}")]
    yearly = pairs.groupBy(*keys, "year").agg(*sums)
    means = [
        F.avg(F.when(F.col(f"n_{b}") > 0, F.col(f"r_{b}") / F.col(f"n_{b}"))).alias(b) for b in EXPONENTS
    ]
    return yearly.groupBy(*keys).agg(*means).unpivot(list(keys), list(EXPONENTS), "param", "stci")


def effective_discharge(pool: DataFrame, keys: Sequence[str], value: str, exponent: str,
                        bins: int = 25) -> DataFrame:
    """A-13, D-2: centre of the log-spaced bin with the greatest count x centre^b.

    Needs at least ``bins`` positive values. The first bin wins ties.
    """
    positive = pool.filter(F.col(value) > 0)
    span = positive.groupBy(*keys).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"),
        F.first(exponent).alias("b"),
    ).filter(F.col("n") >= bins)
    lo, hi = F.log10("lo"), F.log10("hi")
    raw = F.floor((F.log10(value) - lo) / (hi - lo) * bins) + 1
    bin_no = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(raw, F.lit(bins)))
    counts = positive.join(span, list(keys)).groupBy(*keys, "lo", "hi", "b", bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    width = (F.log10("hi") - F.log10("lo")) / bins
    centre = F.pow(F.lit(10.0), F.log10("lo") + (F.col("bin") - 0.5) * width)
    loads = counts.withColumn("centre", centre).withColumn("load", F.col("count") * F.pow("centre", "b"))
    return loads.groupBy(*keys).agg(
        F.min_by("centre", F.struct(-F.round("load", 9), F.col("bin"))).alias("q_eff"))


def peak_ratios(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-3: mean annual maximum and 95th percentile of the pool, natural and regulated.

    One scan and one exchange by ``keys``: a year's maxima stand on the year's first row, and the pool of a station
    is bounded by the calendar.
    """
    year = Window.partitionBy(*keys, "year")
    whole = year.orderBy(F.desc("q_nat")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = pairs.repartition(*keys).select(
        *keys, "q_nat", "q_reg", F.row_number().over(year.orderBy(F.desc("q_nat"))).alias("__n"), F.max("q_reg").over(whole).alias("__reg"))
    first = F.col("__n") == 1
    return marked.groupBy(*keys).agg(
        F.avg(F.when(first, F.col("q_nat"))).alias("annualmax_nat"), F.avg(F.when(first, F.col("__reg"))).alias("annualmax_reg"),
        F.percentile("q_nat", F.lit(0.95)).alias("q5pct_nat"), F.percentile("q_reg", F.lit(0.95)).alias("q5pct_reg"))


def residence_and_retention(nat: DataFrame, stations: DataFrame, keys: Sequence[str],
                            volume: str = "max_vol_km3") -> DataFrame:
    """D-4: residence time V/Q in years and phosphorus retention sqrt(t)/(1+sqrt(t))."""
    mean = nat.groupBy(*keys).agg(F.avg("q").alias("q_mean"))
    per_year = F.col("q_mean") * SECONDS_PER_YEAR / 1e9
    tau = F.when(per_year > 0, F.try_divide(F.col(volume), per_year))
    out = mean.join(stations.select(*keys, volume), list(keys), "left").withColumn("residence_time_yr", tau)
    root = F.sqrt("residence_time_yr")
    return out.withColumn(
        "p_retention_frac", F.when(F.col("residence_time_yr") >= 0, root / (1 + root)))


def pooled_limit(effects: DataFrame, keys: Sequence[str], value: str, p: float = 0.92) -> DataFrame:
    """V-16: percentile of the absolute effect over all reaches of a group (no size bound)."""
    return exact_quantiles(effects, keys, F.abs(value), {"limit": p})
