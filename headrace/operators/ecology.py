"""Flow-alteration indicators: duration curves, ramping, drawdown, floods and the 33 flow parameters.

``flow`` is a series table (keys, scenario, year, hoy, q); see ``series`` for the
bound on one key's rows that the windows rely on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.functions.core import bounded_change, circular_shift
from headrace.functions.hydraulics import WIDTH_COEF, WIDTH_EXP, channel_depth
from headrace.functions.text import risk_bin
from headrace.operators import series as S

DEAD_BAND = 0.05
CURVE_POINTS = 500
RAMP_METRICS = ("rr_down_mean", "rr_down_p95", "rr_up_p95", "rr_down_p95_pctmean", "hp1", "reversals_per_year")
ROLL_DAYS = (1, 3, 7, 30, 90)
MONTHLY = tuple(f"mag_month{m:02d}" for m in range(1, 13))
EXTREMES = tuple(f"{e}{w}day" for w in ROLL_DAYS for e in ("min", "max")) + ("zero_days", "baseflow_index")
TIMING = ("jd_max", "jd_min")
PULSES = ("lo_pulse_count", "lo_pulse_dur", "hi_pulse_count", "hi_pulse_dur")
CHANGES = ("rise_rate", "fall_rate", "reversals")
FLOW_PARAMETERS = MONTHLY + EXTREMES + TIMING + PULSES + CHANGES


def ecodeficit(flow: DataFrame, keys: Sequence[str], lat: str = "lat") -> DataFrame:
    """D-6: area between the duration curves over the annual natural mean, total and by season.

    ``flow`` carries the station latitude. Seasonal values are weighted by the
    season's share of the natural hours; surplus is kept for the total only.
    """
    seasons = F.array(F.lit("total"), cal.season(cal.month_of("year", "hoy"), lat))
    pools = flow.filter(F.col("q").isNotNull()).select(*keys, "scenario", F.explode(seasons).alias("season"), "q")
    curve = S.flow_duration_curve(pools, [*keys, "scenario", "season"], points=CURVE_POINTS)
    paired = S.attach_baseline(curve, [*keys, "season", "k"], value="fdc")
    gap = F.col("fdc_nat") - F.col("fdc_reg")
    ends = F.when(F.col("k").isin(1, CURVE_POINTS), 0.5).otherwise(1.0)
    areas = paired.filter(gap.isNotNull()).groupBy(*keys, "scenario", "season").agg(
        (F.sum(ends * F.greatest(gap, F.lit(0.0))) / CURVE_POINTS).alias("deficit"),
        (F.sum(ends * F.greatest(-gap, F.lit(0.0))) / CURVE_POINTS).alias("surplus"),
    )
    nat = pools.filter(F.col("scenario") == S.BASELINE)
    sizes = nat.groupBy(*keys, "season").agg(F.count("q").alias("n"), F.avg("q").alias("mean"))
    total = sizes.filter("season = 'total'").select(*keys, F.col("n").alias("n_all"), F.col("mean").alias("mean_all"))
    shares = sizes.join(total, list(keys)).select(
        *keys, "season", (F.col("n") / F.col("n_all")).alias("share"), "mean_all")
    out = areas.join(shares, [*keys, "season"])
    scale = F.when(F.col("mean_all") > 0, F.col("share") / F.col("mean_all"))
    return out.select(
        *keys, "scenario", "season", (F.col("deficit") * scale).alias("ecodeficit"),
        F.when(F.col("season") == "total", F.col("surplus") * scale).alias("ecosurplus"),
    )


def ramping(flow: DataFrame, keys: Sequence[str], min_hours: int = 48, dead_band: float = DEAD_BAND) -> DataFrame:
    """D-7: ramp rates, daily range and hourly reversals per key (scenario included in ``keys``).

    Years with fewer than ``min_hours`` values are skipped; the dead band is a
    share of the mean over all years. One exchange serves every window.
    """
    series, year = Window.partitionBy(*keys), Window.partitionBy(*keys, "year")
    ordered = year.orderBy("hoy")
    base = flow.select(
        *keys, "year", "hoy", "q", F.avg("q").over(series).alias("mean"),
        F.count("q").over(year).alias("n"), S.step_change("q", "hoy", ordered).alias("dq"),
        F.row_number().over(ordered).alias("first"),
    )
    turned = base.withColumn("turn", S.direction_change("dq", dead_band * F.col("mean"), ordered))
    used = F.col("n") >= min_hours
    dq = F.when(used, F.col("dq"))
    down, up = F.when(dq < 0, -dq), F.when(dq > 0, dq)
    p95 = F.percentile(down, F.lit(0.95))
    rates = turned.groupBy(*keys).agg(
        F.avg(down).alias("rr_down_mean"), p95.alias("rr_down_p95"),
        F.percentile(up, F.lit(0.95)).alias("rr_up_p95"), F.avg("q").alias("mean"),
        F.try_divide(F.count_if(used & F.col("turn")), F.count_if(used & (F.col("first") == 1))).alias(
            "reversals_per_year"),
    )
    days = S.daily(base.filter(used), keys, {
        "m": F.avg("q"), "range": F.max("q") - F.min("q")})
    hp1 = days.filter(F.col("m") > 0).groupBy(*keys).agg(
        F.percentile(F.col("range") / F.col("m"), F.lit(0.5)).alias("hp1"))
    share = F.when(F.col("mean") > 0, F.col("rr_down_p95") / F.col("mean") * 100)
    return rates.join(hp1, list(keys), "left").withColumn("rr_down_p95_pctmean", share).select(
        *keys, *RAMP_METRICS)


def drawdown(flow: DataFrame, keys: Sequence[str], slope: str = "slope", min_hours: int = 48) -> DataFrame:
    """D-8: hourly depth drops in cm/h: mean of the yearly p95, hours per year above 10 and 13.

    ``flow`` carries the channel slope (NULL: global depth relation). Zero flow counts.
    """
    year = Window.partitionBy(*keys, "year")
    depth = F.when(F.col("q").isNotNull(), channel_depth("q", slope))
    base = flow.select(*keys, "year", "hoy", depth.alias("d"), F.count("q").over(year).alias("n"))
    drop = -S.step_change("d", "hoy", year.orderBy("hoy")) * 100.0
    drops = base.withColumn("drop", drop).filter((F.col("n") >= min_hours) & (F.col("drop") > 0))
    yearly = drops.groupBy(*keys, "year").agg(
        F.percentile("drop", F.lit(0.95)).alias("p95"), F.count_if(F.col("drop") > 10).alias("h10"),
        F.count_if(F.col("drop") > 13).alias("h13"))
    return yearly.groupBy(*keys).agg(
        F.avg("p95").alias("vrr_p95_cmh"), F.avg("h10").alias("vrr_exceed_h_10cmh"),
        F.avg("h13").alias("vrr_exceed_h_13cmh"))


def varial_zone(flow: DataFrame, keys: Sequence[str], length_km: str = "length_km") -> DataFrame:
    """D-9: mean daily range of wetted width; days are 24 consecutive valid hours."""
    valid = flow.filter(F.col("q") >= 0)
    year = Window.partitionBy(*keys, "year")
    at = valid.select(*keys, "year", "q", length_km, (F.row_number().over(year.orderBy("hoy")) - 1).alias("i"),
                      F.count(F.lit(1)).over(year).alias("n"))
    block = F.floor(F.col("i") / 24)
    days = at.filter(block < F.floor(F.col("n") / 24)).groupBy(*keys, "year", block.alias("block")).agg(
        F.max("q").alias("hi"), F.min("q").alias("lo"), F.first(length_km).alias(length_km))
    width = WIDTH_COEF * (F.pow("hi", F.lit(WIDTH_EXP)) - F.pow("lo", F.lit(WIDTH_EXP)))
    out = days.groupBy(*keys).agg(F.avg(width).alias("varial_width_m"), F.first(length_km).alias("__l"))
    return out.select(*keys, "varial_width_m", (F.col("varial_width_m") * F.col("__l") * 1000).alias("varial_area_m2"))


def flood_recurrence(flow: DataFrame, keys: Sequence[str], interval: float = 1.67) -> DataFrame:
    """D-10: recurrence flood of the annual maxima, its relative change from natural, and a risk bin."""
    yearly = flow.groupBy(*keys, "scenario", "year").agg(F.max("q").alias("peak"))
    floods = S.recurrence_quantile(yearly, [*keys, "scenario"], "peak", interval, out="q")
    paired = S.attach_baseline(floods, keys)
    change = F.when(F.col("q_nat") != 0, F.try_divide(F.col("q_reg") - F.col("q_nat"), F.col("q_nat")))
    return paired.withColumn("alteration", change).withColumn("risk", risk_bin("alteration"))


def pulse_thresholds(days: DataFrame, keys: Sequence[str], min_days: int = 30) -> DataFrame:
    """25th and 75th percentile of the natural daily flow; NULL for short records."""
    enough = F.count("d") >= min_days
    return days.groupBy(*keys).agg(
        F.when(enough, F.percentile("d", F.lit(0.25))).alias("lo"),
        F.when(enough, F.percentile("d", F.lit(0.75))).alias("hi"))


def flow_parameters_by_year(flow: DataFrame, keys: Sequence[str], min_days: int = 300,
                            dead_band: float = DEAD_BAND) -> DataFrame:
    """D-11: the 33 parameters of each year with at least ``min_days`` valid days.

    Invalid days are removed first; months, windows and runs then go by position.
    """
    days = S.daily(flow, [*keys, "scenario"], {"d": F.avg("q")}).filter(F.col("d").isNotNull())
    limits = pulse_thresholds(days.filter(F.col("scenario") == S.BASELINE), keys)
    years = [*keys, "scenario", "year"]
    whole = Window.partitionBy(*years)
    ordered = whole.orderBy("doy")
    numbered = days.join(limits, list(keys), "left").select(
        *years, "doy", "d", "lo", "hi", F.row_number().over(ordered).alias("pos"),
        F.count(F.lit(1)).over(whole).alias("n"), F.avg("d").over(whole).alias("mean"),
    ).filter(F.col("n") >= min_days)
    pos, d, n = F.col("pos"), F.col("d"), F.col("n")
    month = F.month(F.date_add(F.when(n >= 366, F.lit("2004-01-01")).otherwise(F.lit("2001-01-01")).cast("date"),
                               pos - 1))
    dd = d - F.lag("d").over(ordered)
    low, high = d < F.col("lo"), d > F.col("hi")

    def starts(mask):
        m = F.coalesce(mask, F.lit(False))
        return m & ~F.coalesce(F.lag(m).over(ordered), F.lit(False))

    marked = numbered.select(
        *years, "pos", "n", "d", "mean", "lo", "hi", month.alias("month"), dd.alias("dd"),
        low.alias("low"), high.alias("high"), starts(low).alias("low_start"), starts(high).alias("high_start"),
        *[F.when(pos >= w, F.avg("d").over(ordered.rowsBetween(1 - w, 0))).alias(f"roll{w}") for w in ROLL_DAYS],
    )
    band = F.when(F.col("mean") > 0, dead_band * F.col("mean")).otherwise(0.0)
    marked = marked.withColumn("turn", S.direction_change("dd", band, whole.orderBy("pos")))

    def pulse(side: str, limit: str):
        count = F.count_if(f"{side}_start")
        length = F.coalesce(F.try_divide(F.count_if(side), count), F.lit(0.0))
        known = F.first(limit).isNotNull()
        return [F.when(known, count).cast("double").alias(f"{side[:2]}_pulse_count"),
                F.when(known, length).alias(f"{side[:2]}_pulse_dur")]

    day = F.col("d")
    return marked.groupBy(*years).agg(
        *[F.avg(F.when(F.col("month") == m, day)).alias(MONTHLY[m - 1]) for m in range(1, 13)],
        *[f(f"roll{w}").alias(f"{e}{w}day") for w in ROLL_DAYS for e, f in (("min", F.min), ("max", F.max))],
        F.count_if(day <= 0).cast("double").alias("zero_days"),
        F.when(F.first("mean") > 0, F.min("roll7") / F.first("mean")).alias("baseflow_index"),
        F.min_by("pos", F.struct(-day, F.col("pos"))).cast("double").alias("jd_max"),
        F.min_by("pos", F.struct(day, F.col("pos"))).cast("double").alias("jd_min"),
        *pulse("low", "lo"), *[c for c in pulse("high", "hi")],
        F.coalesce(F.avg(F.when(F.col("dd") > 0, F.col("dd"))), F.lit(0.0)).alias("rise_rate"),
        F.coalesce(F.avg(F.when(F.col("dd") < 0, F.col("dd"))), F.lit(0.0)).alias("fall_rate"),
        F.count_if("turn").cast("double").alias("reversals"),
    )


def circular_mean_day(day: str, period: float = 365.0):
    """A-17: aggregate; mean day of year on the circle, day 1 at angle 0."""
    angle = (F.col(day) - 1.0) / period * 2 * F.pi()
    mean = F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) / (2 * F.pi()) * period
    return F.pmod(mean, F.lit(period)) + 1.0


def flow_parameters(flow: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """D-11: median over the years of each parameter; timing by the circular mean."""
    yearly = flow_parameters_by_year(flow, keys, **options)
    years_to_one = [
        circular_mean_day(p).alias(p) if p in TIMING else F.percentile(p, F.lit(0.5)).alias(p)
        for p in FLOW_PARAMETERS
    ]
    return yearly.groupBy(*keys, "scenario").agg(*years_to_one)


def parameter_group(param: str = "param"):
    p = F.col(param)
    return (F.when(p.isin(*MONTHLY), 1).when(p.isin(*EXTREMES), 2).when(p.isin(*TIMING), 3)
            .when(p.isin(*PULSES), 4).otherwise(5))


def alteration(parameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-12: change of every parameter from natural, in [-1, 1]; timing as a share of half a year."""
    long = parameters.unpivot([*keys, "scenario"], list(FLOW_PARAMETERS), "param", "q")
    paired = S.attach_baseline(long, [*keys, "param"])
    both = paired.filter(F.col("q_nat").isNotNull() & F.col("q_reg").isNotNull())
    shift = F.abs(circular_shift("q_nat", "q_reg")) / 182.5
    change = F.when(F.col("param").isin(*TIMING), shift).otherwise(bounded_change("q_nat", "q_reg"))
    return both.withColumn("alteration", change).withColumn("param_group", parameter_group())


def alteration_index(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-12: mean absolute alteration overall and by parameter group."""
    size = F.abs("alteration")
    return changes.groupBy(*keys, "scenario").agg(
        F.avg(size).alias("hai"),
        *[F.avg(F.when(F.col("param_group") == g, size)).alias(f"hai_group{g}") for g in range(1, 6)])


def channel_slope(stations: DataFrame, network: DataFrame, river: str = "river_id",
                  raw: str = "slope_dm_per_km") -> DataFrame:
    """D-13: slope in m/m of the station's reach (dm/km x 1e-4), by river id; unknown stays NULL."""
    slopes = network.select(river, (F.col(raw) * 1e-4).alias("slope"))
    return stations.join(slopes, river, "left")
