"""Power, firm capacity and energy tables from hourly flow and power."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.functions.core import ColumnLike, clip, col, ratio
from headrace.functions.hydraulics import flow_for_power, power_mw, pump_flow, turbine_efficiency

OUTAGE_MAX = 0.000274  # fixed value: share of hours a firm target may be missed


def run_of_river_power(flow: DataFrame) -> DataFrame:
    """R-1: min(min(Q, Qmax) at efficiency and head, rated power), MW."""
    eta = turbine_efficiency("head_m")
    q_max = flow_for_power("capacity_mw", "head_m", eta)
    made = power_mw(clip("q", None, q_max), "head_m", eta)
    return flow.withColumn("p_mw", clip(made, None, F.col("capacity_mw")))


def firm_capacity(power: DataFrame, keys: Sequence[str], p: ColumnLike = "p_mw", load: ColumnLike = "load",
                  outage: float = OUTAGE_MAX) -> DataFrame:
    """R-2: tail percentile of power over load, hours with load only, not below 0.

    One station's hours are bounded by the calendar, so the built-in percentile is safe.
    """
    share = F.when(col(load) > 0, ratio(p, load))
    return power.groupBy(*keys).agg(
        F.greatest(F.coalesce(F.percentile(share, F.lit(outage)), F.lit(0.0)), F.lit(0.0)).alias("firm_mw"))


def firm_capacity_exact(power: DataFrame, keys: Sequence[str], p: str = "p_mw", load: str = "load",
                        outage: float = OUTAGE_MAX) -> DataFrame:
    """R-3: the largest target missed in at most ``outage`` of the hours: an order statistic of P/L."""
    rows = power.filter((F.col(load) > 0) & F.col(p).isNotNull()).select(*keys, (F.col(p) / F.col(load)).alias("r"))
    group = Window.partitionBy(*keys)
    ranked = rows.select(*keys, "r", F.row_number().over(group.orderBy("r")).alias("i"),
                         F.count(F.lit(1)).over(group).alias("n"))
    at = F.col("i") == F.floor(F.lit(outage) * F.col("n")) + 1
    return ranked.groupBy(*keys).agg(F.greatest(F.max(F.when(at, F.col("r"))), F.lit(0.0)).alias("firm_mw"))


def outage_fraction(power: DataFrame, targets: DataFrame, keys: Sequence[str], p: str = "p_mw",
                    load: str = "load", target: str = "firm_mw") -> DataFrame:
    """R-4: share of hours whose power is below target x load."""
    at = power.join(targets.select(*keys, target), list(keys))
    below = (F.col(p) < F.col(target) * F.col(load) - 1e-6).cast("int")
    return at.groupBy(*keys).agg(F.avg(F.when(F.col(load) > 0, below)).alias("outage"))


def portfolio_firm(power: DataFrame, loads: DataFrame, keys: Sequence[str], outage: float = OUTAGE_MAX) -> DataFrame:
    """R-5: firm capacity of the summed station shares plus net pumped storage, hour by hour.

    ``power``: keys, year, hoy, p_mw, share, ps_net_mw. ``loads``: keys, year, hoy, load.
    """
    mix = F.coalesce("p_mw", F.lit(0.0)) * F.coalesce("share", F.lit(1.0)) + F.coalesce("ps_net_mw", F.lit(0.0))
    hourly = power.groupBy(*keys, "year", "hoy").agg(F.sum(mix).alias("p_mw"))
    return firm_capacity(hourly.join(loads, [*keys, "year", "hoy"]), keys, outage=outage)


def yearly_energy(power: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-6: yearly energy (MWh, GWh) and capacity factor."""
    energy = F.sum("p_mw")
    hours = cal.hours_in_year("year")
    out = power.groupBy(*keys, "year").agg(energy.alias("energy_mwh"), F.max("capacity_mw").alias("capacity_mw"))
    return out.select("*", (F.col("energy_mwh") / 1e3).alias("energy_gwh"),
                      F.try_divide(F.col("energy_mwh"), F.col("capacity_mw") * hours).alias("cf"))


def monthly_energy(power: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-6: monthly energy (GWh), mean flow and mean head."""
    month = cal.month_of("year", "hoy").alias("month")
    return power.groupBy(*keys, "year", month).agg(
        (F.sum("p_mw") / 1e3).alias("energy_gwh"), F.avg("q").alias("q_mean"), F.avg("head_m").alias("head_mean"))


def guaranteed_power(power: DataFrame, keys: Sequence[str], exceedance: float = 0.90) -> DataFrame:
    """R-7: power exceeded in 90 % of the hours."""
    return power.groupBy(*keys).agg(F.percentile("p_mw", F.lit(round(1 - exceedance, 10))).alias("p_guaranteed_mw"))


def volume_deviation(trial: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-8: mean |V - V0| over mean V0; a trial over an empty base deviates without bound."""
    at = trial.select(*keys, "year", "hoy", "v").join(
        base.select(*keys, "year", "hoy", F.col("v").alias("v0")), [*keys, "year", "hoy"])
    gap, mean = F.avg(F.abs(F.col("v") - F.col("v0"))), F.avg("v0")
    return at.groupBy(*keys).agg(
        F.when(mean > 0, F.try_divide(gap, mean)).otherwise(F.lit(float("inf"))).alias("psi"))


def capacity_bounds(stations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-9: nameplate sums and the scenario bounds A (no pumped storage), B and C (all)."""
    ps = F.col("type") == "PS"
    cap = F.col("capacity_mw")
    sums = stations.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~ps, cap)), F.lit(0.0)).alias("non_ps_mw"),
        F.coalesce(F.sum(F.when(ps, cap)), F.lit(0.0)).alias("ps_mw"))
    both = F.col("non_ps_mw") + F.col("ps_mw")
    return sums.select("*", F.col("non_ps_mw").alias("bound_a_mw"), both.alias("bound_b_mw"), both.alias("bound_c_mw"))


def missing_exporters(plants: DataFrame, summaries: DataFrame, keys: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """R-10: regions with hydro plants but no dispatch summary."""
    left = plants.filter("capacity_mw > 0").join(summaries.select(*keys).distinct(), list(keys), "left_anti")
    out = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("plant_count"), F.sum("capacity_mw").alias("nameplate_mw"))
    return out.filter(F.col("nameplate_mw") > eps)


def centre_share(allocation: DataFrame, stations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-12: share of a station's reference capacity that serves centres, at most 1, and the rest."""
    used = allocation.groupBy(*keys).agg(F.sum("allocated_mw").alias("allocated_mw"))
    at = stations.join(used, list(keys), "left")
    share = F.when(F.col("ref_mw") > 0, F.least(F.coalesce("allocated_mw", F.lit(0.0)) / F.col("ref_mw"), F.lit(1.0)))
    return at.select(*keys, "ref_mw", "allocated_mw", F.coalesce(share, F.lit(0.0)).alias("dc_share")).withColumn(
        "residual_share", 1 - F.col("dc_share"))


def component_best_of(stations: DataFrame, components: DataFrame) -> DataFrame:
    """R-16: a river component keeps scenario B only if its served supply is not below A's."""
    at = stations.join(components, "node")
    served = F.coalesce("dc_share", F.lit(0.0))
    sums = at.groupBy("component").agg(
        F.sum(F.col("elcc_a_mw") * served).alias("a"), F.sum(F.col("elcc_b_mw") * served).alias("b"))
    keep_b = F.coalesce(F.col("b"), F.lit(0.0)) >= F.coalesce(F.col("a"), F.lit(0.0))
    return at.join(sums, "component").select(
        "node", "component", keep_b.alias("keeps_b"),
        F.when(keep_b, F.col("elcc_b_mw")).otherwise(F.col("elcc_a_mw")).alias("elcc_mw"))


def ps_net_flow(ps: DataFrame) -> DataFrame:
    """R-17: turbine and pump flow of pumped storage and what reaches the river, not below 0."""
    eta = turbine_efficiency("head_m")
    gen, pump = flow_for_power("gen_mw", "head_m", eta), pump_flow("pump_mw", "head_m")
    return ps.withColumn("q_gen", gen).withColumn("q_pump", pump).withColumn(
        "q_out", clip(F.col("q") + F.col("q_gen") - F.col("q_pump"), 0.0))


def tighten_bounds(trials: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """R-18: a region's bound falls to what was realised, only where the target was missed."""
    missed = F.col("realized_mw") + tolerance < F.col("target_mw")
    new = F.greatest(F.when(missed, F.least("bound_mw", "realized_mw")).otherwise(F.col("bound_mw")), F.lit(0.0))
    return trials.withColumn("new_bound_mw", new).withColumn("reduction_mw", F.col("bound_mw") - F.col("new_bound_mw"))


def bounds_converged(step: DataFrame, keys: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    worst = F.max("reduction_mw")
    return step.groupBy(*keys).agg(worst.alias("max_reduction_mw"), (worst <= tolerance).alias("converged"))


def diurnal_profile(power: DataFrame, keys: Sequence[str], value: str = "p_mw") -> DataFrame:
    """R-19: mean by hour of day."""
    return power.groupBy(*keys, (F.col("hoy") % 24).alias("hod")).agg(F.avg(value).alias(value))


def ps_yearly(ps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-20: yearly turbine and pump energy of each pair and the energy balance."""
    gen, pump = F.sum("gen_mw"), F.sum("pump_mw")
    return ps.groupBy(*keys, "year").agg(
        gen.alias("gen_mwh"), pump.alias("pump_mwh"), (gen - pump).alias("net_mwh"),
        F.try_divide(gen, pump).alias("round_trip"))


def ps_gain(pairs: DataFrame, solo: DataFrame, joint: DataFrame, pair: str, station: str) -> DataFrame:
    """R-20: firm capacity of pairs with and without pumped storage, and the gain."""
    alone = pairs.join(solo.select(station, "firm_mw"), station).groupBy(pair).agg(F.sum("firm_mw").alias("solo_mw"))
    both = joint.select(pair, F.col("firm_mw").alias("joint_mw"))
    gain = F.col("joint_mw") - F.col("solo_mw")
    return alone.join(both, pair).select("*", gain.alias("gain_mw"),
                                         (F.try_divide(gain, F.col("solo_mw")) * 100).alias("gain_pct"))
