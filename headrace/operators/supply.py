"""Water-supply reliability below the dams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.functions.core import clip
from headrace.operators import graph
from headrace.operators import series as S

NET_IRRIGATION_M_PER_YEAR = 1.0
RELIABILITY = ("efr_compliance", "rel", "vul", "res", "si", "wsi", "gap_months_per_year",
               "gap_volume_mm3_yr", "data_coverage")


def supply_segments(dams: DataFrame, network: DataFrame, eps: float = 0.01) -> DataFrame:
    """D-14: reaches grouped by the set of dams that control them, with length, demand and areas."""
    reaches = graph.downstream_walk(dams, network, eps=eps)
    segments = graph.segments(reaches, network)
    uplands = network.select(F.col("river_id").alias("dam"), "upland_skm")
    dam_area = (segments.select("seg", F.explode("dams").alias("dam")).join(uplands, "dam")
                .groupBy("seg").agg(F.sum("upland_skm").alias("a_dams_skm")))
    return segments.join(dam_area, "seg", "left").select(
        "seg", F.concat_ws("|", F.transform("dams", lambda d: d.cast("string"))).alias("dam_rivers"),
        F.size("dams").alias("n_dams"), "n_reaches", F.bround("length_km", 1).alias("dep_length_km"),
        (F.col("irrigated_km2") * NET_IRRIGATION_M_PER_YEAR).alias("demand_mm3_yr"),
        "a_outlet_skm", F.coalesce("a_dams_skm", F.lit(0.0)).alias("a_dams_skm"),
    )


def dropped_segments(segments: DataFrame, simulated: DataFrame) -> DataFrame:
    """D-18: segments with demand none of whose dams has a simulated flow."""
    dams = segments.filter("demand_mm3_yr > 0").select(
        "seg", "demand_mm3_yr", F.explode(F.split("dam_rivers", r"\|")).alias("dam"))
    alive = dams.join(simulated.select(F.col("river_id").cast("string").alias("dam")), "dam", "left_semi")
    return (dams.select("seg", "demand_mm3_yr").distinct().join(alive, "seg", "left_anti")
            .select("seg", F.lit("dropped_no_sim_dam").alias("metric"), "demand_mm3_yr"))


def environmental_flow(monthly: DataFrame, keys: Sequence[str], value: str = "q") -> DataFrame:
    """D-15: variable monthly flow: 60, 45 or 30 % of the month's mean by its share of the year's."""
    means = monthly.groupBy(*keys, "month").agg(F.avg(value).alias("mmf"))
    annual = F.avg("mmf").over(Window.partitionBy(*keys))
    part = (F.when(F.col("mmf") <= 0.4 * annual, 0.60).when(F.col("mmf") <= 0.8 * annual, 0.45)
            .otherwise(0.30))
    return means.select(*keys, "month", F.when(annual > 0, part * F.col("mmf")).alias("efr"))


def segment_flow(dam_monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-16, A-22: monthly flow of a segment by two methods.

    ``dam_monthly``: keys, scenario, dam, year, month, q, a_ratio. E1 sums the dams;
    E2 scales the natural sum by the area ratio and adds the change. A month is
    NULL only where every dam is.
    """
    sums = dam_monthly.groupBy(*keys, "scenario", "year", "month").agg(
        F.sum("q").alias("q"), F.first("a_ratio").alias("a_ratio"))
    nat = F.max(F.when(F.col("scenario") == S.BASELINE, F.col("q"))).over(
        Window.partitionBy(*keys, "year", "month"))
    both = sums.withColumn("q_nat", nat)
    methods = F.array(F.struct(F.lit("E1").alias("method"), F.lit(1.0).alias("factor")),
                      F.struct(F.lit("E2").alias("method"), F.col("a_ratio").alias("factor")))
    each = both.select("*", F.explode(methods).alias("m"))
    flow = F.col("q_nat") * F.col("m.factor") + (F.col("q") - F.col("q_nat"))
    return each.select(*keys, F.col("m.method").alias("method"), "scenario", "year", "month", flow.alias("q"))


def reliability(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-17: compliance, reliability, vulnerability, resilience, stress and gaps.

    ``monthly``: keys, year, month, q, efr, demand_mm3_yr on a dense month axis.
    Volumes use the true month length. A recovery needs two adjacent observed
    months, December to January included.
    """
    need = F.col("demand_mm3_yr") * 1e6 / 12.0
    seconds = cal.days_in_month("year", "month") * 86400.0
    supply = F.when(F.col("q").isNotNull() & F.col("efr").isNotNull(),
                    F.greatest(F.lit(0.0), F.col("q") - F.col("efr")) * seconds)
    axis = F.col("year") * 12 + F.col("month")
    scored = monthly.select(*keys, "q", "efr", axis.alias("t"), supply.alias("s"),
                            F.when(F.col("demand_mm3_yr") > 0, need).alias("need"))
    ordered = Window.partitionBy(*keys).orderBy("t")
    fails = F.col("s") < F.col("need")
    next_met = (F.lead("s").over(ordered) >= F.col("need")) & (F.lead("t").over(ordered) == F.col("t") + 1)
    flagged = scored.select("*", fails.alias("fail"), (fails & next_met).alias("recovered"))
    deficit = F.greatest(F.lit(0.0), F.col("need") - F.col("s"))
    valid, failed = F.count(F.when(F.col("need").isNotNull(), F.col("s"))), F.count_if("fail")
    sums = flagged.groupBy(*keys).agg(
        F.try_divide(F.count_if(F.col("q") >= F.col("efr")), F.count("q")).alias("efr_compliance"),
        valid.alias("n"), failed.alias("n_fail"), F.count_if("recovered").alias("n_rec"),
        F.count(F.lit(1)).alias("n_all"), F.sum("s").alias("s"), F.first("need").alias("need"),
        F.avg(F.when(deficit > 0, deficit)).alias("mean_gap"), F.sum(deficit).alias("gap"),
    )
    n, need = F.when(F.col("n") > 0, F.col("n")), F.col("need")
    rel = (n - F.col("n_fail")) / n
    vul = F.when(n.isNotNull(), F.coalesce(clip(F.col("mean_gap") / need, None, 1.0), F.lit(0.0)))
    res = F.when(n.isNotNull(), F.when(F.col("n_fail") > 0, F.col("n_rec") / F.col("n_fail")).otherwise(1.0))
    step = sums.select(*keys, F.coalesce("efr_compliance", F.lit(0.0)).alias("efr_compliance"),
                       rel.alias("rel"), vul.alias("vul"), res.alias("res"), "n", "n_fail", "n_all", "s", "need", "gap")
    si = F.pow(F.greatest(F.lit(0.0), F.col("rel") * F.col("res") * (1 - F.col("vul"))), F.lit(1.0 / 3.0))
    stress = F.when(F.col("s") > 0, F.try_divide(F.col("need") * F.col("n"), F.col("s"))).otherwise(
        F.lit(float("inf")))
    return step.select(
        *keys, "efr_compliance", "rel", "vul", "res", F.when(F.col("rel").isNotNull(), si).alias("si"),
        F.when(n.isNotNull(), stress).alias("wsi"), (F.col("n_fail") / n * 12.0).alias("gap_months_per_year"),
        (F.col("gap") / 1e6 / n * 12.0).alias("gap_volume_mm3_yr"),
        (n / F.col("n_all")).alias("data_coverage"),
    )
