"""Transmission corridors, paths and power trade between regions."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.session import reliable_checkpoint

# Fixed values.
AC_AVAILABLE, HVDC_AVAILABLE = 0.8, 0.9
AC_LOSS, HVDC_LOSS = 0.03, 0.02
EPS = 1e-6
HOURS = 8784  # of the longest year


def corridors(lines: DataFrame, year: int, all_lines: bool = False) -> DataFrame:
    """G-12: lines in service by ``year`` summed to undirected corridors.

    In service: existing, or under construction or planned with a date not after ``year``.
    """
    dated = F.col("status").isin("under_construction", "planned") & (F.col("expected_year") <= year)
    existing = F.col("status") == "existing"
    in_service = F.lit(True) if all_lines else existing | F.coalesce(dated, F.lit(False))
    used = lines.filter(in_service & (F.col("capacity_mw") > 0) & (F.col("region_a") != F.col("region_b")))
    if "intra_region" in lines.columns:
        inner = F.lower(F.col("intra_region").cast("string")).isin("true", "1", "yes")
        used = used.filter(~F.coalesce(inner, F.lit(False)))
    cap = F.col("capacity_mw")
    half = F.when(F.col("type") == "MIXED", cap / 2).otherwise(0.0)
    return used.groupBy(
        F.least("region_a", "region_b").alias("region_a"), F.greatest("region_a", "region_b").alias("region_b")
    ).agg(
        F.sum(cap).alias("total_mw"), F.sum(F.when(F.col("type") == "AC", cap).otherwise(half)).alias("ac_mw"),
        F.sum(F.when(F.col("type") == "HVDC", cap).otherwise(half)).alias("hvdc_mw"),
        F.count(F.lit(1)).alias("source_count"), F.count_if(~existing).alias("future_count"),
    )


def corridor_limits(frame: DataFrame) -> DataFrame:
    """G-13: available capacity and loss; explicit values override the weighted ones."""
    typed = F.greatest(F.coalesce("ac_mw", F.lit(0.0)), F.lit(0.0))
    direct = F.greatest(F.coalesce("hvdc_mw", F.lit(0.0)), F.lit(0.0))
    untyped = typed + direct <= EPS
    at = frame.select("*", F.when(untyped, F.col("total_mw") / 2).otherwise(typed).alias("__ac"),
                      F.when(untyped, F.col("total_mw") / 2).otherwise(direct).alias("__dc"))
    ac, dc = F.col("__ac") * AC_AVAILABLE, F.col("__dc") * HVDC_AVAILABLE
    assumed = ac + dc
    loss = F.try_divide(ac * AC_LOSS + dc * HVDC_LOSS, assumed)
    given = F.col("available_mw") if "available_mw" in frame.columns else F.lit(None).cast("double")
    given_loss = F.col("loss_rate") if "loss_rate" in frame.columns else F.lit(None).cast("double")
    available = F.when(given >= 0, F.least(given, F.col("total_mw"))).otherwise(assumed)
    rate = F.when((given_loss >= 0) & (given_loss < 1), given_loss).otherwise(loss)
    keep = [c for c in frame.columns if c not in ("available_mw", "loss_rate")]
    return at.select(*keep, available.alias("available_mw"), rate.alias("loss_rate")).filter(
        F.col("available_mw") > EPS)


def path_table(edges: DataFrame) -> DataFrame:
    """G-14: best path of every ordered region pair: fewest hops, then least loss, then name order.

    ``edges``: region_a, region_b, available_mw, loss_rate. Paths add up like numbers under (min, +) with
    (hops, loss, names) as the number, so the table is squared: a path of n + r hops (r <= n) is a best path of
    exactly n hops and a best one of r. Rounds double n and end when a round finds no new pair; paths may have
    any number of hops. Capacity is the least edge limit referred to the sending end. Rows: at most regions squared.
    """
    one_way = edges.select("region_a", "region_b", "available_mw", "loss_rate")
    links = one_way.unionByName(one_way.select(
        F.col("region_b").alias("region_a"), F.col("region_a").alias("region_b"), "available_mw", "loss_rate"))
    found = reliable_checkpoint(links.select(
        F.col("region_a").alias("src"), F.col("region_b").alias("dst"), F.lit(1).alias("hops"), (1 - F.col("loss_rate")).alias("efficiency"),
        F.col("available_mw").alias("max_send_mw"), F.array("region_a", "region_b").alias("path")))
    for n in (2**k for k in itertools.count()):
        first = found.filter(F.col("hops") == n).withColumnRenamed("dst", "mid")
        second = found.select(F.col("src").alias("mid"), "dst", F.col("hops").alias("__r"), F.col("efficiency").alias("__eff"),
                              F.col("max_send_mw").alias("__mw"), F.slice("path", 2, F.size("path") - 1).alias("__rest"))
        ahead = first.join(second, "mid").filter(F.col("src") != F.col("dst")).join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        level = reliable_checkpoint(_best_paths(ahead.select(
            "src", "dst", (F.col("hops") + F.col("__r")).alias("hops"), (F.col("efficiency") * F.col("__eff")).alias("efficiency"),
            F.least("max_send_mw", F.col("__mw") / F.col("efficiency")).alias("max_send_mw"), F.concat("path", "__rest").alias("path"))))
        if level.limit(1).count() == 0:
            break
        found = found.unionByName(level)
    return found.select("src", "dst", "hops", "efficiency", "max_send_mw",
                        (F.col("max_send_mw") * F.col("efficiency")).alias("max_delivered_mw"),
                        F.concat_ws(" > ", "path").alias("path"))


def _best_paths(candidates: DataFrame) -> DataFrame:
    rest = [c for c in candidates.columns if c not in ("src", "dst")]
    order = F.struct("hops", F.round(-F.ln("efficiency"), 12), "path")
    best = candidates.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select("src", "dst", "r.*").select(candidates.columns)


def corridor_use(allocation: DataFrame, edges: DataFrame, key: str = "alloc_id") -> DataFrame:
    """G-16: flow on every edge of every path after the losses before it; share of the available capacity."""
    nodes = allocation.select(key, "sent_mw", F.split("path", " > ").alias("p")).filter(F.size("p") > 1)
    hops = nodes.select(key, "sent_mw", F.posexplode(F.slice(F.col("p"), 2, F.size("p") - 1)).alias("pos", "to"), "p")
    hops = hops.withColumn("frm", F.element_at("p", F.col("pos") + 1)).drop("p")
    at = hops.select(key, "sent_mw", "pos", F.least("frm", "to").alias("region_a"),
                     F.greatest("frm", "to").alias("region_b")).join(edges, ["region_a", "region_b"])
    # One allocation's rows: the hops of its path.
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.exp(F.coalesce(F.sum(F.ln(1 - F.col("loss_rate"))).over(before), F.lit(0.0)))
    used = at.withColumn("flow_mw", F.col("sent_mw") * kept).groupBy("region_a", "region_b").agg(
        F.sum("flow_mw").alias("used_mw"), F.max("available_mw").alias("available_mw"))
    return used.withColumn("utilization_pct", 100 * F.col("used_mw") / F.col("available_mw"))


def trade_roles(allocation: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """G-15: exporter, importer and transit regions of the cross-region allocations."""
    cross = allocation.filter("cross_region = 1")
    nodes = cross.select(*keys, "src_region", "dc_region", "sent_mw", "delivered_mw",
                         F.posexplode(F.split("path", " > ")).alias("pos", "region"),
                         F.size(F.split("path", " > ")).alias("n"))
    sent = F.sum(F.when(F.col("region") == F.col("src_region"), F.col("sent_mw")))
    got = F.sum(F.when(F.col("region") == F.col("dc_region"), F.col("delivered_mw")))
    passing = F.max(F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1), 1).otherwise(0))
    out = nodes.groupBy(*keys, "region").agg(
        F.coalesce(sent, F.lit(0.0)).alias("export_sent_mw"),
        F.coalesce(got, F.lit(0.0)).alias("import_delivered_mw"), passing.alias("transit"))
    role = F.concat_ws("+", F.when(F.col("export_sent_mw") > EPS, "exporter"),
                       F.when(F.col("import_delivered_mw") > EPS, "importer"),
                       F.when(F.col("transit") == 1, "transit"))
    return out.withColumn("role", role)


def trade_balance(allocation: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """R-14: self supply, export, import, loss and net export of each region, in one pass."""
    own = F.col("src_region") == F.col("dc_region")
    zero = F.lit(0.0)
    source = F.struct(
        F.col("src_region").alias("region"), F.when(own, F.col("delivered_mw")).otherwise(0.0).alias("self"),
        F.when(own, zero).otherwise(F.col("sent_mw")).alias("export"), zero.alias("import"),
        F.when(own, zero).otherwise(F.col("loss_mw")).alias("loss"))
    sink = F.struct(F.col("dc_region").alias("region"), zero.alias("self"), zero.alias("export"),
                    F.when(own, zero).otherwise(F.col("delivered_mw")).alias("import"), zero.alias("loss"))
    sides = allocation.select(*keys, F.explode(F.array(source, sink)).alias("s")).select(*keys, "s.*")
    out = sides.groupBy(*keys, "region").agg(
        F.sum("self").alias("self_supply_mw"), F.sum("export").alias("export_sent_mw"),
        F.sum("import").alias("import_delivered_mw"), F.sum("loss").alias("transmission_loss_mw"))
    out = out.filter(F.greatest("self_supply_mw", "export_sent_mw", "import_delivered_mw",
                                "transmission_loss_mw") > EPS)
    return out.withColumn("net_export_mw", F.col("export_sent_mw") - F.col("import_delivered_mw"))


def allocation_summary(allocation: DataFrame, demand: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """R-15: met, sent, lost and unmet power and coverage by scenario. ``demand``: keys, demand_mw."""
    cross = F.col("cross_region") == 1
    sums = allocation.groupBy(*keys).agg(
        F.sum("sent_mw").alias("sent_mw"), F.sum("delivered_mw").alias("met_mw"),
        F.coalesce(F.sum(F.when(cross, F.col("sent_mw"))), F.lit(0.0)).alias("cross_sent_mw"),
        F.coalesce(F.sum(F.when(cross, F.col("delivered_mw"))), F.lit(0.0)).alias("cross_delivered_mw"),
        F.coalesce(F.sum(F.when(cross, F.col("loss_mw"))), F.lit(0.0)).alias("loss_mw"))
    at = demand.join(sums, list(keys), "left")
    return at.select(*keys, "demand_mw", "sent_mw", "met_mw", "cross_sent_mw", "cross_delivered_mw", "loss_mw",
                     (F.col("demand_mw") - F.col("met_mw")).alias("unmet_mw"),
                     (100 * F.try_divide(F.col("met_mw"), F.col("demand_mw"))).alias("coverage_pct"))


def coverage_by_region(isolated: DataFrame, connected: DataFrame, demand: DataFrame,
                       keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """J-18, R-11: demand met alone and with trade, side by side."""
    def met(df, name):
        return df.groupBy(*keys, F.col("dc_region").alias("region")).agg(F.sum("delivered_mw").alias(name))
    both = met(isolated, "met_isolated_mw").join(met(connected, "met_interconnected_mw"), [*keys, "region"], "full_outer")
    at = demand.join(both, [*keys, "region"], "left")
    alone, linked = F.coalesce("met_isolated_mw", F.lit(0.0)), F.coalesce("met_interconnected_mw", F.lit(0.0))
    return at.select(*keys, "region", "demand_mw", alone.alias("met_isolated_mw"), linked.alias("met_interconnected_mw"),
                     (100 * F.try_divide(alone, F.col("demand_mw"))).alias("cov_isolated_pct"),
                     (100 * F.try_divide(linked, F.col("demand_mw"))).alias("cov_interconnected_pct"))


def source_target_profile(allocation: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """R-13: hourly target of a source: sum over its sinks of sent power x the sink's load shape.

    A year's hours of a region are one array, so what meets the pairs of regions and is shuffled is one row per
    pair and year; the arrays of a source's sinks are added place by place. Hours without a row of any sink
    have none here. A group holds one array per sink, no more than there are regions.
    """
    sent = allocation.groupBy(*keys, "src_region", F.col("dc_region").alias("region")).agg(
        F.sum("sent_mw").alias("sent_mw")).filter(F.col("sent_mw") > EPS)
    given = shapes.groupBy("region", "year", "hoy").agg(F.sum("shape").alias("v"))
    grid = given.select("region", "year").distinct().select("region", "year", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hoy"))
    whole = grid.join(given.withColumn("has", F.lit(True)), ["region", "year", "hoy"], "left")
    yearly = whole.groupBy("region", "year").agg(F.array_sort(F.collect_list(F.struct("hoy", "v", F.coalesce("has", F.lit(False)).alias("has")))).alias("hours"))
    at = sent.join(yearly, "region").groupBy(*keys, "src_region", "year").agg(F.collect_list(F.struct("sent_mw", "hours")).alias("sinks"))
    none = F.array_repeat(F.struct(F.lit(None).cast("double").alias("t"), F.lit(False).alias("has")), HOURS)

    def add(total, sink):
        def place(a, h):
            more = sink["sent_mw"] * h["v"]
            return F.struct(F.coalesce(a["t"] + more, a["t"], more).alias("t"), (a["has"] | h["has"]).alias("has"))
        return F.zip_with(total, sink["hours"], place)

    hourly = at.select(*keys, "src_region", "year", F.posexplode(F.aggregate("sinks", none, add)).alias("hoy", "h"))
    return hourly.filter("h.has").select(*keys, "src_region", "year", "hoy", F.col("h.t").alias("target_mw"))


def coincident_peak_shares(sites: DataFrame, hourly: DataFrame, region: str = "region") -> DataFrame:
    """L-10: each site's share of its region's coincident peak over all years."""
    peak = hourly.groupBy(region).agg(F.max("p_total_kw").alias("peak_kw")).filter("peak_kw > 0")
    active = sites.filter(F.col("site_peak_kw") > 0)
    weight = active.groupBy(region).agg(F.sum("site_peak_kw").alias("sum_kw"))
    at = active.join(peak, region).join(weight, region)
    return at.withColumn("demand_mw", F.col("peak_kw") / 1e3 * F.col("site_peak_kw") / F.col("sum_kw")).drop("sum_kw")


def concentration(trade: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A-16: HHI, Gini, top share and count of the positive exporters of a group."""
    from headrace.operators.ranking import running_totals

    active = trade.filter(F.col(value) > 0)
    totals = active.groupBy(*keys).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("n_exporters"), F.sum(F.col(value) ** 2).alias("__sq"),
        F.max(value).alias("__top"), F.min_by("region", F.struct(-F.col(value), F.col("region"))).alias("top_exporter"))
    ranked = running_totals(active, keys, [value, "region"], {}, row_number="__i")
    weighted = ranked.groupBy(*keys).agg(F.sum(F.col("__i") * F.col(value)).alias("__wx"))
    at = totals.join(weighted, list(keys))
    n, total = F.col("n_exporters"), F.col("total")
    gini = 2 * F.col("__wx") / (n * total) - (n + 1) / n
    return at.select(*keys, (F.col("__sq") / (total * total)).alias("export_hhi"), gini.alias("export_gini"),
                     "top_exporter", (F.col("__top") / total).alias("top_exporter_share"), "n_exporters", "total")


def growing_shape(hourly: DataFrame, region: str = "region") -> DataFrame:
    """L-11: every hour over the region's peak of all years; short years wrap from their first hour; NULL is 0."""
    from headrace.functions import calendar as cal

    peak = hourly.groupBy(region).agg(F.max("p_total_kw").alias("peak")).filter("peak > 0")
    length = hourly.groupBy(region, "year").agg((F.max("hoy") + 1).alias("n_have"))
    grid = length.select(region, "year", "n_have", F.explode(
        F.sequence(F.lit(0), cal.hours_in_year("year") - 1)).alias("hoy"))
    source = grid.withColumn("src", (F.col("hoy") % F.col("n_have")).cast("int"))
    values = hourly.select(region, "year", F.col("hoy").alias("src"), "p_total_kw")
    at = source.join(values, [region, "year", "src"], "left").join(peak, region)
    return at.select(region, "year", "hoy", F.coalesce(F.col("p_total_kw") / F.col("peak"), F.lit(0.0)).alias("shape"))
