"""Power, firm capacity, allocation, corridors and river-graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from headrace.functions import text as TX
from headrace.operators import graph as G
from headrace.operators import power as P
from headrace.operators import ranking as R
from headrace.operators import trade as T
from headrace.plans import standins as X
from headrace.plans.registry import query, rounded, rounded_sql

POWER = """
power AS (SELECT station, scenario, year, hoy, q AS p_mw, 0.8 + 0.4 * (hoy % 24) / 23.0 AS load FROM hflow)
"""


def _power(spark, d):
    return X.hourly_flow(spark, d).select(
        "station", "scenario", "year", "hoy", F.col("q").alias("p_mw"), (0.8 + 0.4 * (F.col("hoy") % 24) / 23.0).alias("load"))


KEYS = ["station", "scenario"]


@query("run_of_river_power", rounded_sql(X.with_sql(X.DAILY, X.STATIONS, """
  eta AS (SELECT station_idx, head_m, abs(capacity_mw) / 2000 AS cap,
            CASE WHEN head_m > 200 THEN 0.87 WHEN head_m > 40 THEN 0.88 ELSE 0.86 END AS e FROM stations)""") + """
  SELECT station_idx, year, sum(least(e * 9810.0 * least(q, cap * 1e6 / (e * 9810.0 * head_m)) * head_m / 1e6, cap)) AS p_mw
  FROM dflow JOIN eta USING (station_idx) WHERE scenario = 'nat' GROUP BY ALL""", p_mw=7))
def run_of_river_power(spark, d):
    st = X.stations(spark, d).select("station_idx", "head_m", (F.abs("capacity_mw") / 2000).alias("capacity_mw"))
    flow = X.daily_flow(spark, d).filter("scenario = 'nat'").join(st, "station_idx")
    return rounded(P.run_of_river_power(flow).groupBy("station_idx", "year").agg(F.sum("p_mw").alias("p_mw")), p_mw=7)


@query("firm_capacity", rounded_sql(X.with_sql(X.HOURLY, POWER) + """
  SELECT station, scenario, greatest(quantile_cont(p_mw / load, 0.000274), 0) AS firm_mw FROM power WHERE load > 0 GROUP BY ALL""", firm_mw=8))
def firm_capacity(spark, d):
    return rounded(P.firm_capacity(_power(spark, d), KEYS), firm_mw=8)


EXACT = """
ranked AS (SELECT station, scenario, p_mw / load AS r, row_number() OVER (PARTITION BY station, scenario ORDER BY p_mw / load) AS i,
             count(*) OVER (PARTITION BY station, scenario) AS n FROM power WHERE load > 0),
firm AS (SELECT station, scenario, greatest(max(CASE WHEN i = floor(0.02 * n) + 1 THEN r END), 0) AS firm_mw FROM ranked GROUP BY ALL),
firm0 AS (SELECT station, scenario, greatest(max(CASE WHEN i = floor(0.000274 * n) + 1 THEN r END), 0) AS firm_mw FROM ranked GROUP BY ALL)
"""


@query("firm_capacity_exact", rounded_sql(X.with_sql(X.HOURLY, POWER, EXACT) + "SELECT 0.02 AS outage, * FROM firm UNION ALL SELECT 0.000274, * FROM firm0", firm_mw=8))
def firm_capacity_exact(spark, d):
    power = _power(spark, d)
    out = [P.firm_capacity_exact(power, KEYS, outage=o).withColumn("outage", F.lit(o)) for o in (0.02, P.OUTAGE_MAX)]
    return rounded(out[0].unionByName(out[1]), firm_mw=8)


@query("outage_fraction", rounded_sql(X.with_sql(X.HOURLY, POWER, EXACT) + """
  SELECT station, scenario, avg(CASE WHEN load > 0 THEN CASE WHEN p_mw < firm_mw * load - 1e-6 THEN 1 ELSE 0 END END) AS outage
  FROM power JOIN firm USING (station, scenario) GROUP BY ALL""", outage=8))
def outage_fraction(spark, d):
    power = _power(spark, d)
    return rounded(P.outage_fraction(power, P.firm_capacity_exact(power, KEYS, outage=0.02), KEYS), outage=8)


@query("portfolio_firm", rounded_sql(X.with_sql(X.HOURLY, POWER) + """
  SELECT scenario, greatest(quantile_cont(p / load, 0.000274), 0) AS firm_mw FROM (
    SELECT scenario, year, hoy, max(load) AS load,
           sum(p_mw * (1 - length(station) / 20.0) + CASE WHEN station = 'click' THEN -0.5 ELSE 0 END) AS p
    FROM power GROUP BY ALL) GROUP BY ALL""", firm_mw=8))
def portfolio_firm(spark, d):
    power = _power(spark, d).withColumn("share", 1 - F.length("station") / 20.0).withColumn(
        "ps_net_mw", F.when(F.col("station") == "click", -0.5).otherwise(0.0))
    loads = power.groupBy("scenario", "year", "hoy").agg(F.max("load").alias("load"))
    return rounded(P.portfolio_firm(power.drop("load"), loads, ["scenario"]), firm_mw=8)


@query("yearly_energy", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, year, e AS energy_mwh, 50.0::DOUBLE AS capacity_mw, e / 1e3 AS energy_gwh,
         e / (50.0 * CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 8784 ELSE 8760 END) AS cf
  FROM (SELECT station_idx, year, sum(q) AS e FROM dflow WHERE scenario = 'nat' GROUP BY ALL)""", energy_mwh=4, energy_gwh=8, cf=8))
def yearly_energy(spark, d):
    power = X.daily_flow(spark, d).filter("scenario = 'nat'").select("station_idx", "year", F.col("q").alias("p_mw"), F.lit(50.0).alias("capacity_mw"))
    return rounded(P.yearly_energy(power, ["station_idx"]), energy_mwh=4, energy_gwh=8, cf=8)


@query("monthly_energy", rounded_sql(X.with_sql(X.DAILY, X.STATIONS) + """
  SELECT station_idx, year, month(make_date(year, 1, 1) + CAST(hoy // 24 AS INT)) AS month, sum(q * 0.9) / 1e3 AS energy_gwh,
         avg(q) AS q_mean, avg(head_m) AS head_mean
  FROM dflow JOIN stations USING (station_idx) WHERE scenario = 'nat' GROUP BY ALL""", energy_gwh=8, q_mean=8, head_mean=8))
def monthly_energy(spark, d):
    at = X.daily_flow(spark, d).filter("scenario = 'nat'").join(X.stations(spark, d).select("station_idx", "head_m"), "station_idx")
    return rounded(P.monthly_energy(at.withColumn("p_mw", F.col("q") * 0.9), ["station_idx"]), energy_gwh=8, q_mean=8, head_mean=8)


@query("guaranteed_power", rounded_sql(X.with_sql(X.HOURLY, POWER) + """
  SELECT station, scenario, quantile_cont(p_mw, 0.1) AS p_guaranteed_mw FROM power GROUP BY ALL""", p_guaranteed_mw=8))
def guaranteed_power(spark, d):
    return rounded(P.guaranteed_power(_power(spark, d), KEYS), p_guaranteed_mw=8)


@query("volume_deviation", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, CASE WHEN avg(n.q) > 0 THEN avg(abs(b.q - n.q)) / avg(n.q) ELSE 'inf'::DOUBLE END AS psi
  FROM dflow b JOIN dflow n USING (station_idx, year, hoy) WHERE b.scenario = 'BAL_C' AND n.scenario = 'nat' GROUP BY ALL""", psi=8))
def volume_deviation(spark, d):
    flow = X.daily_flow(spark, d).withColumnRenamed("q", "v")
    return rounded(P.volume_deviation(flow.filter("scenario = 'BAL_C'"), flow.filter("scenario = 'nat'"), ["station_idx"]), psi=8)


@query("capacity_bounds", rounded_sql(X.with_sql(X.STATIONS) + """
  SELECT region, a AS non_ps_mw, p AS ps_mw, a AS bound_a_mw, a + p AS bound_b_mw, a + p AS bound_c_mw FROM (
    SELECT region, coalesce(sum(CASE WHEN type <> 'PS' THEN capacity_mw END), 0) AS a,
           coalesce(sum(CASE WHEN type = 'PS' THEN capacity_mw END), 0) AS p FROM stations WHERE capacity_mw > 0 GROUP BY ALL)""",
    non_ps_mw=4, ps_mw=4, bound_a_mw=4, bound_b_mw=4, bound_c_mw=4))
def capacity_bounds(spark, d):
    out = P.capacity_bounds(X.stations(spark, d).filter("capacity_mw > 0"), ["region"])
    return rounded(out, non_ps_mw=4, ps_mw=4, bound_a_mw=4, bound_b_mw=4, bound_c_mw=4)


@query("missing_exporters", rounded_sql(X.with_sql(X.STATIONS) + """
  SELECT region, count(*) AS plant_count, sum(capacity_mw) AS nameplate_mw FROM stations WHERE capacity_mw > 0 AND region NOT IN (
    SELECT region FROM stations WHERE capacity_mw < 0) GROUP BY ALL""", nameplate_mw=4))
def missing_exporters(spark, d):
    plants = X.stations(spark, d)
    known = plants.filter("capacity_mw < 0").select("region")
    return rounded(P.missing_exporters(plants, known, ["region"]), nameplate_mw=4)


FILL = """
want AS (SELECT n_name AS region, o_orderkey AS site, o_totalprice / 1000 AS need FROM orders JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey),
cap AS (SELECT region, sum(capacity_mw) AS cap FROM stations GROUP BY ALL),
filled AS (SELECT w.region, site, need, least(need, greatest(0, coalesce(cap, 0) - coalesce(sum(need) OVER (PARTITION BY w.region
             ORDER BY need DESC, site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS delivered_mw
           FROM want w LEFT JOIN cap ON cap.region = w.region WHERE need > 0)
"""


def _filled(spark, d, **options):
    nation = X.table(spark, d, "nation")
    who = X.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("region"))
    want = X.table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select(
        "region", F.col("o_orderkey").alias("site"), (F.col("o_totalprice") / 1000).alias("need"))
    cap = X.stations(spark, d).groupBy("region").agg(F.sum("capacity_mw").alias("cap"))
    return R.capacity_fill(want, cap, ["region"], "need", "cap", "site", **options).select("region", "site", "need", "delivered_mw")


@query("capacity_fill", rounded_sql(X.with_sql(X.STATIONS, FILL) + "SELECT region, site, need, delivered_mw FROM filled", need=5, delivered_mw=5))
def capacity_fill(spark, d):
    return rounded(_filled(spark, d), need=5, delivered_mw=5)


@query("capacity_fill_sliced", rounded_sql(X.with_sql(X.STATIONS, FILL) + "SELECT region, site, need, delivered_mw FROM filled", need=5, delivered_mw=5))
def capacity_fill_sliced(spark, d):
    """The path for groups above ``hot_rows``."""
    return rounded(_filled(spark, d, hot_rows=40), need=5, delivered_mw=5)


@query("isolated_coverage", rounded_sql(X.with_sql(X.STATIONS, FILL) + """
  SELECT region, sum(need) AS demand_mw, sum(delivered_mw) AS met_mw, 100 * sum(delivered_mw) / sum(need) AS coverage_pct FROM filled GROUP BY ALL""",
    demand_mw=3, met_mw=3, coverage_pct=7))
def isolated_coverage(spark, d):
    sums = _filled(spark, d).groupBy("region").agg(F.sum("need").alias("demand_mw"), F.sum("delivered_mw").alias("met_mw"))
    out = sums.withColumn("coverage_pct", 100 * F.col("met_mw") / F.col("demand_mw"))
    return rounded(out, demand_mw=3, met_mw=3, coverage_pct=7)


@query("centre_share", rounded_sql(X.with_sql(X.STATIONS) + """
  SELECT station_idx, ref_mw, alloc AS allocated_mw, share AS dc_share, 1 - share AS residual_share FROM (
    SELECT station_idx, capacity_mw AS ref_mw, alloc, CASE WHEN capacity_mw > 0 THEN least(coalesce(alloc, 0) / capacity_mw, 1) ELSE 0 END AS share
    FROM stations LEFT JOIN (SELECT l_suppkey AS station_idx, sum(l_quantity) AS alloc FROM lineitem GROUP BY ALL) USING (station_idx))""",
    ref_mw=4, allocated_mw=4, dc_share=8, residual_share=8))
def centre_share(spark, d):
    used = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station_idx"), F.col("l_quantity").alias("allocated_mw"))
    st = X.stations(spark, d).select("station_idx", F.col("capacity_mw").alias("ref_mw"))
    return rounded(P.centre_share(used, st, ["station_idx"]), ref_mw=4, allocated_mw=4, dc_share=8, residual_share=8)


@query("pumped_storage_flow", rounded_sql(X.with_sql(X.DAILY, X.STATIONS) + """
  SELECT station_idx, year, sum(greatest(n.q + gen * 1e6 / (e * 9810.0 * head_m) - pump * 1e6 * 0.9 / (9810.0 * head_m), 0)) AS q_out
  FROM (SELECT n.station_idx, n.year, n.q, c.q / 100 AS gen, b.q / 20 AS pump FROM dflow n JOIN dflow c USING (station_idx, year, hoy)
        JOIN dflow b USING (station_idx, year, hoy) WHERE n.scenario = 'nat' AND c.scenario = 'CONV' AND b.scenario = 'BAL_C') n
  JOIN (SELECT *, CASE WHEN head_m > 200 THEN 0.87 WHEN head_m > 40 THEN 0.88 ELSE 0.86 END AS e FROM stations) USING (station_idx)
  GROUP BY ALL""", q_out=7))
def pumped_storage_flow(spark, d):
    wide = X.daily_wide(spark, d).select("station_idx", "year", F.col("q_nat").alias("q"), (F.col("q_conv") / 100).alias("gen_mw"),
                                         (F.col("q_bal") / 20).alias("pump_mw"))
    at = P.ps_net_flow(wide.join(X.stations(spark, d).select("station_idx", "head_m"), "station_idx"))
    return rounded(at.groupBy("station_idx", "year").agg(F.sum("q_out").alias("q_out")), q_out=7)


@query("pumped_storage_yearly", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, year, sum(q_conv) AS gen_mwh, sum(q_bal) AS pump_mwh, sum(q_conv) - sum(q_bal) AS net_mwh,
         sum(q_conv) / nullif(sum(q_bal), 0) AS round_trip FROM daily GROUP BY ALL""", gen_mwh=4, pump_mwh=4, net_mwh=4, round_trip=8))
def pumped_storage_yearly(spark, d):
    at = X.daily_wide(spark, d).select("station_idx", "year", F.col("q_conv").alias("gen_mw"), F.col("q_bal").alias("pump_mw"))
    return rounded(P.ps_yearly(at, ["station_idx"]), gen_mwh=4, pump_mwh=4, net_mwh=4, round_trip=8)


@query("bound_tightening", rounded_sql(X.with_sql(X.FLOWS) + """
  SELECT scenario, region, new_bound_mw, bound_mw - new_bound_mw AS reduction_mw FROM (
    SELECT scenario, dc_region AS region, sum(sent_mw) AS bound_mw, greatest(CASE WHEN sum(delivered_mw) + 1 < sum(sent_mw) * 0.951
      THEN least(sum(sent_mw), sum(delivered_mw)) ELSE sum(sent_mw) END, 0) AS new_bound_mw FROM flows GROUP BY ALL)""",
    new_bound_mw=7, reduction_mw=7))
def bound_tightening(spark, d):
    sent = F.sum("sent_mw")
    trials = X.flows(spark, d).groupBy("scenario", F.col("dc_region").alias("region")).agg(
        sent.alias("bound_mw"), F.sum("delivered_mw").alias("realized_mw"), (sent * 0.951).alias("target_mw"))
    out = P.tighten_bounds(trials).select("scenario", "region", "new_bound_mw", "reduction_mw")
    return rounded(out, new_bound_mw=7, reduction_mw=7)


@query("bound_convergence", rounded_sql(X.with_sql(X.FLOWS) + """
  SELECT scenario, max(r) AS max_reduction_mw, max(r) <= 120 AS converged FROM (SELECT scenario, CASE WHEN d + 1 < s * 0.951 THEN s - least(s, d) ELSE 0 END AS r FROM (
    SELECT scenario, dc_region, sum(sent_mw) AS s, sum(delivered_mw) AS d FROM flows GROUP BY ALL)) GROUP BY ALL""", max_reduction_mw=7))
def bound_convergence(spark, d):
    sent = F.sum("sent_mw")
    trials = X.flows(spark, d).groupBy("scenario", "dc_region").agg(sent.alias("bound_mw"), F.sum("delivered_mw").alias("realized_mw"), (sent * 0.951).alias("target_mw"))
    return rounded(P.bounds_converged(P.tighten_bounds(trials), ["scenario"], 120.0), max_reduction_mw=7)


@query("diurnal_profile", rounded_sql(X.with_sql(X.HOURLY) + """
  SELECT station, scenario, hoy % 24 AS hod, avg(q) AS q FROM hflow GROUP BY ALL""", q=8))
def diurnal_profile(spark, d):
    return rounded(P.diurnal_profile(X.hourly_flow(spark, d), KEYS, "q"), q=8)


# ---- trade ----

LIMITS = """
corr AS (SELECT least(region_a, region_b) AS region_a, greatest(region_a, region_b) AS region_b, sum(capacity_mw) AS total_mw,
    sum(CASE type WHEN 'AC' THEN capacity_mw WHEN 'MIXED' THEN capacity_mw / 2 ELSE 0 END) AS ac_mw,
    sum(CASE type WHEN 'HVDC' THEN capacity_mw WHEN 'MIXED' THEN capacity_mw / 2 ELSE 0 END) AS hvdc_mw, count(*) AS source_count,
    count(CASE WHEN status <> 'existing' THEN 1 END) AS future_count
  FROM lines WHERE (status = 'existing' OR (status IN ('under_construction', 'planned') AND expected_year <= 2033))
    AND capacity_mw > 0 AND region_a <> region_b GROUP BY ALL),
lim AS (SELECT *, ac_mw * 0.8 + hvdc_mw * 0.9 AS available_mw,
          (ac_mw * 0.8 * 0.03 + hvdc_mw * 0.9 * 0.02) / (ac_mw * 0.8 + hvdc_mw * 0.9) AS loss_rate FROM corr)
"""


def _corridors(spark, d):
    return T.corridor_limits(T.corridors(X.lines(spark, d), 2033))


@query("corridor_limits", rounded_sql(X.with_sql(X.LINES, LIMITS) + "SELECT * FROM lim",
                                      total_mw=7, ac_mw=7, hvdc_mw=7, available_mw=7, loss_rate=8))
def corridor_limits(spark, d):
    return rounded(_corridors(spark, d), total_mw=7, ac_mw=7, hvdc_mw=7, available_mw=7, loss_rate=8)


PATHS = """
links AS (SELECT region_a AS a, region_b AS b, available_mw AS mw, 1 - loss_rate AS eff FROM lim UNION ALL
          SELECT region_b, region_a, available_mw, 1 - loss_rate FROM lim),
reach(src, dst, hops) AS (SELECT a, b, 1 FROM links UNION SELECT src, b, hops + 1 FROM reach JOIN links ON a = dst WHERE src <> b
  AND hops < (SELECT count(DISTINCT a) FROM links)),
dist AS (SELECT src, dst, min(hops) AS hops FROM reach GROUP BY ALL),
best(src, dst, hops, eff, send, path, names, i) AS (
  SELECT a, b, 1, eff, mw, [a, b], a || ' > ' || b, 1 FROM links UNION ALL
  SELECT * FROM (
    SELECT w.src, l.b, w.hops + 1, w.eff * l.eff, least(w.send, l.mw / w.eff), list_append(w.path, l.b), w.names || ' > ' || l.b,
           row_number() OVER (PARTITION BY w.src, l.b ORDER BY round(-ln(w.eff * l.eff), 12), list_append(w.path, l.b)) AS i
    FROM best w JOIN links l ON l.a = w.dst JOIN dist d ON d.src = w.src AND d.dst = l.b AND d.hops = w.hops + 1) WHERE i = 1)
"""


@query("path_table", rounded_sql(X.with_sql(X.LINES, LIMITS, PATHS, recursive=True) + """
  SELECT src, dst, CAST(hops AS INT) AS hops, eff AS efficiency, send AS max_send_mw, send * eff AS max_delivered_mw, names AS path
  FROM best WHERE i = 1""", efficiency=8, max_send_mw=3, max_delivered_mw=3))
def path_table(spark, d):
    return rounded(T.path_table(_corridors(spark, d)), efficiency=8, max_send_mw=3, max_delivered_mw=3)


RING = "ring AS (SELECT * FROM lim WHERE abs(CAST(substr(region_a, 8) AS INT) - CAST(substr(region_b, 8) AS INT)) IN (1, 24)),"


@query("long_paths", rounded_sql(X.with_sql(X.LINES, LIMITS, RING[:-1], PATHS.replace("FROM lim", "FROM ring"), recursive=True) + """
  SELECT src, dst, CAST(hops AS INT) AS hops, eff AS efficiency, send AS max_send_mw, send * eff AS max_delivered_mw, names AS path
  FROM best WHERE i = 1""", efficiency=8, max_send_mw=3, max_delivered_mw=3))
def long_paths(spark, d):
    """Paths in a ring of regions: up to half of them lie between two."""
    number = lambda c: F.substring(c, 8, 9).cast("int")
    ring = _corridors(spark, d).filter(F.abs(number("region_a") - number("region_b")).isin(1, 24))
    return rounded(T.path_table(ring), efficiency=8, max_send_mw=3, max_delivered_mw=3)


ALLOC = """
alloc AS (SELECT f.scenario || '/' || f.src_region || '/' || f.dc_region AS alloc_id, f.*, coalesce(p.names, f.src_region) AS path,
            CASE WHEN f.src_region = f.dc_region THEN 0 ELSE 1 END AS cross_region
          FROM flows f LEFT JOIN (SELECT * FROM best WHERE i = 1) p ON p.src = f.src_region AND p.dst = f.dc_region)
"""


def _alloc(spark, d):
    paths = T.path_table(_corridors(spark, d)).select(F.col("src").alias("src_region"), F.col("dst").alias("dc_region"), "path")
    at = X.flows(spark, d).join(paths, ["src_region", "dc_region"], "left")
    return at.select(
        F.concat_ws("/", "scenario", "src_region", "dc_region").alias("alloc_id"), "scenario", "src_region", "dc_region", "sent_mw",
        "delivered_mw", "loss_mw", F.coalesce("path", "src_region").alias("path"),
        (F.col("src_region") != F.col("dc_region")).cast("int").alias("cross_region"))


@query("corridor_use", rounded_sql(X.with_sql(X.LINES, LIMITS, PATHS, X.FLOWS, ALLOC, """
  nodes AS (SELECT alloc_id, sent_mw, string_split(path, ' > ') AS p FROM alloc WHERE contains(path, ' > ')),
  hops_ AS (SELECT alloc_id, sent_mw, g.i AS pos, least(p[g.i], p[g.i + 1]) AS region_a, greatest(p[g.i], p[g.i + 1]) AS region_b
           FROM nodes, range(1, 40) g(i) WHERE g.i < len(p)),
  fl AS (SELECT h.region_a, h.region_b, available_mw, sent_mw * exp(coalesce(sum(ln(1 - loss_rate)) OVER (PARTITION BY alloc_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM hops_ h JOIN lim USING (region_a, region_b))""", recursive=True) + """
  SELECT region_a, region_b, sum(f) AS used_mw, max(available_mw) AS available_mw, 100 * sum(f) / max(available_mw) AS utilization_pct
  FROM fl GROUP BY ALL""", used_mw=3, available_mw=3, utilization_pct=4))
def corridor_use(spark, d):
    edges = _corridors(spark, d).select("region_a", "region_b", "available_mw", "loss_rate")
    return rounded(T.corridor_use(_alloc(spark, d), edges), used_mw=3, available_mw=3, utilization_pct=4)


@query("trade_roles", rounded_sql(X.with_sql(X.LINES, LIMITS, PATHS, X.FLOWS, ALLOC, """
  nodes AS (SELECT scenario, src_region, dc_region, sent_mw, delivered_mw, string_split(path, ' > ') AS p FROM alloc WHERE cross_region = 1),
  n2 AS (SELECT scenario, src_region, dc_region, sent_mw, delivered_mw, p[g.i] AS region, g.i > 1 AND g.i < len(p) AS mid
         FROM nodes, range(1, 40) g(i) WHERE g.i <= len(p)),
  agg AS (SELECT scenario, region, coalesce(sum(CASE WHEN region = src_region THEN sent_mw END), 0) AS export_sent_mw,
            coalesce(sum(CASE WHEN region = dc_region THEN delivered_mw END), 0) AS import_delivered_mw,
            max(CASE WHEN mid THEN 1 ELSE 0 END) AS transit FROM n2 GROUP BY ALL)""", recursive=True) + """
  SELECT *, concat_ws('+', CASE WHEN export_sent_mw > 1e-6 THEN 'exporter' END, CASE WHEN import_delivered_mw > 1e-6 THEN 'importer' END,
         CASE WHEN transit = 1 THEN 'transit' END) AS role FROM agg""", export_sent_mw=5, import_delivered_mw=7))
def trade_roles(spark, d):
    return rounded(T.trade_roles(_alloc(spark, d)), export_sent_mw=5, import_delivered_mw=7)


@query("trade_balance", rounded_sql(X.with_sql(X.FLOWS, """
  s AS (SELECT scenario, src_region AS region, CASE WHEN src_region = dc_region THEN delivered_mw ELSE 0 END AS a,
          CASE WHEN src_region = dc_region THEN 0 ELSE sent_mw END AS b, 0.0 AS c, CASE WHEN src_region = dc_region THEN 0 ELSE loss_mw END AS e FROM flows
        UNION ALL SELECT scenario, dc_region, 0, 0, CASE WHEN src_region = dc_region THEN 0 ELSE delivered_mw END, 0 FROM flows)""") + """
  SELECT scenario, region, sum(a) AS self_supply_mw, sum(b) AS export_sent_mw, sum(c) AS import_delivered_mw, sum(e) AS transmission_loss_mw,
         sum(b) - sum(c) AS net_export_mw FROM s GROUP BY ALL""",
    self_supply_mw=7, export_sent_mw=5, import_delivered_mw=7, transmission_loss_mw=7, net_export_mw=7))
def trade_balance(spark, d):
    return rounded(T.trade_balance(X.flows(spark, d)), self_supply_mw=7, export_sent_mw=5, import_delivered_mw=7, transmission_loss_mw=7, net_export_mw=7)


@query("allocation_summary", rounded_sql(X.with_sql(X.FLOWS) + """
  SELECT scenario, dem AS demand_mw, s AS sent_mw, m AS met_mw, cs AS cross_sent_mw, cd AS cross_delivered_mw, l AS loss_mw, dem - m AS unmet_mw,
         100 * m / dem AS coverage_pct
  FROM (SELECT o_orderstatus AS scenario, sum(o_totalprice) / 100 AS dem FROM orders GROUP BY ALL) JOIN (
    SELECT scenario, sum(sent_mw) AS s, sum(delivered_mw) AS m, sum(CASE WHEN src_region <> dc_region THEN sent_mw END) AS cs,
      sum(CASE WHEN src_region <> dc_region THEN delivered_mw END) AS cd, sum(CASE WHEN src_region <> dc_region THEN loss_mw END) AS l
    FROM flows GROUP BY ALL) USING (scenario)""",
    demand_mw=4, sent_mw=4, met_mw=4, cross_sent_mw=4, cross_delivered_mw=4, loss_mw=4, unmet_mw=4, coverage_pct=7))
def allocation_summary(spark, d):
    at = X.flows(spark, d).withColumn("cross_region", (F.col("src_region") != F.col("dc_region")).cast("int"))
    need = X.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("scenario")).agg((F.sum("o_totalprice") / 100).alias("demand_mw"))
    out = T.allocation_summary(at, need)
    return rounded(out, coverage_pct=7, **{c: 4 for c in out.columns if c.endswith("_mw")})


@query("coverage_with_trade", rounded_sql(X.with_sql(X.FLOWS) + """
  SELECT scenario, region, demand_mw, coalesce(a, 0) AS met_isolated_mw, coalesce(b, 0) AS met_interconnected_mw,
         100 * coalesce(a, 0) / demand_mw AS cov_isolated_pct, 100 * coalesce(b, 0) / demand_mw AS cov_interconnected_pct
  FROM (SELECT scenario, dc_region AS region, sum(sent_mw) AS demand_mw, sum(delivered_mw) AS b,
          sum(CASE WHEN src_region = dc_region THEN delivered_mw END) AS a FROM flows GROUP BY ALL)""",
    demand_mw=5, met_isolated_mw=7, met_interconnected_mw=7, cov_isolated_pct=7, cov_interconnected_pct=7))
def coverage_with_trade(spark, d):
    at = X.flows_once(spark, d)
    need = at.groupBy("scenario", F.col("dc_region").alias("region")).agg(F.sum("sent_mw").alias("demand_mw"))
    out = T.coverage_by_region(at.filter("src_region = dc_region"), at, need)
    return rounded(out, demand_mw=5, met_isolated_mw=7, met_interconnected_mw=7, cov_isolated_pct=7, cov_interconnected_pct=7)


@query("source_target_profile", rounded_sql(X.with_sql(X.HOURLY, X.FLOWS, """
  shapes AS (SELECT n_name AS region, year, hoy, q AS shape FROM hflow JOIN nation ON station = (SELECT list(DISTINCT event_type ORDER BY event_type) FROM events)[n_nationkey % (SELECT count(DISTINCT event_type) FROM events) + 1]
             WHERE scenario = 'nat'),
  sent AS (SELECT src_region, dc_region, sum(sent_mw) AS s FROM flows GROUP BY ALL)""") + """
  SELECT src_region, year, hoy, sum(s * shape) AS target_mw FROM sent JOIN shapes ON region = dc_region GROUP BY ALL""", target_mw=1))
def source_target_profile(spark, d):
    kinds = X.table(spark, d, "events").select(F.col("event_type").alias("station")).distinct()
    one = Window.orderBy("station")  # a handful of stations
    kinds = kinds.select("station", (F.row_number().over(one) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("k"))
    nations = X.table(spark, d, "nation")
    names = nations.join(F.broadcast(kinds), F.col("n_nationkey") % F.col("k") == F.col("i")).select(F.col("n_name").alias("region"), "station")
    shapes = X.hourly_flow(spark, d).filter("scenario = 'nat'").join(names, "station").select("region", "year", "hoy", F.col("q").alias("shape"))
    return rounded(T.source_target_profile(X.flows(spark, d), shapes, keys=()), target_mw=1)


@query("coincident_peak_shares", rounded_sql("""
  WITH hourly AS (SELECT n_name AS region, sum(o_totalprice) AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                  GROUP BY n_name, o_orderdate),
  peak AS (SELECT region, max(p) AS peak_kw FROM hourly GROUP BY ALL),
  sites AS (SELECT n_name AS region, c_custkey AS site, c_acctbal AS site_peak_kw FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)
  SELECT region, site, site_peak_kw, peak_kw, peak_kw / 1e3 * site_peak_kw / sum(site_peak_kw) OVER (PARTITION BY region) AS demand_mw
  FROM sites JOIN peak USING (region)""", peak_kw=2, demand_mw=7))
def coincident_peak_shares(spark, d):
    who = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("region"), F.col("c_custkey").alias("site"), F.col("c_acctbal").alias("site_peak_kw"))
    hourly = X.table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("site")).groupBy("region", "o_orderdate").agg(
        F.sum("o_totalprice").alias("p_total_kw"))
    return rounded(T.coincident_peak_shares(who, hourly), peak_kw=2, demand_mw=7)


@query("trade_concentration", rounded_sql(X.with_sql(X.FLOWS, """
  ex AS (SELECT scenario, src_region AS region, sum(sent_mw) AS mw FROM flows WHERE src_region <> dc_region GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY mw, region) AS i FROM ex)""") + """
  SELECT scenario, sum(mw * mw) / (sum(mw) * sum(mw)) AS export_hhi, 2 * sum(i * mw) / (count(*) * sum(mw)) - (count(*) + 1) / count(*) AS export_gini,
         arg_max(region, mw) AS top_exporter, max(mw) / sum(mw) AS top_exporter_share, count(*) AS n_exporters, sum(mw) AS total FROM rk GROUP BY ALL""",
    export_hhi=8, export_gini=8, top_exporter_share=8, total=2))
def trade_concentration(spark, d):
    ex = X.flows(spark, d).filter("src_region <> dc_region").groupBy("scenario", F.col("src_region").alias("region")).agg(F.sum("sent_mw").alias("mw"))
    return rounded(T.concentration(ex, ["scenario"], "mw"), export_hhi=8, export_gini=8, top_exporter_share=8, total=2)


@query("growing_shape", rounded_sql(X.with_sql(X.HOURLY, """
  h AS (SELECT station AS region, year, hoy, q FROM hflow WHERE scenario = 'nat'),
  pk AS (SELECT region, max(q) AS peak FROM h GROUP BY ALL), ln AS (SELECT region, year, max(hoy) + 1 AS n FROM h GROUP BY ALL)""") + """
  SELECT l.region, l.year, CAST(g.i AS INT) AS hoy, coalesce(h.q / peak, 0) AS shape FROM ln l JOIN pk USING (region), range(0, 8784) g(i)
  LEFT JOIN h ON h.region = l.region AND h.year = l.year AND h.hoy = g.i % n""", shape=8))
def growing_shape(spark, d):
    at = X.hourly_flow(spark, d).filter("scenario = 'nat'").select(F.col("station").alias("region"), "year", "hoy", F.col("q").alias("p_total_kw"))
    return rounded(T.growing_shape(at), shape=8)


# ---- river graph ----

CHAIN = """
down(node, spot, step) AS (SELECT river_id, river_id, 0 FROM network UNION ALL
  SELECT d.node, n.river_id, step + 1 FROM down d JOIN network c ON c.river_id = d.spot JOIN network n ON n.river_id = c.next_down)
"""


@query("downstream_depth", X.with_sql(X.NETWORK, CHAIN, recursive=True) + "SELECT node AS river_id, CAST(max(step) AS INT) AS depth FROM down GROUP BY ALL")
def downstream_depth(spark, d):
    return G.downstream_depth(X.network(spark, d))


@query("topological_level", X.with_sql(X.NETWORK, CHAIN, recursive=True) + """
  SELECT spot AS river_id, CAST(max(step) AS INT) AS level, false AS on_cycle FROM down
  WHERE node NOT IN (SELECT next_down FROM network) GROUP BY ALL""")
def topological_level(spark, d):
    return G.topological_level(X.network(spark, d))


@query("upstream_trace", X.with_sql(X.NETWORK, X.DAMS, CHAIN, recursive=True) + "SELECT DISTINCT node AS river_id FROM down WHERE spot IN (SELECT dam FROM dams)")
def upstream_trace(spark, d):
    return G.upstream_trace(X.dams(spark, d).select(F.col("dam").alias("river_id")), X.network(spark, d))


@query("affected_downstream", X.with_sql(X.NETWORK, X.DAMS, CHAIN, recursive=True) + """
  SELECT spot AS river_id, CAST(min(step) AS INT) AS step FROM down WHERE node IN (SELECT dam FROM dams) AND step > 0 GROUP BY ALL""")
def affected_downstream(spark, d):
    return G.affected_downstream(X.dams(spark, d).select(F.col("dam").alias("river_id")), X.network(spark, d))


@query("river_outlets", X.with_sql(X.NETWORK) + "SELECT river_id FROM network WHERE next_down NOT IN (SELECT river_id FROM network)")
def river_outlets(spark, d):
    return G.outlets(X.network(spark, d))


@query("connected_components", """
  WITH c AS (SELECT c_custkey, c_nationkey FROM customer)
  SELECT c_nationkey::BIGINT AS node, c_nationkey::BIGINT AS component FROM c UNION
  SELECT 100 + c_custkey, c_nationkey FROM c UNION
  SELECT 1000000000000 + o_orderkey, c_nationkey FROM orders JOIN c ON c_custkey = o_custkey""")
def connected_components(spark, d):
    """Orders hang on customers and customers on nations: a few hubs hold all edges."""
    who, what = X.table(spark, d, "customer"), X.table(spark, d, "orders")
    customer = 100 + F.col("c_custkey")
    edges = who.select(customer.alias("a"), F.col("c_nationkey").cast("bigint").alias("b")).unionByName(
        what.join(who, F.col("o_custkey") == F.col("c_custkey")).select((1000000000000 + F.col("o_orderkey")).alias("a"), customer.alias("b")))
    return G.connected_components(edges)


CONTRACT = """
edges AS (SELECT river_id AS up, next_down AS down, CAST(river_id % 5 AS INT) AS tau FROM network WHERE next_down > 0),
kept AS (SELECT river_id AS node FROM network WHERE slope_dm_per_km >= 15),
hop(up, spot, tau) AS (SELECT up, down, tau FROM edges WHERE up IN (SELECT node FROM kept) UNION ALL
  SELECT h.up, e.down, h.tau + e.tau FROM hop h JOIN edges e ON e.up = h.spot WHERE h.spot NOT IN (SELECT node FROM kept))
"""


@query("contract_excluded", X.with_sql(X.NETWORK, CONTRACT, recursive=True) + """
  SELECT up, spot AS down, CAST(min(tau) AS INT) AS tau_h FROM hop WHERE spot IN (SELECT node FROM kept) GROUP BY ALL""")
def contract_excluded(spark, d):
    net = X.network(spark, d)
    edges = net.filter("next_down > 0").select(F.col("river_id").alias("up"), F.col("next_down").alias("down"), (F.col("river_id") % 5).cast("int").alias("tau_h"))
    return G.contract_excluded(edges, net.filter("slope_dm_per_km >= 15").select(F.col("river_id").alias("node")))


CASCADE = """
cedges AS (SELECT s_suppkey AS up, s_suppkey // 2 AS down, s_suppkey % 4 * 24 AS tau FROM supplier WHERE s_suppkey > 0),
moved AS (SELECT down AS station_idx, CASE WHEN hoy + tau >= h THEN CASE WHEN year = 2001 THEN 1995 ELSE year + 1 END ELSE year END AS year,
            CASE WHEN hoy + tau >= h THEN hoy + tau - h ELSE hoy + tau END AS hoy, q_nat, q_conv
          FROM (SELECT *, CASE WHEN year % 4 = 0 THEN 8784 ELSE 8760 END AS h FROM daily) JOIN cedges ON up = station_idx),
ups AS (SELECT station_idx, year, hoy, sum(q_nat) AS un, sum(q_conv) AS uo FROM moved GROUP BY ALL),
inflow AS (SELECT d.station_idx, d.year, d.hoy, d.q_nat, d.q_nat - coalesce(un, 0) AS lateral,
             greatest(d.q_nat - coalesce(un, 0), 0) + coalesce(uo, 0) AS q_in FROM daily d LEFT JOIN ups USING (station_idx, year, hoy))
"""


def _inflow(spark, d):
    at = X.daily_wide(spark, d).select(F.col("station_idx").alias("station"), "year", "hoy", "q_nat", F.col("q_conv").alias("q_out"))
    k = F.col("s_suppkey")
    edges = X.table(spark, d, "supplier").filter("s_suppkey > 0").select(
        k.alias("up"), F.floor(k / 2).alias("down"), (k % 4 * 24).cast("int").alias("tau_h"))
    return G.cascade_inflow(at, edges, 1995, 2001)


@query("cascade_inflow", rounded_sql(X.with_sql(X.DAILY, CASCADE) + """
  SELECT station_idx AS station, year, hoy, q_nat, "lateral", q_in FROM inflow""", q_nat=4, **{'"lateral"': 4}, q_in=4))
def cascade_inflow(spark, d):
    return rounded(_inflow(spark, d), q_nat=4, lateral=4, q_in=4)


@query("lateral_diagnostics", rounded_sql(X.with_sql(X.DAILY, CASCADE) + """
  SELECT station_idx AS station, 100 * count(CASE WHEN lateral < 0 THEN 1 END) / nullif(count(lateral), 0) AS negative_pct,
         avg(CASE WHEN lateral < 0 THEN lateral END) AS mean_deficit FROM inflow GROUP BY ALL""".replace("lateral", '"lateral"'), negative_pct=8, mean_deficit=7))
def lateral_diagnostics(spark, d):
    return rounded(G.lateral_diagnostics(_inflow(spark, d)), negative_pct=8, mean_deficit=7)


@query("component_best_of", rounded_sql(X.with_sql(X.STATIONS, """
  st AS (SELECT station_idx AS node, min(station_idx) OVER (PARTITION BY station_idx % 9) AS component, abs(capacity_mw) AS a, abs(capacity_mw) * (0.8 + station_idx % 5 / 10.0) AS b,
           station_idx % 3 / 3.0 AS share FROM stations),
  sums AS (SELECT component, sum(a * share) AS sa, sum(b * share) AS sb FROM st GROUP BY ALL)""") + """
  SELECT node, component, sb >= sa AS keeps_b, CASE WHEN sb >= sa THEN b ELSE a END AS elcc_mw FROM st JOIN sums USING (component)""", elcc_mw=4))
def component_best_of(spark, d):
    k, cap = F.col("station_idx"), F.abs("capacity_mw")
    at = X.stations(spark, d).select(k.alias("node"), cap.alias("elcc_a_mw"), (cap * (0.8 + k % 5 / 10.0)).alias("elcc_b_mw"), (k % 3 / 3.0).alias("dc_share"))
    return rounded(P.component_best_of(at, G.connected_components(X.station_links(spark, d, 9))), elcc_mw=4)


@query("cascade_topology", """
  SELECT s.s_name AS down, u.s_name AS up, CAST(u.s_suppkey % 7 AS INT) AS tau_h FROM supplier s JOIN supplier u ON u.s_suppkey // 2 = s.s_suppkey AND u.s_suppkey > 0""")
def cascade_topology(spark, d):
    """Packs each station's upstream list as text, then parses it back to edges."""
    k = F.col("s_suppkey")
    entry = F.format_string("%s (ch%d,hops=1,f_reg=0.5,tau=%d)", F.col("s_name"), k, k % 7)
    up = X.table(spark, d, "supplier").filter("s_suppkey > 0").select(F.floor(k / 2).alias("down_key"), entry.alias("entry"))
    # At most two upstream stations each, by the key rule.
    packed = up.groupBy("down_key").agg(F.concat_ws("; ", F.collect_list("entry")).alias("direct_upstream_stations"))
    topo = packed.join(X.table(spark, d, "supplier").select(k.alias("down_key"), F.col("s_name").alias("station_name")), "down_key")
    return TX.cascade_edges(topo)


@query("pumped_storage_gain", rounded_sql(X.with_sql(X.STATIONS, """
  solo AS (SELECT station_idx, station_idx // 2 AS pair, abs(capacity_mw) AS f FROM stations)""") + """
  SELECT pair, sum(f) AS solo_mw, sum(f) * 1.1 + max(f) * 0.05 AS joint_mw, sum(f) * 0.1 + max(f) * 0.05 AS gain_mw,
         (sum(f) * 0.1 + max(f) * 0.05) / nullif(sum(f), 0) * 100 AS gain_pct FROM solo GROUP BY ALL""", solo_mw=4, joint_mw=4, gain_mw=4, gain_pct=7))
def pumped_storage_gain(spark, d):
    solo = X.stations(spark, d).select("station_idx", F.abs("capacity_mw").alias("firm_mw"))
    pairs = solo.select("station_idx", F.floor(F.col("station_idx") / 2).alias("pair"))
    joint = pairs.join(solo, "station_idx").groupBy("pair").agg((F.sum("firm_mw") * 1.1 + F.max("firm_mw") * 0.05).alias("firm_mw"))
    out = P.ps_gain(pairs, solo, joint, "pair", "station_idx").select("pair", "solo_mw", "joint_mw", "gain_mw", "gain_pct")
    return rounded(out, solo_mw=4, joint_mw=4, gain_mw=4, gain_pct=7)
