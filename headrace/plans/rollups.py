"""Ensemble, equity, conservation, quality and source queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from headrace.operators import quality as Q
from headrace.operators import ranking as R
from headrace.operators import sediment as D
from headrace.operators import series as S
from headrace.operators import summaries as V
from headrace.plans import standins as X
from headrace.plans.registry import query, rounded, rounded_sql
from headrace.sources import loads, sinks, tables, text
from headrace.sources.loads import hourly_columns, nested_json, packed_hours

# Ensemble runs: model = order priority, pathway = order status, region = nation.
RUNS = """
runs AS (SELECT n_name AS region, r_name AS bloc, o_orderpriority AS gcm, CASE o_orderstatus WHEN 'F' THEN 'ssp126' WHEN 'O' THEN 'ssp585' ELSE 'ssp370' END AS ssp,
           sum(o_totalprice) / 1e5 AS supply_mw, avg(o_totalprice) / 1e3 AS dc_mean_mw, count(*) AS n_orders
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
"""


def _runs(spark, d):
    nation = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = X.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("region"), F.col("r_name").alias("bloc"))
    ssp = F.when(F.col("o_orderstatus") == "F", "ssp126").when(F.col("o_orderstatus") == "O", "ssp585").otherwise("ssp370")
    return X.table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "region", "bloc", F.col("o_orderpriority").alias("gcm"), ssp.alias("ssp")).agg(
        (F.sum("o_totalprice") / 1e5).alias("supply_mw"), (F.avg("o_totalprice") / 1e3).alias("dc_mean_mw"), F.count(F.lit(1)).alias("n_orders"))


@query("ensemble_spread", rounded_sql(X.with_sql(RUNS) + """
  SELECT region, median(x) AS median, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_samp(x) AS sd, stddev_samp(x) / nullif(avg(x), 0) * 100 AS cv_pct, count(CASE WHEN x > 0 THEN 1 END) AS n_pos,
         count(CASE WHEN x < 0 THEN 1 END) AS n_neg, count(x) AS n FROM (SELECT region, supply_mw - 20 AS x FROM runs) GROUP BY ALL""", median=8, min=8, max=8, mean=8, sd=7, cv_pct=5))
def ensemble_spread(spark, d):
    at = _runs(spark, d).withColumn("x", F.col("supply_mw") - 20)
    return rounded(V.ensemble_spread(at, ["region"], "x"), median=8, min=8, max=8, mean=8, sd=7, cv_pct=5)


@query("climate_sensitivity", rounded_sql(X.with_sql(RUNS, """
  c AS (SELECT region, gcm, 100 * (max(CASE WHEN ssp = 'ssp585' THEN supply_mw END) / nullif(max(CASE WHEN ssp = 'ssp126' THEN supply_mw END), 0) - 1) AS pct FROM runs GROUP BY ALL)""") + """
  SELECT region, median(pct) AS pct_med, count(*) AS n_gcm, count(CASE WHEN pct > 0 THEN 1 END) AS n_pos, count(CASE WHEN pct < 0 THEN 1 END) AS n_neg,
         greatest(count(CASE WHEN pct > 0 THEN 1 END), count(CASE WHEN pct < 0 THEN 1 END)) >= 4 AS robust FROM c WHERE pct IS NOT NULL GROUP BY ALL""", pct_med=7))
def climate_sensitivity(spark, d):
    return rounded(V.climate_sensitivity(_runs(spark, d), "supply_mw"), pct_med=7)


@query("gcm_weighted_change", rounded_sql(X.with_sql(RUNS) + """
  SELECT gcm, m AS wmean, sqrt(greatest(v - m * m, 0)) AS wsd, n, sqrt(greatest(v - m * m, 0)) / sqrt(n) AS se FROM (
    SELECT gcm, sum(dc_mean_mw * supply_mw) / sum(dc_mean_mw) AS m, sum(dc_mean_mw * supply_mw * supply_mw) / sum(dc_mean_mw) AS v, count(*) AS n FROM runs GROUP BY ALL)""", wmean=7, wsd=6, se=6))
def gcm_weighted_change(spark, d):
    return rounded(V.weighted_spread(_runs(spark, d), ["gcm"], "supply_mw", "dc_mean_mw"), wmean=7, wsd=6, se=6)


@query("bloc_weighted_means", rounded_sql(X.with_sql(RUNS) + """
  SELECT bloc, sum(supply_mw * greatest(dc_mean_mw, 1e-6)) / sum(greatest(dc_mean_mw, 1e-6)) AS weighted, median(supply_mw) AS median FROM runs GROUP BY ALL""", weighted=7, median=8))
def bloc_weighted_means(spark, d):
    from headrace.operators.load import demand_weighted
    return rounded(demand_weighted(_runs(spark, d), ["bloc"], "supply_mw", "dc_mean_mw"), weighted=7, median=8)


@query("log_attribution", rounded_sql(X.with_sql(RUNS, """
  w AS (SELECT region, max(CASE WHEN ssp = 'ssp126' THEN supply_mw END) AS s0, max(CASE WHEN ssp = 'ssp585' THEN supply_mw END) AS s1, max(CASE WHEN ssp = 'ssp126' THEN dc_mean_mw END) AS d0,
          max(CASE WHEN ssp = 'ssp585' THEN dc_mean_mw END) AS d1 FROM runs GROUP BY ALL)""") + """
  SELECT region, 100 * ln(s1 / s0) AS hydro, -100 * ln(d1 / d0) AS demand, 100 * ln(s1 / s0) - 100 * ln(d1 / d0) AS net FROM w""", hydro=7, demand=7, net=7))
def log_attribution(spark, d):
    def at(ssp, c):
        return F.max(F.when(F.col("ssp") == ssp, F.col(c)))
    wide = _runs(spark, d).groupBy("region").agg(at("ssp126", "supply_mw").alias("s0"), at("ssp585", "supply_mw").alias("s1"), at("ssp126", "dc_mean_mw").alias("d0"), at("ssp585", "dc_mean_mw").alias("d1"))
    return rounded(V.log_attribution(wide, ["region"], ("s0", "s1"), ("d0", "d1")), hydro=7, demand=7, net=7)


@query("lever_gains", rounded_sql(X.with_sql(RUNS, """
  r AS (SELECT bloc, region, avg(100 * (supply_mw * 1.2 - supply_mw) / dc_mean_mw) AS ps, avg(100 * (supply_mw * 1.2 + n_orders / 10.0 - supply_mw * 1.2) / dc_mean_mw) AS ca, avg(dc_mean_mw) AS dem FROM runs GROUP BY ALL)""") + """
  SELECT bloc, sum(ps * dem) / sum(dem) AS ps_gain_pct, sum(ca * dem) / sum(dem) AS cascade_gain_pct, count(*) AS n_regions FROM r GROUP BY ROLLUP (bloc)""", ps_gain_pct=7, cascade_gain_pct=7))
def lever_gains(spark, d):
    s = F.col("supply_mw")
    at = _runs(spark, d).select("bloc", "region", "dc_mean_mw", s.alias("supply_a_mw"), (s * 1.2).alias("supply_b_mw"), (s * 1.2 + F.col("n_orders") / 10.0).alias("supply_c_mw"))
    return rounded(V.lever_gains(at), ps_gain_pct=7, cascade_gain_pct=7)


@query("interconnection_gain", rounded_sql(X.with_sql(RUNS, "g AS (SELECT region, least(100, n_orders * 3.0) - least(100, n_orders * 1.0) AS gain, dc_mean_mw FROM runs)") + """
  SELECT * FROM (SELECT region, median(gain) AS med, min(gain) AS lo, max(gain) AS hi, median(dc_mean_mw) AS demand_mw FROM g GROUP BY ALL) WHERE med > 5""", demand_mw=7))
def interconnection_gain(spark, d):
    n = F.col("n_orders")
    at = _runs(spark, d).select("region", F.col("dc_mean_mw").alias("demand_mw"), F.least(F.lit(100.0), n * 3.0).alias("cov_interconnected_pct"), F.least(F.lit(100.0), n * 1.0).alias("cov_isolated_pct"))
    return rounded(V.interconnection_gain(at, 5.0), demand_mw=7)


@query("coverage_table", rounded_sql("""
  SELECT region, demand_mw, cov FROM (SELECT n_name AS region, c_acctbal AS demand_mw, c_custkey % 100 AS cov, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS i
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING') WHERE i = 1""", demand_mw=4))
def coverage_table(spark, d):
    at = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("region"), F.col("c_acctbal").alias("demand_mw"), (F.col("c_custkey") % 100).alias("cov"), F.col("c_mktsegment").alias("scenario"), F.col("c_custkey").alias("row_ord"))
    return rounded(V.coverage_table(at, "BUILDING").select("region", "demand_mw", "cov"), demand_mw=4)


@query("coverage_summary", rounded_sql("""
  SELECT sum(c * w) / sum(w) AS weighted, median(c) AS median, count(*) AS n_regions FROM (SELECT n_name, avg(c_custkey % 100) AS c, sum(abs(c_acctbal)) AS w
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""", weighted=7, median=7))
def coverage_summary(spark, d):
    at = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.avg(F.col("c_custkey") % 100).alias("c"), F.sum(F.abs("c_acctbal")).alias("demand_mw"))
    return rounded(V.coverage_summary(at, "c"), weighted=7, median=7)


@query("seasonal_heatmap", rounded_sql("""
  WITH m AS (SELECT n_name AS region, year(o_orderdate) AS year, month(o_orderdate) AS month, sum(o_totalprice) / 1e5 AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
  k AS (SELECT region FROM m GROUP BY region HAVING min(v) < 4 AND max(v) >= 22)
  SELECT region, year, """ + ", ".join(f"avg(CASE WHEN month = {i} THEN v END) AS m{i}" for i in range(1, 13)) + " FROM m WHERE region IN (SELECT region FROM k) GROUP BY ALL", **{f"m{i}": 7 for i in range(1, 13)}))
def seasonal_heatmap(spark, d):
    who = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("region"))
    at = X.table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("region", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        (F.sum("o_totalprice") / 1e5).alias("v"))
    return rounded(V.seasonal_heatmap(at, "v", worst=4.0, best=22.0), **{f"m{i}": 7 for i in range(1, 13)})


@query("small_share_collapse", rounded_sql(X.with_sql(X.STATIONS) + """
  SELECT bloc, CASE WHEN capacity_mw / t < 0.006 THEN 'Other ' || upper(bloc[1]) || lower(bloc[2:]) ELSE name END AS name, CASE WHEN capacity_mw / t < 0.006 THEN 'other' ELSE type END AS kind, sum(capacity_mw) AS value
  FROM stations, (SELECT sum(capacity_mw) AS t FROM stations WHERE capacity_mw > 0) WHERE capacity_mw > 0 GROUP BY ALL""".replace("upper(bloc[1]) || lower(bloc[2:])", "CASE bloc WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(bloc[1]) || lower(bloc[2:]) END"), value=4))
def small_share_collapse(spark, d):
    rows = X.stations(spark, d).select("bloc", "name", F.col("type").alias("kind"), F.col("capacity_mw").alias("value"))
    return rounded(V.collapse_small(rows, 0.006), value=4)


@query("mode_fill", """
  WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 10 THEN p_type END AS kind FROM part),
  c AS (SELECT p_brand, kind AS k, count(*) AS n FROM p WHERE kind IS NOT NULL GROUP BY ALL),
  m AS (SELECT p_brand, k, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, k) AS i FROM c)
  SELECT p_partkey, p.p_brand, coalesce(kind, k, 'developing') AS kind FROM p LEFT JOIN m ON m.p_brand = p.p_brand AND i = 1""")
def mode_fill(spark, d):
    at = X.table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_type")).alias("kind"))
    return V.fill_with_mode(at, ["p_brand"], "kind", "developing").select("p_partkey", "p_brand", "kind")


@query("type_sets", """
  SELECT l_suppkey, array_to_string(list(DISTINCT l_returnflag ORDER BY l_returnflag), '+') AS types, mode(l_linestatus ORDER BY l_linestatus) AS status FROM lineitem GROUP BY ALL""".replace(
    "mode(l_linestatus ORDER BY l_linestatus)", "CASE WHEN count(*) FILTER (l_linestatus = 'F') >= count(*) FILTER (l_linestatus = 'O') THEN 'F' ELSE 'O' END"))
def type_sets(spark, d):
    """The set is bounded by the number of flags."""
    at = X.table(spark, d, "lineitem")
    return at.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "+").alias("types"), F.expr("mode() WITHIN GROUP (ORDER BY l_linestatus)").alias("status"))


@query("corridor_map", rounded_sql(X.with_sql(X.FLOWS, """
  cr AS (SELECT least(src_region, dc_region) AS a, greatest(src_region, dc_region) AS b, sum(sent_mw) AS used_mw FROM flows WHERE src_region <> dc_region GROUP BY ALL),
  nt AS (SELECT region, sum(x) AS net FROM (SELECT src_region AS region, sent_mw AS x FROM flows UNION ALL SELECT dc_region, -delivered_mw FROM flows) GROUP BY ALL)""") + """
  SELECT CASE WHEN na.net < nb.net THEN b ELSE a END AS frm, CASE WHEN na.net < nb.net THEN a ELSE b END AS "to", used_mw, sign(na.net) * sqrt(abs(na.net)) AS net_root_a, sign(nb.net) * sqrt(abs(nb.net)) AS net_root_b
  FROM cr JOIN nt na ON na.region = a JOIN nt nb ON nb.region = b WHERE used_mw >= 50""", used_mw=5, net_root_a=5, net_root_b=5))
def corridor_map(spark, d):
    flows = X.flows_once(spark, d)
    used = flows.filter("src_region <> dc_region").groupBy(F.least("src_region", "dc_region").alias("region_a"), F.greatest("src_region", "dc_region").alias("region_b")).agg(F.sum("sent_mw").alias("used_mw"))
    sides = F.array(F.struct(F.col("src_region").alias("region"), F.col("sent_mw").alias("x")), F.struct(F.col("dc_region").alias("region"), (-F.col("delivered_mw")).alias("x")))
    net = flows.select(F.explode(sides).alias("s")).groupBy("s.region").agg(F.sum("s.x").alias("net_export_mw"))
    return rounded(V.corridor_map(used, net), used_mw=5, net_root_a=5, net_root_b=5)


EFFECTS = """
eff AS (SELECT bloc, station_idx, scenario, avg(q) AS v FROM dflow JOIN stations USING (station_idx) GROUP BY ALL),
ew AS (SELECT bloc, station_idx, max(CASE WHEN scenario = 'nat' THEN v END) AS dc_a, max(CASE WHEN scenario = 'CONV' THEN v END) AS conv, max(CASE WHEN scenario = 'BAL_C' THEN v END) AS bal_c FROM eff GROUP BY ALL)
"""


def _effects(spark, d):
    mean = X.daily_wide(spark, d).groupBy("station_idx").agg(F.avg("q_nat").alias("dc_a"), F.avg("q_conv").alias("conv"), F.avg("q_bal").alias("bal_c"))
    return mean.join(X.stations(spark, d).select("station_idx", "bloc"), "station_idx")


@query("footprint_change", rounded_sql(X.with_sql(X.DAILY, X.STATIONS, EFFECTS) + """
  SELECT bloc, count(*) AS n, 100 * avg(CASE WHEN abs(dc_a - conv) > 1e-9 THEN 1 ELSE 0 END) AS pct_conv, median(CASE WHEN abs(dc_a - conv) > 1e-9 THEN dc_a - conv END) AS med_conv,
    median(CASE WHEN abs(dc_a - conv) > 1e-9 THEN abs((dc_a - conv) / conv) * 100 END) AS rel_conv, 100 * avg(CASE WHEN abs(dc_a - bal_c) > 1e-9 THEN 1 ELSE 0 END) AS pct_typ,
    median(CASE WHEN abs(dc_a - bal_c) > 1e-9 THEN dc_a - bal_c END) AS med_typ, median(CASE WHEN abs(dc_a - bal_c) > 1e-9 THEN abs((dc_a - bal_c) / bal_c) * 100 END) AS rel_typ FROM ew GROUP BY ALL""",
    pct_conv=7, med_conv=8, rel_conv=7, pct_typ=7, med_typ=8, rel_typ=7))
def footprint_change(spark, d):
    return rounded(V.footprint_change(_effects(spark, d), ["bloc"]), pct_conv=7, med_conv=8, rel_conv=7, pct_typ=7, med_typ=8, rel_typ=7)


@query("increment_ratio", rounded_sql(X.with_sql(X.DAILY, X.STATIONS, EFFECTS) + """
  SELECT bloc, avg(dc_a - bal_c) AS typ, avg(dc_a - conv) AS conv, count(*) AS n, avg(dc_a - bal_c) / abs(avg(dc_a - conv)) * 100 AS ratio_pct FROM ew WHERE abs(dc_a - conv) > 1e-9 GROUP BY ALL""", typ=8, conv=8, ratio_pct=6))
def increment_ratio(spark, d):
    at = _effects(spark, d).select("bloc", (F.col("dc_a") - F.col("bal_c")).alias("typ"), (F.col("dc_a") - F.col("conv")).alias("conv"))
    return rounded(V.increment_ratio(at, ["bloc"]), typ=8, conv=8, ratio_pct=6)


OVERLAY = """
rc AS (SELECT c_mktsegment AS region, c_acctbal - 4000 AS eff, length_km, protected_pct, c_custkey % 4 AS n_threatened FROM customer JOIN network ON river_id = c_custkey + 1),
ov AS (SELECT region, CASE WHEN eff > 0 THEN 'harmful' ELSE 'beneficial' END AS sign, count(*) AS n_reach, sum(length_km) AS length_km, coalesce(sum(CASE WHEN protected_pct >= 50 THEN length_km END), 0) AS len_in_pa_km,
         coalesce(sum(CASE WHEN n_threatened > 0 THEN length_km END), 0) AS len_in_fish_km, coalesce(sum(CASE WHEN n_threatened > 0 THEN n_threatened END), 0) AS n_threatened_sp,
         coalesce(sum(CASE WHEN protected_pct >= 50 THEN abs(eff) * length_km END), 0) AS wexp_pa FROM rc WHERE eff <> 0 GROUP BY ALL)
"""


def _overlay(spark, d):
    c = X.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("river_id"), F.col("c_mktsegment").alias("region"), (F.col("c_acctbal") - 4000).alias("eff"), (F.col("c_custkey") % 4).alias("n_threatened"))
    return V.conservation_overlay(c.join(X.network(spark, d), "river_id"), ["region"])


ODIG = dict(length_km=5, len_in_pa_km=5, len_in_fish_km=5, wexp_pa=2, pa_share_pct=7, fish_share_pct=7)


@query("conservation_overlay", rounded_sql(X.with_sql(X.NETWORK, OVERLAY) + "SELECT *, 100 * len_in_pa_km / length_km AS pa_share_pct, 100 * len_in_fish_km / length_km AS fish_share_pct FROM ov", **ODIG))
def conservation_overlay(spark, d):
    return rounded(_overlay(spark, d), **ODIG)


@query("net_sign_table", rounded_sql(X.with_sql(X.NETWORK, OVERLAY) + """
  SELECT region, h + b AS length_km, 100 * pa / (h + b) AS pa_share_pct, 100 * (h - b) / (h + b) AS net_pct, sp AS n_threatened_sp FROM (
    SELECT region, sum(CASE WHEN sign = 'harmful' THEN length_km ELSE 0 END) AS h, sum(CASE WHEN sign = 'beneficial' THEN length_km ELSE 0 END) AS b, sum(len_in_pa_km) AS pa, sum(n_threatened_sp) AS sp FROM ov GROUP BY ALL)""",
    length_km=5, pa_share_pct=7, net_pct=7))
def net_sign_table(spark, d):
    return rounded(V.net_sign_table(_overlay(spark, d), ["region"]), length_km=5, pa_share_pct=7, net_pct=7)


MASTER = """
em AS (SELECT n_name AS region, CASE n_nationkey % 3 WHEN 0 THEN 'developed' WHEN 1 THEN 'emerging' ELSE 'developing' END AS income_group, sum(o_totalprice) / 1e4 AS dc_mean_mw, count(*) * 25.0 AS supply_c_mw,
         count(*) * 2.0 AS grid_resid_c_mw, 100.0 + n_nationkey AS dc_carbon_intensity, sum(o_totalprice) * 3 AS net_carbon_avoided FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
ms AS (SELECT *, 100 * least(supply_c_mw, dc_mean_mw) / dc_mean_mw AS dom_share_pct, net_carbon_avoided / 1e6 AS carbon_mt, dc_carbon_intensity + net_carbon_avoided * 1000 / (dc_mean_mw * 8760) AS ef_grid FROM em)
"""


def _master(spark, d):
    k = F.col("n_nationkey")
    who = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == k).select("c_custkey", F.col("n_name").alias("region"), k)
    group = F.when(k % 3 == 0, "developed").when(k % 3 == 1, "emerging").otherwise("developing")
    at = X.table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("region", "n_nationkey").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    return V.equity_master(at.select("region", group.alias("income_group"), (F.col("s") / 1e4).alias("dc_mean_mw"), (F.col("n") * 25.0).alias("supply_c_mw"), (F.col("n") * 2.0).alias("grid_resid_c_mw"),
                                     (100.0 + k).alias("dc_carbon_intensity"), (F.col("s") * 3).alias("net_carbon_avoided")))


@query("equity_master", rounded_sql(X.with_sql(MASTER) + "SELECT region, income_group, dom_share_pct, carbon_mt, ef_grid FROM ms", dom_share_pct=7, carbon_mt=5, ef_grid=6))
def equity_master(spark, d):
    return rounded(_master(spark, d).select("region", "income_group", "dom_share_pct", "carbon_mt", "ef_grid"), dom_share_pct=7, carbon_mt=5, ef_grid=6)


@query("income_rollup", rounded_sql(X.with_sql(MASTER) + """
  SELECT income_group, count(*) AS n_regions, sum(dc_mean_mw) AS dc_mean_mw, sum(least(supply_c_mw, dc_mean_mw)) AS firm_to_dc_mw, sum(grid_resid_c_mw) AS firm_to_grid_mw, sum(carbon_mt) AS carbon_mt,
         100 * sum(least(supply_c_mw, dc_mean_mw)) / sum(dc_mean_mw) AS dom_share_pct, 100 * sum(carbon_mt) / sum(sum(carbon_mt)) OVER () AS carbon_share_pct FROM ms GROUP BY ALL""",
    dc_mean_mw=4, firm_to_dc_mw=4, carbon_mt=4, dom_share_pct=7, carbon_share_pct=7))
def income_rollup(spark, d):
    return rounded(V.income_rollup(_master(spark, d)), dc_mean_mw=4, firm_to_dc_mw=4, carbon_mt=4, dom_share_pct=7, carbon_share_pct=7)


@query("flow_matrix", rounded_sql(X.with_sql(X.FLOWS, MASTER) + """
  SELECT scenario, a.income_group AS src_group, b.income_group AS dc_group, sum(delivered_mw) AS delivered_mw FROM flows JOIN em a ON a.region = src_region JOIN em b ON b.region = dc_region GROUP BY ALL""", delivered_mw=4))
def flow_matrix(spark, d):
    return rounded(V.flow_matrix(X.flows(spark, d), _master(spark, d).select("region", "income_group")), delivered_mw=4)


@query("corridor_injustice", rounded_sql(X.with_sql(X.FLOWS, MASTER) + """
  SELECT src_region, dc_region, sum(delivered_mw) AS delivered_mw, max(supply_c_mw / e) AS burden_per_mw FROM flows JOIN (SELECT src_region, sum(sent_mw) AS e FROM flows GROUP BY ALL) USING (src_region)
  JOIN em ON region = src_region GROUP BY ALL""", delivered_mw=7, burden_per_mw=8))
def corridor_injustice(spark, d):
    burdens = _master(spark, d).select("region", F.col("supply_c_mw").alias("burden"))
    return rounded(V.corridor_injustice(X.flows_once(spark, d), burdens, ["src_region", "dc_region"]), delivered_mw=7, burden_per_mw=8)


@query("richness_classes", """
  SELECT s_suppkey AS basin, n_threatened, CAST(least(n_threatened, 6) AS INT) AS richness_class FROM supplier JOIN (SELECT l_suppkey, count(*) FILTER (l_quantity > 49) AS n_threatened FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey
  WHERE n_threatened > 0""")
def richness_classes(spark, d):
    species = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("basin")).agg(F.count_if(F.col("l_quantity") > 49).alias("n_threatened"))
    return V.richness_classes(X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("basin")), species)


@query("species_exposure", """
  SELECT count(*) FILTER (h AND NOT g) AS only_harm, count(*) FILTER (g AND NOT h) AS only_benefit, count(*) FILTER (h AND g) AS both FROM (
    SELECT l_partkey, bool_or(s_acctbal > 4000) AS h, bool_or(s_acctbal < 4000) AS g FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal <> 4000 GROUP BY ALL)""")
def species_exposure(spark, d):
    basins = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("basin"), (F.col("s_acctbal") - 4000).alias("eff"))
    return V.species_exposure(basins, X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("basin"), F.col("l_partkey").alias("species")))


@query("both_ends", "(SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7) UNION (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 6)")
def both_ends(spark, d):
    return V.both_ends(X.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("largest_per_segment", """
  SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) WHERE i <= 3""")
def largest_per_segment(spark, d):
    return R.top_per_group(X.table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("key_set_algebra", """
  WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
  SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT k, 'only_r' FROM (SELECT k FROM a EXCEPT SELECT * FROM b) UNION ALL
  SELECT l_partkey, 'only_a' FROM (SELECT l_partkey FROM b EXCEPT SELECT * FROM a)""")
def key_set_algebra(spark, d):
    at = X.table(spark, d, "lineitem")
    a = at.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    b = at.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("k"))
    return (a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("only_r")))
            .unionByName(b.subtract(a).withColumn("side", F.lit("only_a"))))


@query("affected_units", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def affected_units(spark, d):
    units = X.table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return X.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").join(units, "l_suppkey", "left_semi")


# ---- quality ----

@query("range_violations", """
  SELECT event_type, count(*) FILTER ((event_type = 'click' AND (value < 1 OR value > 60)) OR (event_type = 'view' AND value > 90)) AS n_outside, count(value) AS n_known, min(value) AS lowest, max(value) AS highest
  FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def range_violations(spark, d):
    return Q.range_violations(X.table(spark, d, "events"), {"click": (1.0, 60.0), "view": (None, 90.0)}, "event_type", "value")


@query("line_violations", X.with_sql(X.LINES, """
  v AS (SELECT 'line ' || CAST(o_orderkey // 2 AS VARCHAR) AS ln, CASE WHEN type = 'MIXED' THEN 'DC' ELSE type END AS type, status, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE capacity_mw END AS cap, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 'http' END AS src
        FROM (SELECT *, CAST(replace(line_name, 'line ', '') AS BIGINT) AS o_orderkey FROM lines))""") + """
  SELECT ln AS line_name, p.problem, count(*) AS n FROM v JOIN (SELECT ln, count(*) AS c FROM v GROUP BY ALL) USING (ln), (VALUES ('type'), ('status'), ('duplicate'), ('source'), ('capacity')) p(problem)
  WHERE CASE p.problem WHEN 'type' THEN type NOT IN ('AC', 'HVDC', 'MIXED') WHEN 'status' THEN false WHEN 'duplicate' THEN c > 1 WHEN 'source' THEN trim(src) = '' ELSE status = 'existing' AND NOT coalesce(cap > 0, false) END GROUP BY ALL""")
def line_violations(spark, d):
    o = F.replace(F.col("line_name"), F.lit("line "), F.lit("")).cast("bigint")
    at = X.lines(spark, d).withColumn("o", o).select(
        F.concat(F.lit("line "), F.floor(F.col("o") / 2).cast("string")).alias("line_name"), F.when(F.col("type") == "MIXED", "DC").otherwise(F.col("type")).alias("type"), "status",
        F.when(F.col("o") % 9 != 0, F.col("capacity_mw")).alias("capacity_mw"), F.when(F.col("o") % 10 == 0, " ").otherwise("http").alias("source_url"))
    return Q.line_violations(at).groupBy("line_name", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("scenario_order_violations", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT * FROM (SELECT station_idx, sum(q_conv) AS supply_a_mw, sum(q_nat) AS supply_b_mw, sum(q_bal) * 0.96 AS supply_c_mw FROM daily GROUP BY ALL) WHERE supply_b_mw + 1e-6 < supply_a_mw OR supply_c_mw + 1e-6 < supply_b_mw""",
    supply_a_mw=4, supply_b_mw=4, supply_c_mw=4))
def scenario_order_violations(spark, d):
    at = X.daily_wide(spark, d).groupBy("station_idx").agg(F.sum("q_conv").alias("supply_a_mw"), F.sum("q_nat").alias("supply_b_mw"), (F.sum("q_bal") * 0.96).alias("supply_c_mw"))
    return rounded(Q.scenario_order_violations(at, ["station_idx"]), supply_a_mw=4, supply_b_mw=4, supply_c_mw=4)


@query("missing_days", """
  SELECT s_suppkey AS station_idx, CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM supplier, range(1995, 2002) a(y), range(1, 13) b(m)
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND year(l_shipdate) = y AND month(l_shipdate) = m)""")
def missing_days(spark, d):
    expected = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("station_idx"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    actual = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station_idx"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    return Q.missing_combinations(actual, expected, ["station_idx", "year", "month"])


@query("duplicate_coordinates", "SELECT round(c_acctbal / 100, 0) AS lat, c_nationkey AS lon, count(*) AS n_rows FROM customer GROUP BY ALL HAVING count(*) > 1")
def duplicate_coordinates(spark, d):
    at = X.table(spark, d, "customer").select(F.round(F.col("c_acctbal") / 100, 0).alias("lat"), F.col("c_nationkey").alias("lon"))
    return Q.duplicate_keys(at, ["lat", "lon"])


@query("dangling_references", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_references(spark, d):
    return Q.dangling(X.table(spark, d, "documents"), X.table(spark, d, "labels"), ["doc_id"])


@query("single_row_check", "SELECT n_nationkey, count(s_suppkey) AS n_rows FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL HAVING count(s_suppkey) <> 1")
def single_row_check(spark, d):
    have = X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return Q.not_one_row(have, ["n_nationkey"], X.table(spark, d, "nation"))


@query("coverage_report", rounded_sql("""
  SELECT field, 100 * avg(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) AS known_pct, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75 FROM (
    SELECT 'c_acctbal' AS field, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer UNION ALL SELECT 'c_custkey', c_custkey FROM customer) GROUP BY ALL""", known_pct=7, p25=6, p50=6, p75=6))
def coverage_report(spark, d):
    at = X.table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), F.col("c_custkey").cast("double").alias("c_custkey"))
    return rounded(Q.coverage_report(at, ["c_acctbal", "c_custkey"]), known_pct=7, p25=6, p50=6, p75=6)


# ---- sources and sinks: text that Spark makes from the tables, then reads ----

@query("channel_text", rounded_sql(X.with_sql(X.HOURLY) + """
  SELECT CAST(n AS INT) AS channel, ts, q_nat / 3600 AS flo_out FROM hourly JOIN (
    SELECT event_type AS station, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events)) USING (station)
  WHERE n % 2 = 1""", flo_out=10))
def channel_text(spark, d):
    """Every second channel is wanted; the others' rows are dropped by their id."""
    names = ("jday", "mon", "day", "yr", "tstep", "unit", "gis_id", "name", "flo_out")
    kinds = X.table(spark, d, "events").select(F.col("event_type").alias("station")).distinct()
    numbered = kinds.withColumn("n", F.row_number().over(Window.orderBy("station")))  # a handful of stations
    at = X.hourly(spark, d).join(F.broadcast(numbered), "station")
    line = F.format_string("%d %d %d %d %d %d %d cha%s %.4f", F.dayofyear("ts"), F.month("ts"), F.dayofmonth("ts"), F.year("ts"), F.hour("ts") + 1, F.lit(1), F.col("n"), F.col("station"), F.col("q_nat"))
    heads = kinds.select("station", F.explode(F.array(F.lit("channel day table"), F.lit(" ".join(names)), F.lit("m^3/h"))).alias("value"))
    lines = at.select("station", line.alias("value")).unionByName(heads)
    ids = numbered.filter("n % 2 = 1").select(F.col("n").alias("id"))
    return rounded(text.channel_subday(text.tokens(lines.withColumnRenamed("station", "file")), names, ids), flo_out=10)


@query("land_unit_text", rounded_sql("""
  SELECT CAST(l_suppkey AS INT) AS id, l_shipdate::DATE AS date, sum(l_quantity) AS perc, CASE WHEN sum(l_tax) > 0.05 THEN round(sum(l_tax), 4) END AS et FROM lineitem GROUP BY ALL""", perc=4, et=4))
def land_unit_text(spark, d):
    names = ("jday", "mon", "day", "yr", "unit", "gis_id", "name", "perc", "et")
    at = X.table(spark, d, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("x"))
    et = F.when(F.round("x", 9) > 0.05, F.format_string("%.4f", F.round("x", 4))).otherwise("nan")
    line = F.concat_ws(" ", F.dayofyear("t"), F.month("t"), F.dayofmonth("t"), F.year("t"), F.lit("1"), F.lit("0"), F.format_string("rtu%05d", F.col("l_suppkey")), F.col("q").cast("string"), et)
    lines = at.select(F.lit("lsunit").alias("file"), line.alias("value"))
    out = text.daily_table(text.tokens(lines), names, ["perc", "et"], id_column="name", prefix="rtu")
    return rounded(out, perc=4, et=4)


@query("weather_text", rounded_sql(X.with_sql(X.HOURLY) + """
  SELECT station || '.tmp' AS file, ts::DATE AS date, round(max(q_nat), 3) AS tmax, round(min(q_nat), 3) AS tmin, (round(max(q_nat), 3) + round(min(q_nat), 3)) / 2 AS tmp_ave FROM hourly GROUP BY ALL""", tmp_ave=6))
def weather_text(spark, d):
    at = X.hourly(spark, d).groupBy("station", F.to_date("ts").alias("date")).agg(F.max("q_nat").alias("hi"), F.min("q_nat").alias("lo"))
    series = at.select("station", "date", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.round("hi", 3).alias("tmax"), F.round("lo", 3).alias("tmin"))
    lines = sinks.station_weather_lines(series, "tmp").select(F.concat("station", F.lit(".tmp")).alias("file"), "value")
    return rounded(text.temperature(text.tokens(lines)), tmp_ave=6)


@query("rain_text", rounded_sql(X.with_sql(X.HOURLY) + "SELECT station || '.pcp' AS file, ts, round(q_bal, 3) AS precip_mm FROM hourly", precip_mm=3))
def rain_text(spark, d):
    at = X.hourly(spark, d).select("station", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.round("q_bal", 3).alias("value"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    lines = sinks.station_weather_lines(at, "pcp").select(F.concat("station", F.lit(".pcp")).alias("file"), "value")
    return rounded(text.rain(text.tokens(lines)), precip_mm=3)


@query("connection_text", X.with_sql(X.STATIONS) + """
  SELECT CAST(station_idx AS INT) AS id, round(lat, 3) AS lat, round(lon, 3) AS lon, 'w' || CAST(station_idx % 7 AS VARCHAR) AS weather, CASE WHEN station_idx % 3 = 0 THEN CAST(station_idx + 5 AS INT) END AS aqu FROM stations""")
def connection_text(spark, d):
    k = F.col("station_idx")
    tail = F.when(k % 3 == 0, F.format_string(" sdc 12 tot 1.0 aqu %d rhg 1.0", k + 5)).otherwise(" sdc 12 tot 1.0")
    line = F.concat(F.format_string("%d cha%d 1 10.5 %.3f %.3f 300 w%d", k, k, F.col("lat"), F.col("lon"), k % 7), tail)
    lines = X.stations(spark, d).select(F.lit("chandeg.con").alias("file"), line.alias("value"))
    heads = X.table(spark, d, "region").select(F.lit("chandeg.con").alias("file"), F.concat(F.lit("id name "), "r_name").alias("value"))
    return rounded(text.connections(text.tokens(lines.unionByName(heads))), lat=3, lon=3)


@query("day_row_load", rounded_sql(X.with_sql(X.HOURLY) + "SELECT station AS area, ts, round(q_nat, 4) AS load_mw FROM hourly", load_mw=4))
def day_row_load(spark, d):
    at = X.hourly(spark, d).withColumn("d", F.to_date("ts")).withColumn("h", F.hour("ts"))
    wide = at.groupBy("station", "d").pivot("h", list(range(24))).agg(F.max(F.round("q_nat", 4).cast("string")))
    return rounded(hourly_columns(wide, F.col("station"), F.col("d"), [f"`{h}`" for h in range(24)]), load_mw=4)


@query("nested_json_load", rounded_sql(X.with_sql(X.HOURLY) + "SELECT station AS area, ts, q_nat / 1000 AS load_mw FROM hourly", load_mw=8))
def nested_json_load(spark, d):
    at = X.hourly(spark, d).withColumn("d", F.to_date("ts")).withColumn("h", F.hour("ts"))
    wide = at.groupBy("station", "d").pivot("h", list(range(24))).agg(F.max("q_nat"))
    values = F.struct(*[F.col(f"`{h}`").alias(f"Hour{h + 1:02d}") for h in range(24)])
    item = F.struct(F.date_format("d", "yyyy-MM-dd'T'00:00:00").alias("Date"), F.array(F.struct(values.alias("Values"))).alias("HourlyEntities"))
    docs = wide.select("station", F.to_json(F.struct(F.array(item).alias("Items"))).alias("value"))
    return rounded(nested_json(docs, F.col("station")), load_mw=8)


@query("packed_hour_sequence", rounded_sql("""
  SELECT event_type AS area, CAST((i - 1) % 24 AS INT) AS hod, CAST(((i - 1) // 24) % 365 + 1 AS INT) AS doy, value AS load_mw FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)""", load_mw=4))
def packed_hour_sequence(spark, d):
    at = X.table(spark, d, "events").select("event_type", "event_id", "value")
    numbered = R.running_totals(at, ["event_type"], ["event_id"], {}, row_number="row_no").withColumn("row_ord", F.col("row_no") - 1)
    return rounded(packed_hours(numbered, "event_type", "value"), load_mw=4)


@query("wide_area_load", rounded_sql(X.with_sql(X.HOURLY) + "SELECT station AS area, ts, q_nat AS load_mw FROM hourly", load_mw=4))
def wide_area_load(spark, d):
    at = X.hourly(spark, d)
    stations = [r.station for r in at.select("station").distinct().orderBy("station").collect()]  # columns of the wide file
    wide = at.groupBy("ts").pivot("station", stations).agg(F.max("q_nat"))
    return rounded(loads.wide_areas(wide, F.col("ts"), {s: s for s in stations}), load_mw=4)


@query("combined_or_parts", """
  SELECT o_custkey AS folder, o_orderkey AS path FROM orders o WHERE (o_orderstatus = 'P') = EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P')""")
def combined_or_parts(spark, d):
    files = X.table(spark, d, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("path"), (F.col("o_orderstatus") == "P").alias("is_combined"))
    return tables.combined_or_parts(files).select("folder", "path")


@query("freshest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS path FROM orders GROUP BY ALL")
def freshest_per_key(spark, d):
    files = X.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    return tables.freshest_per_key(files, ["o_custkey"])


@query("run_manifest", rounded_sql("SELECT o_orderpriority AS program, o_orderstatus AS status, count(*) AS n_runs, sum(o_totalprice) AS seconds FROM orders GROUP BY ALL", seconds=2))
def run_manifest(spark, d):
    runs = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("program"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("seconds"))
    return rounded(sinks.run_manifest(runs), seconds=2)


@query("dataset_card", """
  SELECT '["value"]' AS features, map_from_entries(list((event_type, months) ORDER BY event_type)) AS split_months, max(b) AS last_ts, min(a) AS first_ts, sum(n)::BIGINT AS n_rows FROM (
    SELECT event_type, list(DISTINCT strftime(ts, '%Y-%m') ORDER BY strftime(ts, '%Y-%m')) AS months, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY ALL)""".replace(
    "map_from_entries(list((event_type, months) ORDER BY event_type))", "string_agg(event_type || '=' || array_to_string(months, ','), ';' ORDER BY event_type)"))
def dataset_card(spark, d):
    card = sinks.dataset_card(X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", ["value"], "event_type")
    shown = F.concat_ws(";", F.transform(F.map_entries("split_months"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))))
    return card.withColumn("split_months", shown)


@query("duplicate_cells", "SELECT user_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_cells(spark, d):
    at = X.table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return tables.duplicate_cells(at, ["user_id", "ts"])


@query("category_order", """
  SELECT n_name, r_name, coalesce(ord, 99) AS bloc_order, row_number() OVER (ORDER BY coalesce(ord, 99), n_nationkey DESC) AS i FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (VALUES ('ASIA', 0), ('EUROPE', 1), ('AFRICA', 2)) o(r, ord) ON r = r_name""")
def category_order(spark, d):
    order = spark.createDataFrame([("ASIA", 0), ("EUROPE", 1), ("AFRICA", 2)], "r_name string, bloc_order int")
    at = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "n_nationkey", "r_name")
    placed = V.category_order(at, "r_name", order, out="bloc_order")
    return placed.select("n_name", "r_name", "bloc_order", F.row_number().over(Window.orderBy("bloc_order", F.desc("n_nationkey"))).alias("i"))  # 25 nations


@query("global_quantiles", rounded_sql("SELECT quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem", p5=4, p95=4, p99=4))
def global_quantiles(spark, d):
    return rounded(R.exact_quantiles(X.table(spark, d, "lineitem"), [], "l_extendedprice", {"p5": 0.05, "p95": 0.95, "p99": 0.99}), p5=4, p95=4, p99=4)


@query("global_quantiles_large", rounded_sql("""
  SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY ALL UNION ALL
  SELECT 'all', quantile_cont(l_quantity, 0.05), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 1) FROM lineitem""", p5=4, p95=4, p99=4))
def global_quantiles_large(spark, d):
    """The path for groups above ``hot_rows``: sketches bracket, counts prove."""
    at = X.table(spark, d, "lineitem")
    parts = R.exact_quantiles(at, ["l_returnflag"], "l_extendedprice", {"p5": 0.05, "p95": 0.95, "p99": 0.99}, hot_rows=500)
    whole = R.exact_quantiles(at, [], "l_quantity", {"p5": 0.05, "p95": 0.5, "p99": 1.0}, hot_rows=500).select(F.lit("all").alias("l_returnflag"), "p5", "p95", "p99")
    return rounded(parts.unionByName(whole), p5=4, p95=4, p99=4)


@query("recurrence_quantile", rounded_sql(X.with_sql(X.DAILY, """
  l AS (SELECT station_idx, count(*) AS n, list(q ORDER BY q) AS v FROM dflow WHERE scenario = 'nat' GROUP BY ALL), x AS (SELECT *, 0.9 * (n + 1) AS p FROM l)""") + """
  SELECT station_idx, CASE WHEN n < 5 THEN NULL WHEN p >= n THEN v[n] ELSE v[CAST(floor(p) AS INT)] + (p - floor(p)) * (v[CAST(floor(p) AS INT) + 1] - v[CAST(floor(p) AS INT)]) END AS q10 FROM x""", q10=6))
def recurrence_quantile(spark, d):
    return rounded(S.recurrence_quantile(X.daily_flow(spark, d).filter("scenario = 'nat'"), ["station_idx"], "q", 10.0, out="q10"), q10=6)


@query("filled_exponents", """
  SELECT event_id, coalesce(CASE WHEN value > 50 THEN value END, 1.5) AS b_low, coalesce(CASE WHEN event_id % 2 = 0 THEN 1.9 END, 2.0)::DOUBLE AS b_central, 2.5::DOUBLE AS b_high FROM events""")
def filled_exponents(spark, d):
    at = X.table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.col("value").cast("string")).otherwise("n/a").alias("b_low"),
                                            F.when(F.col("event_id") % 2 == 0, F.lit("1.9")).alias("b_central"))
    return D.fill_exponents(at)
