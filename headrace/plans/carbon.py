"""Reservoir, grid and trade carbon queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headrace.functions import geo
from headrace.functions.core import round_even
from headrace.operators import carbon as C
from headrace.operators import ranking as R
from headrace.operators.stations import fallback_join
from headrace.plans import standins as X
from headrace.plans.registry import query, rounded, rounded_sql
from headrace.session import reliable_checkpoint

# Reservoirs: suppliers, with monthly climate from their key.
RES = """
res AS (SELECT station_idx, name, region, lat, lon, max_area_km2, max_vol_km3, head_m, abs(capacity_mw) / 10 AS gen_gwh, capacity_mw,
          CASE WHEN station_idx % 6 = 0 THEN NULL ELSE max_area_km2 * 0.9 END AS area_km2,
          CASE WHEN station_idx % 5 = 0 THEN NULL ELSE max_vol_km3 * 1.1 END AS vol_km3,
          CASE WHEN station_idx % 4 = 0 THEN 3.0 + station_idx % 30 END AS depth_m,
          CASE WHEN station_idx % 9 = 0 THEN NULL ELSE 20.0 + station_idx % 150 END AS ocs_tha,
          CASE WHEN station_idx % 8 = 0 THEN NULL ELSE CAST(station_idx * 31 % 97 AS DOUBLE) END AS total_p,
          50.0 + station_idx % 500 AS discharge_cms, CAST(station_idx % 13 AS DOUBLE) AS ice_free_months FROM stations)
"""


def _reservoirs(spark, d):
    k = F.col("station_idx")
    months = range(12)
    return X.stations(spark, d).select(
        "station_idx", "name", "region", "lat", "lon", "max_area_km2", "max_vol_km3", "head_m", (F.abs("capacity_mw") / 10).alias("gen_gwh"), "capacity_mw",
        F.when(k % 6 != 0, F.col("max_area_km2") * 0.9).alias("area_km2"), F.when(k % 5 != 0, F.col("max_vol_km3") * 1.1).alias("vol_km3"),
        F.when(k % 4 == 0, 3.0 + k % 30).alias("depth_m"), F.when(k % 9 != 0, 20.0 + k % 150).alias("ocs_tha"),
        F.when(k % 8 != 0, (k * 31 % 97).cast("double")).alias("total_p"), (50.0 + k % 500).alias("discharge_cms"),
        (k % 13).cast("double").alias("ice_free_months"),
        F.array(*[(30.0 - F.abs("lat") / 2 + 8.0 * (m % 6) / 5.0).alias("t") for m in months]).alias("tavg"),
        F.array(*[(9000.0 + 700.0 * ((k + m * 5) % 12)).alias("s") for m in months]).alias("srad"),
        F.lit(None).cast("double").alias("res_area_km2"), F.lit(None).cast("double").alias("res_vol_km3"),
        F.lit(None).cast("double").alias("res_avg_depth_m"), F.lit(None).cast("double").alias("max_head_m"),
        F.lit(None).cast("double").alias("dam_height_m"))


FLUX = """
tp AS (SELECT station_idx, CASE WHEN total_p IS NULL THEN 20.0 ELSE 5 + 55 * (
         (SELECT count(*) FROM res r2 WHERE r2.total_p < r.total_p) + ((SELECT count(*) FROM res r2 WHERE r2.total_p = r.total_p) + 1) / 2.0)
         / (SELECT count(total_p) FROM res) END AS tp FROM res r),
clim AS (SELECT station_idx, log10(avg(pow(10, greatest(t, 4) * 0.05))) / 0.05 AS et2, log10(avg(pow(10, greatest(t, 4) * 0.052))) / 0.052 AS et4
         FROM (SELECT station_idx, 30.0 - abs(lat) / 2 + 8.0 * (m % 6) / 5.0 AS t FROM res, range(0, 12) x(m)) GROUP BY ALL),
rad AS (SELECT station_idx, n, avg(s) * n AS ghr FROM (
          SELECT station_idx, (9000.0 + 700.0 * ((station_idx + m * 5) % 12)) / 3600 AS s, CASE WHEN ice_free_months > 0 THEN least(greatest(ice_free_months, 1), 12) ELSE 12 END AS n,
            row_number() OVER (PARTITION BY station_idx ORDER BY (station_idx + m * 5) % 12 DESC, m) AS i FROM res, range(0, 12) x(m))
        WHERE i <= greatest(1, round_even(n, 0)) GROUP BY station_idx, n),
geo AS (SELECT *, coalesce(area_km2, max_area_km2) AS area, coalesce(vol_km3, max_vol_km3) AS vol,
          coalesce(depth_m, coalesce(vol_km3, max_vol_km3) / nullif(coalesce(area_km2, max_area_km2), 0) * 1000) AS md FROM res),
geo2 AS (SELECT *, CASE WHEN head_m > md THEN head_m ELSE md / 0.46 END AS xd, vol * 1e9 / (discharge_cms * 31536000.0) AS wrt FROM geo),
lit AS (SELECT *, CASE WHEN md IS NULL OR xd IS NULL THEN NULL WHEN xd <= 3 THEN 100.0 WHEN md <= 0 THEN NULL WHEN xd / md - 1 <= 0 THEN 100.0
          ELSE least(greatest((1 - pow(1 - 3 / xd, xd / md - 1)) * 100, 0), 100) END AS pl FROM geo2),
fl AS (SELECT l.*, tp, et2, et4, ghr,
         greatest(pow(10, i0) * (pow(100, 0.6636) - pow(0.5, 0.6636)) / (0.6636 * 99.5) * 44 / 12 * 365 / 1000 - pow(10, i0 - 0.6728) * 44 / 12 * 365 / 1000, 0) AS co2,
         CASE WHEN pl > 0 THEN pow(10, 0.8804 + 0.6068 * log10(pl / 100) + 0.04828 * et4) * (1 - pow(10, -1.16)) / (1.16 * ln(10)) * 365 / 1000 * 16 / 12 * 34 END AS d4,
         CASE WHEN pl > 0 AND ghr > 0 THEN pow(10, -0.98574 + 1.0075 * log10(pl / 100) + 0.04928 * ghr) * 16 / 12 * 34 * 365 / 1000 END AS e4
       FROM (SELECT lit.*, tp, et2, et4, ghr, 1.7892 + 0.04 * et2 + 0.06918 * log10(area) + 0.0216 * coalesce(ocs_tha * 0.1, 0) + 0.1472 * log10(tp) AS i0
             FROM lit JOIN tp USING (station_idx) JOIN clim USING (station_idx) JOIN rad USING (station_idx)) l),
gas AS (SELECT *, CASE WHEN md IS NOT NULL AND wrt IS NOT NULL AND (md < 5 OR wrt < 0.1) THEN 0.0 WHEN d4 > 0 AND wrt > 0 THEN
          least(pow(10, -5.5029 + 2.2857 * log10(d4) + 0.9866 * log10(wrt)) * discharge_cms * 31536000.0 * 0.9 * 16 / 12 * 34 / (area * 1e6), 4000) END AS g4 FROM fl),
ef AS (SELECT *, co2 + d4 + coalesce(e4, 0) + coalesce(g4, 0) AS tot, coalesce(md < 1.5, false) AS bad FROM gas),
efx AS (SELECT *, CASE WHEN NOT bad THEN tot * area * 1e6 / nullif(gen_gwh * 1e6, 0) END AS efk FROM ef)
"""


def _factors(spark, d):
    return C.reservoir_emission_factor(C.phosphorus_transfer(_reservoirs(spark, d)))


@query("reservoir_emission_factor", rounded_sql(X.with_sql(X.STATIONS, RES, FLUX) + """
  SELECT station_idx, md AS mean_depth_m, xd AS max_depth_m, pl AS pct_littoral, et2 AS eff_temp_co2, et4 AS eff_temp_ch4, ghr AS cum_ghr, wrt AS wrt_yr,
         tp AS tp_ugl, co2 AS co2_diff, d4 AS ch4_diff, e4 AS ch4_ebull, g4 AS ch4_degas, co2 IS NOT NULL AND d4 IS NOT NULL AND e4 IS NOT NULL AND g4 IS NOT NULL AS pathways_complete,
         bad AS geom_implausible, CASE WHEN NOT bad THEN tot END AS areal_total, efk AS ef_gco2kwh,
         CASE WHEN NOT bad THEN (co2 + d4 + coalesce(e4, 0)) * area * 1e6 / nullif(gen_gwh * 1e6, 0) END AS ef_no_degas_gco2kwh FROM efx""",
    mean_depth_m=5, max_depth_m=5, pct_littoral=6, eff_temp_co2=6, eff_temp_ch4=6, cum_ghr=6, wrt_yr=6, tp_ugl=6, co2_diff=5, ch4_diff=5,
    ch4_ebull=5, ch4_degas=4, areal_total=4, ef_gco2kwh=3, ef_no_degas_gco2kwh=3))
def reservoir_emission_factor(spark, d):
    names = ("station_idx mean_depth_m max_depth_m pct_littoral eff_temp_co2 eff_temp_ch4 cum_ghr wrt_yr tp_ugl co2_diff ch4_diff ch4_ebull ch4_degas "
             "pathways_complete geom_implausible areal_total ef_gco2kwh ef_no_degas_gco2kwh").split()
    return rounded(_factors(spark, d).select(*names), mean_depth_m=5, max_depth_m=5, pct_littoral=6, eff_temp_co2=6, eff_temp_ch4=6, cum_ghr=6,
                   wrt_yr=6, tp_ugl=6, co2_diff=5, ch4_diff=5, ch4_ebull=5, ch4_degas=4, areal_total=4, ef_gco2kwh=3, ef_no_degas_gco2kwh=3)


STEF = """
alloc AS (SELECT l_suppkey AS station_idx, sum(l_quantity) AS allocated_mw FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09 GROUP BY ALL),
sef AS (SELECT station_idx, region, gen_gwh, allocated_mw, CASE WHEN bad THEN 'geom_implausible' WHEN mapped IS NOT NULL THEN 'reservoir' WHEN zoned IS NOT NULL THEN 'zone-flux' ELSE '' END AS ef_source,
    CASE WHEN bad THEN NULL WHEN mapped IS NOT NULL THEN least(12000, mapped) ELSE zoned END AS hydro_ef
  FROM (SELECT station_idx, region, gen_gwh, bad, CASE WHEN station_idx % 7 <> 0 THEN efk END AS mapped, allocated_mw,
          CASE WHEN gen_gwh > 0 THEN least(3000, CASE WHEN abs(lat) < 23.5 THEN 1500.0 WHEN abs(lat) < 35 THEN 800 WHEN abs(lat) < 55 THEN 400 ELSE 200 END * area / gen_gwh) END AS zoned
        FROM efx LEFT JOIN alloc USING (station_idx)))
"""


def _station_factors(spark, d):
    used = X.table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49 and l_discount > 0.09").groupBy(F.col("l_suppkey").alias("station_idx")).agg(
        F.sum("l_quantity").alias("allocated_mw"))
    at = _factors(spark, d).select("station_idx", "region", "lat", F.col("area_use").alias("area_km2"), "gen_gwh", "geom_implausible",
                                   F.when(F.col("station_idx") % 7 != 0, F.col("ef_gco2kwh")).alias("ef_gco2kwh")).join(used, "station_idx", "left")
    return C.station_emission_factor(at)


@query("station_emission_factor", rounded_sql(X.with_sql(X.STATIONS, RES, FLUX, STEF) + "SELECT station_idx, ef_source, hydro_ef FROM sef", hydro_ef=4))
def station_emission_factor(spark, d):
    return rounded(_station_factors(spark, d).select("station_idx", "ef_source", "hydro_ef"), hydro_ef=4)


REGEF = """
reg AS (SELECT region, CASE WHEN hs > 0 THEN CASE WHEN aa > 0 THEN ea / aa ELSE es / nullif(gs, 0) END ELSE eg / nullif(gg, 0) END AS c,
          CASE WHEN hs > 0 THEN 'allocated' ELSE 'generation' END AS weighting, nm AS n_matched FROM (
    SELECT region, count(CASE WHEN hydro_ef IS NOT NULL AND allocated_mw IS NOT NULL THEN 1 END) AS hs, count(allocated_mw) AS nm,
      sum(CASE WHEN hydro_ef IS NOT NULL THEN allocated_mw END) AS aa, sum(hydro_ef * allocated_mw) AS ea,
      sum(CASE WHEN allocated_mw IS NOT NULL AND hydro_ef IS NOT NULL AND gen_gwh > 0 THEN gen_gwh END) AS gs, sum(CASE WHEN allocated_mw IS NOT NULL AND gen_gwh > 0 THEN hydro_ef * gen_gwh END) AS es,
      sum(CASE WHEN hydro_ef IS NOT NULL AND gen_gwh > 0 THEN gen_gwh END) AS gg, sum(CASE WHEN gen_gwh > 0 THEN hydro_ef * gen_gwh END) AS eg FROM sef GROUP BY ALL))
"""


@query("region_emission_factors", rounded_sql(X.with_sql(X.STATIONS, RES, FLUX, STEF, REGEF) + """
  SELECT region, c AS ef_central, weighting, n_matched, c * 0.6 AS ef_low, c * 2.5 AS ef_high FROM reg""", ef_central=4, ef_low=4, ef_high=4))
def region_emission_factors(spark, d):
    return rounded(C.region_emission_factors(_station_factors(spark, d), ["region"]), ef_central=4, ef_low=4, ef_high=4)


GRID = """
regs AS (SELECT n_name AS region, r_name AS country, 'k' || CAST(n_nationkey % 4 AS VARCHAR) AS subkey, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
subn AS (SELECT r_name AS country, 'k' || CAST(r_regionkey % 4 AS VARCHAR) AS subkey, 400.0 + r_regionkey * 10 AS central, 450.0 + r_regionkey * 10 AS upper FROM region WHERE r_regionkey < 2),
offi AS (SELECT r_name AS country, 500.0 + r_regionkey AS central, 700.0 + r_regionkey AS upper FROM region WHERE r_regionkey IN (1, 2)),
stat AS (SELECT r_name AS country, 600.0 + r_regionkey AS central, 800.0 + r_regionkey AS upper FROM region WHERE r_regionkey <> 4),
grid AS (SELECT region, country, coalesce(s.central, o.central, t.central, 650.0) AS central,
    CASE WHEN s.central IS NOT NULL THEN s.upper WHEN o.central IS NOT NULL THEN o.upper WHEN t.central IS NOT NULL THEN t.upper ELSE 900.0 END AS upper,
    CASE WHEN s.central IS NOT NULL THEN 'official-subnational' WHEN o.central IS NOT NULL THEN 'official-country' WHEN t.central IS NOT NULL THEN 'statistical-country' ELSE 'global-default' END AS tier
  FROM regs LEFT JOIN subn s USING (country, subkey) LEFT JOIN offi o USING (country) LEFT JOIN stat t USING (country))
"""


def _grid(spark, d):
    r = X.table(spark, d, "region")
    k = F.col("r_regionkey")
    regions = X.table(spark, d, "nation").join(r, F.col("n_regionkey") == k).select(
        F.col("n_name").alias("region"), F.col("r_name").alias("country"), F.concat(F.lit("k"), (F.col("n_nationkey") % 4).cast("string")).alias("subkey"))
    name = F.col("r_name").alias("country")
    sub = r.filter(k < 2).select(name, F.concat(F.lit("k"), (k % 4).cast("string")).alias("subkey"), (400.0 + k * 10).alias("central"), (450.0 + k * 10).alias("upper"))
    official = r.filter(k.isin(1, 2)).select(name, (500.0 + k).alias("central"), (700.0 + k).alias("upper"))
    stat = r.filter(k != 4).select(name, (600.0 + k).alias("central"), (800.0 + k).alias("upper"))
    return C.grid_factor(regions, sub, official, stat)


@query("grid_factor", X.with_sql(GRID) + "SELECT * FROM grid")
def grid_factor(spark, d):
    return _grid(spark, d)


@query("centre_carbon", rounded_sql(X.with_sql(X.STATIONS, RES, FLUX, STEF, REGEF, GRID, """
  med AS (SELECT median(hydro_ef) AS m FROM sef),
  fac AS (SELECT region, coalesce(c, m) AS ec, g.central AS gc, g.upper AS gu FROM reg JOIN grid g USING (region), med),
  dem AS (SELECT n_name AS region, avg(o_totalprice) / 1000 AS dc FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
  sup AS (SELECT region, s.scenario, dc, cap * s.f AS supply FROM (SELECT region, sum(greatest(capacity_mw, 0)) / 200 AS cap FROM stations GROUP BY ALL) JOIN dem USING (region),
            (VALUES ('DC_A', 0.6), ('DC_B', 0.8), ('DC_C', 1.0)) s(scenario, f)),
  e AS (SELECT region, scenario, gc, gu, dc * 8760 AS need, least(supply, dc) * 8760 AS hyd, greatest(0, dc * 8760 - least(supply, dc) * 8760) AS short, band, ec * k AS ef
        FROM sup JOIN fac USING (region), (VALUES ('low', 0.6), ('central', 1.0), ('high', 2.5)) b(band, k))""") + """
  SELECT region, scenario, band, hyd / 1e3 AS hydro_gwh, short / 1e3 AS shortfall_gwh, short / nullif(need, 0) AS shortfall_frac, short * gc / 1000 AS grid_carbon_t,
         short * gu / 1000 AS grid_carbon_marginal_t, hyd * ef / 1000 AS hydro_carbon_t, hyd * ef / 1000 + short * gc / 1000 AS total_carbon_t,
         (hyd * ef / 1000 + short * gc / 1000) * 1000 / nullif(need, 0) AS intensity_g_kwh, need * gc / 1000 - hyd * ef / 1000 - short * gc / 1000 AS avoided_t FROM e""",
    hydro_gwh=4, shortfall_gwh=4, shortfall_frac=7, grid_carbon_t=1, grid_carbon_marginal_t=1, hydro_carbon_t=1, total_carbon_t=1, intensity_g_kwh=3, avoided_t=1))
def centre_carbon(spark, d):
    # Used three times below, so it is computed once.
    stations_ef = reliable_checkpoint(_station_factors(spark, d).select("region", "gen_gwh", "hydro_ef", "allocated_mw"))
    ef = C.region_emission_factors(stations_ef, ["region"])
    grid = _grid(spark, d).select("region", F.col("central").alias("grid_central"), F.col("upper").alias("grid_upper"))
    middle = F.broadcast(R.exact_quantiles(stations_ef, [], "hydro_ef", {"ef": 0.5}).select(F.col("ef").alias("__middle")))  # one row, none if no factor is known
    who = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("region"))
    need = X.table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("region").agg((F.avg("o_totalprice") / 1000).alias("dc_mean_mw"))
    cap = X.stations(spark, d).groupBy("region").agg((F.sum(F.greatest("capacity_mw", F.lit(0.0))) / 200).alias("cap"))
    shares = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(f).alias("f")) for s, f in (("DC_A", 0.6), ("DC_B", 0.8), ("DC_C", 1.0))])
    summary = cap.join(need, "region").select("region", "dc_mean_mw", "cap", F.explode(shares).alias("s")).select(
        "region", F.col("s.scenario").alias("scenario"), "dc_mean_mw", (F.col("cap") * F.col("s.f")).alias("supply_mw"))
    out = C.centre_carbon(summary, ef.join(grid, "region").join(middle, F.lit(True), "left"), ["region"], F.col("__middle"))
    return rounded(out, hydro_gwh=4, shortfall_gwh=4, shortfall_frac=7, grid_carbon_t=1, grid_carbon_marginal_t=1, hydro_carbon_t=1, total_carbon_t=1,
                   intensity_g_kwh=3, avoided_t=1)


@query("cross_region_carbon", rounded_sql(X.with_sql(X.STATIONS, RES, FLUX, X.FLOWS, GRID, """
  al AS (SELECT region AS src_region, l_suppkey AS station, sum(l_quantity) AS w FROM lineitem JOIN stations ON station_idx = l_suppkey GROUP BY ALL),
  m AS (SELECT src_region, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN b ELSE c END AS ef,
          CASE WHEN a IS NOT NULL THEN 'reservoir' WHEN b IS NOT NULL THEN 'generation' ELSE 'capacity-estimate' END AS method, w
        FROM (SELECT src_region, w, CASE WHEN station_idx % 2 = 0 THEN efk END AS a, CASE WHEN NOT bad THEN tot END * area / CASE WHEN station_idx % 3 > 0 AND gen_gwh > 0 THEN gen_gwh END AS b,
                CASE WHEN NOT bad THEN tot END * area * 1e6 / (CASE WHEN capacity_mw > 0 THEN capacity_mw END * 0.5 * 8760 * 1000) AS c FROM al JOIN efx ON station_idx = station)),
  pt AS (SELECT src_region, method, sum(w) AS w, sum(least(12000, ef) * w) AS ew FROM m WHERE ef IS NOT NULL GROUP BY ALL),
  se AS (SELECT src_region, sum(ew) / sum(w) AS src_ef, arg_min(method, (-w, method)) AS st FROM pt GROUP BY ALL)""") + """
  SELECT scenario, f.src_region, dc_region, sent_mw, delivered_mw, loss_mw, loss_mw / sent_mw AS loss_frac, src_ef, coalesce(st, 'missing') AS src_ef_status, g.central AS grid_ef,
         sent_mw * 8760 * src_ef / 1000 AS hydro_carbon_t, sent_mw * src_ef / delivered_mw AS intensity_g_kwh, delivered_mw * 8760 * g.central / 1000 - sent_mw * 8760 * src_ef / 1000 AS avoided_t
  FROM flows f LEFT JOIN se USING (src_region) LEFT JOIN grid g ON g.region = dc_region WHERE f.src_region <> dc_region AND sent_mw > 0 AND delivered_mw > 0""",
    sent_mw=5, delivered_mw=7, loss_mw=7, loss_frac=9, src_ef=4, hydro_carbon_t=0, intensity_g_kwh=3, avoided_t=0))
def cross_region_carbon(spark, d):
    k = F.col("station_idx")
    # Joined twice below, so it is computed once.
    ef = _factors(spark, d).select(k.alias("station"), F.when(k % 2 == 0, F.col("ef_gco2kwh")).alias("ef_gco2kwh"), "areal_total", F.col("area_use").alias("area_km2"),
                                   F.when(k % 3 > 0, F.col("gen_gwh")).alias("gen_gwh"), "capacity_mw", F.col("region").alias("src_region"))
    ef = reliable_checkpoint(ef)
    used = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station")).agg(F.sum("l_quantity").alias("allocated_mw"))
    allocation = used.join(ef.select("station", "src_region"), "station")
    source = C.exporting_station_factor(allocation, ef.drop("src_region"), ["src_region"])
    out = C.cross_region_carbon(X.flows(spark, d), source, _grid(spark, d))
    return rounded(out, sent_mw=5, delivered_mw=7, loss_mw=7, loss_frac=9, src_ef=4, hydro_carbon_t=0, intensity_g_kwh=3, avoided_t=0)


@query("percent_rank_ties", rounded_sql("""
  SELECT p_partkey, p_size, p_type, (rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0)
         / count(*) OVER (PARTITION BY p_type) AS pct_rank FROM part""", pct_rank=8))
def percent_rank_ties(spark, d):
    at = X.table(spark, d, "part").select("p_partkey", "p_size", "p_type")
    return rounded(R.percent_rank_average(at, ["p_type"], "p_size").select("p_partkey", "p_size", "p_type", "pct_rank"), pct_rank=8)


@query("percent_rank_sliced", rounded_sql("""
  SELECT l_orderkey, l_linenumber, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0)
         / count(*) OVER (PARTITION BY l_returnflag) AS pct_rank FROM lineitem""", pct_rank=8))
def percent_rank_sliced(spark, d):
    """The path for groups above ``hot_rows``: range slices and offsets."""
    at = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    out = R.percent_rank_average(at, ["l_returnflag"], "l_extendedprice", hot_rows=500)
    return rounded(out.select("l_orderkey", "l_linenumber", "pct_rank"), pct_rank=8)


@query("layer_join", """
  WITH c AS (SELECT s_suppkey, 'N' || (s_suppkey % 9) AS name, round_even(s_acctbal / 100, 4) AS lat FROM supplier),
  l AS (SELECT 'N' || (c_custkey % 9) AS name, round_even(c_acctbal / 100, 4) AS lat, c_custkey AS row_ord, c_nationkey AS soil FROM customer
        UNION ALL SELECT 'N' || (s_suppkey % 9), round_even(s_acctbal / 100, 4) + 0.0001, 1000000 + s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0),
  k AS (SELECT name, round_even(lat, 3) AS latkey, arg_min(soil, row_ord) AS soil FROM l GROUP BY ALL)
  SELECT s_suppkey, soil FROM c LEFT JOIN k ON k.name = c.name AND k.latkey = round_even(lat, 3)""")
def layer_join(spark, d):
    """J-3: a layer joined on name and latitude to 3 digits."""
    s, c = X.table(spark, d, "supplier"), X.table(spark, d, "customer")
    name = lambda k: F.concat(F.lit("N"), (F.col(k) % 9).cast("string")).alias("name")
    coords = s.select("s_suppkey", name("s_suppkey"), round_even(F.col("s_acctbal") / 100, 4).alias("lat"))
    layer = c.select(name("c_custkey"), round_even(F.col("c_acctbal") / 100, 4).alias("lat"), F.col("c_custkey").alias("row_ord"), F.col("c_nationkey").alias("soil")).unionByName(
        s.filter("s_suppkey % 2 = 0").select(name("s_suppkey"), (round_even(F.col("s_acctbal") / 100, 4) + 0.0001).alias("lat"), (F.col("s_suppkey") + 1000000).alias("row_ord"), F.col("s_nationkey").alias("soil")))
    return C.reservoir_layers(coords, layer).select("s_suppkey", "soil")


@query("latitude_bands", X.with_sql(X.STATIONS) + """
  SELECT station_idx, CASE WHEN abs(lat) <= 15 THEN 1200.0 WHEN abs(lat) <= 30 THEN 1500 WHEN abs(lat) <= 45 THEN 600 WHEN abs(lat) <= 55 THEN 300 ELSE 150 END::DOUBLE AS evaporation_mm,
         CASE WHEN abs(lat) < 23.5 THEN 'tropical' WHEN abs(lat) < 35 THEN 'subtropical' WHEN abs(lat) < 55 THEN 'temperate' ELSE 'boreal' END AS zone,
         CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INT) + 1 AS epsg FROM stations""")
def latitude_bands(spark, d):
    return X.stations(spark, d).select("station_idx", geo.net_evaporation_mm("lat").alias("evaporation_mm"), geo.climate_zone("lat").alias("zone"),
                                       geo.utm_epsg("lat", "lon").alias("epsg"))


@query("composite_key_join", """
  WITH p AS (SELECT p_name AS name, CAST(p_size AS DOUBLE) / 4 AS lat, p_retailprice AS v, p_partkey AS row_ord FROM part),
  strict AS (SELECT name, round_even(lat, 0) AS k, arg_min(v, row_ord) AS v FROM p GROUP BY ALL), loose AS (SELECT name, arg_min(v, row_ord) AS v FROM p GROUP BY ALL),
  w AS (SELECT l_orderkey, l_linenumber, p_name AS name, round_even(l_quantity / 4, 0) AS k FROM lineitem JOIN part ON p_partkey = l_partkey)
  SELECT l_orderkey, l_linenumber, coalesce(s.v, l.v) AS v FROM w LEFT JOIN strict s ON s.name = w.name AND s.k = w.k LEFT JOIN loose l ON l.name = w.name""")
def composite_key_join(spark, d):
    part = X.table(spark, d, "part")
    right = part.select(F.col("p_name").alias("name"), F.bround(F.col("p_size").cast("double") / 4, 0).alias("k"), F.col("p_retailprice").alias("v"), F.col("p_partkey").alias("row_ord"))
    lines = X.table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    left = lines.select("l_orderkey", "l_linenumber", F.col("p_name").alias("name"), F.bround(F.col("l_quantity") / 4, 0).alias("k"))
    return fallback_join(left, right, ["name", "k"], ["name"], ["v"]).select("l_orderkey", "l_linenumber", "v")
