"""Sediment, ecology and water-supply queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headrace.functions.core import finite, ratio
from headrace.operators import ecology as E
from headrace.operators import graph as G
from headrace.operators import sediment as D
from headrace.operators import series as S
from headrace.operators import supply as W
from headrace.plans import standins as X
from headrace.plans.registry import query, rounded, rounded_sql
from headrace.sources.sinks import metric_rows

PAIRS = """
pairs AS (
  SELECT s.station_idx, s.scenario, s.year, s.hoy, n.q AS q_nat, s.q AS q_reg
  FROM dflow s JOIN dflow n ON n.station_idx = s.station_idx AND n.year = s.year AND n.hoy = s.hoy
  WHERE n.scenario = 'nat' AND s.scenario <> 'nat' AND n.q >= 0 AND s.q >= 0)
"""
EXPONENTS = """
b AS (SELECT station_idx, 1.3 + 0.2 * (station_idx % 3) AS b_low, 1.8 + 0.2 * (station_idx % 3) AS b_central,
             2.3 + 0.2 * (station_idx % 3) AS b_high FROM stations)
"""
RATIO = """
yearly AS (
  SELECT p.station_idx, scenario, year, param,
         sum(pow(q_reg, e)) / nullif(sum(pow(q_nat, e)), 0) AS r
  FROM pairs p JOIN (SELECT station_idx, 'b_low' AS param, b_low AS e FROM b UNION ALL
                     SELECT station_idx, 'b_central', b_central FROM b UNION ALL
                     SELECT station_idx, 'b_high', b_high FROM b) x ON x.station_idx = p.station_idx
  GROUP BY ALL),
stci AS (SELECT station_idx, scenario, param, avg(r) AS stci FROM yearly GROUP BY ALL)
"""


def _pairs(spark, d):
    return S.finite_pairs(X.daily_flow(spark, d), ["station_idx"])


def _exponents(spark, d):
    shift = 0.2 * (F.col("station_idx") % 3)
    return X.stations(spark, d).select("station_idx", (1.3 + shift).alias("b_low"), (1.8 + shift).alias("b_central"),
                                       (2.3 + shift).alias("b_high"))


def _stci(spark, d):
    at = _pairs(spark, d).join(_exponents(spark, d), "station_idx")
    return D.transport_ratio(at, ["station_idx", "scenario"])


@query("sediment_transport_ratio", rounded_sql(
    X.with_sql(X.DAILY, X.STATIONS, EXPONENTS, PAIRS, RATIO) + "SELECT * FROM stci", stci=8))
def sediment_transport_ratio(spark, d):
    return rounded(_stci(spark, d), stci=8)


@query("sediment_ratio_by_region", rounded_sql(
    X.with_sql(X.DAILY, X.STATIONS, EXPONENTS, PAIRS, RATIO)
    + "SELECT bloc, scenario, param, avg(stci) AS mean_ratio, count(*) AS n_stations FROM stci JOIN stations USING (station_idx) "
      "GROUP BY ALL", mean_ratio=8))
def sediment_ratio_by_region(spark, d):
    at = _stci(spark, d).join(X.stations(spark, d).select("station_idx", "bloc"), "station_idx")
    out = at.groupBy("bloc", "scenario", "param").agg(F.avg("stci").alias("mean_ratio"), F.count(F.lit(1)).alias("n_stations"))
    return rounded(out, mean_ratio=8)


@query("sediment_metric_table", rounded_sql(
    X.with_sql(X.DAILY, X.STATIONS, EXPONENTS, PAIRS, RATIO) + """
    SELECT region, NULL::VARCHAR AS gcm, NULL::VARCHAR AS ssp, NULL::VARCHAR AS scenario_tag, name AS station,
           CAST(station_idx AS INT) AS station_idx, NULL::VARCHAR AS river, lat, lon, 'sediment' AS topic, scenario, 'STCI' AS metric,
           param, 1.0::DOUBLE AS value_nat, stci AS value_reg, stci - 1.0 AS delta, stci AS ratio, 'mean' AS year_agg, '' AS notes
    FROM stci JOIN stations USING (station_idx)""", value_reg=8, delta=8, ratio=8))
def sediment_metric_table(spark, d):
    st = X.stations(spark, d).select("station_idx", "region", F.col("name").alias("station"), "lat", "lon")
    rows = metric_rows(_stci(spark, d).join(st, "station_idx"), "sediment", "STCI", F.lit(1.0), "stci", param=F.col("param"))
    return rounded(rows, value_reg=8, delta=8, ratio=8)


EFFECTIVE = """
pos AS (SELECT station_idx, scenario, q FROM dflow WHERE q > 0),
span AS (SELECT station_idx, scenario, min(q) lo, max(q) hi FROM pos GROUP BY ALL HAVING count(*) >= 25),
bins AS (SELECT p.station_idx, p.scenario, lo, hi,
           CASE WHEN hi = lo THEN 1 ELSE least(floor((log10(q) - log10(lo)) / (log10(hi) - log10(lo)) * 25) + 1, 25) END AS bin
         FROM pos p JOIN span USING (station_idx, scenario)),
cnt AS (SELECT station_idx, scenario, lo, hi, bin, count(*) c FROM bins GROUP BY ALL),
loads AS (SELECT cnt.station_idx, scenario, bin, pow(10, log10(lo) + (bin - 0.5) * (log10(hi) - log10(lo)) / 25) AS centre, c, b_central
          FROM cnt JOIN b USING (station_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY station_idx, scenario ORDER BY round(c * pow(centre, b_central), 9) DESC, bin) AS i
           FROM loads)
"""


@query("sediment_effective_discharge", rounded_sql(
    X.with_sql(X.DAILY, X.STATIONS, EXPONENTS, EFFECTIVE) + "SELECT station_idx, scenario, centre AS q_eff FROM ranked WHERE i = 1", q_eff=7))
def sediment_effective_discharge(spark, d):
    pool = X.daily_flow(spark, d).join(_exponents(spark, d).select("station_idx", "b_central"), "station_idx")
    return rounded(D.effective_discharge(pool, ["station_idx", "scenario"], "q", "b_central"), q_eff=7)


@query("sediment_peak_ratios", rounded_sql(X.with_sql(X.DAILY, PAIRS) + """
  SELECT * FROM (SELECT station_idx, scenario, avg(pn) AS annualmax_nat, avg(pr) AS annualmax_reg FROM
     (SELECT station_idx, scenario, year, max(q_nat) pn, max(q_reg) pr FROM pairs GROUP BY ALL) GROUP BY ALL)
  JOIN (SELECT station_idx, scenario, quantile_cont(q_nat, 0.95) AS q5pct_nat, quantile_cont(q_reg, 0.95) AS q5pct_reg
        FROM pairs GROUP BY ALL) USING (station_idx, scenario)""",
    annualmax_nat=8, annualmax_reg=8, q5pct_nat=8, q5pct_reg=8))
def sediment_peak_ratios(spark, d):
    out = D.peak_ratios(_pairs(spark, d), ["station_idx", "scenario"])
    return rounded(out, annualmax_nat=8, annualmax_reg=8, q5pct_nat=8, q5pct_reg=8)


@query("sediment_residence_time", rounded_sql(X.with_sql(X.DAILY, X.STATIONS) + """
  SELECT station_idx, q_mean, max_vol_km3, tau AS residence_time_yr, sqrt(tau) / (1 + sqrt(tau)) AS p_retention_frac FROM (
    SELECT station_idx, avg(q) AS q_mean, any_value(max_vol_km3) AS max_vol_km3,
           any_value(max_vol_km3) / nullif(avg(q) * 365.25 * 86400 / 1e9, 0) AS tau
    FROM dflow JOIN stations USING (station_idx) WHERE scenario = 'nat' GROUP BY station_idx)""",
    q_mean=8, residence_time_yr=8, p_retention_frac=8))
def sediment_residence_time(spark, d):
    nat = X.daily_flow(spark, d).filter("scenario = 'nat'")
    out = D.residence_and_retention(nat, X.stations(spark, d), ["station_idx"])
    return rounded(out, q_mean=8, residence_time_yr=8, p_retention_frac=8)


def _class_case(text: str) -> str:
    from headrace.functions.text import LITHOLOGY_RULES
    parts = []
    for label, words in LITHOLOGY_RULES.items():
        hit = " OR ".join(f"contains({text}, '{w}')" for w in words)
        parts.append(f"WHEN {hit} THEN '{label}'")
    return "CASE " + " ".join(parts) + " ELSE 'default' END"


@query("rating_exponent_classes", f"""
  SELECT litho_class, lang,
         CASE litho_class WHEN 'clastic_sed' THEN 1.7 WHEN 'crystalline' THEN 1.3 ELSE 1.5 END::DOUBLE AS b_low,
         CASE litho_class WHEN 'clastic_sed' THEN 2.2 WHEN 'crystalline' THEN 1.8 ELSE 2.0 END::DOUBLE AS b_central,
         CASE litho_class WHEN 'clastic_sed' THEN 2.7 WHEN 'crystalline' THEN 2.3 ELSE 2.5 END::DOUBLE AS b_high, count(*) AS n
  FROM (SELECT lang, {_class_case("lower(coalesce(text, ''))")} AS litho_class FROM documents) GROUP BY ALL""")
def rating_exponent_classes(spark, d):
    docs = X.table(spark, d, "documents").select("lang", "text")
    classed = D.rating_exponents(docs, "text")
    return classed.groupBy("litho_class", "lang", "b_low", "b_central", "b_high").agg(F.count(F.lit(1)).alias("n"))


# ---- ecology ----

FDC = """
fdc AS (
  SELECT station, scenario, season, g.k,
         CASE WHEN x <= 1 THEN v[1] WHEN x >= n THEN v[n] ELSE v[i] + (x - i) * (v[i + 1] - v[i]) END AS f
  FROM (SELECT p.*, g.k, (g.k - 0.5) / 500 * n + 0.5 AS x, CAST(floor((g.k - 0.5) / 500 * n + 0.5) AS INT) AS i
        FROM (SELECT station, scenario, season, count(*) AS n, list(q ORDER BY q DESC) AS v FROM pools GROUP BY ALL) p,
             range(1, 501) AS g(k) WHERE n >= 10) g)
"""
SEASONS = """
seasoned AS (
  SELECT station, scenario, q, CASE month(make_date(year, 1, 1) + CAST(hoy // 24 AS INT))
     WHEN 12 THEN 'winter' WHEN 1 THEN 'winter' WHEN 2 THEN 'winter' WHEN 3 THEN 'spring' WHEN 4 THEN 'spring'
     WHEN 5 THEN 'spring' WHEN 6 THEN 'summer' WHEN 7 THEN 'summer' WHEN 8 THEN 'summer' ELSE 'autumn' END AS nseason, lat
  FROM located),
pools AS (
  SELECT station, scenario, 'total' AS season, q FROM seasoned UNION ALL
  SELECT station, scenario, CASE WHEN lat >= 0 THEN nseason ELSE CASE nseason WHEN 'winter' THEN 'summer'
     WHEN 'summer' THEN 'winter' WHEN 'spring' THEN 'autumn' ELSE 'spring' END END, q FROM seasoned)
"""


@query("ecodeficit", rounded_sql(X.with_sql(X.DENSE, """
  located AS (SELECT station_idx AS station, scenario, year, hoy, q, CASE WHEN station_idx % 2 = 0 THEN -10.0 ELSE 20.0 END AS lat
              FROM dense_flow)""", SEASONS, FDC, """
  nat AS (SELECT station, season, count(*) AS n, avg(q) AS m FROM pools WHERE scenario = 'nat' GROUP BY ALL),
  areas AS (
    SELECT r.station, r.scenario, r.season,
           sum(CASE WHEN r.k IN (1, 500) THEN 0.5 ELSE 1 END * greatest(n.f - r.f, 0)) / 500 AS deficit,
           sum(CASE WHEN r.k IN (1, 500) THEN 0.5 ELSE 1 END * greatest(r.f - n.f, 0)) / 500 AS surplus
    FROM fdc r JOIN fdc n ON n.station = r.station AND n.season = r.season AND n.k = r.k AND n.scenario = 'nat'
    WHERE r.scenario <> 'nat' GROUP BY ALL)""") + """
  SELECT a.station AS station_idx, a.scenario, a.season, deficit * s.n / t.n / t.m AS ecodeficit,
         CASE WHEN a.season = 'total' THEN surplus * s.n / t.n / t.m END AS ecosurplus
  FROM areas a JOIN nat s ON s.station = a.station AND s.season = a.season
  JOIN nat t ON t.station = a.station AND t.season = 'total'""", ecodeficit=8, ecosurplus=8))
def ecodeficit(spark, d):
    lat = F.when(F.col("station_idx") % 2 == 0, -10.0).otherwise(20.0)
    out = E.ecodeficit(X.dense_flow(spark, d).withColumn("lat", lat), ["station_idx"])
    return rounded(out, ecodeficit=8, ecosurplus=8)


@query("flow_duration_curve", rounded_sql(X.with_sql(X.HOURLY, """
  pools AS (SELECT station, scenario, 'all' AS season, q FROM hflow)""", FDC) + """
  SELECT station, scenario, k, f AS fdc FROM fdc""", fdc=7))
def flow_duration_curve(spark, d):
    return rounded(S.flow_duration_curve(X.hourly_flow(spark, d), ["station", "scenario"]), fdc=7)


STEPS = """
steps AS (
  SELECT station, scenario, year, hoy, q, avg(q) OVER (PARTITION BY station, scenario) AS mean,
         count(q) OVER (PARTITION BY station, scenario, year) AS n,
         CASE WHEN lag(hoy) OVER w = hoy - 1 THEN q - lag(q) OVER w END AS dq,
         row_number() OVER w AS i
  FROM hflow WINDOW w AS (PARTITION BY station, scenario, year ORDER BY hoy)),
signs AS (SELECT *, CASE WHEN abs(dq) > 0.05 * mean THEN sign(dq) END AS sg FROM steps),
turns AS (
  SELECT *, sg <> lag(sg) OVER (PARTITION BY station, scenario, year ORDER BY hoy) AS turn FROM signs WHERE sg IS NOT NULL)
"""


@query("hourly_ramping", rounded_sql(X.with_sql(X.HOURLY, STEPS) + """
  SELECT station, scenario, rr_down_mean, rr_down_p95, rr_up_p95, rr_down_p95 / mean * 100 AS rr_down_p95_pctmean,
         hp1, n_turn / n_years AS reversals_per_year
  FROM (SELECT station, scenario, avg(CASE WHEN n >= 48 AND dq < 0 THEN -dq END) AS rr_down_mean,
          quantile_cont(CASE WHEN n >= 48 AND dq < 0 THEN -dq END, 0.95) AS rr_down_p95,
          quantile_cont(CASE WHEN n >= 48 AND dq > 0 THEN dq END, 0.95) AS rr_up_p95, avg(q) AS mean,
          count(CASE WHEN n >= 48 AND i = 1 THEN 1 END) AS n_years FROM steps GROUP BY ALL)
  JOIN (SELECT station, scenario, count(CASE WHEN turn AND n >= 48 THEN 1 END) AS n_turn FROM turns GROUP BY ALL)
    USING (station, scenario)
  JOIN (SELECT station, scenario, median(r / m) AS hp1 FROM (
          SELECT station, scenario, year, hoy // 24 AS day, max(q) - min(q) AS r, avg(q) AS m FROM steps WHERE n >= 48 GROUP BY ALL)
        WHERE m > 0 GROUP BY ALL) USING (station, scenario)""",
    rr_down_mean=7, rr_down_p95=7, rr_up_p95=7, rr_down_p95_pctmean=7, hp1=7, reversals_per_year=7))
def hourly_ramping(spark, d):
    out = E.ramping(X.hourly_flow(spark, d), ["station", "scenario"])
    return rounded(out, **{m: 7 for m in E.RAMP_METRICS})


@query("drawdown_rates", rounded_sql(X.with_sql(X.HOURLY, """
  depth AS (SELECT station, scenario, year, hoy, count(q) OVER (PARTITION BY station, scenario, year) AS n,
      CASE WHEN length(station) % 2 = 0 THEN pow(0.035 / (7.2 * sqrt(length(station) / 10000.0)), 0.6) ELSE 0.27 END
        * pow(greatest(q, 0), 0.3) AS dd FROM hflow),
  drops AS (SELECT *, CASE WHEN lag(hoy) OVER w = hoy - 1 THEN (lag(dd) OVER w - dd) * 100 END AS drop_cm FROM depth
            WINDOW w AS (PARTITION BY station, scenario, year ORDER BY hoy)),
  yearly AS (SELECT station, scenario, year, quantile_cont(drop_cm, 0.95) AS p95, count(CASE WHEN drop_cm > 10 THEN 1 END) AS h10,
             count(CASE WHEN drop_cm > 13 THEN 1 END) AS h13 FROM drops WHERE n >= 48 AND drop_cm > 0 GROUP BY ALL)""") + """
  SELECT station, scenario, avg(p95) AS vrr_p95_cmh, avg(h10) AS vrr_exceed_h_10cmh, avg(h13) AS vrr_exceed_h_13cmh
  FROM yearly GROUP BY ALL""", vrr_p95_cmh=7, vrr_exceed_h_10cmh=7, vrr_exceed_h_13cmh=7))
def drawdown_rates(spark, d):
    slope = F.when(F.length("station") % 2 == 0, F.length("station") / 10000.0)
    out = E.drawdown(X.hourly_flow(spark, d).withColumn("slope", slope), ["station", "scenario"])
    return rounded(out, vrr_p95_cmh=7, vrr_exceed_h_10cmh=7, vrr_exceed_h_13cmh=7)


@query("varial_zone", rounded_sql(X.with_sql(X.HOURLY, """
  placed AS (SELECT station, scenario, year, q, row_number() OVER (PARTITION BY station, scenario, year ORDER BY hoy) - 1 AS i,
         count(*) OVER (PARTITION BY station, scenario, year) AS n FROM hflow WHERE q >= 0),
  days AS (SELECT station, scenario, year, i // 24 AS b, max(q) AS hi, min(q) AS lo FROM placed WHERE i // 24 < n // 24 GROUP BY ALL)""") + """
  SELECT station, scenario, avg(7.2 * (sqrt(hi) - sqrt(lo))) AS varial_width_m,
         avg(7.2 * (sqrt(hi) - sqrt(lo))) * max(length(station)) * 1000 AS varial_area_m2 FROM days GROUP BY ALL""",
    varial_width_m=8, varial_area_m2=3))
def varial_zone(spark, d):
    flow = X.hourly_flow(spark, d).withColumn("length_km", F.length("station"))
    return rounded(E.varial_zone(flow, ["station", "scenario"]), varial_width_m=8, varial_area_m2=3)


@query("flood_recurrence", rounded_sql(X.with_sql(X.DAILY, """
  peaks AS (SELECT station_idx, scenario, year, max(q) AS p FROM dflow GROUP BY ALL),
  lists AS (SELECT station_idx, scenario, count(*) AS n, list(p ORDER BY p) AS v FROM peaks GROUP BY ALL),
  q167 AS (SELECT station_idx, scenario, CASE WHEN n < 5 THEN NULL WHEN x <= 1 THEN v[1] WHEN x >= n THEN v[n]
             ELSE v[CAST(floor(x) AS INT)] + (x - floor(x)) * (v[CAST(floor(x) AS INT) + 1] - v[CAST(floor(x) AS INT)]) END AS q
           FROM (SELECT *, (1 - 1 / 1.67) * (n + 1) AS x FROM lists))""") + """
  SELECT station_idx, scenario, q_nat, q_reg, alteration, CASE WHEN alteration IS NULL THEN 'na' WHEN abs(alteration) > 0.5 THEN 'high'
         WHEN abs(alteration) > 0.25 THEN 'moderate' ELSE 'low' END AS risk
  FROM (SELECT r.station_idx, r.scenario, n.q AS q_nat, r.q AS q_reg, (r.q - n.q) / nullif(n.q, 0) AS alteration
        FROM q167 r JOIN q167 n ON n.station_idx = r.station_idx AND n.scenario = 'nat' WHERE r.scenario <> 'nat')""",
    q_nat=8, q_reg=8, alteration=8))
def flood_recurrence(spark, d):
    out = E.flood_recurrence(X.daily_flow(spark, d), ["station_idx"])
    return rounded(out, q_nat=8, q_reg=8, alteration=8)


IHA = """
days AS (SELECT station_idx, scenario, year, hoy // 24 + 1 AS doy, avg(q) AS d FROM dense_flow GROUP BY ALL),
lim AS (SELECT station_idx, quantile_cont(d, 0.25) AS lo, quantile_cont(d, 0.75) AS hi FROM days WHERE scenario = 'nat'
        GROUP BY ALL HAVING count(*) >= 30),
num AS (SELECT station_idx, scenario, year, d, lo, hi, row_number() OVER w AS pos, count(*) OVER (PARTITION BY station_idx, scenario, year) AS n,
          avg(d) OVER (PARTITION BY station_idx, scenario, year) AS mean, d - lag(d) OVER w AS dd,
          coalesce(d < lo, false) AS low, coalesce(d > hi, false) AS high
        FROM days LEFT JOIN lim USING (station_idx) WINDOW w AS (PARTITION BY station_idx, scenario, year ORDER BY doy)),
marked AS (
  SELECT *, month(CASE WHEN n >= 366 THEN DATE '2004-01-01' ELSE DATE '2001-01-01' END + CAST(pos - 1 AS INT)) AS mon,
    low AND NOT coalesce(lag(low) OVER w, false) AS low_start, high AND NOT coalesce(lag(high) OVER w, false) AS high_start,
    CASE WHEN pos >= 3 THEN avg(d) OVER (PARTITION BY station_idx, scenario, year ORDER BY pos ROWS 2 PRECEDING) END AS r3,
    CASE WHEN pos >= 7 THEN avg(d) OVER (PARTITION BY station_idx, scenario, year ORDER BY pos ROWS 6 PRECEDING) END AS r7,
    CASE WHEN pos >= 30 THEN avg(d) OVER (PARTITION BY station_idx, scenario, year ORDER BY pos ROWS 29 PRECEDING) END AS r30,
    CASE WHEN pos >= 90 THEN avg(d) OVER (PARTITION BY station_idx, scenario, year ORDER BY pos ROWS 89 PRECEDING) END AS r90,
    CASE WHEN abs(dd) > CASE WHEN mean > 0 THEN 0.05 * mean ELSE 0 END THEN sign(dd) END AS sg
  FROM num WHERE n >= 300 WINDOW w AS (PARTITION BY station_idx, scenario, year ORDER BY pos)),
revs AS (SELECT station_idx, scenario, year, count(CASE WHEN sg <> p THEN 1 END)::DOUBLE AS reversals FROM (
           SELECT station_idx, scenario, year, sg, lag(sg) OVER (PARTITION BY station_idx, scenario, year ORDER BY pos) AS p
           FROM marked WHERE sg IS NOT NULL) GROUP BY ALL),
years AS (
  SELECT station_idx, scenario, year, """ + ", ".join(
    f"avg(CASE WHEN mon = {m} THEN d END) AS mag_month{m:02d}" for m in range(1, 13)) + """,
    min(d) AS min1day, max(d) AS max1day, min(r3) AS min3day, max(r3) AS max3day, min(r7) AS min7day, max(r7) AS max7day,
    min(r30) AS min30day, max(r30) AS max30day, min(r90) AS min90day, max(r90) AS max90day,
    count(CASE WHEN d <= 0 THEN 1 END)::DOUBLE AS zero_days, min(r7) / nullif(max(mean), 0) AS baseflow_index,
    arg_min(pos, (-d, pos))::DOUBLE AS jd_max, arg_min(pos, (d, pos))::DOUBLE AS jd_min,
    count(CASE WHEN low_start THEN 1 END)::DOUBLE AS lo_pulse_count,
    coalesce(count(CASE WHEN low THEN 1 END) / nullif(count(CASE WHEN low_start THEN 1 END), 0), 0) AS lo_pulse_dur,
    count(CASE WHEN high_start THEN 1 END)::DOUBLE AS hi_pulse_count,
    coalesce(count(CASE WHEN high THEN 1 END) / nullif(count(CASE WHEN high_start THEN 1 END), 0), 0) AS hi_pulse_dur,
    coalesce(avg(CASE WHEN dd > 0 THEN dd END), 0) AS rise_rate, coalesce(avg(CASE WHEN dd < 0 THEN dd END), 0) AS fall_rate
  FROM marked GROUP BY ALL),
params AS (
  SELECT station_idx, scenario, """ + ", ".join(
    (f"(((atan2(avg(sin(({p} - 1) / 365 * 2 * pi())), avg(cos(({p} - 1) / 365 * 2 * pi()))) / (2 * pi()) * 365) % 365 + 365) % 365) + 1 AS {p}"
     if p in E.TIMING else f"median({p}) AS {p}") for p in E.FLOW_PARAMETERS) + """
  FROM years LEFT JOIN revs USING (station_idx, scenario, year) GROUP BY ALL),
plong AS (UNPIVOT params ON """ + ", ".join(E.FLOW_PARAMETERS) + """ INTO NAME param VALUE q),
alter_ AS (
  SELECT *, CASE WHEN param IN ('jd_max', 'jd_min') THEN abs(CASE WHEN s > 182.5 THEN s - 365 ELSE s END) / 182.5
         ELSE (q_reg - q_nat) / greatest(abs(q_nat), abs(q_reg), 1e-9) END AS alteration,
    CASE WHEN param LIKE 'mag_%' THEN 1 WHEN param LIKE '%day' OR param IN ('zero_days', 'baseflow_index') THEN 2
         WHEN param LIKE 'jd_%' THEN 3 WHEN param LIKE '%pulse%' THEN 4 ELSE 5 END AS param_group
  FROM (SELECT r.station_idx, r.scenario, r.param, n.q AS q_nat, r.q AS q_reg, ((r.q - n.q) % 365 + 365) % 365 AS s
        FROM plong r JOIN plong n ON n.station_idx = r.station_idx AND n.param = r.param AND n.scenario = 'nat'
        WHERE r.scenario <> 'nat'))
"""


@query("flow_parameters", rounded_sql(X.with_sql(X.DENSE, IHA) + "SELECT * FROM params", **{p: 7 for p in E.FLOW_PARAMETERS}))
def flow_parameters(spark, d):
    return rounded(E.flow_parameters(X.dense_flow(spark, d), ["station_idx"]), **{p: 7 for p in E.FLOW_PARAMETERS})


@query("hydrologic_alteration", rounded_sql(
    X.with_sql(X.DENSE, IHA) + "SELECT station_idx, scenario, param, q_nat, q_reg, alteration, param_group FROM alter_",
    q_nat=7, q_reg=7, alteration=7))
def hydrologic_alteration(spark, d):
    out = E.alteration(E.flow_parameters(X.dense_flow(spark, d), ["station_idx"]), ["station_idx"])
    return rounded(out.select("station_idx", "scenario", "param", "q_nat", "q_reg", "alteration", "param_group"),
                   q_nat=7, q_reg=7, alteration=7)


@query("alteration_index", rounded_sql(X.with_sql(X.DENSE, IHA) + """
  SELECT station_idx, scenario, avg(abs(alteration)) AS hai, """ + ", ".join(
    f"avg(CASE WHEN param_group = {g} THEN abs(alteration) END) AS hai_group{g}" for g in range(1, 6)) + """
  FROM alter_ GROUP BY ALL""", hai=7, **{f"hai_group{g}": 7 for g in range(1, 6)}))
def alteration_index(spark, d):
    changes = E.alteration(E.flow_parameters(X.dense_flow(spark, d), ["station_idx"]), ["station_idx"])
    return rounded(E.alteration_index(changes, ["station_idx"]), hai=7, **{f"hai_group{g}": 7 for g in range(1, 6)})


@query("channel_slope", rounded_sql(X.with_sql(X.STATIONS, X.NETWORK) + """
  SELECT s.station_idx, s.station_idx * 5 + 3 AS river_id, n.slope_dm_per_km * 1e-4 AS slope
  FROM stations s LEFT JOIN network n ON n.river_id = s.station_idx * 5 + 3""", slope=8))
def channel_slope(spark, d):
    at = X.stations(spark, d).select("station_idx", (F.col("station_idx") * 5 + 3).alias("river_id"))
    return rounded(E.channel_slope(at, X.network(spark, d)).select("station_idx", "river_id", "slope"), slope=8)


# ---- supply ----

WALK = """
walk(dam, river_id, step, own) AS (
  SELECT dam, river_id, 0, upland_skm FROM dams JOIN network ON river_id = dam
  UNION ALL
  SELECT w.dam, n.river_id, step + 1, own FROM walk w JOIN network c ON c.river_id = w.river_id
  JOIN network n ON n.river_id = c.next_down
  WHERE n.river_id NOT IN (SELECT dam FROM dams) AND NOT (own > 0 AND own / n.upland_skm < 0.01))
"""
SEGMENTS = """
sets AS (SELECT river_id, list(DISTINCT dam ORDER BY dam) AS dams FROM walk GROUP BY ALL),
seg0 AS (SELECT dams, count(*) AS n_reaches, sum(length_km) AS len, sum(irrigated_pct / 100 * catch_skm) AS irr,
           max(upland_skm) AS a_outlet_skm FROM sets JOIN network USING (river_id) GROUP BY dams),
segs AS (SELECT array_to_string(dams, '|') AS dam_rivers, CAST(len(dams) AS INT) AS n_dams, n_reaches, round_even(len, 1) AS dep_length_km,
           irr AS demand_mm3_yr, a_outlet_skm,
           (SELECT sum(upland_skm) FROM network WHERE list_contains(dams, river_id)) AS a_dams_skm FROM seg0)
"""


@query("downstream_walk", X.with_sql(X.NETWORK, X.DAMS, WALK, recursive=True)
       + "SELECT dam, river_id, CAST(step AS INT) AS step FROM walk")
def downstream_walk(spark, d):
    return G.downstream_walk(X.dams(spark, d), X.network(spark, d))


@query("supply_segments", rounded_sql(X.with_sql(X.NETWORK, X.DAMS, WALK, SEGMENTS, recursive=True) + """
  SELECT dam_rivers, n_dams, n_reaches, dep_length_km, demand_mm3_yr, a_outlet_skm, a_dams_skm FROM segs""",
    dep_length_km=4, demand_mm3_yr=8, a_outlet_skm=4, a_dams_skm=4))
def supply_segments(spark, d):
    out = W.supply_segments(X.dams(spark, d), X.network(spark, d)).drop("seg")
    return rounded(out, dep_length_km=4, demand_mm3_yr=8, a_outlet_skm=4, a_dams_skm=4)


MONTHLY = """
mm AS (SELECT station_idx, scenario, year, month(make_date(year, 1, 1) + CAST(hoy // 24 AS INT)) AS month, avg(q) AS q
       FROM dflow GROUP BY ALL),
grid AS (SELECT station_idx, scenario, CAST(y AS INT) AS year, CAST(m AS INT) AS month
         FROM (SELECT station_idx, scenario, min(year) a, max(year) b FROM mm GROUP BY ALL), range(1990, 2010) ys(y), range(1, 13) ms(m)
         WHERE y BETWEEN a AND b),
monthly AS (SELECT g.*, mm.q FROM grid g LEFT JOIN mm USING (station_idx, scenario, year, month))
"""


@query("monthly_means", rounded_sql(X.with_sql(X.DAILY, MONTHLY) + "SELECT * FROM monthly", q=8))
def monthly_means(spark, d):
    return rounded(S.monthly_means(X.daily_flow(spark, d), ["station_idx", "scenario"]), q=8)


EFR = """
mmf AS (SELECT station_idx, scenario, month, avg(q) AS mmf FROM monthly GROUP BY ALL),
efr AS (SELECT station_idx, scenario, month, CASE WHEN maf > 0 THEN CASE WHEN mmf <= 0.4 * maf THEN 0.6 WHEN mmf <= 0.8 * maf THEN 0.45
          ELSE 0.3 END * mmf END AS efr
        FROM (SELECT *, avg(mmf) OVER (PARTITION BY station_idx, scenario) AS maf FROM mmf))
"""


@query("environmental_flow", rounded_sql(X.with_sql(X.DAILY, MONTHLY, EFR) + "SELECT * FROM efr", efr=8))
def environmental_flow(spark, d):
    monthly = S.monthly_means(X.daily_flow(spark, d), ["station_idx", "scenario"])
    return rounded(W.environmental_flow(monthly, ["station_idx", "scenario"]), efr=8)


@query("supply_reliability", rounded_sql(X.with_sql(X.DAILY, MONTHLY, EFR, """
  scored AS (
    SELECT m.*, e.efr, 5.0 + m.station_idx % 40 AS dem, (5.0 + m.station_idx % 40) * 1e6 / 12 AS need,
      greatest(0, m.q - e.efr) * day(last_day(make_date(year, month, 1))) * 86400.0 AS s0
    FROM monthly m JOIN efr e USING (station_idx, scenario, month)),
  s AS (SELECT *, CASE WHEN q IS NULL OR efr IS NULL THEN NULL ELSE s0 END AS s FROM scored),
  f AS (SELECT *, s < need AS fail, lead(s) OVER w >= need AND lead(year * 12 + month) OVER w = year * 12 + month + 1 AS nm FROM s
        WINDOW w AS (PARTITION BY station_idx, scenario ORDER BY year, month)),
  a AS (SELECT station_idx, scenario, count(CASE WHEN q >= efr THEN 1 END) / nullif(count(q), 0) AS efr_compliance, count(s) AS n,
          count(CASE WHEN fail THEN 1 END) AS nf, count(CASE WHEN fail AND nm THEN 1 END) AS nr, count(*) AS na, sum(s) AS ss,
          max(need) AS need, avg(CASE WHEN need - s > 0 THEN need - s END) AS mg, sum(CASE WHEN s IS NOT NULL THEN greatest(0, need - s) END) AS gap
        FROM f GROUP BY ALL),
  r AS (SELECT *, (n - nf) / n AS rel, CASE WHEN mg IS NULL THEN 0 ELSE least(1.0, mg / need) END AS vul, CASE WHEN nf > 0 THEN nr / nf ELSE 1.0 END AS res FROM a)""") + """
  SELECT station_idx, scenario, efr_compliance, rel, vul, res, pow(greatest(0, rel * res * (1 - vul)), 1.0 / 3) AS si,
         CASE WHEN ss > 0 THEN need * n / ss ELSE 'inf'::DOUBLE END AS wsi, nf / n * 12.0 AS gap_months_per_year,
         gap / 1e6 / n * 12.0 AS gap_volume_mm3_yr, n / na AS data_coverage FROM r""",
    **{m: 7 for m in W.RELIABILITY}))
def supply_reliability(spark, d):
    keys = ["station_idx", "scenario"]
    monthly = S.monthly_means(X.daily_flow(spark, d), keys)
    at = monthly.join(W.environmental_flow(monthly, keys), [*keys, "month"]).withColumn(
        "demand_mm3_yr", 5.0 + F.col("station_idx") % 40)
    return rounded(W.reliability(at, keys), **{m: 7 for m in W.RELIABILITY})


@query("segment_flow_methods", rounded_sql(X.with_sql(X.DAILY, MONTHLY, """
  dam AS (SELECT station_idx % 7 AS seg, scenario, station_idx, year, month, q, 1.0 + (station_idx % 7) / 10.0 AS a FROM monthly),
  tot AS (SELECT seg, scenario, year, month, sum(q) AS q, max(a) AS a FROM dam GROUP BY ALL),
  b2 AS (SELECT t.*, n.q AS qn FROM tot t LEFT JOIN tot n ON n.seg = t.seg AND n.year = t.year AND n.month = t.month AND n.scenario = 'nat')""") + """
  SELECT seg, method, scenario, year, month, qn * CASE method WHEN 'E1' THEN 1 ELSE a END + (q - qn) AS q
  FROM b2, (VALUES ('E1'), ('E2')) v(method)""", q=7))
def segment_flow_methods(spark, d):
    monthly = S.monthly_means(X.daily_flow(spark, d), ["station_idx", "scenario"])
    seg = F.col("station_idx") % 7
    dam = monthly.select(seg.alias("seg"), "scenario", "year", "month", "q", (1.0 + seg / 10.0).alias("a_ratio"))
    return rounded(W.segment_flow(dam, ["seg"]), q=7)


@query("dropped_segments", rounded_sql(X.with_sql(X.NETWORK, X.DAMS, WALK, SEGMENTS, recursive=True) + """
  SELECT dam_rivers, 'dropped_no_sim_dam' AS metric, demand_mm3_yr FROM segs WHERE demand_mm3_yr > 0 AND NOT EXISTS (
    SELECT 1 FROM supplier WHERE s_acctbal > 2000 AND list_contains(string_split(dam_rivers, '|'), CAST(s_suppkey * 5 + 3 AS VARCHAR)))""",
    demand_mm3_yr=8))
def dropped_segments(spark, d):
    segs = W.supply_segments(X.dams(spark, d), X.network(spark, d))
    alive = X.table(spark, d, "supplier").filter("s_acctbal > 2000").select((F.col("s_suppkey") * 5 + 3).alias("river_id"))
    out = W.dropped_segments(segs, alive).join(segs.select("seg", "dam_rivers"), "seg").drop("seg")
    return rounded(out, demand_mm3_yr=8)


@query("reach_effects", rounded_sql(X.with_sql(X.NETWORK, X.DAMS, WALK, recursive=True) + """,
  eff AS (SELECT s_suppkey * 5 + 3 AS dam, (s_acctbal - 3000) / 1000 AS eff FROM supplier)""".replace(",\n", ", ", 1) + """
  SELECT river_id, arg_max(eff, (abs(eff), -dam)) AS eff FROM walk JOIN eff USING (dam) GROUP BY ALL""", eff=8))
def reach_effects(spark, d):
    eff = X.table(spark, d, "supplier").select((F.col("s_suppkey") * 5 + 3).alias("dam"), ((F.col("s_acctbal") - 3000) / 1000).alias("eff"))
    return rounded(G.reach_paint(G.downstream_walk(X.dams(spark, d), X.network(spark, d)), eff), eff=8)


@query("robust_effect_limit", rounded_sql("""
  SELECT c_mktsegment, quantile_cont(abs(c_acctbal - 4000), 0.92) AS "limit" FROM customer GROUP BY ALL""", **{'"limit"': 4}))
def robust_effect_limit(spark, d):
    at = X.table(spark, d, "customer").select("c_mktsegment", (F.col("c_acctbal") - 4000).alias("eff"))
    return rounded(D.pooled_limit(at, ["c_mktsegment"], "eff"), limit=4)


@query("scenario_increments", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, avg(b.q - c.q) AS mean_increment, avg(b.q) / nullif(avg(c.q), 0) AS mean_ratio, count(*) AS n
  FROM dflow b JOIN dflow c USING (station_idx, year, hoy) WHERE b.scenario = 'BAL_C' AND c.scenario = 'CONV' GROUP BY ALL""",
    mean_increment=8, mean_ratio=8))
def scenario_increments(spark, d):
    flow = X.daily_flow(spark, d).filter("scenario <> 'nat'")
    at = S.attach_baseline(flow, ["station_idx", "year", "hoy"], baseline="CONV").filter("q_nat is not null")
    out = at.groupBy("station_idx").agg(F.avg(F.col("q_reg") - F.col("q_nat")).alias("mean_increment"),
                                        ratio(F.avg("q_reg"), F.avg("q_nat")).alias("mean_ratio"), F.count(F.lit(1)).alias("n"))
    return rounded(out, mean_increment=8, mean_ratio=8)


@query("finite_flow_audit", """
  SELECT event_type, count(v) AS n_known, count(*) - count(v) AS n_missing FROM (
    SELECT event_type, CASE WHEN value > 95 THEN NULL ELSE value END AS v FROM events) GROUP BY ALL""")
def finite_flow_audit(spark, d):
    v = F.when(F.col("value") > 97, float("nan")).when(F.col("value") > 95, float("inf")).otherwise(F.col("value"))
    at = X.table(spark, d, "events").select("event_type", finite(v).alias("v"))
    return at.groupBy("event_type").agg(F.count("v").alias("n_known"), (F.count(F.lit(1)) - F.count("v")).alias("n_missing"))
