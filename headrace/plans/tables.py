"""Load, weather, feature-table and time-series queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.operators import features as M
from headrace.operators import load as L
from headrace.operators import series as S
from headrace.operators import weather as WX
from headrace.plans import standins as X
from headrace.session import reliable_checkpoint
from headrace.plans.registry import query, rounded, rounded_sql

ORDER_LOAD = """
oload AS (SELECT o_orderpriority AS region, o_orderdate AS ts, sum(o_totalprice) AS load_mw FROM orders GROUP BY ALL)
"""


def _order_load(spark, d):
    """Daily load of an order priority; hour of day 0."""
    return X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("region"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("load_mw"))


HOURLOAD = "hload AS (SELECT station AS region, ts, q_nat AS load_mw FROM hourly)"
SLOTS = """
pk AS (SELECT region, quantile_cont(load_mw, 0.99) AS p99, avg(load_mw) AS m FROM hload GROUP BY ALL),
slots AS (SELECT region, dayofyear(ts) AS doy, hour(ts) AS hod, avg(load_mw) AS v FROM hload GROUP BY ALL),
cal AS (SELECT CAST(y AS INT) AS year, CAST(h AS INT) AS hoy FROM range(2027, 2041) a(y), range(0, 8784) b(h) WHERE h < CASE WHEN y % 4 = 0 THEN 8784 ELSE 8760 END),
prof AS (SELECT pk.region, year, hoy, coalesce(v, m) / p99 AS l_norm FROM pk, cal LEFT JOIN slots s ON s.region = pk.region AND s.doy = least(hoy // 24 + 1, 365) AND s.hod = hoy % 24)
"""


def _hour_load(spark, d):
    return X.hourly(spark, d).select(F.col("station").alias("region"), "ts", F.col("q_nat").alias("load_mw"))


@query("load_profile", rounded_sql(X.with_sql(X.HOURLY, HOURLOAD, SLOTS) + "SELECT * FROM prof", l_norm=8))
def load_profile(spark, d):
    return rounded(L.load_profile(_hour_load(spark, d), ["region"]), l_norm=8)


@query("load_profile_utc", rounded_sql(X.with_sql(X.HOURLY, HOURLOAD, SLOTS) + """
  SELECT region, year, CAST(((hoy - round_even(length(region) - 2.5, 0)) % n + n) % n AS INT) AS hoy, l_norm
  FROM (SELECT *, CASE WHEN year % 4 = 0 THEN 8784 ELSE 8760 END AS n FROM prof)""", l_norm=8))
def load_profile_utc(spark, d):
    load = _hour_load(spark, d)
    offsets = load.select("region").distinct().withColumn("offset_h", F.length("region") - 2.5)
    return rounded(L.load_profile(load, ["region"], offsets=offsets), l_norm=8)


@query("proxy_profile", rounded_sql(X.with_sql(X.HOURLY, HOURLOAD, SLOTS) + """
  SELECT 'like ' || region AS region, year, CAST(((hoy - (length(region) - 6)) % n + n) % n AS INT) AS hoy, l_norm
  FROM (SELECT *, CASE WHEN year % 4 = 0 THEN 8784 ELSE 8760 END AS n FROM prof)""", l_norm=8))
def proxy_profile(spark, d):
    profile = L.load_profile(_hour_load(spark, d), ["region"])
    names = X.table(spark, d, "events").select(F.col("event_type").alias("source")).distinct()
    proxies = names.select(F.concat(F.lit("like "), "source").alias("target"), "source")
    offsets = names.select(F.col("source").alias("region"), F.lit(6.0).alias("offset_h")).unionByName(
        names.select(F.concat(F.lit("like "), "source").alias("region"), F.length("source").cast("double").alias("offset_h")))
    return rounded(L.proxy_profile(profile, proxies, offsets), l_norm=8)


@query("shape_profile", rounded_sql(X.with_sql(X.HOURLY, HOURLOAD, """
  hh AS (SELECT region, hour(ts) AS h, avg(load_mw) AS v FROM hload GROUP BY ALL),
  mm AS (SELECT month(o_orderdate) AS m, avg(o_totalprice) / 1e5 AS f FROM orders GROUP BY ALL),
  cal AS (SELECT CAST(y AS INT) AS year, CAST(h AS INT) AS hoy FROM range(2027, 2041) a(y), range(0, 8784) b(h) WHERE h < CASE WHEN y % 4 = 0 THEN 8784 ELSE 8760 END),
  raw AS (SELECT region, year, hoy, v * f AS x FROM cal JOIN hh ON h = hoy % 24 JOIN mm ON m = month(make_date(year, 1, 1) + CAST(hoy // 24 AS INT)))""") + """
  SELECT region, year, hoy, x / quantile_cont(x, 0.99) OVER (PARTITION BY region, year) AS l_norm FROM raw""", l_norm=8))
def shape_profile(spark, d):
    hours = _hour_load(spark, d).groupBy("region", F.hour("ts").alias("h")).agg(F.avg("load_mw").alias("v"))
    # 24 and 12 entries per list.
    hourly = hours.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda s: s["v"]).alias("hourly"))
    months = X.table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("m")).agg((F.avg("o_totalprice") / 1e5).alias("f"))
    monthly = months.groupBy(F.lit(1).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "f"))), lambda s: s["f"]).alias("monthly"))
    shapes = hourly.withColumn("k", F.lit(1)).join(monthly, "k").drop("k")
    return rounded(L.profile_from_shape(shapes, ["region"], (L.FIRST_YEAR, L.LAST_YEAR)), l_norm=8)


@query("seasonal_factors", rounded_sql(X.with_sql(X.HOURLY, HOURLOAD, SLOTS) + """
  SELECT region, month, m / avg(m) OVER (PARTITION BY region) AS factor FROM (
    SELECT region, CAST(least(hoy // 730, 11) AS INT) AS month, avg(l_norm) AS m FROM prof GROUP BY ALL)""", factor=8))
def seasonal_factors(spark, d):
    profile = L.load_profile(_hour_load(spark, d), ["region"])
    return rounded(L.seasonal_factors(profile, ["region"]), factor=8)


@query("repeat_year_profile", rounded_sql(X.with_sql(X.HOURLY, "h AS (SELECT station AS region, hoy, q AS v FROM hflow WHERE scenario = 'nat')") + """
  SELECT region, CAST(y AS INT) AS year, hoy, v AS l_norm FROM h, range(2027, 2041) a(y) UNION ALL
  SELECT region, y, hoy + 8760, v FROM h, range(2028, 2041, 4) a(y) WHERE hoy < 24""", l_norm=8))
def repeat_year_profile(spark, d):
    at = X.hourly_flow(spark, d).filter("scenario = 'nat'").select(F.col("station").alias("region"), "hoy", F.col("q").alias("l_norm"))
    return rounded(L.repeat_year_profile(at, ["region"]), l_norm=8)


@query("aggregate_areas", rounded_sql(X.with_sql(X.HOURLY) + """
  SELECT region, ts, sum(q_nat) AS load_mw FROM (SELECT 'all' AS region, ts, q_nat FROM hourly UNION ALL
    SELECT CASE WHEN station IN ('click', 'view') THEN 'reads' ELSE 'writes' END, ts, q_nat FROM hourly) GROUP BY ALL""", load_mw=6))
def aggregate_areas(spark, d):
    load = X.hourly(spark, d).select(F.col("station").alias("area"), "ts", F.col("q_nat").alias("load_mw"))
    kind = F.when(F.col("area").isin("click", "view"), "reads").otherwise("writes")
    areas = load.select("area").distinct().select("area", F.explode(F.array(F.lit("all"), kind)).alias("region"))
    return rounded(L.aggregate_areas(load, areas), load_mw=6)


@query("monthly_coverage", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, year, month(make_date(year, 1, 1) + CAST(hoy // 24 AS INT)) AS month, least(greatest(100 * sum(q_conv) / nullif(sum(q_bal) * 0.95, 0), 0), 100) AS coverage_pct
  FROM daily GROUP BY ALL""", coverage_pct=8))
def monthly_coverage(spark, d):
    at = X.daily_wide(spark, d).select("station_idx", "year", "hoy", F.col("q_conv").alias("firm_mw"), (F.col("q_bal") * 0.95).alias("load_mw"))
    return rounded(L.monthly_coverage(at, ["station_idx"]), coverage_pct=8)


@query("load_floor", """
  SELECT event_type AS source, count(*) AS n, round(min(value), 6) AS lowest FROM events
  WHERE value > CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 25 WHEN 'error' THEN 40 ELSE '-inf'::DOUBLE END GROUP BY ALL""")
def load_floor(spark, d):
    at = X.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("value").alias("load_mw"))
    kept = L.floor_filter(at, {"click": 10.0, "view": 25.0, "error": 40.0})
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("load_mw"), 6).alias("lowest"))


@query("hourly_mean", rounded_sql("SELECT user_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2", value=7))
def hourly_mean(spark, d):
    return rounded(S.hourly_mean(X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["user_id"], "ts", "value"), value=7)


# ---- weather ----

WEATHER = """
era AS (SELECT event_type AS cell, date_trunc('hour', ts) AS ts, avg(value) / 5000 AS tp, 260 + avg(value) / 4 AS t2m, 255 + avg(value) / 5 AS d2m,
          avg(value) * 20000 AS ssrd, avg(value) / 20 AS u10, count(*) / 2.0 AS v10 FROM events GROUP BY 1, 2),
wx AS (SELECT cell, ts, greatest(tp * 1000, 0) AS pcp_mm, t2m - 273.15 AS tmp_c, least(greatest(exp(17.625 * (d2m - 273.15) / (243.04 + d2m - 273.15))
         / exp(17.625 * (t2m - 273.15) / (243.04 + t2m - 273.15)), 0), 1) AS hmd, greatest(ssrd / 1e6, 0) AS slr_mj, sqrt(u10 * u10 + v10 * v10) AS wnd FROM era),
wd AS (SELECT cell, CAST(ts AS DATE) AS date, max(tmp_c) AS tmax, min(tmp_c) AS tmin, sum(pcp_mm) AS pcp, max(pcp_mm) AS pcp_hour_max, sum(slr_mj) AS slr, avg(hmd) AS hmd,
         avg(wnd) AS wnd FROM wx GROUP BY ALL)
"""


def _weather(spark, d):
    v = F.avg("value")
    raw = X.table(spark, d, "events").groupBy(F.col("event_type").alias("cell"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        (v / 5000).alias("tp"), (260 + v / 4).alias("t2m"), (255 + v / 5).alias("d2m"), (v * 20000).alias("ssrd"), (v / 20).alias("u10"),
        (F.count(F.lit(1)) / 2.0).alias("v10"))
    return WX.derive_weather(raw, ["cell"])


@query("daily_weather", rounded_sql(X.with_sql(WEATHER) + "SELECT * FROM wd", tmax=8, tmin=8, pcp=8, pcp_hour_max=8, slr=8, hmd=8, wnd=8))
def daily_weather(spark, d):
    return rounded(WX.daily_weather(_weather(spark, d), ["cell"]), tmax=8, tmin=8, pcp=8, pcp_hour_max=8, slr=8, hmd=8, wnd=8)


GEN = dict(tmax_ave=8, tmin_ave=8, tmax_sd=7, tmin_sd=7, pcp_sum=8, pcp_sd=7, wet_dry=8, wet_wet=8, pcp_days=4, pcp_hour_max=8, slr_ave=8, dew_ave=8, wnd_ave=8)


@query("weather_generator_stats", rounded_sql(X.with_sql(WEATHER, """
  st AS (SELECT cell, month(date) AS month, avg(tmax) AS tmax_ave, avg(tmin) AS tmin_ave, greatest(0.1, stddev_pop(tmax)) AS tmax_sd, greatest(0.1, stddev_pop(tmin)) AS tmin_sd,
           sum(pcp) AS pcp_sum, greatest(0.1, stddev_pop(pcp)) AS pcp_sd, least(0.95, count(CASE WHEN pcp > 0.1 THEN 1 END) / count(*)) AS wet_dry,
           least(0.95, count(CASE WHEN pcp > 0.1 THEN 1 END) / count(*)) AS wet_wet, greatest(0.1, count(CASE WHEN pcp > 0.1 THEN 1 END))::DOUBLE AS pcp_days,
           greatest(0.1, max(pcp_hour_max)) AS pcp_hour_max, avg(slr) AS slr_ave, avg(hmd) AS dew_ave, avg(wnd) AS wnd_ave FROM wd GROUP BY ALL)""") + """
  SELECT c.cell, CAST(m AS INT) AS month, coalesce(tmax_ave, 32) AS tmax_ave, coalesce(tmin_ave, 23) AS tmin_ave, coalesce(tmax_sd, 1.5) AS tmax_sd, coalesce(tmin_sd, 1.0) AS tmin_sd,
         coalesce(pcp_sum, 150) AS pcp_sum, coalesce(pcp_sd, 10) AS pcp_sd, coalesce(wet_dry, 0.4) AS wet_dry, coalesce(wet_wet, 0.6) AS wet_wet, coalesce(pcp_days, 15) AS pcp_days,
         coalesce(pcp_hour_max, 30) AS pcp_hour_max, coalesce(slr_ave, 18) AS slr_ave, coalesce(dew_ave, 0.75) AS dew_ave, coalesce(wnd_ave, 2) AS wnd_ave
  FROM (SELECT DISTINCT cell FROM wd) c, range(1, 13) r(m) LEFT JOIN st ON st.cell = c.cell AND st.month = m""", **GEN))
def weather_generator_stats(spark, d):
    return rounded(WX.generator_stats(WX.daily_weather(_weather(spark, d), ["cell"]), ["cell"]), **GEN)


CELLS = """
cells AS (SELECT event_type AS cell, row_number() OVER (ORDER BY event_type) * 10.0 AS lat, 0.0 AS lon, row_number() OVER (ORDER BY event_type) <> 3 AS is_land
          FROM (SELECT DISTINCT event_type FROM events)),
near AS (SELECT s_suppkey AS station, arg_min(cell, ((lat - (10 * (s_suppkey % 6) + 2)) ** 2 + 1, cell)) AS cell FROM supplier, cells WHERE is_land GROUP BY ALL)
"""


@query("grid_to_station_series", rounded_sql(X.with_sql(WEATHER, CELLS) + """
  SELECT station, wd.* FROM near JOIN wd USING (cell)""", tmax=8, tmin=8, pcp=8, pcp_hour_max=8, slr=8, hmd=8, wnd=8))
def grid_to_station_series(spark, d):
    """L-3 whole: the nearest land cell of each station (the third cell is sea), then its daily weather."""
    place = F.row_number().over(Window.orderBy("cell"))  # a handful of cells
    cells = X.table(spark, d, "events").select(F.col("event_type").alias("cell")).distinct().select(
        "cell", (place * 10.0).alias("lat"), F.lit(0.0).alias("lon"), (place != 3).alias("is_land"))
    stations = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), (10.0 * (F.col("s_suppkey") % 6) + 2).alias("lat"), F.lit(1.0).alias("lon"))
    near = WX.nearest_land_cell(stations, reliable_checkpoint(cells))
    return rounded(WX.grid_to_station_series(_weather(spark, d), near), tmax=8, tmin=8, pcp=8, pcp_hour_max=8, slr=8, hmd=8, wnd=8)


UNITS = """
g AS (SELECT event_type AS cell, CASE event_type WHEN 'click' THEN 'pr' WHEN 'view' THEN 'tas' WHEN 'error' THEN 'hurs' WHEN 'signup' THEN 'sfcwind' ELSE 'rsds' END AS var,
        date_trunc('hour', ts) AS ts, CASE WHEN min(event_id) % 50 = 0 THEN 9.97e36 ELSE avg(value) * CASE event_type WHEN 'view' THEN 4 ELSE 1 END - 5 END AS value FROM events GROUP BY 1, 2, 3)
"""


@query("unit_normalisation", rounded_sql(X.with_sql(UNITS, """
  k AS (SELECT cell, var, ts, CASE WHEN abs(value) <= 1e10 THEN value END AS v FROM g),
  e AS (SELECT var, avg(v) AS m FROM k JOIN (SELECT var, min(ts) AS t0 FROM k GROUP BY ALL) USING (var) WHERE ts < t0 + INTERVAL 24 HOUR GROUP BY ALL)""") + """
  SELECT cell, k.var, ts, CASE WHEN v IS NULL THEN NULL WHEN k.var = 'pr' THEN greatest(v * 3600, 0) WHEN k.var = 'tas' THEN CASE WHEN m > 100 THEN v - 273.15 ELSE v END
    WHEN k.var = 'hurs' THEN least(greatest(CASE WHEN m > 5 THEN v / 100 ELSE v END, 0), 1) WHEN k.var = 'sfcwind' THEN greatest(v, 0) ELSE v END AS value FROM k LEFT JOIN e USING (var)""", value=7))
def unit_normalisation(spark, d):
    kind = F.col("event_type")
    var = (F.when(kind == "click", "pr").when(kind == "view", "tas").when(kind == "error", "hurs").when(kind == "signup", "sfcwind").otherwise("rsds"))
    grid = X.table(spark, d, "events").groupBy(kind.alias("cell"), var.alias("var"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min("event_id").alias("e"), F.avg("value").alias("v"))
    grid = grid.select("cell", "var", "ts", F.lit("kg m-2 s-1").alias("units"), F.when(F.col("e") % 50 == 0, 9.97e36).otherwise(
        F.col("v") * F.when(F.col("var") == "tas", 4).otherwise(1) - 5).alias("value"))
    return rounded(WX.normalise_units(grid, []).select("cell", "var", "ts", "value"), value=7)


# ---- feature table ----

FEATURES = """
chan AS (SELECT station AS channel, ts, q_nat AS flo_out, CASE WHEN q_bal > 60 THEN NULL ELSE q_bal / 10 END AS precip_mm FROM hourly),
dayt AS (SELECT station AS channel, CAST(ts AS DATE) AS date, avg(q_bal) AS tmp_ave FROM hourly GROUP BY ALL),
feat AS (SELECT c.*, """ + ", ".join(f"lag(flo_out, {k}) OVER w AS flo_out_lag{k}h" for k in M.LAG_HOURS) + ", " + ", ".join(
    f"sum(precip_mm) OVER (PARTITION BY channel ORDER BY ts ROWS {k - 1} PRECEDING) AS precip_sum_{k}h" for k in M.RAIN_HOURS) + """,
    CAST(ts AS DATE) AS date FROM chan c WINDOW w AS (PARTITION BY channel ORDER BY ts)),
fx AS (SELECT f.*, tmp_ave, sin(2 * pi() * hour(ts) / 24) AS sin_hour, cos(2 * pi() * hour(ts) / 24) AS cos_hour, sin(2 * pi() * dayofyear(ts) / 365.25) AS sin_doy,
         cos(2 * pi() * dayofyear(ts) / 365.25) AS cos_doy FROM feat f LEFT JOIN dayt USING (channel, date))
"""
FDIG = {"flo_out": 6, "precip_mm": 7, **{f"flo_out_lag{k}h": 6 for k in M.LAG_HOURS}, **{f"precip_sum_{k}h": 7 for k in M.RAIN_HOURS}, "tmp_ave": 8, "sin_hour": 8, "cos_hour": 8,
        "sin_doy": 8, "cos_doy": 8}


def _features(spark, d):
    at = X.hourly(spark, d)
    flow = at.select(F.col("station").alias("channel"), "ts", F.col("q_nat").alias("flo_out"))
    rain = at.select(F.col("station").alias("channel"), "ts", F.when(F.col("q_bal") <= 60, F.col("q_bal") / 10).alias("precip_mm"))
    day = at.groupBy(F.col("station").alias("channel"), F.to_date("ts").alias("date")).agg(F.avg("q_bal").alias("tmp_ave"))
    return M.hourly_features(flow, rain, [day])


@query("hourly_features", rounded_sql(X.with_sql(X.HOURLY, FEATURES) + "SELECT * FROM fx", **FDIG))
def hourly_features(spark, d):
    return rounded(_features(spark, d), **FDIG)


@query("training_rows", """
  WITH h AS (SELECT event_type AS channel, date_trunc('hour', ts) AS ts, sum(value) AS q FROM events GROUP BY ALL),
  f AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts) AS i FROM h)
  SELECT channel, count(*) AS n_rows FROM f WHERE i > 24 AND channel IN (SELECT channel FROM f GROUP BY ALL HAVING max(q) >= 0.1) GROUP BY ALL""")
def training_rows(spark, d):
    """M-3: complete rows after the longest lag (rain has no gaps here), of rivers with enough flow."""
    at = X.hourly(spark, d)
    flow = at.select(F.col("station").alias("channel"), "ts", F.col("q_nat").alias("flo_out"))
    rain = at.select(F.col("station").alias("channel"), "ts", F.col("q_bal").alias("precip_mm"))
    made = M.hourly_features(flow, rain, target=flow.select("channel", "ts", F.col("flo_out").alias("y")))
    split = M.training_set(made, n_val=0, n_test=0)
    return split.groupBy("channel").agg(F.count(F.lit(1)).alias("n_rows"))


MONTH_DRAW = """
  WITH m AS (SELECT DISTINCT date_trunc('month', l_shipdate)::TIMESTAMP AS m FROM lineitem), n AS (SELECT m, row_number() OVER (ORDER BY m) AS i, count(*) OVER () AS n FROM m),
  k AS (SELECT *, row_number() OVER (ORDER BY md5('42/' || i), i) AS k FROM n),
  room AS (SELECT DISTINCT n - 24 AS room, ('0x' || md5('42/1')[1:8])::BIGINT % (n - 23) + 1 AS start, ('0x' || md5('42/2')[1:8])::BIGINT AS h FROM n),
  blocks AS (SELECT *, greatest(start - 12, 0) AS before, h % (greatest(start - 12, 0) + greatest(room - start + 2, 0)) AS pick FROM room),
  c AS (SELECT start, CASE WHEN pick < before THEN pick + 1 ELSE start + 12 + pick - before END AS test FROM blocks)
"""


@query("month_split_months", MONTH_DRAW + """
  SELECT m, CASE WHEN k <= 12 THEN 'val' WHEN k <= 24 THEN 'test' ELSE 'train' END AS split, 'discrete' AS mode FROM k UNION ALL
  SELECT m, CASE WHEN i >= start AND i < start + 12 THEN 'val' WHEN i >= test AND i < test + 12 THEN 'test' ELSE 'train' END, 'contiguous' FROM n, c""")
def month_split_months(spark, d):
    at = X.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("timestamp_ntz").alias("ts"))
    parts = [S.month_split(at, "ts", 12, 12, mode=mode).select(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("m"), "split").distinct().withColumn("mode", F.lit(mode))
             for mode in ("discrete", "contiguous")]
    return parts[0].unionByName(parts[1])


@query("month_split_sizes", MONTH_DRAW + "SELECT CASE WHEN k <= 12 THEN 'val' WHEN k <= 24 THEN 'test' ELSE 'train' END AS split, count(*) AS n_months FROM k GROUP BY ALL")
def month_split_sizes(spark, d):
    at = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("channel"), F.col("l_shipdate").alias("ts"))
    out = S.month_split(at, "ts", 12, 12).select("split", F.date_trunc("month", "ts").alias("m")).distinct()
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n_months"))


SCALE = """
h AS (SELECT station AS channel, ts, q_nat AS x, q_bal AS y, CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'val' ELSE 'test' END AS split FROM hourly),
sc AS (SELECT channel, avg(x) AS mean_x, CASE WHEN stddev_samp(x) < 1e-8 THEN 1 ELSE stddev_samp(x) END AS sd_x, CASE WHEN avg(y) < 1e-8 THEN 1 ELSE avg(y) END AS target_scale
       FROM h WHERE split = 'train' GROUP BY ALL)
"""


def _split_table(spark, d):
    day = F.dayofmonth("ts")
    return X.hourly(spark, d).select(F.col("station").alias("channel"), "ts", F.col("q_nat").alias("x"), F.col("q_bal").alias("y"),
                                     F.when(day <= 20, "train").when(day <= 25, "val").otherwise("test").alias("split"))


@query("train_scaler", rounded_sql(X.with_sql(X.HOURLY, SCALE) + "SELECT * FROM sc", mean_x=8, sd_x=7, target_scale=8))
def train_scaler(spark, d):
    return rounded(M.train_scaler(_split_table(spark, d), ["x"]), mean_x=8, sd_x=7, target_scale=8)


@query("standardised_features", rounded_sql(X.with_sql(X.HOURLY, SCALE) + """
  SELECT channel, ts, split, (x - mean_x) / sd_x AS x, greatest(y, 1e-4) / target_scale AS y FROM h JOIN sc USING (channel)""", x=7, y=7))
def standardised_features(spark, d):
    at = _split_table(spark, d)
    return rounded(M.standardise(at, M.train_scaler(at, ["x"]), ["x"]), x=7, y=7)


@query("valid_rivers", X.with_sql(X.HOURLY, SCALE) + """
  SELECT * FROM (SELECT channel, count(CASE WHEN split = 'train' THEN 1 END) AS n_train, count(CASE WHEN split = 'val' THEN 1 END) AS n_val FROM h GROUP BY ALL)
  WHERE n_train >= 440 AND n_val >= 100 UNION ALL
  SELECT 'default limits: ' || channel, n_train, n_val FROM (
    SELECT channel || '/' || k AS channel, count(CASE WHEN split = 'train' THEN 1 END) * k AS n_train, count(CASE WHEN split = 'val' THEN 1 END) * k AS n_val
    FROM h, range(1, 9) r(k) GROUP BY channel, k) WHERE n_train >= 1200 AND n_val >= 720""")
def valid_rivers(spark, d):
    at = _split_table(spark, d)
    # the stand-in has one month; rivers of 1 to 8 such months meet or miss the default limits
    copies = at.join(F.broadcast(spark.range(1, 9).withColumnRenamed("id", "k")), how="cross")
    longer = copies.select(F.explode(F.sequence(F.lit(1), "k")), F.concat_ws("/", "channel", "k").alias("channel"), "split")
    standard = M.valid_rivers(longer.select("channel", "split"))
    return M.valid_rivers(at, 440, 100).unionByName(standard.withColumn("channel", F.concat(F.lit("default limits: "), "channel")))


@query("skill_scores", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, CASE WHEN n >= 5 THEN 1 - e / nullif(n * vo, 0) END AS nse, CASE WHEN n >= 5 AND so > 0 THEN 1 - sqrt((r - 1) ** 2 + (ss / so - 1) ** 2 + (ms / mo - 1) ** 2) END AS kge,
    CASE WHEN n >= 5 THEN r * r END AS r2, CASE WHEN n >= 5 THEN 100 * (ts - t0) / t0 END AS pbias, CASE WHEN n >= 5 THEN sqrt(e / n) END AS rmse
  FROM (SELECT station_idx, count(*) AS n, sum((q_nat - q_bal) ** 2) AS e, var_pop(q_nat) AS vo, stddev_pop(q_nat) AS so, stddev_pop(q_bal) AS ss, avg(q_nat) AS mo, avg(q_bal) AS ms,
          corr(q_nat, q_bal) AS r, sum(q_nat) AS t0, sum(q_bal) AS ts FROM daily GROUP BY ALL)""", nse=7, kge=6, r2=7, pbias=9, rmse=7))
def skill_scores(spark, d):
    return rounded(M.skill(X.daily_wide(spark, d), ["station_idx"], "q_nat", "q_bal"), nse=7, kge=6, r2=7, pbias=9, rmse=7)


@query("skill_observed_hours", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, CASE WHEN n >= 5 THEN 1 - e / nullif(n * vo, 0) END AS nse_obs, CASE WHEN n >= 5 AND so > 0 THEN 1 - sqrt((r - 1) ** 2 + (ss / so - 1) ** 2 + (ms / mo - 1) ** 2) END AS kge_obs
  FROM (SELECT station_idx, count(*) FILTER (o) AS n, sum((q_nat - q_bal) ** 2) FILTER (o) AS e, var_pop(q_nat) FILTER (o) AS vo, stddev_pop(q_nat) FILTER (o) AS so,
          stddev_pop(q_bal) FILTER (o) AS ss, avg(q_nat) FILTER (o) AS mo, avg(q_bal) FILTER (o) AS ms, corr(q_nat, q_bal) FILTER (o) AS r
        FROM (SELECT *, hoy // 24 % 3 = 0 AS o FROM daily) GROUP BY ALL)""", nse_obs=7, kge_obs=6))
def skill_observed_hours(spark, d):
    at = X.daily_wide(spark, d).withColumn("is_observed", (F.floor(F.col("hoy") / 24) % 3 == 0).cast("int"))
    return rounded(M.skill_observed(at, ["station_idx"], "q_nat", "q_bal"), nse_obs=7, kge_obs=6)


@query("interval_skill", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, avg(CASE WHEN q_nat BETWEEN q_conv * 1.02 AND q_bal * 0.99 THEN 1 ELSE 0 END) AS picp, avg(q_bal * 0.99 - q_conv * 1.02) / nullif(max(q_nat) - min(q_nat), 0) AS pinaw
  FROM daily GROUP BY ALL""", picp=8, pinaw=8))
def interval_skill(spark, d):
    at = X.daily_wide(spark, d).select("station_idx", "q_nat", (F.col("q_conv") * 1.02).alias("lo"), (F.col("q_bal") * 0.99).alias("hi"))
    return rounded(M.interval_skill(at, ["station_idx"], "q_nat", "lo", "hi"), picp=8, pinaw=8)


@query("best_trial", rounded_sql("""
  WITH t AS (SELECT l_suppkey AS channel, l_partkey AS trial, avg(l_discount) - 0.03 AS val_nse, avg(l_tax) AS val_crps FROM lineitem GROUP BY ALL)
  SELECT channel, trial, val_nse, val_crps FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY (round(val_nse, 9) > 0) DESC, round(val_crps, 9), round(val_nse, 9) DESC, trial) AS i FROM t)
  WHERE i = 1""", val_nse=8, val_crps=8))
def best_trial(spark, d):
    at = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("channel"), F.col("l_partkey").alias("trial")).agg(
        F.round(F.avg("l_discount") - 0.03, 9).alias("val_nse"), F.round(F.avg("l_tax"), 9).alias("val_crps"))
    return rounded(M.best_trial(at), val_nse=8, val_crps=8)


@query("scenario_change", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT scenario, station_idx, f AS fut_mean, h AS hist_mean, f / greatest(h, 1e-8) AS ratio_fut_hist FROM
    (SELECT scenario, station_idx, avg(q) AS f FROM dflow WHERE year >= 1999 GROUP BY ALL) LEFT JOIN
    (SELECT station_idx, avg(q) AS h FROM dflow WHERE year < 1999 AND scenario = 'nat' GROUP BY ALL) USING (station_idx)""", fut_mean=8, hist_mean=8, ratio_fut_hist=8))
def scenario_change(spark, d):
    flow = X.daily_flow(spark, d)
    out = M.scenario_change(flow.filter("year >= 1999"), flow.filter("year < 1999 and scenario = 'nat'"), ["scenario"], "station_idx", "q")
    return rounded(out, fut_mean=8, hist_mean=8, ratio_fut_hist=8)


@query("climatology_curve", rounded_sql(X.with_sql(X.HOURLY, """
  m AS (SELECT station, hoy, avg(q) AS v FROM hflow WHERE scenario = 'nat' GROUP BY ALL),
  g AS (SELECT station, CAST(h AS INT) AS hoy FROM (SELECT DISTINCT station FROM m), range(0, 8760) r(h)),
  j AS (SELECT g.station, g.hoy, v, last_value(CASE WHEN v IS NOT NULL THEN g.hoy END IGNORE NULLS) OVER w AS bx, last_value(v IGNORE NULLS) OVER w AS bv,
          first_value(CASE WHEN v IS NOT NULL THEN g.hoy END IGNORE NULLS) OVER f AS ax, first_value(v IGNORE NULLS) OVER f AS av FROM g LEFT JOIN m ON m.station = g.station AND m.hoy = g.hoy
        WINDOW w AS (PARTITION BY g.station ORDER BY g.hoy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY g.station ORDER BY g.hoy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""") + """
  SELECT station, hoy, coalesce(v, bv + (av - bv) * (hoy - bx) / nullif(ax - bx, 0), bv) AS q FROM j""", q=8))
def climatology_curve(spark, d):
    at = X.hourly(spark, d).select("station", "ts", F.col("q_nat").alias("q"))
    return rounded(S.climatology(at, ["station"], "ts", "q"), q=8)


@query("calendar_alignment", rounded_sql(X.with_sql(X.HOURLY, """
  g AS (SELECT station, CAST(y AS INT) AS year, CAST(h AS INT) AS hoy FROM (SELECT DISTINCT station FROM hourly), range(2023, 2025) a(y), range(0, 8784) b(h)
        WHERE h < CASE WHEN y % 4 = 0 THEN 8784 ELSE 8760 END)""") + """
  SELECT g.station, g.year, g.hoy, greatest(coalesce(q - 30, avg(q - 30) OVER (PARTITION BY g.station, g.year), 0), 0) AS q
  FROM g LEFT JOIN (SELECT * FROM hflow WHERE scenario = 'nat') f ON f.station = g.station AND f.year = g.year AND f.hoy = g.hoy""", q=8))
def calendar_alignment(spark, d):
    at = X.hourly(spark, d).select("station", "ts", (F.col("q_nat") - 30).alias("q"))
    return rounded(S.align_to_calendar(at, ["station"], "ts", "q", 2023, 2024), q=8)


@query("environmental_target", rounded_sql(X.with_sql(X.DAILY) + "SELECT station_idx, 0.1 * greatest(coalesce(avg(q_nat), 0), 0) AS q_env FROM daily GROUP BY ALL", q_env=9))
def environmental_target(spark, d):
    return rounded(M.env_flow_target(X.daily_wide(spark, d), ["station_idx"], "q_nat"), q_env=9)


@query("sequence_windows", rounded_sql(X.with_sql(X.HOURLY, """
  s AS (SELECT station, ts, q_nat AS y, count(*) OVER w AS n, sum(q_bal) OVER w AS sx, lag(q_bal, 6) OVER (PARTITION BY station ORDER BY ts) AS first_x FROM hourly
        WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))""") + """
  SELECT station, ts, y, CAST(n AS INT) AS n_steps, sx AS sum_x, first_x FROM s WHERE n = 6""", y=6, sum_x=6, first_x=6))
def sequence_windows(spark, d):
    made = S.sequences(X.hourly(spark, d), ["station"], "ts", ["q_bal"], 6, "q_nat")
    out = made.select("station", "ts", "y", F.size("x").alias("n_steps"), F.aggregate("x", F.lit(0.0), lambda a, s: a + s["q_bal"]).alias("sum_x"), F.col("x")[0]["q_bal"].alias("first_x"))
    return rounded(out, y=6, sum_x=6, first_x=6)


@query("missing_share", rounded_sql("""
  SELECT user_id, feature, avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS missing_share FROM (
    SELECT user_id, 'value' AS feature, CASE WHEN value <= 80 THEN value END AS v FROM events UNION ALL
    SELECT user_id, 'k', CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 10 THEN 1 END FROM events) GROUP BY ALL""", missing_share=8))
def missing_share(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    at = X.table(spark, d, "events").select("user_id", F.when(F.col("value") <= 80, F.col("value")).alias("value"), F.when(k >= 10, k).alias("k"))
    return rounded(M.missing_share(at, ["user_id"], ["value", "k"]), missing_share=8)


PCHIP = """
s3 AS (SELECT station, ts - to_hours(CAST(hour(ts) % 3 AS INT)) AS ts, avg(q_nat) AS y FROM hourly GROUP BY ALL),
k0 AS (SELECT station, ts, y, epoch(lead(ts) OVER w - ts) / 3600 AS h, lead(y) OVER w AS y1 FROM s3 WINDOW w AS (PARTITION BY station ORDER BY ts)),
k1 AS (SELECT *, (y1 - y) / h AS d FROM k0),
k2 AS (SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lead(h) OVER w AS hn, lead(d) OVER w AS dn, lag(h, 2) OVER w AS hpp, lag(d, 2) OVER w AS dpp
       FROM k1 WINDOW w AS (PARTITION BY station ORDER BY ts)),
e0 AS (SELECT *, CASE WHEN hp IS NULL THEN ((2 * h + hn) * d - h * dn) / (h + hn) WHEN h IS NULL THEN ((2 * hp + hpp) * dp - hp * dpp) / (hp + hpp) END AS s,
         CASE WHEN hp IS NULL THEN d ELSE dp END AS da, CASE WHEN hp IS NULL THEN dn ELSE dpp END AS db FROM k2),
k3 AS (SELECT *, CASE WHEN hp IS NULL OR h IS NULL THEN CASE WHEN sign(s) <> sign(da) THEN 0 WHEN sign(da) <> sign(db) AND abs(s) > 3 * abs(da) THEN 3 * da ELSE s END
         WHEN dp * d > 0 THEN (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) ELSE 0 END AS m FROM e0),
k4 AS (SELECT *, lead(m) OVER w AS m1, lead(ts, 2) OVER w IS NULL AS fin FROM k3 WINDOW w AS (PARTITION BY station ORDER BY ts)),
k5 AS (SELECT *, g.i / h AS t FROM k4, range(0, 800) g(i) WHERE y1 IS NOT NULL AND g.i < h + CASE WHEN fin THEN 3 ELSE 0 END)
"""


@query("pchip_hourly", rounded_sql(X.with_sql(X.HOURLY, PCHIP) + """
  SELECT station, ts + to_hours(CAST(i AS INT)) AS ts, greatest((2 * t * t * t - 3 * t * t + 1) * y + (t * t * t - 2 * t * t + t) * h * m + (3 * t * t - 2 * t * t * t) * y1 + (t * t * t - t * t) * h * m1, 0) AS q,
         CAST(i = 0 OR (fin AND i = h) AS INT) AS is_observed FROM k5""", q=7))
def pchip_hourly(spark, d):
    """3-hourly means to hours."""
    at = X.hourly(spark, d)
    slot = F.timestamp_add("HOUR", -(F.hour("ts") % 3), F.col("ts"))
    three = at.groupBy("station", slot.alias("ts")).agg(F.avg("q_nat").alias("q"))
    return rounded(S.pchip_hourly(three, ["station"], "ts", "q"), q=7)


@query("deviation_and_swing", rounded_sql(X.with_sql(X.HOURLY, "hp AS (SELECT station, scenario, hoy % 24 AS hod, avg(q) AS q FROM hflow GROUP BY ALL)") + """
  SELECT station, scenario, hod, q, q - avg(q) OVER w AS deviation, max(q) OVER w - min(q) OVER w AS swing, CASE WHEN max(q) OVER w > 0 THEN q / max(q) OVER w ELSE q END AS peak_share
  FROM hp WINDOW w AS (PARTITION BY station, scenario)""", q=8, deviation=8, swing=8, peak_share=8))
def deviation_and_swing(spark, d):
    hours = X.hourly_flow(spark, d).groupBy("station", "scenario", (F.col("hoy") % 24).alias("hod")).agg(F.avg("q").alias("q"))
    return rounded(S.deviation_and_swing(hours, ["station", "scenario"], "q"), q=8, deviation=8, swing=8, peak_share=8)


@query("pulse_stats", rounded_sql(X.with_sql(X.HOURLY, """
  m AS (SELECT station, scenario, hoy, q > 150 AS i FROM hflow), s AS (SELECT *, i AND NOT coalesce(lag(i) OVER (PARTITION BY station, scenario ORDER BY hoy), false) AS st FROM m)""") + """
  SELECT station, scenario, count(CASE WHEN st THEN 1 END) AS pulse_count, coalesce(count(CASE WHEN i THEN 1 END) / nullif(count(CASE WHEN st THEN 1 END), 0), 0) AS pulse_mean_len FROM s GROUP BY ALL""", pulse_mean_len=8))
def pulse_stats(spark, d):
    return rounded(S.pulse_stats(X.hourly_flow(spark, d), ["station", "scenario"], "hoy", F.col("q") > 150), pulse_mean_len=8)


@query("rolling_mean_extremes", rounded_sql(X.with_sql(X.HOURLY) + """
  SELECT station, scenario, """ + ", ".join(f"{f}(CASE WHEN i >= {k} THEN r{k} END) AS {f}{k}day" for k in (3, 7) for f in ("min", "max")) + """
  FROM (SELECT station, scenario, row_number() OVER w AS i, avg(q) OVER (PARTITION BY station, scenario ORDER BY hoy ROWS 2 PRECEDING) AS r3,
          avg(q) OVER (PARTITION BY station, scenario ORDER BY hoy ROWS 6 PRECEDING) AS r7 FROM hflow WINDOW w AS (PARTITION BY station, scenario ORDER BY hoy)) GROUP BY ALL""",
    min3day=8, max3day=8, min7day=8, max7day=8))
def rolling_mean_extremes(spark, d):
    return rounded(S.rolling_mean_extremes(X.hourly_flow(spark, d), ["station", "scenario"], "hoy", "q", (3, 7)), min3day=8, max3day=8, min7day=8, max7day=8)


@query("circular_shift", rounded_sql(X.with_sql(X.DAILY) + """
  SELECT station_idx, year, CAST(((hoy + 5 * 24 - 8760) % n + n) % n AS INT) AS hoy, q_nat FROM (SELECT *, CASE WHEN year % 4 = 0 THEN 8784 ELSE 8760 END AS n FROM daily)""", q_nat=6))
def circular_shift(spark, d):
    at = X.daily_wide(spark, d).select("station_idx", "year", "hoy", "q_nat")
    return rounded(S.roll_hours(at, F.lit(5 * 24 - 8760)), q_nat=6)


@query("calendar_features", rounded_sql("""
  SELECT l_shipdate::DATE AS date, dayofyear(l_shipdate) AS doy, sin(2 * pi() * dayofyear(l_shipdate) / 365.25) AS sin_doy, cos(2 * pi() * dayofyear(l_shipdate) / 365.25) AS cos_doy,
    CASE WHEN year(l_shipdate) % 4 = 0 THEN 8784 ELSE 8760 END AS hours, day(last_day(l_shipdate)) AS month_days, count(*) AS n FROM lineitem GROUP BY ALL""", sin_doy=8, cos_doy=8))
def calendar_features(spark, d):
    days = X.table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    year, doy = F.year("l_shipdate"), F.dayofyear("l_shipdate")
    feats = cal.cyclic_features(F.lit(0), doy)[2:]
    out = days.select(F.to_date("l_shipdate").alias("date"), doy.alias("doy"), *feats, cal.hours_in_year(year).alias("hours"),
                      cal.days_in_month(year, F.month("l_shipdate")).alias("month_days"), "n")
    return rounded(out, sin_doy=8, cos_doy=8)


@query("mapped_daily_mean", rounded_sql("""
  WITH lsu AS (SELECT l_suppkey AS unit, l_shipdate::DATE AS date, avg(l_quantity) AS perc, avg(l_tax) AS et FROM lineitem GROUP BY ALL),
  map AS (SELECT s_nationkey AS channel, s_suppkey AS unit FROM supplier)
  SELECT channel, date, avg(perc) AS wb_perc, avg(et) AS wb_et FROM map JOIN lsu USING (unit) GROUP BY ALL""", wb_perc=8, wb_et=9))
def mapped_daily_mean(spark, d):
    units = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.to_date("l_shipdate").alias("date")).agg(
        F.avg("l_quantity").alias("perc"), F.avg("l_tax").alias("et"))
    mapping = X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("channel"), F.col("s_suppkey").alias("unit"))
    return rounded(M.mapped_daily_mean(units, mapping, "unit", ["perc", "et"], "wb"), wb_perc=8, wb_et=9)


@query("land_mask", rounded_sql("""
  WITH c AS (SELECT l_linestatus AS region, l_suppkey AS lat, l_linenumber AS lon, least(avg(CASE WHEN l_discount > 0.04 THEN 1 ELSE 0 END), avg(CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END)) AS min_valid FROM lineitem GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY lat, lon) AS cell_no FROM c WHERE min_valid >= 0.5""", min_valid=8))
def land_mask(spark, d):
    at = X.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("region"), F.col("l_suppkey").alias("lat"), F.col("l_linenumber").alias("lon"),
                                              F.when(F.col("l_discount") > 0.04, 1.0).alias("tp"), F.when(F.col("l_tax") > 0.02, 1.0).alias("t2m"))
    return rounded(WX.land_mask(at, ["region"], ["tp", "t2m"]).drop("cell_id"), min_valid=8)


@query("merged_predictions", rounded_sql(X.with_sql(X.HOURLY) + """
  SELECT split, count(*) AS n, count(sigma) AS n_sigma, sum(mu) AS mu FROM (SELECT 'train' AS split, q_nat AS mu, NULL AS sigma FROM hourly WHERE day(ts) <= 20 UNION ALL
    SELECT 'test', q_bal, q_nat FROM hourly WHERE day(ts) > 20) GROUP BY ALL""", mu=4))
def merged_predictions(spark, d):
    at, day = X.hourly(spark, d), F.dayofmonth("ts")
    train = at.filter(day <= 20).select(F.lit("train").alias("split"), F.col("q_nat").alias("mu"))
    test = at.filter(day > 20).select(F.lit("test").alias("split"), F.col("q_bal").alias("mu"), F.col("q_nat").alias("sigma"))
    out = M.merge_predictions([train, test]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("sigma").alias("n_sigma"), F.sum("mu").alias("mu"))
    return rounded(out, mu=4)


@query("year_column_mean", rounded_sql("""
  SELECT l_suppkey, l_linenumber, avg(m) AS l_norm FROM (
    SELECT l_suppkey, l_linenumber, year(l_shipdate) AS y, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY ALL""", l_norm=8))
def year_column_mean(spark, d):
    at = X.table(spark, d, "lineitem")
    first, last = at.agg(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate"))).first()
    names = [f"y{y}" for y in range(first or 0, (last or -1) + 1)]
    wide = at.groupBy("l_suppkey", "l_linenumber").agg(*[F.avg(F.when(F.year("l_shipdate") == int(c[1:]), F.col("l_quantity"))).alias(c) for c in names])
    return rounded(L.average_columns(wide, ["l_suppkey", "l_linenumber"], names), l_norm=8)
