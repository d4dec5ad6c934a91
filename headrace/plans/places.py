"""Plant inventory, spatial-join and name-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headrace.functions import geo, hydraulics, text
from headrace.functions.core import first_match, number
from headrace.operators import spatial as SP
from headrace.operators import stations as ST
from headrace.operators import weather as WX
from headrace.operators.graph import connected_components
from headrace.plans import standins as X
from headrace.plans.registry import query, rounded, rounded_sql

# Sites: customers as points.
SITES = """
sites AS (SELECT c_custkey AS site, CAST(c_custkey * 41 % 170 - 85 AS DOUBLE) + (c_custkey * 7 % 100) / 100.0 AS lat,
            CAST(c_custkey * 67 % 360 - 180 AS DOUBLE) + (c_custkey * 3 % 100) / 100.0 AS lon FROM customer)
"""


def _sites(spark, d):
    k = F.col("c_custkey")
    return X.table(spark, d, "customer").select(k.alias("site"), ((k * 41 % 170 - 85).cast("double") + (k * 7 % 100) / 100.0).alias("lat"),
                                               ((k * 67 % 360 - 180).cast("double") + (k * 3 % 100) / 100.0).alias("lon"))


HAV = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query("nearest_station_planar", rounded_sql(X.with_sql(X.STATIONS, SITES) + """
  SELECT site, station_idx, d2 FROM (SELECT site, station_idx, (p.lat - s.lat) ** 2 + (p.lon - s.lon) ** 2 AS d2,
    row_number() OVER (PARTITION BY site ORDER BY (p.lat - s.lat) ** 2 + (p.lon - s.lon) ** 2, station_idx) AS i FROM sites p, stations s) WHERE i = 1""", d2=6))
def nearest_station_planar(spark, d):
    out = SP.nearest(_sites(spark, d), X.stations(spark, d), "site", "station_idx", ["lat", "lon"])
    return rounded(out.select("site", "station_idx", "d2"), d2=6)


@query("ranked_station_candidates", rounded_sql(X.with_sql(X.STATIONS, SITES) + f"""
  SELECT site, station_idx, km, CAST(i AS INT) AS rank FROM (SELECT site, station_idx, km, row_number() OVER (PARTITION BY site ORDER BY round(km, 7), station_idx) AS i FROM (
    SELECT site, station_idx, {HAV.format(a="p", b="s")} AS km FROM sites p, stations s)) WHERE i <= 5""", km=4))
def ranked_station_candidates(spark, d):
    return rounded(SP.nearest_haversine(_sites(spark, d), X.stations(spark, d), "site", "station_idx", k=5), km=4)


PAIRED = """
ps AS (SELECT * FROM stations WHERE type = 'PS'), other AS (SELECT * FROM stations WHERE type <> 'PS'), sto AS (SELECT * FROM stations WHERE type = 'STO')
"""


def _anchors(spark, d, mode):
    st = X.stations(spark, d)
    at = st.select(F.col("station_idx").alias("node"), "lat", "lon", "type")
    comp = connected_components(X.station_links(spark, d, 30)) if mode == "cascade" else None
    return SP.pair_with_anchor(at.filter("type = 'PS'").drop("type"), at.filter("type <> 'PS'").withColumn("is_storage", F.col("type") == "STO"), mode, comp)


@query("anchor_nearest", rounded_sql(X.with_sql(X.STATIONS, PAIRED) + f"""
  SELECT node, anchor, km, 'nearest' AS how FROM (SELECT p.station_idx AS node, s.station_idx AS anchor, {HAV.format(a="p", b="s")} AS km,
    row_number() OVER (PARTITION BY p.station_idx ORDER BY round({HAV.format(a="p", b="s")}, 7), s.station_idx) AS i FROM ps p, other s) WHERE i = 1""", km=4))
def anchor_nearest(spark, d):
    return rounded(_anchors(spark, d, "nearest"), km=4)


@query("anchor_in_cascade", rounded_sql(X.with_sql(X.STATIONS, PAIRED) + f"""
  SELECT node, anchor, km, CASE WHEN same THEN 'cascade' ELSE 'fallback' END AS how FROM (SELECT p.station_idx AS node, s.station_idx AS anchor, {HAV.format(a="p", b="s")} AS km,
    p.station_idx % 30 = s.station_idx % 30 AS same, row_number() OVER (PARTITION BY p.station_idx ORDER BY (p.station_idx % 30 = s.station_idx % 30) DESC,
    round({HAV.format(a="p", b="s")}, 7), s.station_idx) AS i FROM ps p, sto s) WHERE i = 1""", km=4))
def anchor_in_cascade(spark, d):
    return rounded(_anchors(spark, d, "cascade"), km=4)


@query("nearest_land_cell", X.with_sql(X.STATIONS, SITES) + """
  SELECT station, CASE WHEN w.site % 3 <> 0 THEN w.site ELSE l.site END AS cell, w.site % 3 = 0 AS remapped FROM (
    SELECT station_idx AS station, site, row_number() OVER (PARTITION BY station_idx ORDER BY (p.lat - s.lat) ** 2 + (p.lon - s.lon) ** 2, site) AS i FROM sites p, stations s) w
  JOIN (SELECT station_idx AS station, site, row_number() OVER (PARTITION BY station_idx ORDER BY (p.lat - s.lat) ** 2 + (p.lon - s.lon) ** 2, site) AS i FROM sites p, stations s
        WHERE site % 3 <> 0) l USING (station) WHERE w.i = 1 AND l.i = 1""")
def nearest_land_cell(spark, d):
    cells = _sites(spark, d).select(F.col("site").alias("cell"), "lat", "lon", (F.col("site") % 3 != 0).alias("is_land"))
    st = X.stations(spark, d).select(F.col("station_idx").alias("station"), "lat", "lon")
    return WX.nearest_land_cell(st, cells)


CLUSTER = """
plants AS (SELECT c_custkey AS plant, c_acctbal AS capacity_mw, 10.0 + abs(c_acctbal) / 5000.0 AS lat, 20.0 + (c_custkey * 104729 % 991) / 500.0 AS lon FROM customer),
near AS (SELECT p.plant AS a, s.plant AS b FROM plants p, plants s WHERE p.plant <> s.plant AND abs(p.lat - s.lat) < 0.05 AND """ + HAV.format(a="p", b="s") + """ < 3),
reach(plant, seen) AS (SELECT plant, plant FROM plants UNION SELECT n.b, r.seen FROM reach r JOIN near n ON n.a = r.plant),
cl AS (SELECT plant, min(seen) AS cluster FROM reach GROUP BY ALL)
"""


def _plants(spark, d):
    k = F.col("c_custkey")
    return X.table(spark, d, "customer").select(k.alias("plant"), F.col("c_acctbal").alias("capacity_mw"), (10.0 + F.abs("c_acctbal") / 5000.0).alias("lat"),
                                               (20.0 + (k * 104729 % 991) / 500.0).alias("lon"))


@query("plant_clusters", X.with_sql(CLUSTER, recursive=True) + "SELECT plant, cluster FROM cl")
def plant_clusters(spark, d):
    return SP.merge_clusters(_plants(spark, d).select("plant", "lat", "lon"), 3.0)


@query("cluster_representatives", rounded_sql(X.with_sql(CLUSTER, recursive=True) + """
  SELECT cluster, arg_min(plant, (-capacity_mw, plant)) AS representative, count(*) AS n_plants, sum(capacity_mw) AS capacity_mw FROM cl JOIN plants USING (plant) GROUP BY ALL""", capacity_mw=3))
def cluster_representatives(spark, d):
    plants = _plants(spark, d)
    return rounded(SP.cluster_members(plants, SP.merge_clusters(plants.select("plant", "lat", "lon"), 3.0)), capacity_mw=3)


# Polygons: each nation an irregular pentagon.
RINGS = """
rings AS (SELECT n_nationkey AS poly, 0 AS ring, i AS seq, n_nationkey * 53 % 300 - 150 + [0, 30, 38, 14, -9][i + 1] + n_nationkey / 7.0 AS x,
            n_nationkey * 29 % 130 - 70 + [0, -6, 21, 33, 17][i + 1] + n_nationkey / 11.0 AS y FROM nation, range(0, 5) r(i)),
edges AS (SELECT a.poly, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM rings a JOIN rings b ON a.poly = b.poly AND b.seq = (a.seq + 1) % 5)
"""


def _edges(spark, d):
    k = F.col("n_nationkey")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, (x, y) in enumerate(((0, 0), (30, -6), (38, 21), (14, 33), (-9, 17)))])
    rings = X.table(spark, d, "nation").select(k.alias("poly"), F.lit(0).alias("ring"), F.explode(corners).alias("c")).select(
        "poly", "ring", F.col("c.i").alias("seq"), (F.col("poly") * 53 % 300 - 150 + F.col("c.dx") + F.col("poly") / 7.0).alias("x"),
        (F.col("poly") * 29 % 130 - 70 + F.col("c.dy") + F.col("poly") / 11.0).alias("y"))
    return SP.polygon_edges(rings)


INSIDE = """
cross_ AS (SELECT site, poly, count(*) AS n FROM sites, edges WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL),
inside AS (SELECT site, min(poly) AS poly FROM cross_ WHERE n % 2 = 1 GROUP BY ALL)
"""


@query("point_in_polygon", X.with_sql(SITES, RINGS, INSIDE) + "SELECT site, poly FROM sites LEFT JOIN inside USING (site)")
def point_in_polygon(spark, d):
    points = _sites(spark, d).withColumnRenamed("site", "point")
    return SP.point_in_polygon(points, _edges(spark, d)).select(F.col("point").alias("site"), "poly")


SEGDIST = """
(lon - (x1 + t * (x2 - x1))) ** 2 + (lat - (y1 + t * (y2 - y1))) ** 2
"""
SEGS = """
sd AS (SELECT site, poly, min(""" + SEGDIST + """) AS d2 FROM (SELECT *, greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM sites, edges) GROUP BY ALL),
closest AS (SELECT site, arg_min(poly, (round(d2, 9), poly)) AS poly, sqrt(min(d2)) AS distance FROM sd GROUP BY ALL)
"""


@query("locate_or_nearest", X.with_sql(SITES, RINGS, INSIDE, SEGS) + """
  SELECT site, coalesce(i.poly, n.poly) AS poly, i.poly IS NULL AS by_distance FROM sites LEFT JOIN inside i USING (site) JOIN closest n USING (site)""")
def locate_or_nearest(spark, d):
    points = _sites(spark, d).withColumnRenamed("site", "point")
    return SP.locate(points, _edges(spark, d)).select(F.col("point").alias("site"), "poly", "by_distance")


@query("basin_fill", rounded_sql(X.with_sql(SITES, RINGS, INSIDE) + """
  SELECT poly, avg(c_acctbal) AS mean_eff, arg_max(c_acctbal, (abs(c_acctbal), -site)) AS max_eff FROM inside JOIN customer ON c_custkey = site GROUP BY ALL""", mean_eff=7, max_eff=4))
def basin_fill(spark, d):
    from headrace.operators.summaries import basin_fill as fill
    points = _sites(spark, d).withColumnRenamed("site", "point")
    at = SP.point_in_polygon(points, _edges(spark, d)).join(X.table(spark, d, "customer").select(F.col("c_custkey").alias("point"), F.col("c_acctbal").alias("eff")), "point")
    out = fill(at, "poly", "eff").withColumnRenamed("eff", "mean_eff").join(fill(at, "poly", "eff", "max").withColumnRenamed("eff", "max_eff"), "poly")
    return rounded(out, mean_eff=7, max_eff=4)


@query("boxes_of_grid", X.with_sql(SITES, RINGS) + """
  SELECT CAST(poly AS VARCHAR) AS region, site FROM sites JOIN (SELECT poly, min(x1) - 0.5 AS xa, max(x1) + 0.5 AS xb, min(y1) - 0.5 AS ya, max(y1) + 0.5 AS yb FROM edges GROUP BY ALL)
  ON lon BETWEEN xa AND xb AND lat BETWEEN ya AND yb""")
def boxes_of_grid(spark, d):
    boxes = _edges(spark, d).groupBy(F.col("poly").cast("string").alias("region")).agg(
        F.min("x1").alias("lon_min"), F.max("x1").alias("lon_max"), F.min("y1").alias("lat_min"), F.max("y1").alias("lat_max"))
    return SP.in_boxes(_sites(spark, d), boxes).select("region", "site")


# Layers: a point, a line or a triangle at each site, by its number.
LAYER = """
layer AS (SELECT site AS feature, site % 3 = 2 AS closed, lon + ox1 AS x1, lat + oy1 AS y1, lon + ox2 AS x2, lat + oy2 AS y2 FROM (
    SELECT site, lon, lat, s.a[1] AS ox1, s.a[2] AS oy1, s.a[3] AS ox2, s.a[4] AS oy2
    FROM (SELECT *, site % 17 / 2.0 AS dx, site % 11 / 2.0 - 2 AS dy FROM sites) p, LATERAL (SELECT unnest(CASE site % 3 WHEN 0 THEN [[0.0::DOUBLE, 0, 0, 0]]
      WHEN 1 THEN [[0.0::DOUBLE, 0, dx, dy], [dx, dy, dx + 9, dy - 7]] ELSE [[0.0::DOUBLE, 0, dx + 1, dy], [dx + 1, dy, dx, dy + 3], [dx, dy + 3, 0, 0]] END) AS a) s))
"""


def _side_sql(x, y, e):
    return f"(({e}.x2 - {e}.x1) * ({y} - {e}.y1) - ({x} - {e}.x1) * ({e}.y2 - {e}.y1))"


def _apart_sql(p, q):
    s, t = _side_sql(f"{q}.x1", f"{q}.y1", p), _side_sql(f"{q}.x2", f"{q}.y2", p)
    return f"(({s} > 0 AND {t} > 0) OR ({s} < 0 AND {t} < 0))"


def _holds_sql(x, y, e):
    """The +x ray from (x, y) crosses edge e."""
    return f"(({e}.y1 > {y}) <> ({e}.y2 > {y}) AND {x} < {e}.x1 + ({y} - {e}.y1) * ({e}.x2 - {e}.x1) / ({e}.y2 - {e}.y1))"


def _clip_sql(area):
    boxes = " AND ".join(f"least(l.{a}1, l.{a}2) <= greatest(a.{a}1, a.{a}2) AND least(a.{a}1, a.{a}2) <= greatest(l.{a}1, l.{a}2)" for a in "xy")
    return f"""area AS ({area}),
  hit AS (SELECT DISTINCT feature FROM layer l, area a WHERE {boxes} AND NOT {_apart_sql("l", "a")} AND NOT {_apart_sql("a", "l")}
    UNION SELECT feature FROM (SELECT feature, l.x1, l.y1, poly FROM (SELECT DISTINCT feature, x1, y1 FROM layer) l, area a WHERE {_holds_sql("l.x1", "l.y1", "a")} GROUP BY ALL HAVING count(*) % 2 = 1)
    UNION SELECT feature FROM (SELECT feature, a.x1, a.y1 FROM (SELECT DISTINCT x1, y1 FROM area) a, layer l WHERE l.closed AND {_holds_sql("a.x1", "a.y1", "l")} GROUP BY ALL HAVING count(*) % 2 = 1))"""


def _layer(spark, d):
    k = F.col("site")
    dx, dy = k % 17 / 2.0, k % 11 / 2.0 - 2
    zero = F.lit(0.0)

    def segment(*ends):
        return F.struct(*[e.cast("double").alias(n) for e, n in zip(ends, ("a", "b", "c", "d"))])

    drawn = F.when(k % 3 == 0, F.array(segment(zero, zero, zero, zero))).when(
        k % 3 == 1, F.array(segment(zero, zero, dx, dy), segment(dx, dy, dx + 9, dy - 7))).otherwise(
        F.array(segment(zero, zero, dx + 1, dy), segment(dx + 1, dy, dx, dy + 3), segment(dx, dy + 3, zero, zero)))
    at = _sites(spark, d).select(k.alias("feature"), (k % 3 == 2).alias("closed"), "lon", "lat", F.explode(drawn).alias("s"))
    return at.select("feature", "closed", (F.col("lon") + F.col("s.a")).alias("x1"), (F.col("lat") + F.col("s.b")).alias("y1"),
                     (F.col("lon") + F.col("s.c")).alias("x2"), (F.col("lat") + F.col("s.d")).alias("y2"))


@query("clip_layer", X.with_sql(SITES, RINGS, LAYER, _clip_sql("SELECT * FROM edges WHERE poly % 5 = 1")) + "SELECT feature FROM hit")
def clip_layer(spark, d):
    return SP.clip_layer(_layer(spark, d), _edges(spark, d).filter("poly % 5 = 1"), "feature", cell=2.0)


_MID = "(SELECT (min(lat) + max(lat)) / 2 FROM kept)"
FLAT = f"""
kept AS (SELECT site, c_nationkey AS basin, lon, lat FROM sites JOIN customer ON c_custkey = site JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 4),
fp AS (SELECT site, basin, radians(lon) * cos(radians({_MID})) * 6371 AS lon, radians(lat) * 6371 AS lat FROM kept),
fe AS (SELECT poly, radians(x1) * cos(radians({_MID})) * 6371 AS x1, radians(y1) * 6371 AS y1, radians(x2) * cos(radians({_MID})) * 6371 AS x2, radians(y2) * 6371 AS y2 FROM edges)
"""


@query("pour_points", rounded_sql(X.with_sql(SITES, RINGS, FLAT, SEGS.replace("FROM sites, edges", "FROM fp, fe")) + """
  SELECT site AS plant, basin, poly AS river, distance AS km, basin < 2 AS is_outlet FROM closest JOIN fp USING (site) WHERE distance <= 900""", km=4))
def pour_points(spark, d):
    basin = F.col("c_nationkey")
    plants = _sites(spark, d).join(X.table(spark, d, "customer"), F.col("c_custkey") == F.col("site")).select(F.col("site").alias("plant"), basin.alias("basin"), "lon", "lat")
    n = F.col("n_nationkey")
    basins = X.table(spark, d, "nation").filter("n_regionkey <> 4").select(n.alias("basin"), F.when(n >= 2, n % 2).otherwise(-1).cast("int").alias("next_basin"))
    rivers = _edges(spark, d).select(F.col("poly").alias("river"), "x1", "y1", "x2", "y2")
    return rounded(SP.pour_points(plants, basins, rivers, 900.0), km=4)


@query("spaced_selection", """
  WITH l AS (SELECT list([{'point': c_custkey, 'x': (c_custkey * 7919 % 9973)::DOUBLE, 'y': (c_custkey * 104729 % 9967)::DOUBLE}] ORDER BY c_acctbal, c_custkey) AS a FROM customer)
  SELECT u.point, u.x, u.y FROM (SELECT unnest(list_reduce(a, lambda acc, p: CASE WHEN len(list_filter(acc, lambda q:
    (q.x - p[1].x) * (q.x - p[1].x) + (q.y - p[1].y) * (q.y - p[1].y) < 250000)) = 0 THEN list_concat(acc, p) ELSE acc END)) AS u FROM l)""")
def spaced_selection(spark, d):
    """The twin is the sequential loop as a fold over the ordered list."""
    k = F.col("c_custkey")
    points = X.table(spark, d, "customer").select(k.alias("point"), (k * 7919 % 9973).cast("double").alias("x"), (k * 104729 % 9967).cast("double").alias("y"), F.col("c_acctbal").alias("prio"))
    return SP.spaced_selection(points, 500.0, ["prio"]).select("point", "x", "y")


# ---- plants ----

PLANTS = """
pl AS (SELECT s.*, 0.5 + station_idx % 9 / 10.0 AS q_hist, CASE WHEN station_idx % 4 = 0 THEN NULL ELSE station_idx % 11 / 20.0 END AS ps_vol_km3 FROM stations s),
par AS (SELECT *, CASE WHEN type IN ('ROR', 'Canal') THEN 0 ELSE max_vol_km3 * 1e9 END AS v_max_m3, CASE WHEN type IN ('ROR', 'Canal') THEN 0 ELSE max_area_km2 * 1e6 END AS a_max_m2,
          CASE WHEN head_m > 200 THEN 0.87 WHEN head_m > 40 THEN 0.88 ELSE 0.86 END::DOUBLE AS eta_turb FROM pl)
"""


def _plant_table(spark, d):
    k = F.col("station_idx")
    return X.stations(spark, d).withColumn("q_hist", 0.5 + k % 9 / 10.0).withColumn("ps_vol_km3", F.when(k % 4 != 0, k % 11 / 20.0))


@query("static_parameters", rounded_sql(X.with_sql(X.STATIONS, PLANTS) + """
  SELECT station_idx, v_max_m3, a_max_m2, eta_turb, capacity_mw * 1e6 / (eta_turb * 9810.0 * head_m) AS q_max_turb,
    least(greatest(CASE WHEN v_max_m3 > 0 AND ps_vol_km3 > 0 THEN ps_vol_km3 * 1e9 / v_max_m3 ELSE 0.6 END, 0.3), 0.84) AS f_opt, CASE WHEN type = 'PS' THEN capacity_mw ELSE 0 END AS p_pump_mw,
    CASE WHEN type = 'PS' THEN capacity_mw * 1e6 * 0.9 / (9810.0 * head_m) ELSE 0 END AS q_max_pump FROM par""", v_max_m3=0, q_max_turb=5, f_opt=8, q_max_pump=5))
def static_parameters(spark, d):
    out = ST.static_parameters(_plant_table(spark, d)).select("station_idx", "v_max_m3", "a_max_m2", "eta_turb", "q_max_turb", "f_opt", "p_pump_mw", "q_max_pump")
    return rounded(out, v_max_m3=0, q_max_turb=5, f_opt=8, q_max_pump=5)


@query("regulation_category", rounded_sql(X.with_sql(X.STATIONS, PLANTS) + """
  SELECT station_idx, f_reg, CASE WHEN f_reg >= 1 THEN 'A' WHEN f_reg >= 0.001 THEN 'B' ELSE 'RoR' END AS category FROM (
    SELECT station_idx, CASE WHEN v_max_m3 > 0 THEN v_max_m3 / (40 * q_hist * 365.25 * 86400) ELSE 0 END AS f_reg FROM par)""", f_reg=8))
def regulation_category(spark, d):
    at = ST.static_parameters(_plant_table(spark, d)).withColumn("river_id", F.col("station_idx"))
    hist = at.select("river_id", (40 * F.col("q_hist")).alias("q_hist"))
    return rounded(ST.regulation(at.drop("q_hist"), hist).select("station_idx", "f_reg", "category"), f_reg=8)


@query("flow_capacity_screen", rounded_sql(X.with_sql(X.STATIONS, PLANTS) + """
  SELECT station_idx, r AS flow_cap_ratio, coalesce(r < 0.1 AND type <> 'PS', false) AS excluded FROM (
    SELECT station_idx, type, CASE WHEN capacity_mw > 0 THEN eta_turb * 9810.0 * q_hist * 1000 * head_m / 1e6 / capacity_mw END AS r FROM par)""", flow_cap_ratio=7))
def flow_capacity_screen(spark, d):
    at = _plant_table(spark, d).withColumn("q_hist", F.col("q_hist") * 1000)
    return rounded(ST.flow_capacity_screen(at).select("station_idx", "flow_cap_ratio", "excluded"), flow_cap_ratio=7)


@query("future_exclusion", X.with_sql(X.STATIONS) + """
  SELECT station_idx FROM stations WHERE capacity_mw > 0 AND (station_idx % 5 = 0 OR 2020 + station_idx % 13 <= 2027)""")
def future_exclusion(spark, d):
    at = X.stations(spark, d).withColumn("year_built", F.when(F.col("station_idx") % 5 != 0, 2020 + F.col("station_idx") % 13)).withColumn(
        "river_id", F.col("station_idx")).withColumn("merge_status", F.lit(None).cast("string"))
    return ST.exclude_future(ST.active_stations(at)).select("station_idx")


@query("bathymetry_fix", rounded_sql(X.with_sql(X.STATIONS, PLANTS) + """,
  raw AS (SELECT station_idx, type, head_m, max_area_km2 AS a0, max_vol_km3 AS v0, CASE WHEN station_idx % 3 = 0 THEN max_area_km2 * 25 ELSE max_area_km2 * 2 END AS ra, max_vol_km3 * 3 AS rv,
            v_max_m3, a_max_m2 FROM par),
  fx AS (SELECT *, type IN ('STO', 'PS') AND a0 / ra < 0.1 AND rv > 0 AS hit FROM raw)""".replace(",\n", ", ", 1) + """
  SELECT station_idx, CASE WHEN hit THEN ra ELSE a0 END AS max_area_km2, CASE WHEN hit THEN rv ELSE v0 END AS max_vol_km3,
    CASE WHEN v_max_m3 > 0 THEN a_max_m2 / 1e6 / pow(head_m, CASE WHEN hit THEN 1.81 ELSE 1.5 END) END AS bathy_a,
    CASE WHEN v_max_m3 > 0 THEN v_max_m3 / 1e9 / pow(head_m, CASE WHEN hit THEN 2.91 ELSE 2.5 END) END AS bathy_c, hit AS bathymetry_fixed FROM fx""", max_area_km2=6, max_vol_km3=8, bathy_a=9, bathy_c=12))
def bathymetry_fix(spark, d):
    a, v = F.col("max_area_km2"), F.col("max_vol_km3")
    null = F.lit(None).cast("double")
    at = ST.static_parameters(_plant_table(spark, d)).select(
        "station_idx", "type", "head_m", a, v, "v_max_m3", "a_max_m2", "ps_vol_km3", F.when(F.col("station_idx") % 3 == 0, a * 25).otherwise(a * 2).alias("res_area_km2"),
        (v * 3).alias("res_vol_km3"), null.alias("dam_height_m"), null.alias("max_head_m"), null.alias("ps_area_km2"), F.lit(2.0).alias("coeff_a"), F.lit(1.5).alias("coeff_b"),
        F.lit(3.0).alias("coeff_c"), F.lit(2.5).alias("coeff_d"))
    out = ST.anchor_bathymetry(ST.fix_bathymetry_mismatch(at)).select("station_idx", "max_area_km2", "max_vol_km3", "bathy_a", "bathy_c", "bathymetry_fixed")
    return rounded(out, max_area_km2=6, max_vol_km3=8, bathy_a=9, bathy_c=12)


@query("head_and_area_curves", rounded_sql(X.with_sql(X.STATIONS) + """
  SELECT station_idx, h, CASE WHEN h > 0 THEN 0.02 * pow(h, 1.81) * 1e6 ELSE 0 END AS area_m2, 7.2 * sqrt(head_m) AS width_m, 0.27 * pow(head_m, 0.3) AS depth_m FROM (
    SELECT station_idx, head_m, CASE WHEN max_vol_km3 > 0 THEN pow(max_vol_km3 / 0.001, 1 / 2.91) ELSE 0 END AS h FROM stations)""", h=8, area_m2=2, width_m=8, depth_m=8))
def head_and_area_curves(spark, d):
    h = hydraulics.head_from_volume(F.col("max_vol_km3") * 1e9, F.lit(0.001), F.lit(2.91))
    at = X.stations(spark, d).select("station_idx", "head_m", h.alias("h"))
    out = at.select("station_idx", "h", hydraulics.area_from_head("h", F.lit(0.02), F.lit(1.81)).alias("area_m2"), hydraulics.channel_width("head_m").alias("width_m"),
                    hydraulics.channel_depth("head_m", F.lit(None).cast("double")).alias("depth_m"))
    return rounded(out, h=8, area_m2=2, width_m=8, depth_m=8)


@query("pumped_storage_volume", rounded_sql(X.with_sql(X.STATIONS, PLANTS) + """
  SELECT station_idx, CASE WHEN taken THEN given WHEN hit THEN capacity_mw * 1e6 * 8 * 3600 / (0.88 * 9810.0 * head_m * 1e9) ELSE v END AS ps_vol_km3, hit AS ps_vol_estimated, taken AS ps_vol_verified FROM (
    SELECT *, type = 'PS' AND capacity_mw > 0 AND given IS NULL AND (hrs < 4 OR hrs > 200) AS hit, type = 'PS' AND coalesce(given > 0, false) AS taken FROM (
      SELECT *, station_idx % 11 / 500.0 AS v, CASE WHEN station_idx % 3 = 0 THEN station_idx % 2 / 100.0 END AS given,
             CASE WHEN station_idx % 11 > 0 THEN station_idx % 11 / 500.0 * 1e9 * 9810.0 * head_m / (capacity_mw * 1e6 * 3600) ELSE 0 END AS hrs FROM pl))""", ps_vol_km3=9))
def pumped_storage_volume(spark, d):
    """A third of the stations have a verified volume, half of these 0."""
    k = F.col("station_idx")
    at = _plant_table(spark, d).withColumn("ps_vol_km3", k % 11 / 500.0).withColumn("verified_ps_vol_km3", F.when(k % 3 == 0, k % 2 / 100.0))
    return rounded(ST.estimate_ps_volume(at).select("station_idx", "ps_vol_km3", "ps_vol_estimated", "ps_vol_verified"), ps_vol_km3=9)


CORR = """
corr AS (SELECT region, name, type AS original_type, CASE WHEN station_idx % 5 = 0 THEN 'STO' ELSE type END AS corrected_type, max_vol_km3 AS original_vol_km3,
           max_vol_km3 * (1 + station_idx % 4 / 10.0) AS corrected_vol_km3, capacity_mw AS original_cap_mw, capacity_mw + station_idx % 30 AS corrected_cap_mw FROM stations WHERE head_m > 100),
fixed AS (SELECT station_idx, coalesce(original_type <> corrected_type, false) AS type_changed,
            coalesce((original_vol_km3 = 0 AND corrected_vol_km3 > 0) OR (original_vol_km3 > 0 AND abs(corrected_vol_km3 - original_vol_km3) > 0.1 * original_vol_km3), false) AS vol_changed,
            coalesce(abs(corrected_cap_mw - original_cap_mw) > 10, false) AS cap_changed, type, corrected_type, max_vol_km3, corrected_vol_km3, capacity_mw, corrected_cap_mw
          FROM stations LEFT JOIN corr USING (region, name))
"""


def _corrected(spark, d):
    st = X.stations(spark, d)
    k = F.col("station_idx")
    corr = st.filter("head_m > 100").select(
        "region", "name", F.col("type").alias("original_type"), F.when(k % 5 == 0, "STO").otherwise(F.col("type")).alias("corrected_type"), F.col("max_vol_km3").alias("original_vol_km3"),
        (F.col("max_vol_km3") * (1 + k % 4 / 10.0)).alias("corrected_vol_km3"), F.col("capacity_mw").alias("original_cap_mw"), (F.col("capacity_mw") + k % 30).alias("corrected_cap_mw"))
    return ST.apply_corrections(st, corr)


@query("curated_corrections", rounded_sql(X.with_sql(X.STATIONS, CORR) + """
  SELECT station_idx, CASE WHEN type_changed THEN corrected_type ELSE type END AS type, CASE WHEN vol_changed THEN corrected_vol_km3 ELSE max_vol_km3 END AS max_vol_km3,
    CASE WHEN cap_changed THEN corrected_cap_mw ELSE capacity_mw END AS capacity_mw FROM fixed""", max_vol_km3=9, capacity_mw=6))
def curated_corrections(spark, d):
    return rounded(_corrected(spark, d).select("station_idx", "type", "max_vol_km3", "capacity_mw"), max_vol_km3=9, capacity_mw=6)


@query("correction_counts", X.with_sql(X.STATIONS, CORR) + """
  SELECT count(CASE WHEN type_changed THEN 1 END) AS n_type_changed, count(CASE WHEN vol_changed THEN 1 END) AS n_vol_changed, count(CASE WHEN cap_changed THEN 1 END) AS n_cap_changed FROM fixed""")
def correction_counts(spark, d):
    return ST.change_counts(_corrected(spark, d), ["type_changed", "vol_changed", "cap_changed"])


@query("verified_corrections", rounded_sql(X.with_sql(X.STATIONS) + """
  SELECT station_idx, CASE WHEN vh THEN v ELSE max_vol_km3 END AS max_vol_km3, CASE WHEN hh THEN h ELSE head_m END AS head_m, CASE WHEN ch THEN c ELSE capacity_mw END AS capacity_mw FROM (
    SELECT *, abs(max_vol_km3 - v) / greatest(v, 0.001) > 0.1 AS vh, h / head_m > 2 OR h / head_m < 0.5 AS hh, abs(capacity_mw - c) / greatest(capacity_mw, 1) > 0.15 AS ch FROM (
      SELECT *, max_vol_km3 * (0.8 + station_idx % 5 / 10.0) AS v, head_m * (0.3 + station_idx % 7 / 3.0) AS h, capacity_mw * (0.7 + station_idx % 6 / 8.0) AS c FROM stations))""",
    max_vol_km3=9, head_m=8, capacity_mw=6))
def verified_corrections(spark, d):
    st, k = X.stations(spark, d), F.col("station_idx")
    web = st.select("name", (F.col("max_vol_km3") * (0.8 + k % 5 / 10.0)).alias("verified_vol_km3"), (F.col("head_m") * (0.3 + k % 7 / 3.0)).alias("verified_head_m"),
                    (F.col("capacity_mw") * (0.7 + k % 6 / 8.0)).alias("verified_cap_mw"))
    return rounded(ST.apply_verified(st, web).select("station_idx", "max_vol_km3", "head_m", "capacity_mw"), max_vol_km3=9, head_m=8, capacity_mw=6)


@query("relocated_stations", rounded_sql(X.with_sql(X.STATIONS) + """
  SELECT station_idx, CASE WHEN type = 'PS' THEN station_idx + 1000 ELSE station_idx END AS river_id, CASE WHEN station_idx % 8 = 0 THEN lat + 1 ELSE lat END AS lat FROM stations""", lat=8))
def relocated_stations(spark, d):
    st, k = X.stations(spark, d).withColumn("river_id", F.col("station_idx")), F.col("station_idx")
    moves = st.filter("type = 'PS'").select("name", (k + 1000).alias("new_river_id"), F.when(k % 8 == 0, F.col("lat") + 1).alias("new_lat"), F.col("lon").alias("new_lon"))
    return rounded(ST.relocate(st, moves).select("station_idx", "river_id", "lat"), lat=8)


@query("river_id_fallback", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN -c_custkey END, c_nationkey) AS river_id FROM customer")
def river_id_fallback(spark, d):
    k = F.col("c_custkey")
    at = X.table(spark, d, "customer").select(k, F.when(k % 2 == 0, k).alias("snapped"), F.when(k % 3 == 0, -k).alias("final"), F.col("c_nationkey").cast("bigint").alias("matched"))
    return at.select("c_custkey", ST.river_id("snapped", "final", "matched").alias("river_id"))


@query("quality_filter", "SELECT doc_id, CASE quality WHEN 1 THEN 'A' ELSE 'C' END AS snap_quality FROM labels WHERE quality = 1 AND toxic = 0")
def quality_filter(spark, d):
    at = X.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("C").alias("snap_quality"), F.when(F.col("toxic") == 0, 1.0).alias("lat"), F.lit(0.0).alias("lon"))
    return ST.quality_filter(at).select("doc_id", "snap_quality")


@query("text_to_number", """
  SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 4 = 1 THEN NULL ELSE round(value, 2) END AS v FROM events""")
def text_to_number(spark, d):
    v = F.round("value", 2).cast("string")
    odd = F.when(F.col("event_id") % 4 == 1, F.concat(v, F.lit(" mw"))).otherwise(F.concat(F.lit(" "), v))
    return X.table(spark, d, "events").select("event_id", number(F.get_json_object("props", "$.k")).alias("k"), number(odd).alias("v"))


@query("type_labels", """
  SELECT CASE upper(trim(p_type)) WHEN 'ECONOMY' THEN 'STO' WHEN 'STANDARD' THEN 'ROR' WHEN 'PROMO' THEN 'PS' ELSE upper(trim(p_type)) END AS label, count(*) AS n FROM part GROUP BY ALL""")
def type_labels(spark, d):
    padded = F.concat(F.lit("  "), F.lower("p_type"))
    label = text.normalise_label(padded, {"ECONOMY": "STO", "STANDARD": "ROR", "PROMO": "PS"})
    return X.table(spark, d, "part").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("region_labels", """
  SELECT n_name, CASE WHEN n_regionkey = 0 THEN 'Region ' || n_nationkey ELSE CASE WHEN n_name LIKE 'NATION_2%' THEN 'Nation ' || split_part(n_name, '_', 2) || ' (US)' ELSE 'Nation ' || split_part(n_name, '_', 2) END END AS label
  FROM nation WHERE NOT (n_regionkey = 0 AND n_name LIKE 'NATION_2%') UNION ALL SELECT n_name, 'Region ' || n_nationkey || ' (US)' FROM nation WHERE n_regionkey = 0 AND n_name LIKE 'NATION_2%'""")
def region_labels(spark, d):
    nation, k = X.table(spark, d, "nation"), F.col("n_nationkey")
    labels = nation.filter("n_regionkey = 0").select("n_name", F.concat(F.lit("Region "), k.cast("string")).alias("given"))
    return nation.join(labels, "n_name", "left").select("n_name", text.region_display("n_name", "given", "NATION_2").alias("label"))


@query("station_names", X.with_sql(X.STATIONS) + """
  SELECT station_idx, 's' || CAST(round_even(abs(lat) * 1000, 0) AS INT) || CASE WHEN lat >= 0 THEN 'n' ELSE 's' END || CAST(round_even(abs(lon) * 1000, 0) AS INT) || CASE WHEN lon >= 0 THEN 'e' ELSE 'w' END AS code,
         round(lat, 3) AS lat, round(lon, 3) AS lon FROM stations""")
def station_names(spark, d):
    at = X.stations(spark, d).select("station_idx", geo.grid_station_name("lat", "lon").alias("code"))
    return rounded(at.select("station_idx", "code", *geo.grid_station_coords("code")), lat=3, lon=3)


@query("station_distances", rounded_sql(X.with_sql(X.STATIONS) + f"""
  SELECT p.station_idx, {HAV.format(a="p", b="s")} AS km FROM stations p JOIN stations s ON s.station_idx = p.station_idx // 2""", km=6))
def station_distances(spark, d):
    st = X.stations(spark, d).select("station_idx", "lat", "lon")
    down = st.select(F.col("station_idx").alias("down"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    at = st.withColumn("down", F.floor(F.col("station_idx") / 2)).join(down, "down")
    return rounded(at.select("station_idx", geo.haversine_km("lat", "lon", "la", "lo").alias("km")), km=6)


@query("name_matches", """
  WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size > 25 UNION SELECT 'no such ' || p_type FROM part),
  al AS (SELECT name, name AS alias, 0 AS k FROM w UNION ALL SELECT DISTINCT 'no such ' || p_type, p_type, 1 FROM part WHERE p_size % 2 = 0
         UNION ALL SELECT DISTINCT 'no such ' || p_type, substr(p_type, 2, 4), 2 FROM part WHERE p_size % 3 = 0),
  f AS (SELECT p_partkey AS feature, lower(p_name) AS a, lower(p_type) AS b FROM part),
  h AS (SELECT name, feature, 0 AS how, k, 0 AS o FROM al JOIN f ON a = lower(alias) UNION ALL SELECT name, feature, 0, k, 1 FROM al JOIN f ON b = lower(alias)
        UNION ALL SELECT name, feature, 1, k, 0 FROM al JOIN f ON contains(a, lower(alias)) UNION ALL SELECT name, feature, 1, k, 1 FROM al JOIN f ON contains(b, lower(alias))),
  m AS (SELECT name, min((how, k, o)) AS best FROM h GROUP BY ALL)
  SELECT w.name, how, count(DISTINCT feature) AS n FROM (SELECT w.name, h.feature, CASE WHEN h.how = 0 THEN 'exact' WHEN h.how = 1 THEN 'substring' ELSE 'unmatched' END AS how
    FROM w LEFT JOIN m USING (name) LEFT JOIN h ON h.name = w.name AND (h.how, h.k, h.o) = best) w GROUP BY ALL""")
def name_matches(spark, d):
    part = X.table(spark, d, "part")
    wanted = part.select(F.split("p_name", " ")[0].alias("name")).union(part.filter("p_size > 25").select("p_name")).union(
        part.select(F.concat(F.lit("no such "), "p_type")))
    none = F.concat(F.lit("no such "), "p_type").alias("name")
    aliases = part.filter("p_size % 2 = 0").select(none, F.col("p_type").alias("alias"), F.lit(1).alias("ord")).union(
        part.filter("p_size % 3 = 0").select(none, F.substring("p_type", 2, 4).alias("alias"), F.lit(2).alias("ord"))).distinct()
    hits = ST.match_names(wanted, part.select(F.col("p_partkey").alias("feature"), "p_name", "p_type"), ["p_name", "p_type"], aliases=aliases)
    return hits.groupBy("name", "how").agg(F.count("feature").alias("n"))


@query("packed_list_join", """
  SELECT w.tok AS province, count(*) AS n_parts, count(DISTINCT p_brand) AS n_brands FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tok FROM part) w GROUP BY ALL""")
def packed_list_join(spark, d):
    packed = X.table(spark, d, "part").select("p_brand", F.regexp_replace("p_name", " ", "|").alias("provinces"))
    return text.explode_list(packed, "provinces", r"\|", "province").groupBy("province").agg(F.count(F.lit(1)).alias("n_parts"), F.countDistinct("p_brand").alias("n_brands"))


@query("first_per_key", """
  SELECT p_brand, p_name, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY ALL""")
def first_per_key(spark, d):
    at = X.table(spark, d, "part").select("p_brand", "p_name", "p_partkey", "p_retailprice")
    return first_match(at, ["p_brand", "p_name"], ["p_partkey"])


@query("first_non_null", """
  SELECT user_id, arg_min(CASE WHEN value > 40 THEN value END, event_id) FILTER (value > 40) AS v, arg_min(event_type, event_id) FILTER (event_type <> 'click') AS kind FROM events GROUP BY ALL""")
def first_non_null(spark, d):
    from headrace.functions.core import first_non_null as pick
    at = X.table(spark, d, "events")
    return at.groupBy("user_id").agg(pick(F.when(F.col("value") > 40, F.col("value")), "event_id").alias("v"), pick(F.when(F.col("event_type") != "click", F.col("event_type")), "event_id").alias("kind"))


@query("input_keys", "SELECT s_suppkey, sha256(CAST(s_suppkey AS VARCHAR) || '|' || s_name) AS digest FROM supplier")
def input_keys(spark, d):
    return X.table(spark, d, "supplier").select("s_suppkey", text.input_key("s_suppkey", "s_name").alias("digest"))


@query("expanded_area", X.with_sql(SITES, RINGS, LAYER, """
  up(basin, spot) AS (SELECT n_nationkey, n_nationkey FROM nation UNION ALL SELECT u.basin, CAST(u.spot // 2 AS INT) FROM up u WHERE u.spot > 1),
  want AS (SELECT DISTINCT basin FROM up WHERE spot IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000))""",
    _clip_sql("SELECT * FROM edges WHERE poly IN (SELECT basin FROM want)"), recursive=True) + "SELECT feature FROM hit")
def expanded_area(spark, d):
    n = F.col("n_nationkey")
    basins = X.table(spark, d, "nation").select(n.alias("basin"), F.floor(n / 2).cast("int").alias("next_basin"))
    plants = X.table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("basin"))
    return SP.expand_area(basins, plants, _edges(spark, d).withColumnRenamed("poly", "basin"), _layer(spark, d), "feature", cell=2.0)


@query("channel_mapping", X.with_sql(X.STATIONS, SITES, """
  u AS (SELECT site AS unit, c_nationkey AS subbasin, CASE WHEN c_acctbal > 5000 THEN site % 150 END AS channel, lat, lon FROM sites JOIN customer ON c_custkey = site),
  own AS (SELECT station_idx AS channel, unit, subbasin, false AS by_distance FROM stations JOIN u ON u.channel = station_idx),
  near AS (SELECT s.station_idx AS channel, unit, subbasin, true AS by_distance, row_number() OVER (PARTITION BY s.station_idx ORDER BY (s.lat - u.lat) ** 2 + (s.lon - u.lon) ** 2, unit) AS i
           FROM stations s, u WHERE s.station_idx NOT IN (SELECT channel FROM own))""") + """
  SELECT m.channel, m.unit, m.subbasin, m.by_distance, s_suppkey AS aquifer FROM (SELECT channel, unit, subbasin, by_distance FROM own UNION ALL SELECT channel, unit, subbasin, by_distance FROM near WHERE i = 1) m
  LEFT JOIN supplier ON s_nationkey = m.subbasin""")
def channel_mapping(spark, d):
    from headrace.operators.features import channel_mapping as mapping
    channels = X.stations(spark, d).select(F.col("station_idx").alias("channel"), "lat", "lon")
    at = _sites(spark, d).join(X.table(spark, d, "customer"), F.col("c_custkey") == F.col("site"))
    units = at.select(F.col("site").alias("unit"), F.col("c_nationkey").alias("subbasin"), F.when(F.col("c_acctbal") > 5000, F.col("site") % 150).alias("channel"), "lat", "lon")
    aquifers = X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("subbasin"), F.col("s_suppkey").alias("aquifer"))
    return mapping(channels, units, aquifers).select("channel", "unit", "subbasin", "by_distance", "aquifer")


@query("study_resolution", "SELECT c_custkey, CASE WHEN a <= 1000000 THEN 500 WHEN a <= 2500000 THEN 750 WHEN a <= 5000000 THEN 1000 WHEN a <= 10000000 THEN 1500 ELSE 2000 END AS metres FROM (SELECT c_custkey, abs(c_acctbal) * 1500 AS a FROM customer)")
def study_resolution(spark, d):
    at = X.table(spark, d, "customer").select("c_custkey", (F.abs("c_acctbal") * 1500).alias("a"))
    return at.select("c_custkey", ST.dem_resolution("a").alias("metres"))
