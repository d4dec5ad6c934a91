"""The driver's tables in the roles of flow series, stations, networks and trade.

Every query reads these derived tables whole. The SQL texts are the same
derivations for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.session import reliable_checkpoint


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Hourly flow: station = event type, natural = sum of values, regulated = weighted by the JSON property.
HOURLY = """
hourly AS (
  SELECT event_type AS station, date_trunc('hour', ts) AS ts, sum(value) AS q_nat,
         sum(value * (0.6 + 0.008 * CAST(json_extract_string(props, '$.k') AS DOUBLE))) AS q_bal
  FROM events GROUP BY 1, 2),
hflow AS (
  SELECT station, s.scenario, CAST(year(ts) AS INT) AS year,
         CAST((dayofyear(ts) - 1) * 24 + hour(ts) AS INT) AS hoy,
         CASE WHEN s.scenario = 'nat' THEN q_nat ELSE q_bal END AS q
  FROM hourly, (VALUES ('nat'), ('BAL_C')) AS s(scenario))
"""


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").groupBy(
        F.col("event_type").alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    ).agg(F.sum("value").alias("q_nat"), F.sum(F.col("value") * (0.6 + 0.008 * k)).alias("q_bal"))


def stack(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Scenario columns to rows. ``columns``: scenario to column."""
    parts = [F.struct(F.lit(s).alias("scenario"), F.col(c).alias("q")) for s, c in columns.items()]
    return df.select(*keys, F.explode(F.array(*parts)).alias("s")).select(*keys, "s.*")


def hourly_flow(spark: SparkSession, folder: str) -> DataFrame:
    at = hourly(spark, folder).select(
        "station", F.year("ts").alias("year"), cal.hour_of_year("ts").alias("hoy"), "q_nat", "q_bal")
    return stack(at, ["station", "year", "hoy"], {"nat": "q_nat", "BAL_C": "q_bal"})


# Daily flow: station = supplier; natural = quantity, CONV after discount, BAL_C after tax.
DAILY = """
daily AS (
  SELECT l_suppkey AS station_idx, CAST(year(l_shipdate) AS INT) AS year,
         CAST((dayofyear(l_shipdate) - 1) * 24 AS INT) AS hoy, sum(l_quantity) AS q_nat,
         sum(l_quantity * (1 - l_discount)) AS q_conv, sum(l_quantity * (1 + l_tax)) AS q_bal
  FROM lineitem GROUP BY 1, 2, 3),
dflow AS (
  SELECT station_idx, s.scenario, year, hoy,
         CASE s.scenario WHEN 'nat' THEN q_nat WHEN 'CONV' THEN q_conv ELSE q_bal END AS q
  FROM daily, (VALUES ('nat'), ('CONV'), ('BAL_C')) AS s(scenario))
"""


#: Lines that a task sums to days. Nearly every (station, day) of suppliers has one line, so sums before the shuffle save nothing.
LINES_PER_TASK = 500_000


def daily_wide(spark: SparkSession, folder: str, station: Column | None = None) -> DataFrame:
    """The lines go to tasks by station and day before they are summed; a task's table of sums is bounded by LINES_PER_TASK."""
    q = F.col("l_quantity")
    key = F.col("l_suppkey") if station is None else station
    lines = table(spark, folder, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_PER_TASK))
    day = lines.select(key.alias("station_idx"), F.year("l_shipdate").alias("year"),
                       ((F.dayofyear("l_shipdate") - 1) * 24).cast("int").alias("hoy"), "l_quantity", "l_discount", "l_tax")
    return day.repartition(tasks, "station_idx", "year", "hoy").groupBy("station_idx", "year", "hoy").agg(
        F.sum(q).alias("q_nat"), F.sum(q * (1 - F.col("l_discount"))).alias("q_conv"),
        F.sum(q * (1 + F.col("l_tax"))).alias("q_bal"))


def daily_flow(spark: SparkSession, folder: str) -> DataFrame:
    return stack(daily_wide(spark, folder), ["station_idx", "year", "hoy"],
                 {"nat": "q_nat", "CONV": "q_conv", "BAL_C": "q_bal"})


# Dense daily flow: station = line number, nearly every day present.
DENSE = """
dense AS (
  SELECT l_linenumber AS station_idx, CAST(year(l_shipdate) AS INT) AS year,
         CAST((dayofyear(l_shipdate) - 1) * 24 AS INT) AS hoy, sum(l_quantity) AS q_nat,
         sum(l_quantity * (1 - 4 * l_discount)) AS q_bal
  FROM lineitem GROUP BY 1, 2, 3),
dense_flow AS (
  SELECT station_idx, s.scenario, year, hoy, CASE WHEN s.scenario = 'nat' THEN q_nat ELSE q_bal END AS q
  FROM dense, (VALUES ('nat'), ('BAL_C')) AS s(scenario))
"""


def dense_flow(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity")
    at = table(spark, folder, "lineitem").groupBy(
        F.col("l_linenumber").alias("station_idx"), F.year("l_shipdate").alias("year"),
        ((F.dayofyear("l_shipdate") - 1) * 24).cast("int").alias("hoy"),
    ).agg(F.sum(q).alias("q_nat"), F.sum(q * (1 - 4 * F.col("l_discount"))).alias("q_bal"))
    return stack(at, ["station_idx", "year", "hoy"], {"nat": "q_nat", "BAL_C": "q_bal"})


# Stations: suppliers with their nation as region and its region as bloc.
STATIONS = """
stations AS (
  SELECT s_suppkey AS station_idx, s_name AS name, n_name AS region, r_name AS bloc, s_acctbal AS capacity_mw,
         CAST(s_suppkey * 37 % 160 - 80 AS DOUBLE) + (s_suppkey * 7919 % 1000) / 1000.0 AS lat,
         CAST(s_suppkey * 61 % 360 - 180 AS DOUBLE) + (s_suppkey * 104729 % 1000) / 1000.0 AS lon,
         CASE s_suppkey % 4 WHEN 0 THEN 'PS' WHEN 1 THEN 'STO' WHEN 2 THEN 'ROR' ELSE 'Canal' END AS type,
         CAST(10 + s_suppkey * 13 % 290 AS DOUBLE) AS head_m,
         CAST(s_suppkey * 17 % 101 AS DOUBLE) / 10.0 AS max_vol_km3,
         CAST(1 + s_suppkey * 29 % 400 AS DOUBLE) AS max_area_km2
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def station_columns(key: Column) -> list[Column]:
    """Coordinates and plant facts that follow from a key."""
    kind = F.when(key % 4 == 0, "PS").when(key % 4 == 1, "STO").when(key % 4 == 2, "ROR").otherwise("Canal")
    return [
        ((key * 37 % 160 - 80).cast("double") + (key * 7919 % 1000) / 1000.0).alias("lat"),
        ((key * 61 % 360 - 180).cast("double") + (key * 104729 % 1000) / 1000.0).alias("lon"),
        kind.alias("type"), (10 + key * 13 % 290).cast("double").alias("head_m"),
        ((key * 17 % 101).cast("double") / 10.0).alias("max_vol_km3"),
        (1 + key * 29 % 400).cast("double").alias("max_area_km2"),
    ]


def stations(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return at.select(F.col("s_suppkey").alias("station_idx"), F.col("s_name").alias("name"), F.col("n_name").alias("region"),
                     F.col("r_name").alias("bloc"), F.col("s_acctbal").alias("capacity_mw"),
                     *station_columns(F.col("s_suppkey")))


def station_links(spark: SparkSession, folder: str, step: int) -> DataFrame:
    """(a, b): cascades as chains of stations whose keys differ by ``step``; a link to itself for each station."""
    key = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("a"))
    up = key.select((F.col("a") + step).alias("a"), F.col("a").alias("b"))
    return key.join(up, "a").unionByName(key.withColumn("b", F.col("a")))


# River network: node = customer key + 1, downstream = node div 2; upstream area shrinks away from the mouth.
NETWORK = """
network AS (
  SELECT c_custkey + 1 AS river_id, (c_custkey + 1) // 2 AS next_down,
         1.0 + abs(c_acctbal) / 1000.0 AS length_km, 10.0 + c_custkey % 7 AS catch_skm,
         100000.0 / (c_custkey + 1) AS upland_skm, CAST(c_custkey * 7 % 60 AS DOUBLE) AS irrigated_pct,
         CAST(c_custkey * 3 % 50 AS DOUBLE) AS slope_dm_per_km, CAST(c_custkey * 11 % 100 AS DOUBLE) AS protected_pct
  FROM customer)
"""


def network(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        (k + 1).alias("river_id"), F.floor((k + 1) / 2).alias("next_down"),
        (1.0 + F.abs("c_acctbal") / 1000.0).alias("length_km"), (10.0 + k % 7).alias("catch_skm"),
        (100000.0 / (k + 1)).alias("upland_skm"), (k * 7 % 60).cast("double").alias("irrigated_pct"),
        (k * 3 % 50).cast("double").alias("slope_dm_per_km"), (k * 11 % 100).cast("double").alias("protected_pct"))


# Dams: each supplier sits on the reach with five times its key + 3.
DAMS = "dams AS (SELECT DISTINCT d.dam FROM (SELECT s_suppkey * 5 + 3 AS dam FROM supplier) d)"


def dams(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select((F.col("s_suppkey") * 5 + 3).alias("dam")).distinct()


# Trade: orders served by the suppliers of their lines, nation to nation.
FLOWS = """
flows AS (
  SELECT sn.n_name AS src_region, cn.n_name AS dc_region, sum(l_extendedprice) / 1000.0 AS sent_mw,
         sum(l_extendedprice * (1 - l_discount)) / 1000.0 AS delivered_mw,
         sum(l_extendedprice * l_discount) / 1000.0 AS loss_mw, o_orderstatus AS scenario
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey GROUP BY 1, 2, o_orderstatus)
"""


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines are summed by (order, supplier nation) sides only at the end: one aggregate after the joins."""
    nation = table(spark, folder, "nation")
    source = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("src_region"))
    sink = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("dc_region"))
    order = table(spark, folder, "orders").join(sink, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "dc_region", F.col("o_orderstatus").alias("scenario"))
    price = F.col("l_extendedprice")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    at = lines.join(source, F.col("l_suppkey") == F.col("s_suppkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    return at.groupBy("src_region", "dc_region", "scenario").agg(
        (F.sum(price) / 1000.0).alias("sent_mw"), (F.sum(price * (1 - F.col("l_discount"))) / 1000.0).alias("delivered_mw"),
        (F.sum(price * F.col("l_discount")) / 1000.0).alias("loss_mw"))


def flows_once(spark: SparkSession, folder: str) -> DataFrame:
    """The flow table kept for plans that read it several times: nations squared x statuses rows."""
    return reliable_checkpoint(flows(spark, folder))


# Transmission lines: one per order between the customer's nation and a neighbour.
LINES = """
lines AS (
  SELECT 'NATION_' || CAST(c_nationkey AS VARCHAR) AS region_a,
         'NATION_' || CAST((c_nationkey + CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END) % 25 AS VARCHAR) AS region_b,
         o_totalprice / 1000.0 AS capacity_mw,
         CASE o_orderkey % 5 WHEN 0 THEN 'HVDC' WHEN 1 THEN 'MIXED' ELSE 'AC' END AS type,
         CASE o_orderstatus WHEN 'F' THEN 'existing' WHEN 'O' THEN 'planned' ELSE 'inactive' END AS status,
         CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 2026 + o_orderkey % 12 END AS INT) AS expected_year,
         'line ' || CAST(o_orderkey AS VARCHAR) AS line_name
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    o, n = F.col("o_orderkey"), F.col("c_nationkey")
    at = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hop = F.when(o % 3 == 0, 1).when(o % 3 == 1, 2).otherwise(5)
    return at.select(
        F.concat(F.lit("NATION_"), n.cast("string")).alias("region_a"),
        F.concat(F.lit("NATION_"), ((n + hop) % 25).cast("string")).alias("region_b"),
        (F.col("o_totalprice") / 1000.0).alias("capacity_mw"),
        F.when(o % 5 == 0, "HVDC").when(o % 5 == 1, "MIXED").otherwise("AC").alias("type"),
        F.when(F.col("o_orderstatus") == "F", "existing").when(F.col("o_orderstatus") == "O", "planned")
        .otherwise("inactive").alias("status"),
        F.when(o % 7 != 0, 2026 + o % 12).cast("int").alias("expected_year"),
        F.concat(F.lit("line "), o.cast("string")).alias("line_name"))


def with_sql(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"
