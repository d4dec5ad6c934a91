"""Tables written to a folder of the run and read back with the library's own readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from headrace.operators import quality
from headrace.operators.ranking import running_totals
from headrace.plans import standins as X
from headrace.plans.registry import query, rounded, rounded_sql
from headrace.schemas import METRIC, STATION
from headrace.session import run_folder
from headrace.sources import loads, sinks, tables, text


@query("station_csv", rounded_sql("""
  SELECT 'sul' AS path_region, s_name AS name, round(s_acctbal, 2) AS lat, NULL AS lon, CAST(s_nationkey AS DOUBLE) AS capacity_mw,
         row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL
  SELECT 'peru', s_name, NULL, round(s_acctbal, 2), CASE WHEN s_nationkey > 3 THEN s_nationkey END,
         (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) + row_number() OVER (ORDER BY s_suppkey) FROM supplier WHERE s_suppkey % 2 = 1""", lat=2, lon=2))
def station_csv(spark, d):
    """S-1: two files with differing columns; ``i`` is the place in the order of rows."""
    folder, at = run_folder(spark), X.table(spark, d, "supplier")
    even = at.filter("s_suppkey % 2 = 0").orderBy("s_suppkey").select(
        F.col("s_name").alias("name"), F.bround("s_acctbal", 2).alias("lat"), F.col("s_nationkey").alias("capacity_mw"), F.lit("a,b").alias("extra"))
    odd = at.filter("s_suppkey % 2 = 1").orderBy("s_suppkey").select(
        F.bround("s_acctbal", 2).alias("lon"), F.concat(F.lit(" "), "s_name").alias("name"), F.when(F.col("s_nationkey") > 3, F.col("s_nationkey").cast("string")).otherwise("nan").alias("capacity_mw"))
    for part, name in ((even, "sul"), (odd, "peru")):  # files follow one another in the order of keys
        part.write.option("header", True).csv(f"{folder}/{name}/hydro")
    back = tables.read_station_csv(spark, [f"{folder}/sul/hydro", f"{folder}/peru/hydro"], STATION, region_pattern=r"([^/]+)/hydro/[^/]+$")
    ranked = running_totals(back, [], ["row_ord"], {}, row_number="i", hot_rows=500)
    return rounded(ranked.select("path_region", "name", "lat", "lon", "capacity_mw", "i"), lat=2, lon=2)


@query("delimited_load", rounded_sql(X.with_sql(X.HOURLY) + "SELECT 'load; ' || station AS area, ts, round(q_nat, 4) AS load_mw FROM hourly WHERE q_nat < 180", load_mw=4))
def delimited_load(spark, d):
    """S-8: a text file with lead-in lines, a header and quoted fields that hold the separator."""
    folder, at = run_folder(spark), X.hourly(spark, d)
    mw = F.when(F.col("q_nat") < 180, F.round("q_nat", 4).cast("string")).otherwise("n/a")
    rows = at.select(F.concat_ws(";", F.date_format("ts", "dd.MM.yyyy HH:mm"), F.concat(F.lit('"load; '), "station", F.lit('"')), mw).alias("value"))
    lead = spark.createDataFrame([("Report of loads",), ("all times local",), ("Time;Area;MW",)], "value string")
    lead.unionByName(rows).write.text(folder)
    fields = loads.read_delimited(spark, folder, ["t", "area", "mw"], sep=";", header_starts="Time;")
    return rounded(loads.load_rows(fields, F.col("area"), loads.parse_time("t", "dd.MM.yyyy HH:mm"), loads.number("mw")), load_mw=4)


@query("scenario_catalog", """
  SELECT DISTINCT r_name AS region, o_orderpriority AS gcm, o_orderstatus AS ssp, 'flat' AS tag FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 2 = 1 AND contains(r_name, 'A')""")
def scenario_catalog(spark, d):
    """S-15: combinations of a table partitioned by run."""
    folder = run_folder(spark)
    nations = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = X.table(spark, d, "orders").join(X.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    at.select(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("gcm"), F.col("o_orderstatus").alias("ssp"),
              F.when(F.col("o_orderkey") % 2 == 1, "flat").otherwise("base").alias("tag"), "o_totalprice").repartition("region", "gcm", "ssp", "tag").write.partitionBy(
        "region", "gcm", "ssp", "tag").parquet(folder)
    return tables.scenario_catalog(spark, folder, tag="flat", contains="A")


@query("metric_table", rounded_sql("""
  SELECT r_name AS region, o_orderstatus AS scenario_tag, 'STCI' AS metric, max(CASE WHEN o_orderstatus = 'P' THEN 2.0 ELSE 1.0 END) * avg(o_totalprice) AS value_nat,
         avg(o_totalprice) / 2 AS value_reg, 'b_low' AS param
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderstatus""", value_nat=4, value_reg=4))
def metric_table(spark, d):
    """S-18, P-23: the tidy metric table; a second run replaces the folders of one scenario only."""
    folder = run_folder(spark)
    nations = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = X.table(spark, d, "orders").join(X.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    means = at.groupBy(F.col("r_name").alias("region"), F.col("o_orderstatus").alias("scenario_tag")).agg(F.avg("o_totalprice").alias("n"))
    means = means.select("*", (F.col("n") / 2).alias("r"), F.lit("g").alias("gcm"), F.lit("s").alias("ssp"))
    sinks.write_long_table(sinks.metric_rows(means, "sediment", "STCI", "n", "r", param="b_low"), folder)
    again = means.filter("scenario_tag = 'P'").withColumn("n", F.col("n") * 2)
    sinks.write_long_table(sinks.metric_rows(again, "sediment", "STCI", "n", "r", param="b_low"), folder)
    back = tables.read_columns(spark, folder, ["region", "scenario_tag", "metric", "value_nat", "value_reg", "param"])
    assert {f.name for f in METRIC} == set(spark.read.parquet(folder).columns)
    return rounded(back, value_nat=4, value_reg=4)


@query("period_grid", """
  SELECT l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_discount > 0 THEN l_quantity END AS value FROM lineitem WHERE l_suppkey % 2 = 0 UNION ALL
  SELECT l_suppkey, l_linenumber, CAST(l_shipdate AS DATE), CASE WHEN l_discount > 0 THEN l_quantity END FROM lineitem WHERE l_suppkey % 2 = 1""")
def period_grid(spark, d):
    """S-2, S-13, S-19: named outputs in folders, read as the periods of one grid, NaN as NULL."""
    folder, at = run_folder(spark), X.table(spark, d, "lineitem")
    value = F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("double")).otherwise(float("nan"))
    rows = at.select("l_suppkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), value.alias("value"), "l_tax")
    sinks.write_outputs({f"period{k}": rows.filter(F.col("l_suppkey") % 2 == k) for k in (0, 1)}, folder)
    return tables.read_grid(spark, [f"{folder}/period{k}" for k in (0, 1)], ["l_suppkey", "l_linenumber", "day", "value"])


@query("xml_load", rounded_sql(X.with_sql(X.HOURLY) + "SELECT station AS area, ts, round(q_nat, 4) AS load_mw FROM hourly WHERE q_nat < 180", load_mw=4))
def xml_load(spark, d):
    """S-11, X-9: a folder of XML rows per area, written and read back; a row whose value is no number is left out."""
    folder, at = run_folder(spark), X.hourly(spark, d)
    mw = F.when(F.col("q_nat") < 180, F.round("q_nat", 4).cast("string")).otherwise("n/a")
    at.select("station", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DT"), mw.alias("MW")).write.partitionBy("station").format("xml").option(
        "rowTag", "DataTable").option("rootTag", "NewDataSet").save(folder)
    areas = sorted(r["station"] for r in at.select("station").distinct().collect())  # one folder each
    parts = [loads.read_xml(spark, f"{folder}/station={a}", area=a) for a in areas]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out.select("area", "ts", "load_mw"), load_mw=4)


@query("station_weather_files", rounded_sql(X.with_sql(X.HOURLY) + """
  SELECT station AS station, ts::DATE AS date, round(max(q_nat), 3) AS tmax, round(min(q_nat), 3) AS tmin, (round(max(q_nat), 3) + round(min(q_nat), 3)) / 2 AS tmp_ave,
         sum(round(q_bal, 3)) AS precip_mm FROM hourly GROUP BY ALL""", tmp_ave=6, precip_mm=3))
def station_weather_files(spark, d):
    """S-22, S-6: temperature and rain files per station, written and read back as text."""
    at, folder = X.hourly(spark, d).withColumn("date", F.to_date("ts")), run_folder(spark)
    place = [F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")]
    tmp = at.groupBy("station", "date").agg(F.round(F.max("q_nat"), 3).alias("tmax"), F.round(F.min("q_nat"), 3).alias("tmin")).select("*", *place)
    pcp = at.select("station", "date", F.hour("ts").alias("hour"), F.round("q_bal", 3).alias("value"), *place)
    sinks.write_station_weather(sinks.station_weather_lines(tmp, "tmp").unionByName(sinks.station_weather_lines(pcp, "pcp")), folder)
    lines = spark.read.text(folder)  # station and ext are folders
    back = lines.select(F.col("station").alias("file"), "ext", "value")
    warm = text.temperature(text.tokens(back.filter("ext = 'tmp'").drop("ext")))
    wet = text.rain(text.tokens(back.filter("ext = 'pcp'").drop("ext"))).groupBy("file", F.to_date("ts").alias("date")).agg(F.sum("precip_mm").alias("precip_mm"))
    return rounded(warm.join(wet, ["file", "date"]).withColumnRenamed("file", "station"), tmp_ave=6, precip_mm=3)


@query("missing_columns", """
  SELECT 'nation' AS table_name, 'n_area' AS column_name, 'absent' AS reason UNION ALL SELECT 'orders', 'o_discount', 'absent'
  UNION ALL SELECT 'orders', 'rebate', 'empty' FROM orders HAVING count(CASE WHEN o_totalprice < 0 THEN 1 END) = 0
  UNION ALL SELECT 'orders', 'big', 'empty' FROM orders HAVING count(CASE WHEN o_totalprice > 1000 THEN 1 END) = 0""")
def missing_columns(spark, d):
    """Q-1: required columns that the tables lack, or that are wholly NULL, as rows."""
    price = F.col("o_totalprice")
    orders = X.table(spark, d, "orders").withColumns({"rebate": F.when(price < 0, price), "big": F.when(price > 1000, price)})
    found = {"nation": X.table(spark, d, "nation"), "orders": orders}
    return quality.missing_columns(found, {"nation": ["n_nationkey", "n_area"], "orders": ["o_orderkey", "rebate", "big", "o_discount"]})


@query("parameter_violations", """
  SELECT name, kind, value FROM (SELECT 'p' || l_orderkey || '.' || l_linenumber AS name, CASE l_linenumber % 4 WHEN 0 THEN 'atc' WHEN 1 THEN 'loss' WHEN 2 THEN 'scale' ELSE 'iterations' END AS kind,
    CASE l_linenumber % 4 WHEN 0 THEN l_discount * 20 WHEN 1 THEN l_tax * 13 - 0.01 WHEN 2 THEN l_discount ELSE l_quantity / 10 END AS value FROM lineitem)
  WHERE NOT CASE kind WHEN 'atc' THEN value > 0 AND value <= 1 WHEN 'loss' THEN value >= 0 AND value < 1 WHEN 'scale' THEN value > 0 ELSE value >= 1 END""")
def parameter_violations(spark, d):
    """Q-7: settings outside their domain, as rows."""
    k = F.col("l_linenumber") % 4
    kind = F.when(k == 0, "atc").when(k == 1, "loss").when(k == 2, "scale").otherwise("iterations")
    value = F.when(k == 0, F.col("l_discount") * 20).when(k == 1, F.col("l_tax") * 13 - 0.01).when(k == 2, F.col("l_discount")).otherwise(F.col("l_quantity") / 10)
    name = F.concat(F.lit("p"), "l_orderkey", F.lit("."), "l_linenumber")
    return quality.parameter_violations(X.table(spark, d, "lineitem").select(name.alias("name"), kind.alias("kind"), value.alias("value")))


@query("observed_write", """
  SELECT 'quantity' AS field, count(*) AS n_rows, count(l_quantity) AS n_known, count(*) FILTER (l_quantity < 2 OR l_quantity > 40) AS n_outside,
    CAST(min(l_quantity) AS DOUBLE) AS lowest, CAST(max(l_quantity) AS DOUBLE) AS highest FROM lineitem UNION ALL
  SELECT 'discount', count(*), count(CASE WHEN l_discount > 0.02 THEN 1 END), count(*) FILTER (l_discount > 0.09),
    CAST(min(CASE WHEN l_discount > 0.02 THEN l_discount END) AS DOUBLE), CAST(max(CASE WHEN l_discount > 0.02 THEN l_discount END) AS DOUBLE) FROM lineitem""")
def observed_write(spark, d):
    """Q-2, Q-8, A-20: range and gap counts from the pass that writes the table."""
    at = X.table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount"))
    return quality.write_observed(at, run_folder(spark), ["quantity", "discount"], {"quantity": (2, 40), "discount": (None, 0.09)})
