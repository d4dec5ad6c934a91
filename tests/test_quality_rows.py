"""Checks that return rows, and joins back of hot values."""

from pyspark.sql import functions as F

from headrace.operators import quality as Q
from headrace.operators import ranking as R
from headrace.operators import sediment as S
from headrace.operators import trade as T


def test_missing_columns(spark):
    a = spark.createDataFrame([(1, None)], "x int, y int")
    b = spark.createDataFrame([], "z int")
    got = {tuple(r) for r in Q.missing_columns({"a": a, "b": b}, {"a": ["x", "y", "w"], "b": ["z"]}).collect()}
    assert got == {("a", "y", "empty"), ("a", "w", "absent"), ("b", "z", "empty")}


def test_parameter_violations(spark):
    rows = [("a", "atc", 1.0), ("b", "atc", 0.0), ("c", "loss", 0.0), ("d", "loss", 1.0), ("e", "scale", 0.0), ("f", "iterations", 1.0), ("g", "what", 1.0), ("h", "loss", None)]
    assert {r["name"] for r in Q.parameter_violations(spark.createDataFrame(rows, "name string, kind string, value double")).collect()} == {"b", "d", "e", "g", "h"}


def test_percent_rank_spreads_a_hot_value(spark):
    """A value of a third of the rows is joined back in many tasks."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    df = df.unionByName(spark.createDataFrame([(-1, None)], "id long, v long"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.percent_rank_average(df, [], "v")
        tasks = {r["t"] for r in out.filter("v = 7").select(F.spark_partition_id().alias("t")).distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) > 1
    values = sorted(r["v"] for r in df.filter("v IS NOT NULL").collect())
    got = {r["id"]: r["pct_rank"] for r in out.collect()}
    assert len(got) == 3001 and got[-1] is None
    low, high = values.index(7) + 1, len(values) - values[::-1].index(7)
    assert abs(got[0] - (low + high) / 2 / len(values)) < 1e-12 and abs(got[2999] - 1) < 1e-12


def test_peak_ratios_scan_once(spark, tmp_path):
    rows = [("s", y, float(i % 7), float((i * 5) % 11)) for y in (2001, 2002) for i in range(30)]
    spark.createDataFrame(rows, "k string, year int, q_nat double, q_reg double").write.parquet(str(tmp_path / "p"))
    out = S.peak_ratios(spark.read.parquet(str(tmp_path / "p")), ["k"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    r = out.first()
    assert (r["annualmax_nat"], r["annualmax_reg"]) == (6.0, 10.0)


def test_target_profile_of_partial_years(spark):
    alloc = spark.createDataFrame([("A", "X", 2.0), ("A", "Y", 3.0), ("B", "Y", 1.0), ("B", "Z", 1.0)], "src_region string, dc_region string, sent_mw double")
    shapes = spark.createDataFrame([("X", 2020, 0, 0.5), ("X", 2020, 8783, 1.0), ("Y", 2020, 0, 0.25), ("Y", 2020, 1, None), ("Y", 2021, 4, 1.0)], "region string, year int, hoy int, shape double")
    got = {tuple(r) for r in T.source_target_profile(alloc, shapes, keys=()).collect()}
    assert got == {("A", 2020, 0, 1.75), ("A", 2020, 8783, 2.0), ("A", 2020, 1, None), ("A", 2021, 4, 3.0), ("B", 2020, 0, 0.25), ("B", 2020, 1, None), ("B", 2021, 4, 1.0)}


def test_write_observed(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5), (None, 6), (-3.0, 70), (9.0, None)], "a double, b int")
    path = str(tmp_path / "out")
    got = {r["field"]: tuple(r)[1:] for r in Q.write_observed(df, path, ["a", "b"], {"a": (0, 8)}).collect()}
    assert got == {"a": (4, 3, 2, -3.0, 9.0), "b": (4, 3, 0, 5.0, 70.0)}
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, df.collect()))
    none = Q.write_observed(df.filter("false"), str(tmp_path / "none"), ["a"], {"a": (None, 8)}).collect()
    assert [tuple(r) for r in none] == [("a", 0, 0, 0, None, None)]
