"""Learning tables: drops, held-out months and scores."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from headrace.operators import features as M
from headrace.sources import tables


def test_training_set_drops_and_splits(spark):
    months = [dt.datetime(2000 + m // 12, m % 12 + 1, d) for m in range(12) for d in (1, 2)]
    rows = [(c, t, (0.05 if c == 2 else 5.0) + i, None if (c, i) == (1, 3) else 1.0) for c in (1, 2) for i, t in enumerate(months)]
    rows = [(c, t, y if c == 1 else 0.01, x) for c, t, y, x in rows]
    table = spark.createDataFrame(rows, "channel int, ts timestamp_ntz, y double, x double")
    out = M.training_set(table, 2, 3).collect()
    assert {r["channel"] for r in out} == {1} and len(out) == 23
    by_split = {s: {(r["ts"].year, r["ts"].month) for r in out if r["split"] == s} for s in ("train", "val", "test")}
    assert [len(by_split[s]) for s in ("train", "val", "test")] == [7, 2, 3]


def test_scaler_uses_training_rows_only(spark):
    rows = [(1, dt.datetime(2000, 1, i + 1), s, x, y) for i, (s, x, y) in enumerate((("train", 1.0, 2.0), ("train", 3.0, 4.0), ("val", 90.0, 0.0)))]
    table = spark.createDataFrame(rows, "channel int, ts timestamp_ntz, split string, x double, y double")
    scaler = M.train_scaler(table, ["x"])
    got = {r["split"]: r for r in M.standardise(table, scaler, ["x"]).collect()}
    assert got["val"]["x"] == pytest.approx((90 - 2) / np.std([1, 3], ddof=1))
    assert got["val"]["y"] == pytest.approx(1e-4 / 3)


def test_scores_need_five_pairs(spark):
    rng = np.random.default_rng(3)
    obs, sim = rng.gamma(2, 5, 40), rng.gamma(2, 5, 40)
    rows = [(1, float(o), float(s)) for o, s in zip(obs, sim)] + [(1, None, 2.0), (2, 1.0, 1.0)] + [(3, 2.0, float(i)) for i in range(6)]
    got = {r["st"]: r for r in M.skill(spark.createDataFrame(rows, "st int, o double, s double"), ["st"], "o", "s").collect()}
    r, a, b = np.corrcoef(obs, sim)[0, 1], np.std(sim) / np.std(obs), np.mean(sim) / np.mean(obs)
    assert got[1]["nse"] == pytest.approx(1 - np.sum((obs - sim) ** 2) / np.sum((obs - obs.mean()) ** 2))
    assert got[1]["kge"] == pytest.approx(1 - np.sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2))
    assert all(got[2][m] is None for m in ("nse", "kge", "r2", "pbias", "rmse"))
    assert got[3]["nse"] is None and got[3]["kge"] is None and got[3]["rmse"] is not None


def test_best_trial_order(spark):
    rows = [(1, 1, -0.1, 0.1), (1, 2, 0.2, 0.5), (1, 3, 0.3, 0.5), (2, 1, -0.5, 0.9), (2, 2, -0.2, 0.4)]
    df = spark.createDataFrame(rows, "channel int, trial int, val_nse double, val_crps double")
    assert {r["channel"]: r["trial"] for r in M.best_trial(df).collect()} == {1: 3, 2: 2}


def test_grid_periods(spark, tmp_path):
    for i, v in enumerate((1.0, float("nan"))):
        spark.createDataFrame([(i, 1.5, 2.5, v, "x")], "ts int, lat double, lon double, value double, extra string").write.parquet(str(tmp_path / f"p{i}"))
    grid = tables.read_grid(spark, [str(tmp_path / "p0"), str(tmp_path / "p1")], ["ts", "lat", "lon", "value"])
    assert sorted((r["ts"], r["value"]) for r in grid.collect()) == [(0, 1.0), (1, None)]
    assert tables.duplicate_cells(grid, ["lat", "lon"]).count() == 1


def test_a_heavy_subbasin_is_dealt_to_many_tasks(spark, monkeypatch):
    from headrace.operators import features as M
    monkeypatch.setattr(M, "PAIRS_PER_TASK", 100)
    rows = spark.range(200).select(F.col("id").alias("channel"), F.col("id").alias("unit"), F.when(F.col("id") < 190, 1).when(F.col("id") < 195, 2).alias("subbasin"))
    aquifers = spark.range(30).select(F.lit(1).alias("subbasin"), F.col("id").alias("aquifer"))
    out = M._spread_join(rows, aquifers, "subbasin")
    assert out.count() == 190 * 30 + 10 and out.distinct().count() == out.count()
    assert out.filter("aquifer is null").count() == 10
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) <= 1000


def test_daily_sums_go_to_tasks_by_day(spark, monkeypatch):
    from headrace.plans import standins as X
    monkeypatch.setattr(X, "LINES_PER_TASK", 300)
    assert X.daily_wide(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 20
