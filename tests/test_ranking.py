"""Ordered work on groups cut into slices equals the plain answer."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from headrace.operators import ranking as R


@pytest.fixture(scope="module")
def skewed():
    """One group holds most rows and one value many copies."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 else rng.choice("abc")
        value = 7.0 if rng.random() < 0.4 else round(rng.uniform(-50, 50), 3)
        rows.append((group, i, value))
    return rows


@pytest.mark.parametrize("hot_rows", [60, 10**9])
def test_quantiles_match_numpy(spark, skewed, hot_rows):
    df = spark.createDataFrame(skewed, "g string, id int, v double")
    probs = {"low": 0.000274, "mid": 0.5, "high": 0.95}
    groups = defaultdict(list)
    for g, _, v in skewed:
        groups[g].append(v)
    for row in R.exact_quantiles(df, ["g"], "v", probs, hot_rows=hot_rows).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.percentile(groups[row["g"]], p * 100), abs=1e-9)


def test_quantiles_by_full_ranking(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, id int, v double").withColumnRenamed("v", "__v")
    groups = defaultdict(list)
    for g, _, v in skewed:
        groups[g].append(v)
    for row in R._ranked_quantiles(df, ["g"], {"q": 0.31}, 60).collect():
        assert row["q"] == pytest.approx(np.percentile(groups[row["g"]], 31), abs=1e-9)


def test_quantiles_survive_a_bad_sketch(spark, skewed, monkeypatch):
    """Brackets that miss the rank are noticed and the groups ranked in full."""
    monkeypatch.setattr(R, "SKETCH_ACCURACY", 10_000)
    monkeypatch.setattr(R.F, "percentile_approx", lambda c, edges, acc: F.array(*[F.lit(-60.0) for _ in edges]))
    df = spark.createDataFrame(skewed, "g string, id int, v double")
    got = R.exact_quantiles(df, [], "v", {"q": 0.5}, hot_rows=60).first()["q"]
    assert got == pytest.approx(np.percentile([v for *_, v in skewed], 50), abs=1e-9)


@pytest.mark.parametrize("hot_rows", [60, 10**9])
def test_quantiles_without_keys(spark, skewed, hot_rows):
    df = spark.createDataFrame(skewed, "g string, id int, v double")
    got = R.exact_quantiles(df, [], "v", {"q": 0.92}, hot_rows=hot_rows).first()["q"]
    assert got == pytest.approx(np.percentile([v for *_, v in skewed], 92), abs=1e-9)


@pytest.mark.parametrize("hot_rows", [60, 10**9])
def test_running_totals(spark, skewed, hot_rows):
    df = spark.createDataFrame(skewed, "g string, id int, v double")
    out = R.running_totals(df, ["g"], [F.desc("v"), F.asc("id")], {"run": F.col("v")}, "no", hot_rows=hot_rows)
    got = {(r["g"], r["id"]): (r["no"], r["run"]) for r in out.collect()}
    by_group = defaultdict(list)
    for g, i, v in skewed:
        by_group[g].append((-v, i))
    for g, items in by_group.items():
        total = 0.0
        for n, (minus, i) in enumerate(sorted(items), 1):
            total -= minus
            assert got[g, i][0] == n
            assert got[g, i][1] == pytest.approx(total, abs=1e-6)
    assert len(got) == len(skewed)


@pytest.mark.parametrize("hot_rows", [60, 10**9])
def test_capacity_fill_equals_loop(spark, skewed, hot_rows):
    needs = [(g, i, abs(v)) for g, i, v in skewed]
    cap = {"hot": 700.0, "a": 55.5, "b": 0.0}
    out = R.capacity_fill(spark.createDataFrame(needs, "g string, site int, need double"),
                          spark.createDataFrame(list(cap.items()), "g string, cap double"), ["g"], "need", "cap", "site",
                          hot_rows=hot_rows)
    got = {r["site"]: r["delivered_mw"] for r in out.collect()}
    left = defaultdict(float, cap)
    for g, site, need in sorted(needs, key=lambda r: (-r[2], r[1])):
        if need <= 0:
            continue
        give = min(need, left[g])
        left[g] -= give
        assert got[site] == pytest.approx(give, abs=1e-6)


@pytest.mark.parametrize("hot_rows", [60, 10**9])
def test_percent_rank_averages_ties(spark, hot_rows):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0] + [5.0] * 100
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    got = {r["id"]: r["p"] for r in R.percent_rank_average(df, [], "v", "p", hot_rows=hot_rows).collect()}
    assert got[3] is None
    assert got[1] == pytest.approx(1 / 105)
    assert got[0] == got[2] == got[5] == pytest.approx(4 / 105)
    assert got[6] == pytest.approx((6 + 105) / 2 / 105)


def test_top_per_group(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, id int, v double")
    got = {(r["g"], r["id"]) for r in R.top_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 4).collect()}
    by_group = defaultdict(list)
    for g, i, v in skewed:
        by_group[g].append((-v, i))
    assert got == {(g, i) for g, items in by_group.items() for _, i in sorted(items)[:4]}


def test_slices_do_not_outgrow_the_rows():
    assert R._pieces(100, 40) == 6 and R._pieces(0, 40) == 2
    assert R._pieces(9_000_000, 40) == 90 and R._pieces(54_000_000, 40) == 540
    assert R._pieces(40_000_000, R.HOT_ROWS) == 20


def test_hot_groups_are_picked_without_a_shuffle_of_their_rows(spark, skewed, monkeypatch):
    seen, inner = [], R._large_quantiles
    monkeypatch.setattr(R, "_large_quantiles", lambda rows, *rest: seen.append(rows) or inner(rows, *rest))
    df = spark.createDataFrame(skewed, "g string, id int, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in (["g"], []):
            R.exact_quantiles(df, keys, "v", {"q": 0.5}, hot_rows=60).collect()
        seen.append(R._slices(df, ["g"], [F.col("v")], 60)[0])
        plans = [rows._jdf.queryExecution().sparkPlan().toString() for rows in seen]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 3 and all("Broadcast" in p and "SortMergeJoin" not in p for p in plans)
