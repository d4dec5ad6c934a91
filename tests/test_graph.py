"""River and transmission graphs: cascades, cycles and odd pointers."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from headrace.operators import graph as G
from headrace.operators import supply as W
from headrace.operators import trade as T


def net(spark, rows):
    """(id, down, upland) rows."""
    df = spark.createDataFrame([(i, d, float(a)) for i, d, a in rows], "river_id long, next_down long, upland_skm double")
    return df.withColumn("length_km", F.lit(2.0)).withColumn("catch_skm", F.lit(10.0)).withColumn("irrigated_pct", F.lit(50.0))


@pytest.fixture(scope="module")
def river(spark):
    # 1 -> 2 -> 3 -> 4 -> 5 -> 0; 10 -> 11 -> 4; 20 -> 99 (outside)
    return net(spark, [(1, 2, 10), (2, 3, 20), (3, 4, 30), (4, 5, 80), (5, 0, 90), (10, 11, 5), (11, 4, 7), (20, 99, 3)])


def test_walk_stops(spark, river):
    dams = spark.createDataFrame([(1,), (3,), (10,), (20,), (77,)], "dam long")
    got = {(r["dam"], r["river_id"], r["step"]) for r in G.downstream_walk(dams, river).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (3, 3, 0), (3, 4, 1), (3, 5, 2), (10, 10, 0), (10, 11, 1), (10, 4, 2), (10, 5, 3), (20, 20, 0)}


def test_walk_attenuates(spark):
    rows = [(i, i + 1, 10.0 * 4**i) for i in range(8)]
    dams = spark.createDataFrame([(0,)], "dam long")
    got = [r["river_id"] for r in G.downstream_walk(dams, net(spark, rows)).orderBy("step").collect()]
    assert got == [0, 1, 2, 3]  # the next one has under 1 % of the dam's area


def test_long_walk(spark):
    rows = [(i, i + 1 if i < 299 else 0, 100.0) for i in range(1, 300)]
    dams = spark.createDataFrame([(1,)], "dam long")
    assert G.downstream_walk(dams, net(spark, rows)).agg(F.max("step")).first()[0] == 298


def test_segments_share_controls(spark, river):
    dams = spark.createDataFrame([(3,), (10,)], "dam long")
    segs = {r["dam_rivers"]: r for r in W.supply_segments(dams, river).collect()}
    assert set(segs) == {"3", "10", "3|10"}
    both = segs["3|10"]
    assert (both["n_reaches"], both["dep_length_km"], both["demand_mm3_yr"], both["a_outlet_skm"], both["a_dams_skm"]) == (2, 4.0, 10.0, 90.0, 35.0)


def test_levels_and_cycles(spark, river):
    levels = {r["river_id"]: r["level"] for r in G.topological_level(river).collect()}
    assert levels == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 10: 0, 11: 1, 20: 0}
    loop = net(spark, [(1, 2, 1), (2, 3, 1), (3, 2, 1), (9, 1, 1)])
    got = {r["river_id"]: (r["level"], r["on_cycle"]) for r in G.topological_level(loop).collect()}
    assert got == {9: (0, False), 1: (1, False), 2: (None, True), 3: (None, True)}
    assert {r["river_id"]: r["depth"] for r in G.downstream_depth(loop).collect()} == dict.fromkeys((1, 2, 3, 9))
    assert {r["river_id"]: r["depth"] for r in G.downstream_depth(river).collect()}[1] == 4


def test_trace_outlets_and_affected(spark, river):
    def ids(df):
        return {r["river_id"] for r in df.collect()}
    at = spark.createDataFrame([(4,)], "river_id long")
    assert ids(G.upstream_trace(at, river)) == {1, 2, 3, 4, 10, 11}
    assert ids(G.outlets(river)) == {5, 20}
    assert ids(G.affected_downstream(spark.createDataFrame([(2,), (3,)], "river_id long"), river)) == {3, 4, 5}


def test_contract(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 4), (3, 4, 5), (7, 3, 1)], "up long, down long, tau_h int")
    kept = spark.createDataFrame([(1,), (4,), (7,)], "node long")
    got = {(r["up"], r["down"], r["tau_h"]) for r in G.contract_excluded(edges, kept).collect()}
    assert got == {(1, 4, 12), (7, 4, 6)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5, k) for k in range(300, 360)]
    edges += [(k, k + 1) for k in range(1000, 1040)] + [(400, 400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(parent)}


def test_cascade_inflow(spark):
    rows = [(s, 2027, h, q, o) for s, q, o in ((1, 5.0, 2.0), (2, 3.0, 1.0)) for h in range(8760)]
    flow = spark.createDataFrame(rows, "station int, year int, hoy int, q_nat double, q_out double")
    edges = spark.createDataFrame([(1, 2, 6)], "up int, down int, tau_h int")
    out = G.cascade_inflow(flow, edges, 2027, 2027)
    assert {tuple(r) for r in out.select("station", "lateral", "q_in").distinct().collect()} == {(1, 5.0, 5.0), (2, -2.0, 2.0)}
    diag = {r["station"]: tuple(r)[1:] for r in G.lateral_diagnostics(out).collect()}
    assert diag == {1: (0.0, None), 2: (100.0, -2.0)}


def test_paths_prefer_few_hops_then_low_loss(spark):
    edges = spark.createDataFrame([("a", "b", 100.0, 0.10), ("b", "d", 50.0, 0.10), ("a", "c", 80.0, 0.02), ("c", "d", 60.0, 0.02),
                                   ("a", "e", 5.0, 0.0), ("e", "f", 5.0, 0.0), ("f", "d", 5.0, 0.0)],
                                  "region_a string, region_b string, available_mw double, loss_rate double")
    got = {(r["src"], r["dst"]): r for r in T.path_table(edges).collect()}
    best = got["a", "d"]
    assert best["path"] == "a > c > d" and best["hops"] == 2
    assert best["max_send_mw"] == pytest.approx(60 / 0.98) and best["efficiency"] == pytest.approx(0.98**2)
    assert ("b", "f") in got and got["b", "f"]["hops"] == 2


def test_explicit_limits_win(spark):
    frame = spark.createDataFrame([("a", "b", 100.0, 100.0, 0.0, 500.0, 0.5), ("a", "c", 100.0, 0.0, 0.0, None, None), ("b", "c", 10.0, 10.0, 0.0, 0.0, 0.1)],
                                  "region_a string, region_b string, total_mw double, ac_mw double, hvdc_mw double, available_mw double, loss_rate double")
    got = {(r["region_a"], r["region_b"]): r for r in T.corridor_limits(frame).collect()}
    assert got["a", "b"]["available_mw"] == 100.0 and got["a", "b"]["loss_rate"] == 0.5
    assert got["a", "c"]["available_mw"] == pytest.approx(85.0)
    assert ("b", "c") not in got


def test_chain_of_any_length(spark):
    n = 10_000
    chain = spark.range(1, n + 1).select(F.col("id").alias("river_id"), F.when(F.col("id") < n, F.col("id") + 1).otherwise(0).alias("next_down"))
    middle = spark.createDataFrame([(n // 2,)], "river_id long")
    assert G.downstream_depth(chain).filter(F.coalesce(F.col("depth") != n - F.col("river_id"), F.lit(True))).count() == 0
    levels = G.topological_level(chain)
    assert levels.filter(F.coalesce(F.col("level") != F.col("river_id") - 1, F.lit(True)) | F.col("on_cycle")).count() == 0
    assert G.upstream_trace(spark.createDataFrame([(n,)], "river_id long"), chain).count() == n
    below = G.affected_downstream(middle, chain)
    assert below.count() == n // 2 and below.filter(F.col("step") != F.col("river_id") - n // 2).count() == 0
    edges = chain.filter("next_down <> 0").select(F.col("river_id").alias("up"), F.col("next_down").alias("down"), F.lit(1).alias("tau_h"))
    kept = spark.createDataFrame([(1,), (n,)], "node long")
    assert [tuple(r) for r in G.contract_excluded(edges, kept).collect()] == [(1, n, n - 1)]


def test_walk_limit_is_reported(spark):
    chain = net(spark, [(i, i + 1, 100.0) for i in range(1, 40)])
    start = spark.createDataFrame([(1,)], "dam long")
    for limit in (7, 8, 9, 16):
        with pytest.warns(UserWarning, match=f"cut after {limit} steps"):
            assert G.downstream_walk(start, chain, max_steps=limit).count() == limit
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert G.downstream_walk(start, chain, max_steps=64).count() == 39


def test_paths_of_many_hops(spark):
    edges = spark.createDataFrame([(f"r{i:02}", f"r{i + 1:02}", 10.0, 0.01) for i in range(9)], "region_a string, region_b string, available_mw double, loss_rate double")
    paths = T.path_table(edges)
    assert paths.count() == 90 and paths.agg(F.max("hops")).first()[0] == 9


def test_components_with_a_salted_hub(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    edges = [(5, k) for k in range(300, 400)] + [(1, 2), (2, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 5 for k in (5, *range(300, 400))}, 1: 1, 2: 1, 3: 1, 7: 7}


def test_only_hubs_are_copied_to_salts(spark):
    least = spark.createDataFrame([(5, 5, 900)] + [(k, 5, 1) for k in range(300, 1200)], "u long, m long, n long")
    copies = G._salt_copies(least, 1800)
    assert copies.count() == 900 + G.HUB_SALTS
    assert copies.groupBy("u").count().filter("count > 1").collect() == [(5, G.HUB_SALTS)]
