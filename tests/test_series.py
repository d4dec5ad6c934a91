"""Calendar and series rules on small hand-made series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.operators import ecology as E
from headrace.operators import sediment as D
from headrace.operators import series as S
from headrace.operators import supply as W


def flow(spark, rows):
    return spark.createDataFrame(rows, "st int, scenario string, year int, hoy int, q double")


def test_leap_season_and_shift(spark):
    df = spark.createDataFrame([(2028, 8783, -1.0), (2027, 8759, None), (2100, 1416, 3.0)], "year int, hoy int, lat double")
    out = df.select(cal.hours_in_year("year").alias("n"), cal.month_of("year", "hoy").alias("m"),
                    cal.season(cal.month_of("year", "hoy"), "lat").alias("s")).collect()
    assert [tuple(r) for r in out] == [(8784, 12, "summer"), (8760, 12, "winter"), (8760, 3, "spring")]
    moved = S.roll_hours(df.select("year", "hoy"), F.lit(2)).collect()
    assert [r["hoy"] for r in moved] == [1, 1, 1418]


def test_step_change_breaks_at_gaps(spark):
    rows = [(1, "nat", 2027, h, float(q)) for h, q in ((0, 1), (1, 4), (3, 9), (4, 7))]
    from pyspark.sql import Window
    w = Window.partitionBy("st", "year").orderBy("hoy")
    out = flow(spark, rows).withColumn("d", S.step_change("q", "hoy", w)).orderBy("hoy").collect()
    assert [r["d"] for r in out] == [None, 3.0, None, -2.0]


@pytest.mark.parametrize("n", [10, 37, 2000])
def test_duration_curve_equals_interp(spark, n):
    values = np.random.default_rng(n).gamma(2.0, 10.0, n)
    df = spark.createDataFrame([(1, float(v)) for v in values], "st int, q double")
    got = [r["fdc"] for r in S.flow_duration_curve(df, ["st"]).orderBy("k").collect()]
    grid = (np.arange(1, 501) - 0.5) / 500
    want = np.interp(grid, (np.arange(1, n + 1) - 0.5) / n, np.sort(values)[::-1])
    assert np.allclose(got, want, atol=1e-9)


def test_duration_curve_needs_ten(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(9)], "st int, q double")
    assert S.flow_duration_curve(df, ["st"]).count() == 0


def test_recurrence(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (5, 1, 4, 2, 3, 9)] + [(2, 1.0)] * 4, "st int, q double")
    got = {r["st"]: r["q_ri"] for r in S.recurrence_quantile(df, ["st"], "q").collect()}
    assert got[1] == pytest.approx(np.interp(1 - 1 / 1.67, np.arange(1, 7) / 7, [1, 2, 3, 4, 5, 9]))
    assert got[2] is None


def fritsch_carlson(x, y, at):
    """Scalar monotone cubic with one-sided three-point ends, the last cubic extended."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    out = []
    for v in at:
        i = min(max(np.searchsorted(x, v, side="right") - 1, 0), len(x) - 2)
        t = (v - x[i]) / h[i]
        out.append((2 * t**3 - 3 * t**2 + 1) * y[i] + (t**3 - 2 * t**2 + t) * h[i] * m[i]
                   + (3 * t**2 - 2 * t**3) * y[i + 1] + (t**3 - t**2) * h[i] * m[i + 1])
    return np.maximum(out, 0.0)


def test_pchip(spark):
    rng = np.random.default_rng(2)
    start = dt.datetime(2001, 2, 27)
    y = np.round(rng.gamma(1.0, 5.0, 20), 3)
    y[5:8] = 0.0
    rows = [(1, start + dt.timedelta(hours=3 * i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "st int, ts timestamp_ntz, q double")
    out = S.pchip_hourly(df, ["st"], "ts", "q").orderBy("ts").collect()
    hours = np.arange(0, 3 * 19 + 2.5, 1.0)
    assert [(r["ts"] - start).total_seconds() / 3600 for r in out] == list(hours)
    assert np.allclose([r["q"] for r in out], fritsch_carlson(3 * np.arange(20), y, hours), atol=1e-9)
    assert sum(r["is_observed"] for r in out) == 20


def test_linear_fill(spark):
    values = [None, 2.0, None, None, 8.0, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "st int, hoy int, q double")
    got = [r["q"] for r in S.linear_fill(df, ["st"], "hoy", "q").orderBy("hoy").collect()]
    assert got == [None, 2.0, 4.0, 6.0, 8.0, 8.0]


@pytest.mark.parametrize("mode", ["discrete", "contiguous"])
def test_month_split(spark, mode):
    months = [dt.datetime(2000 + m // 12, m % 12 + 1, 5) for m in range(36)]
    df = spark.createDataFrame([(m,) for m in months], "ts timestamp_ntz")
    for seed in (1, 2, 42):
        got = {r["ts"]: r["split"] for r in S.month_split(df, "ts", 6, 5, seed, mode).collect()}
        held = {s: [i for i, m in enumerate(months) if got[m] == s] for s in ("val", "test", "train")}
        assert [len(held[s]) for s in ("val", "test", "train")] == [6, 5, 25]
        if mode == "contiguous":
            assert all(max(v) - min(v) == len(v) - 1 for v in (held["val"], held["test"]))
    with pytest.raises(Exception, match="too few months"):
        S.month_split(df, "ts", 30, 6, 1, mode).collect()


def test_delay_wraps_years(spark):
    rows = [(1, 2, 2027, 8759, 5.0), (1, 2, 2028, 8783, 7.0), (1, 2, 2027, 3, 9.0)]
    df = spark.createDataFrame(rows, "st int, tau int, year int, hoy int, q double")
    got = {(r["year"], r["hoy"]): r["q"] for r in S.lagged_value(df, ["st"], "tau", 2027, 2028).collect()}
    assert got == {(2028, 1): 5.0, (2027, 1): 7.0, (2027, 5): 9.0}


def test_regulated_equal_to_natural(spark):
    rng = np.random.default_rng(1)
    q = np.round(rng.gamma(2.0, 10.0, (2, 8760)), 4)
    rows = [(1, s, 2027 + y, h, float(q[y, h])) for s in ("nat", "BAL") for y in range(2) for h in range(0, 8760, 3)]
    df = flow(spark, rows).withColumn("lat", F.lit(-12.0))
    deficits = E.ecodeficit(df, ["st"]).collect()
    assert len(deficits) == 5 and all(r["ecodeficit"] == pytest.approx(0, abs=1e-12) for r in deficits)
    pairs = S.finite_pairs(df, ["st"])
    for b in D.EXPONENTS:
        pairs = pairs.withColumn(b, F.lit(2.0))
    assert all(r["stci"] == pytest.approx(1.0) for r in D.transport_ratio(pairs, ["st"]).collect())
    hai = E.alteration_index(E.alteration(E.flow_parameters(df, ["st"]), ["st"]), ["st"]).first()
    assert hai["hai"] == pytest.approx(0.0, abs=1e-12)


def test_short_years_are_skipped(spark):
    rows = [(1, s, 2027, h, 1.0 + h % 5) for s in ("nat", "BAL") for h in range(47)]
    ramps = E.ramping(flow(spark, rows), ["st", "scenario"]).collect()
    assert all(r["rr_down_mean"] is None and r["reversals_per_year"] is None for r in ramps)
    days = [(1, s, 2027, 24 * d, 1.0 + d % 7) for s in ("nat", "BAL") for d in range(299)]
    assert E.flow_parameters_by_year(flow(spark, days), ["st"]).count() == 0
    days += [(1, s, 2027, 24 * 299, 3.0) for s in ("nat", "BAL")]
    assert E.flow_parameters_by_year(flow(spark, days), ["st"]).count() == 2


def test_varial_zone_reblocks_after_gaps(spark):
    hours = [h for h in range(60) if h not in (5, 6, 30)]
    rows = [(1, "BAL", 2027, h, float(h)) for h in hours] + [(1, "BAL", 2027, 30, -1.0)]
    got = E.varial_zone(flow(spark, rows).withColumn("length_km", F.lit(2.0)), ["st"]).first()
    blocks = [hours[:24], hours[24:48]]
    want = np.mean([7.2 * (max(b) ** 0.5 - min(b) ** 0.5) for b in blocks])
    assert got["varial_width_m"] == pytest.approx(want)
    assert got["varial_area_m2"] == pytest.approx(want * 2000)


def test_reliability_by_hand(spark):
    month = 31 * 86400.0
    need = 12 * 10.0 * month / 1e6  # 10 m3/s of a 31-day month
    supply = {1: 12.0, 2: None, 3: 4.0, 5: 12.0, 7: 4.0, 8: 12.0}
    rows = [(1, 2027, m, None if v is None else v + 2.0, 2.0, need) for m, v in supply.items()]
    df = spark.createDataFrame(rows, "st int, year int, month int, q double, efr double, demand_mm3_yr double")
    r = W.reliability(df, ["st"]).first()
    assert r["efr_compliance"] == 1.0
    assert r["rel"] == pytest.approx(3 / 5)
    assert r["vul"] == pytest.approx(0.6)
    assert r["res"] == pytest.approx(1 / 2)  # July recovers in August; March has no observed April
    assert r["data_coverage"] == pytest.approx(5 / 6)
    assert r["gap_months_per_year"] == pytest.approx(2 / 5 * 12)
    assert r["wsi"] == pytest.approx(10 * 5 / 44)


def test_reliability_without_failures_or_demand(spark):
    rows = [(1, 2027, 1, 9.0, 2.0, 1.0), (2, 2027, 1, 9.0, 2.0, 0.0), (3, 2027, 1, 2.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "st int, year int, month int, q double, efr double, demand_mm3_yr double")
    got = {r["st"]: r for r in W.reliability(df, ["st"]).collect()}
    assert (got[1]["rel"], got[1]["vul"], got[1]["res"], got[1]["si"]) == (1.0, 0.0, 1.0, 1.0)
    assert got[2]["efr_compliance"] == 1.0 and got[2]["rel"] is None and got[2]["wsi"] is None
    assert got[3]["wsi"] == float("inf") and got[3]["si"] == 0.0


def test_area_method_of_segment_flow(spark):
    rows = [(1, s, dam, 2027, 1, q, 1.5) for s, dam, q in (("nat", 1, 4.0), ("nat", 2, None), ("BAL", 1, 6.0), ("BAL", 2, None))]
    rows += [(1, s, dam, 2027, 2, None, 1.5) for s in ("nat", "BAL") for dam in (1, 2)]
    df = spark.createDataFrame(rows, "seg int, scenario string, dam int, year int, month int, q double, a_ratio double")
    got = {(r["method"], r["scenario"], r["month"]): r["q"] for r in W.segment_flow(df, ["seg"]).collect()}
    assert got["E1", "BAL", 1] == 6.0 and got["E2", "BAL", 1] == 8.0 and got["E2", "nat", 1] == 6.0
    assert got["E1", "BAL", 2] is None
