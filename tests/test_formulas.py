"""Closed forms, missing inputs and edge rules of power, carbon and load."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headrace.functions import core, hydraulics, text
from headrace.functions import geo
from headrace.operators import carbon as C
from headrace.operators import load as L
from headrace.operators import power as P
from headrace.operators import quality as Q
from headrace.operators import summaries as V
from headrace.operators import weather as WX


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def null():
    return F.lit(None).cast("double")


def test_missing_and_infinite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r["v"] for r in core.nan_to_null(df).collect()] == [1.0, None, None, None]
    row = one(spark, core.number(F.lit(" 3.5 ")), core.number(F.lit("n/a")), core.number(F.lit("inf")), core.clip(null(), 0.0, 1.0), core.clip(F.lit(7.0), 0.0, 1.0))
    assert tuple(row) == (3.5, None, None, None, 1.0)


def test_tidy_row(spark):
    df = spark.createDataFrame([(2.0, 3.0), (0.0, 3.0), (None, 3.0)], "n double, r double").select(*core.tidy("n", "r"))
    assert [(r["delta"], r["ratio"]) for r in df.collect()] == [(1.0, 1.5), (3.0, None), (None, None)]


def test_reservoir_forms_need_their_inputs(spark):
    t = F.array(*[F.lit(float(v)) for v in range(-3, 9)])
    row = one(spark, C.effective_temperature(t, 0.05), C.littoral_pct(F.lit(10.0), F.lit(30.0)), C.littoral_pct(F.lit(10.0), F.lit(2.5)), C.littoral_pct(F.lit(30.0), F.lit(30.0)),
              C.littoral_pct(null(), F.lit(30.0)), C.ch4_degassing(null(), F.lit(1.0), F.lit(1.0), F.lit(1.0)), C.co2_diffusion(null(), F.lit(1.0), null(), null()),
              C.cumulative_radiance(F.array(*[F.lit(3600.0 * v) for v in range(1, 13)]), F.lit(2.5)))
    want = math.log10(np.mean([10 ** (max(v, 4) * 0.05) for v in range(-3, 9)])) / 0.05
    assert row[0] == pytest.approx(want)
    assert row[1] == pytest.approx((1 - (1 - 3 / 30) ** 2) * 100)
    assert tuple(row)[2:7] == (100.0, 100.0, None, None, None)
    assert row[7] == pytest.approx((12 + 11) / 2 * 2.5)  # 2.5 months round to 2


def test_station_factor_has_no_answer_without_generation(spark):
    rows = [(1, 10.0, 5.0, None, None, False), (2, 10.0, 5.0, 1.0, None, False), (3, 10.0, 5.0, 1.0, 20000.0, False), (4, 10.0, 5.0, 1.0, 50.0, True)]
    df = spark.createDataFrame(rows, "st int, lat double, area_km2 double, gen_gwh double, ef_gco2kwh double, geom_implausible boolean")
    got = {r["st"]: (r["hydro_ef"], r["ef_source"]) for r in C.station_emission_factor(df).collect()}
    assert got == {1: (None, ""), 2: (3000.0, "zone-flux"), 3: (12000.0, "reservoir"), 4: (None, "geom_implausible")}


def test_exact_firm_capacity_keeps_its_outage(spark):
    rng = np.random.default_rng(6)
    rows = [(s, int(y), h, float(rng.gamma(2, 3)), float(0.5 + rng.random())) for s in range(3) for y in (2027,) for h in range(1500)]
    power = spark.createDataFrame(rows, "st int, year int, hoy int, p_mw double, load double")
    for outage in (0.000274, 0.01):
        firm = P.firm_capacity_exact(power, ["st"], outage=outage)
        assert all(r["outage"] <= outage for r in P.outage_fraction(power, firm, ["st"]).collect())
        more = firm.withColumn("firm_mw", F.col("firm_mw") * 1.01 + 0.01)
        assert all(r["outage"] > outage or outage * 1500 > 5 for r in P.outage_fraction(power, more, ["st"]).collect())


def test_power_needs_flow_and_head(spark):
    df = spark.createDataFrame([(1, 5.0, None, 10.0), (2, None, 50.0, 10.0), (3, 1e6, 50.0, 10.0)], "st int, q double, head_m double, capacity_mw double")
    got = {r["st"]: r["p_mw"] for r in P.run_of_river_power(df).collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(10.0)


def test_hydraulic_guards(spark):
    row = one(spark, hydraulics.head_from_volume(F.lit(0.0), F.lit(1.0), F.lit(2.0)), hydraulics.head_from_volume(F.lit(8e9), F.lit(1.0), F.lit(3.0)),
              hydraulics.area_from_head(F.lit(-1.0), F.lit(1.0), F.lit(1.0)), hydraulics.f_opt(null(), F.lit(5.0)), hydraulics.flow_for_power(F.lit(5.0), F.lit(0.0), F.lit(0.9)))
    assert tuple(row) == (0.0, pytest.approx(2.0), 0.0, 0.6, 0.0)


def test_topology_text(spark):
    df = spark.createDataFrame([("D", "Station (A) (ch1,hops=4,f_reg=0.52,tau=3); B(ch9,hops=1)"), ("E", None), ("F", "")], "station_name string, direct_upstream_stations string")
    got = {(r["up"], r["down"], r["tau_h"]) for r in text.cascade_edges(df).collect()}
    assert got == {("Station (A)", "D", 3), ("B", "D", 0)}


def test_first_rule_wins(spark):
    row = one(spark, text.keyword_class(F.lit("Sandstone and BASALT"), text.LITHOLOGY_RULES), text.keyword_class(F.lit("loess over granite"), text.LITHOLOGY_RULES),
              text.keyword_class(null().cast("string"), text.LITHOLOGY_RULES))
    assert tuple(row) == ("volcanic", "unconsolidated", "default")


def test_station_names_round_trip(spark):
    df = spark.createDataFrame([(-15.0005, 102.5), (31.5, -108.9)], "lat double, lon double")
    coded = df.select(geo.grid_station_name("lat", "lon").alias("n"))
    assert [r["n"] for r in coded.collect()] == ["s15000s102500e", "s31500n108900w"]
    assert [tuple(r) for r in coded.select(*geo.grid_station_coords("n")).collect()] == [(-15.0, 102.5), (31.5, -108.9)]
    assert tuple(one(spark, *geo.grid_station_coords(F.lit("bad")))) == (None, None)


def test_profile_rules(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(hours=h), float(h % 24 + 1)) for h in range(8784) if not 24 * 40 <= h < 24 * 41]
    load = spark.createDataFrame(rows, "region string, ts timestamp_ntz, load_mw double")
    offsets = spark.createDataFrame([("a", 5.5)], "region string, offset_h double")
    plain = {(r["year"], r["hoy"]): r["l_norm"] for r in L.load_profile(load, ["region"], years=(2027, 2028)).collect()}
    assert len(plain) == 8760 + 8784
    p99 = np.percentile([r[2] for r in rows], 99)
    assert plain[2027, 7] == pytest.approx(8 / p99)
    assert plain[2028, 8783] == pytest.approx(24 / p99)  # day 366 repeats day 365
    assert plain[2027, 24 * 40 + 3] == pytest.approx(np.mean([r[2] for r in rows]) / p99)
    moved = {(r["year"], r["hoy"]): r["l_norm"] for r in L.load_profile(load, ["region"], offsets=offsets, years=(2027, 2028)).collect()}
    assert moved[2027, 0] == pytest.approx(plain[2027, 6])  # 5.5 rounds to 6
    assert moved[2027, 8759] == pytest.approx(plain[2027, 5])


def test_generator_defaults(spark):
    rows = [("a", dt.date(2027, 1, d), 10.0, 5.0, 0.0, 0.0, None, 0.5, 2.5) for d in range(1, 32)]
    days = spark.createDataFrame(rows, "cell string, date date, tmax double, tmin double, pcp double, pcp_hour_max double, slr double, hmd double, wnd double")
    got = {r["month"]: r for r in WX.generator_stats(days, ["cell"]).collect()}
    assert len(got) == 12
    assert (got[1]["tmax_sd"], got[1]["pcp_days"], got[1]["slr_ave"], got[1]["wet_dry"]) == (0.1, 0.1, 18.0, 0.0)
    assert (got[2]["tmax_ave"], got[2]["pcp_sum"], got[2]["wet_wet"]) == (32.0, 150.0, 0.6)


def test_land_cells_are_numbered(spark):
    t = [dt.datetime(2027, 1, 1, h) for h in range(4)]
    rows = [("a", x, float(lat), 5.0, 1.0 if lat != 2 or i == 0 else None, 2.0) for lat in (3, 1, 2) for i, x in enumerate(t)]
    grid = spark.createDataFrame(rows, "region string, ts timestamp_ntz, lat double, lon double, tp double, t2m double")
    got = [(r["lat"], r["cell_id"]) for r in WX.land_mask(grid, ["region"], ["tp", "t2m"]).orderBy("cell_no").collect()]
    assert got == [(1.0, "s00001"), (3.0, "s00002")]


def test_parameter_checks():
    Q.check_parameters({"ac": 0.8}, {"ac": 0.03})
    for atc, loss in (({"ac": 0.0}, {}), ({"ac": 1.2}, {}), ({}, {"ac": 1.0}), ({}, {"ac": -0.1})):
        with pytest.raises(ValueError):
            Q.check_parameters(atc, loss)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="lacks"):
        Q.require_columns(spark.range(1), ["id", "name"])


def test_mode_tie_and_empty_group(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "g int, v string")
    assert sorted((r["g"], r["v"]) for r in V.fill_with_mode(df, ["g"], "v", "none").collect()) == [(1, "a"), (1, "a"), (1, "b"), (2, "none")]


def test_equity_share_is_unknown_without_supply(spark):
    df = spark.createDataFrame([(None, 10.0, 1.0, 2.0), (20.0, 10.0, 1.0, 2.0)], "supply_c_mw double, dc_mean_mw double, net_carbon_avoided double, dc_carbon_intensity double")
    assert sorted((r["dom_share_pct"] is None, r["dom_share_pct"]) for r in V.equity_master(df).collect()) == [(False, 100.0), (True, None)]


def test_layer_key_rounds_as_numpy_does(spark):
    lats = [64.6835, -8.1595, 32.1795, 16.0815, 0.0005, 1.0015, -12.3455]
    coords = spark.createDataFrame([("a", x) for x in lats], "name string, lat double")
    layer = spark.createDataFrame([("a", float(np.round(x, 3)), i, i) for i, x in enumerate(lats)], "name string, lat double, row_ord int, soil int")
    got = {r["lat"]: r["soil"] for r in C.reservoir_layers(coords, layer).collect()}
    assert got == {x: i for i, x in enumerate(lats)}
