"""Declared schemas of the core tables. Optional columns are added as typed NULLs."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType()}


def struct(fields: str) -> T.StructType:
    """``name TYPE, ...`` without a running session."""
    pairs = (field.split() for field in fields.split(","))
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in pairs])


FLOW = struct(
    "region STRING, gcm STRING, ssp STRING, tag STRING, scenario STRING, station_idx INT, year INT, hoy INT, q DOUBLE")
POWER = struct(
    "region STRING, gcm STRING, ssp STRING, tag STRING, scenario STRING, station_idx INT, year INT, hoy INT, "
    "p_stable DOUBLE, p_flexible DOUBLE, p_ror DOUBLE, v DOUBLE, ps_gen DOUBLE, ps_pump DOUBLE")
RIVER_NETWORK = struct(
    "river_id BIGINT, next_down BIGINT, length_km DOUBLE, catch_skm DOUBLE, upland_skm DOUBLE, irrigated_pct DOUBLE, "
    "slope_dm_per_km DOUBLE, protected_pct DOUBLE")
STATION = struct(
    "region STRING, station_idx INT, name STRING, lat DOUBLE, lon DOUBLE, type STRING, merge_status STRING, "
    "capacity_mw DOUBLE, head_m DOUBLE, max_head_m DOUBLE, dam_height_m DOUBLE, year_built INT, river_id BIGINT, "
    "max_area_km2 DOUBLE, max_vol_km3 DOUBLE, res_area_km2 DOUBLE, res_vol_km3 DOUBLE, ps_vol_km3 DOUBLE, "
    "ps_area_km2 DOUBLE, coeff_a DOUBLE, coeff_b DOUBLE, coeff_c DOUBLE, coeff_d DOUBLE, snap_quality STRING")
LOAD_PROFILE = struct("region STRING, year INT, hoy INT, l_norm DOUBLE")
ALLOCATION = struct(
    "scenario STRING, scenario_name STRING, scope STRING, dc_id STRING, dc_region STRING, src_region STRING, "
    "sent_mw DOUBLE, delivered_mw DOUBLE, allocated_mw DOUBLE, loss_mw DOUBLE, hops INT, path STRING, cross_region INT")
METRIC = struct(
    "region STRING, gcm STRING, ssp STRING, scenario_tag STRING, station STRING, station_idx INT, river STRING, "
    "lat DOUBLE, lon DOUBLE, topic STRING, scenario STRING, metric STRING, param STRING, value_nat DOUBLE, "
    "value_reg DOUBLE, delta DOUBLE, ratio DOUBLE, year_agg STRING, notes STRING")
