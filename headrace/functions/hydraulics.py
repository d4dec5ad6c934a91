"""Closed-form hydraulics and reservoir expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headrace.functions.core import ColumnLike, clip, col

# Fixed values.
WATER_DENSITY = 1000.0  # kg/m3
GRAVITY = 9.81  # m/s2
MANNING_N = 0.035
WIDTH_COEF, WIDTH_EXP = 7.2, 0.50
DEPTH_COEF, DEPTH_EXP = 0.27, 0.30
DEPTH_EXP_MANNING = 0.3
AREA_EXPONENT, VOLUME_EXPONENT = 1.81, 2.91
SECONDS_PER_YEAR = 365.25 * 24 * 3600
PS_ROUND_TRIP = 0.88


def channel_width(q: ColumnLike) -> Column:
    """X-10: wetted width, m."""
    return WIDTH_COEF * F.pow(col(q), F.lit(WIDTH_EXP))


def depth_coefficient(slope: ColumnLike) -> Column:
    """X-10: K of d = K q^0.3; Manning where the slope is known, else the global value."""
    s = col(slope)
    manning = F.pow(MANNING_N / (WIDTH_COEF * F.sqrt(s)), F.lit(0.6))
    return F.when(s > 0, manning).otherwise(F.lit(DEPTH_COEF))


def channel_depth(q: ColumnLike, slope: ColumnLike) -> Column:
    """X-10: flow depth, m; both forms share the exponent 0.3."""
    return depth_coefficient(slope) * F.pow(clip(q, 0.0), F.lit(DEPTH_EXP))


def head_from_volume(volume_m3: ColumnLike, c: ColumnLike, d: ColumnLike) -> Column:
    """X-11: h(V) = (V/c)^(1/d), V in km3; 0 where undefined."""
    v, cc, dd = col(volume_m3) / 1e9, col(c), col(d)
    return F.when((v > 0) & (cc > 0) & (dd > 0), F.pow(v / cc, 1.0 / dd)).otherwise(0.0)


def area_from_head(h: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    """X-11: A(h) = a h^b in m2; 0 where undefined."""
    hh, aa, bb = col(h), col(a), col(b)
    return F.when((hh > 0) & (aa > 0) & bb.isNotNull(), aa * F.pow(hh, bb) * 1e6).otherwise(0.0)


def turbine_efficiency(head: ColumnLike) -> Column:
    """P-10: efficiency by head band (fixed values)."""
    h = col(head)
    return F.when(h > 200, 0.87).when(h > 40, 0.88).otherwise(0.86)


def power_mw(q: ColumnLike, head: ColumnLike, eta: ColumnLike) -> Column:
    return col(eta) * WATER_DENSITY * GRAVITY * col(q) * col(head) / 1e6


def flow_for_power(p_mw: ColumnLike, head: ColumnLike, eta: ColumnLike) -> Column:
    """Flow that gives a power; 0 without head."""
    denominator = col(eta) * WATER_DENSITY * GRAVITY * col(head)
    return F.when(col(head) > 0, F.try_divide(col(p_mw) * 1e6, denominator)).otherwise(0.0)


def pump_flow(p_mw: ColumnLike, head: ColumnLike, eta_pump: float = 0.90) -> Column:
    return F.when(
        col(head) > 0, F.try_divide(col(p_mw) * 1e6 * eta_pump, WATER_DENSITY * GRAVITY * col(head))
    ).otherwise(0.0)


def f_opt(ps_volume: ColumnLike, max_volume: ColumnLike) -> Column:
    """P-10: target filling, bounded to [0.3, 0.84]; 0.6 where unknown."""
    p, v = col(ps_volume), col(max_volume)
    raw = F.when((v > 0) & (p > 0), F.try_divide(p, v)).otherwise(F.lit(0.60))
    return clip(raw, 0.3, 0.84)


def ps_volume_km3(capacity_mw: ColumnLike, head: ColumnLike, hours: float = 8.0) -> Column:
    """P-18: upper-reservoir volume that stores ``hours`` of full output."""
    cap, h = col(capacity_mw), col(head)
    energy = cap * 1e6 * hours * 3600
    return F.when(
        (cap > 0) & (h > 0), F.try_divide(energy, PS_ROUND_TRIP * WATER_DENSITY * GRAVITY * h * 1e9)
    )


def ps_storage_hours(volume_km3: ColumnLike, capacity_mw: ColumnLike, head: ColumnLike) -> Column:
    """P-18: hours of full output a volume holds; 0 without volume."""
    v = col(volume_km3)
    hours = F.try_divide(v * 1e9 * WATER_DENSITY * GRAVITY * col(head), col(capacity_mw) * 1e6 * 3600)
    return F.when(v > 0, hours).otherwise(0.0)
