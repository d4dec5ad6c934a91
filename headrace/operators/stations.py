"""Plant inventory: cleaning, static parameters, screens, curated corrections and name matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrace.functions.hydraulics import (
    AREA_EXPONENT, SECONDS_PER_YEAR, VOLUME_EXPONENT, f_opt, flow_for_power, power_mw, ps_storage_hours,
    ps_volume_km3, pump_flow, turbine_efficiency,
)
from headrace.session import reliable_checkpoint

MISMATCH_RATIO = 0.1
NO_STORAGE = ("ROR", "Canal")


def _pos(name: str) -> Column:
    """The value where it is positive, else NULL."""
    return F.when(F.col(name) > 0, F.col(name))


def quality_filter(plants: DataFrame, grades: Sequence[str] = ("A", "B")) -> DataFrame:
    """P-4: plants with an accepted snap quality and readable coordinates."""
    kept = plants.filter(F.col("snap_quality").isin(*grades)) if "snap_quality" in plants.columns else plants
    return kept.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def active_stations(stations: DataFrame) -> DataFrame:
    """P-5: not dropped by the merge, with capacity and a river id."""
    kept = F.coalesce(F.col("merge_status") != "dropped", F.lit(True))
    return stations.filter(kept & (F.col("capacity_mw") > 0) & F.col("river_id").isNotNull())


def static_parameters(stations: DataFrame) -> DataFrame:
    """P-10: efficiency, turbine and pump flow, target filling; no storage for run-of-river types."""
    no_store = F.col("type").isin(*NO_STORAGE)
    zero = F.lit(0.0)
    head, cap = F.coalesce("head_m", zero), F.coalesce("capacity_mw", zero)
    v = F.when(no_store, zero).otherwise(F.coalesce("max_vol_km3", zero) * 1e9)
    a = F.when(no_store, zero).otherwise(F.coalesce("max_area_km2", zero) * 1e6)
    eta = turbine_efficiency(head)
    ps = F.col("type") == "PS"
    return stations.select(
        "*", v.alias("v_max_m3"), a.alias("a_max_m2"), eta.alias("eta_turb"),
        flow_for_power(cap, head, eta).alias("q_max_turb"), f_opt(F.col("ps_vol_km3") * 1e9, v).alias("f_opt"),
        F.when(ps, cap).otherwise(0.0).alias("p_pump_mw"),
        F.when(ps, pump_flow(cap, head)).otherwise(0.0).alias("q_max_pump"))


def regulation(stations: DataFrame, mean_flow: DataFrame) -> DataFrame:
    """P-11: storage over yearly flow, and the category A, B or RoR. ``mean_flow``: river_id, q_hist."""
    at = stations.join(mean_flow, "river_id", "left")
    stored = (F.col("v_max_m3") > 0) & (F.col("q_hist") > 0) & ~F.col("type").isin(*NO_STORAGE)
    ratio = F.when(stored, F.col("v_max_m3") / (F.col("q_hist") * SECONDS_PER_YEAR)).otherwise(0.0)
    at = at.withColumn("f_reg", ratio)
    return at.withColumn("category", F.when(F.col("f_reg") >= 1, "A").when(F.col("f_reg") >= 0.001, "B").otherwise("RoR"))


def flow_capacity_screen(stations: DataFrame, threshold: float = 0.1) -> DataFrame:
    """P-6: ratio of possible to rated power, and whether the station fails the screen (PS never does)."""
    possible = F.when((F.col("q_hist") > 0) & (F.col("head_m") > 0),
                      power_mw("q_hist", "head_m", turbine_efficiency("head_m"))).otherwise(0.0)
    share = F.when(F.col("capacity_mw") > 0, possible / F.col("capacity_mw"))
    fails = F.coalesce((share < threshold) & (F.col("type") != "PS"), F.lit(False))
    return stations.select("*", share.alias("flow_cap_ratio"), fails.alias("excluded"))


def exclude_future(stations: DataFrame, first_year: int = 2027) -> DataFrame:
    """P-7: stations commissioned after ``first_year`` dropped; an unknown year stays."""
    return stations.filter(F.col("year_built").isNull() | (F.col("year_built") <= first_year))


def fix_bathymetry_mismatch(stations: DataFrame) -> DataFrame:
    """P-8: where the used area is under a tenth of the reference one, take the reference reservoir.

    All new values come from the original columns; the power laws pass through the ends.
    """
    height = F.coalesce(_pos("dam_height_m"), _pos("head_m"))
    hit = F.coalesce(
        F.col("type").isin("STO", "PS") & (F.col("res_area_km2") > 0) & (F.col("max_area_km2") > 0)
        & (F.col("max_area_km2") / F.col("res_area_km2") < MISMATCH_RATIO)
        & (F.col("res_vol_km3") > 0) & height.isNotNull(), F.lit(False))
    area, volume = F.col("res_area_km2"), F.col("res_vol_km3")
    new = {
        "max_area_km2": area, "max_vol_km3": volume, "max_head_m": height,
        "coeff_a": area / F.pow(height, F.lit(AREA_EXPONENT)), "coeff_b": F.lit(AREA_EXPONENT),
        "coeff_c": volume / F.pow(height, F.lit(VOLUME_EXPONENT)), "coeff_d": F.lit(VOLUME_EXPONENT),
        "ps_area_km2": area * 0.70, "ps_vol_km3": volume * 0.70,
    }
    kept = [F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in stations.columns]
    return stations.select(*kept, hit.alias("bathymetry_fixed"))


def anchor_bathymetry(stations: DataFrame) -> DataFrame:
    """P-9: coefficients that pass through (head, largest area and volume); default exponents where unknown."""
    known = F.coalesce((F.col("coeff_a") > 0) & (F.col("coeff_c") > 0) & F.col("coeff_b").isNotNull()
                       & F.col("coeff_d").isNotNull(), F.lit(False))
    b = F.when(known, F.col("coeff_b")).otherwise(AREA_EXPONENT)
    d = F.when(known, F.col("coeff_d")).otherwise(VOLUME_EXPONENT)
    h = F.coalesce(_pos("head_m"), F.lit(1.0))
    stored = F.col("v_max_m3") > 0
    area = F.coalesce(F.when(F.col("a_max_m2") > 0, F.col("a_max_m2") / 1e6), F.lit(0.0))
    return stations.select(
        "*", F.when(stored, area / F.pow(h, b)).alias("bathy_a"), F.when(stored, b).alias("bathy_b"),
        F.when(stored, F.col("v_max_m3") / 1e9 / F.pow(h, d)).alias("bathy_c"), F.when(stored, d).alias("bathy_d"))


def relocate(stations: DataFrame, moves: DataFrame) -> DataFrame:
    """P-19: replace river id and coordinates from an override table (name, new_river_id, new_lat, new_lon)."""
    at = stations.join(moves, "name", "left")
    moved = F.col("new_river_id").isNotNull()
    place = moved & F.col("new_lat").isNotNull()
    swap = {"river_id": F.when(moved, F.col("new_river_id")).otherwise(F.col("river_id")),
            "lat": F.when(place, F.col("new_lat")).otherwise(F.col("lat")),
            "lon": F.when(place, F.col("new_lon")).otherwise(F.col("lon"))}
    return at.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in stations.columns])


def river_id(*columns: str) -> Column:
    """P-13: first known river id."""
    return F.coalesce(*columns)


def apply_corrections(stations: DataFrame, corrections: DataFrame, keys: Sequence[str] = ("region", "name")) -> DataFrame:
    """P-17: curated type, volume and capacity, with a flag per change.

    Type changes where the table says so. Volume: over 10 % off or between zero and
    positive. Capacity: over 10 MW off. ``corrections``: keys, original_type,
    corrected_type, original_vol_km3, corrected_vol_km3, original_cap_mw, corrected_cap_mw.
    """
    at = stations.join(corrections, list(keys), "left")
    no = F.lit(False)
    ov, cv = F.col("original_vol_km3"), F.col("corrected_vol_km3")
    oc, cc = F.col("original_cap_mw"), F.col("corrected_cap_mw")
    off = ((ov == 0) & (cv > 0)) | ((cv == 0) & (ov > 0)) | ((ov > 0) & (F.abs(cv - ov) > 0.1 * ov))
    type_hit = F.coalesce((F.col("original_type") != F.col("corrected_type")) & (F.col("type") != F.col("corrected_type")), no)
    vol_hit = F.coalesce(off & ~F.col("max_vol_km3").eqNullSafe(cv), no)
    cap_hit = F.coalesce((F.abs(cc - oc) > 10) & ~F.col("capacity_mw").eqNullSafe(cc), no)
    new = {"type": F.when(type_hit, F.col("corrected_type")).otherwise(F.col("type")),
           "max_vol_km3": F.when(vol_hit, cv).otherwise(F.col("max_vol_km3")),
           "capacity_mw": F.when(cap_hit, cc).otherwise(F.col("capacity_mw"))}
    return at.select(*[new[c].alias(c) if c in new else F.col(c) for c in stations.columns],
                     type_hit.alias("type_changed"), vol_hit.alias("vol_changed"), cap_hit.alias("cap_changed"))


def apply_verified(stations: DataFrame, verified: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """P-17: web-verified values: volume over 10 % off, head by a factor of 2, capacity over 15 % off."""
    at = stations.join(verified, list(keys), "left")
    no = F.lit(False)
    vol, head, cap = F.col("verified_vol_km3"), F.col("verified_head_m"), F.col("verified_cap_mw")
    vol_hit = F.coalesce(vol.isNotNull() & (F.col("max_vol_km3").isNull()
                         | (F.abs(F.col("max_vol_km3") - vol) / F.greatest(vol, F.lit(0.001)) > 0.1)), no)
    ratio = F.try_divide(head, _pos("head_m"))
    head_hit = F.coalesce((ratio > 2) | (ratio < 0.5), no)
    cap_hit = F.coalesce(F.abs(F.col("capacity_mw") - cap) / F.greatest("capacity_mw", F.lit(1.0)) > 0.15, no)
    new = {"max_vol_km3": F.when(vol_hit, vol).otherwise(F.col("max_vol_km3")),
           "head_m": F.when(head_hit, head).otherwise(F.col("head_m")),
           "capacity_mw": F.when(cap_hit, cap).otherwise(F.col("capacity_mw"))}
    return at.select(*[new[c].alias(c) if c in new else F.col(c) for c in stations.columns],
                     vol_hit.alias("vol_verified"), head_hit.alias("head_verified"), cap_hit.alias("cap_verified"))


def estimate_ps_volume(stations: DataFrame, low_h: float = 4.0, high_h: float = 200.0,
                       verified: str = "verified_ps_vol_km3") -> DataFrame:
    """P-18: pumped storage whose volume implies under 4 or over 200 hours takes 8 hours of output.

    A station with a value in the ``verified`` column, if there is one, takes that volume (if
    positive) and is never estimated.
    """
    given = F.col(verified) if verified in stations.columns else F.lit(None).cast("double")
    hours = ps_storage_hours("ps_vol_km3", "capacity_mw", "head_m")
    sized = (F.col("type") == "PS") & (F.col("capacity_mw") > 0) & (F.col("head_m") > 0) & given.isNull()
    hit = F.coalesce(sized & ((hours < low_h) | (hours > high_h)), F.lit(False))
    taken = F.coalesce((F.col("type") == "PS") & (given > 0), F.lit(False))
    volume = F.when(taken, given).when(hit, ps_volume_km3("capacity_mw", "head_m")).otherwise(F.col("ps_vol_km3"))
    rest = [c for c in stations.columns if c not in ("ps_vol_km3", verified)]
    return stations.select(*rest, volume.alias("ps_vol_km3"), hit.alias("ps_vol_estimated"), taken.alias("ps_vol_verified"))


def change_counts(changed: DataFrame, flags: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """P-17: number of changes by kind."""
    return changed.groupBy(*keys).agg(*[F.count_if(f).alias(f"n_{f}") for f in flags])


def match_names(wanted: DataFrame, features: DataFrame, name_columns: Sequence[str], want: str = "name",
                feature: str = "feature", aliases: DataFrame | None = None) -> DataFrame:
    """J-21: names to features: exact (lower, trimmed), then substring, else unmatched.

    ``aliases``: name, alias, ord (from 1); a name stands first among its own aliases. All aliases
    are tried exactly before any as a substring; the first alias with a hit decides, then
    the first name column. The substring step joins on the rarest of the alias's pieces of
    up to three letters, which every containing name holds; a piece that most names hold
    is used only by an alias that has no other. Names are matched once per distinct text, and
    features meet only the texts that are chosen.
    """
    columns = F.array(*[F.struct(F.lit(i).alias("ord"), F.lower(F.trim(c)).alias("text")) for i, c in enumerate(name_columns)])
    named = features.select(feature, F.explode(columns).alias("n")).select(feature, F.col("n.ord").alias("ord"), F.col("n.text").alias("full")).filter("full is not null")
    texts = reliable_checkpoint(named.select("ord", F.col("full").alias("text")).distinct())
    asked = wanted.select(want, F.lower(F.trim(want)).alias("text"), F.lit(0).alias("alias")).distinct()
    if aliases is not None:
        more = wanted.select(want).distinct().join(aliases.select(F.col("name").alias(want), F.lower(F.trim("alias")).alias("text"),
                                                                  F.col("ord").cast("int").alias("alias")), want)
        asked = asked.unionByName(more)
    exact = asked.join(texts, "text").select(want, F.col("text").alias("full"), "alias", "ord", F.lit("exact").alias("how"))
    rest = asked.join(exact.select(want), want, "left_anti").filter(F.length("text") > 0)

    def pieces(sizes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length("text"))
        return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(sizes, lambda k: F.substring(F.col("text"), i, k)))))
    index = texts.filter(F.length("text") > 0).select("ord", F.col("text").alias("full"),
                                                      F.explode(pieces(F.sequence(F.lit(1), F.lit(3)))).alias("gram"))
    size = F.least(F.length("text"), F.lit(3))
    own = rest.select(want, "text", "alias", F.explode(pieces(F.array(size))).alias("gram")).filter(
        F.length("gram") == F.least(F.length("text"), F.lit(3)))
    # A piece that no name holds drops out here, and with it the alias.
    held = index.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = own.join(held, "gram", "left").groupBy(want, "text", "alias").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    partial = ranked.join(index, "gram").filter(F.contains("full", "text")).select(
        want, "full", "alias", "ord", F.lit("substring").alias("how"))
    hits = exact.unionByName(partial)
    first = hits.groupBy(want).agg(F.min(F.struct("alias", "ord")).alias("f")).select(want, "f.*")
    chosen = hits.join(first, [want, "alias", "ord"]).select(want, "ord", "full", "how").distinct()
    chosen = chosen.join(named, ["ord", "full"]).select(want, feature, "how").distinct()
    return wanted.select(want).distinct().join(chosen, want, "left").select(
        want, feature, F.coalesce("how", F.lit("unmatched")).alias("how"))


def fallback_join(left: DataFrame, right: DataFrame, strict: Sequence[str], loose: Sequence[str],
                  values: Sequence[str], order: str = "row_ord") -> DataFrame:
    """J-3, J-4: first match on the strict key, else on the loose one."""
    from headrace.functions.core import first_match

    near = first_match(right.select(*strict, *values, order), list(strict), [order]).drop(order)
    far = first_match(right.select(*loose, *values, order), list(loose), [order]).drop(order)
    near = near.select(*strict, F.lit(True).alias("__hit"), *[F.col(v).alias(f"__n_{v}") for v in values])
    far = far.select(*loose, *[F.col(v).alias(f"__f_{v}") for v in values])
    at = left.join(near, list(strict), "left").join(far, list(loose), "left")
    return at.select(*left.columns, *[
        F.when(F.col("__hit"), F.col(f"__n_{v}")).otherwise(F.col(f"__f_{v}")).alias(v) for v in values])


def dem_resolution(area_km2: str, base: int = 500) -> Column:
    """X-14: coarser resolution for larger study areas (fixed steps)."""
    a = F.col(area_km2)
    return (F.when(a.isNull() | (a <= 1_000_000), base).when(a <= 2_500_000, max(base, 750))
            .when(a <= 5_000_000, max(base, 1000)).when(a <= 10_000_000, max(base, 1500)).otherwise(max(base, 2000)))

