"""Ensemble, regional, conservation and equity roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrace.functions.core import clip, first_match, ratio, weighted_mean, small_side
from headrace.functions.text import sign_class
from headrace.operators.ranking import top_per_group
from headrace.session import reliable_checkpoint

EPS = 1e-9


def ensemble_spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A-14: median, range, deviation, CV and sign agreement over the ensemble members."""
    mean, sd = F.avg(value), F.stddev_samp(value)
    return df.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        mean.alias("mean"), sd.alias("sd"), (F.try_divide(sd, mean) * 100).alias("cv_pct"),
        F.count_if(F.col(value) > 0).alias("n_pos"), F.count_if(F.col(value) < 0).alias("n_neg"),
        F.count(value).alias("n"))


def coverage_table(parts: DataFrame, scenario: str = "A") -> DataFrame:
    """V-1: one row per region for a scenario from the union of the bloc tables; first in ``row_ord`` wins."""
    return first_match(parts.filter(F.col("scenario") == scenario), ["region"], ["row_ord"])


def coverage_summary(table: DataFrame, value: str, weight: str = "demand_mw") -> DataFrame:
    """V-1: demand-weighted global value and the median region."""
    return table.agg(weighted_mean(value, weight).alias("weighted"), F.percentile(value, F.lit(0.5)).alias("median"),
                     F.count(F.lit(1)).alias("n_regions"))


def seasonal_heatmap(monthly: DataFrame, value: str, months: Sequence[int] = tuple(range(1, 13)),
                     worst: float = 90.0, best: float = 5.0) -> DataFrame:
    """V-2, A-12: regions with a bad worst month and a fair best one, one column per month."""
    kept = monthly.groupBy("region").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter(
        (F.col("lo") < worst) & (F.col("hi") >= best))
    at = monthly.join(kept.select("region"), "region", "left_semi")
    wide = at.groupBy("region", "year").pivot("month", list(months)).agg(F.avg(value))
    return wide.select("region", "year", *[F.col(str(m)).alias(f"m{m}") for m in months])


def collapse_small(rows: DataFrame, threshold: float = 0.0004) -> DataFrame:
    """V-4: entries under a share of the grand total merge into "Other <bloc>". Rows: bloc, name, kind, value."""
    positive = rows.filter("value > 0")
    total = positive.agg(F.sum("value").alias("__t")).withColumn("__one", F.lit(1))
    at = positive.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")  # a single row
    small = F.col("value") / F.col("__t") < threshold
    other = F.concat(F.lit("Other "), F.initcap(F.replace(F.col("bloc"), F.lit("_"), F.lit(" "))))
    return at.groupBy(
        "bloc", F.when(small, other).otherwise(F.col("name")).alias("name"),
        F.when(small, "other").otherwise(F.col("kind")).alias("kind")).agg(F.sum("value").alias("value"))


def fill_with_mode(df: DataFrame, keys: Sequence[str], value: str, default: str) -> DataFrame:
    """V-5, A-10: missing labels take the group's most frequent one; ties to the smallest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    mode = counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias("__mode"))
    return df.join(mode, list(keys), "left").withColumn(
        value, F.coalesce(value, "__mode", F.lit(default))).drop("__mode")


def climate_sensitivity(runs: DataFrame, value: str, low: str = "ssp126", high: str = "ssp585", agree: int = 4) -> DataFrame:
    """V-6: % change between two pathways per model, its median over models, and sign agreement."""
    def at(ssp):
        return F.max(F.when(F.col("ssp") == ssp, F.col(value)))
    change = runs.filter(F.col("ssp").isin(low, high)).groupBy("region", "gcm").agg(
        (100 * F.try_divide(at(high) - at(low), at(low))).alias("pct")).filter("pct is not null")
    out = change.groupBy("region").agg(
        F.percentile("pct", F.lit(0.5)).alias("pct_med"), F.count(F.lit(1)).alias("n_gcm"),
        F.count_if(F.col("pct") > 0).alias("n_pos"), F.count_if(F.col("pct") < 0).alias("n_neg"))
    return out.withColumn("robust", F.greatest("n_pos", "n_neg") >= agree)


def weighted_spread(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """V-7, A-15: weighted mean, weighted deviation and standard error of the mean, in one pass."""
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight))
    mean = F.try_divide(F.sum(w * v), F.sum(w))
    spread = F.try_divide(F.sum(w * v * v), F.sum(w)) - mean * mean
    sd = F.sqrt(clip(spread, 0.0))
    return df.groupBy(*keys).agg(mean.alias("wmean"), sd.alias("wsd"), F.count(v).alias("n"),
                                 (sd / F.sqrt(F.count(v).cast("double"))).alias("se"))


def log_attribution(df: DataFrame, keys: Sequence[str], hydro: tuple[str, str], demand: tuple[str, str]) -> DataFrame:
    """V-9: log change of supply over demand as a hydro term plus a demand term, in %."""
    def ln_ratio(a, b):
        return 100 * F.ln(F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(b) / F.col(a)))
    return df.select(*keys, ln_ratio(*hydro).alias("hydro"), (-ln_ratio(*demand)).alias("demand")).withColumn(
        "net", F.col("hydro") + F.col("demand"))


def interconnection_gain(cov: DataFrame, threshold: float = 0.0) -> DataFrame:
    """V-10: coverage gained by trade: median and range over the ensemble, above a threshold."""
    gain = F.col("cov_interconnected_pct") - F.col("cov_isolated_pct")
    out = cov.withColumn("gain", gain).groupBy("region").agg(
        F.percentile("gain", F.lit(0.5)).alias("med"), F.min("gain").alias("lo"), F.max("gain").alias("hi"),
        F.percentile("demand_mw", F.lit(0.5)).alias("demand_mw"))
    return out.filter(F.col("med") > threshold)


def lever_gains(supply: DataFrame) -> DataFrame:
    """V-11: gains B-A and C-B as % of demand, by region, then weighted by bloc and globally (bloc NULL).

    ``supply``: bloc, region, supply_a_mw, supply_b_mw, supply_c_mw, dc_mean_mw.
    """
    active = supply.filter("dc_mean_mw > 0")
    by_region = active.groupBy("bloc", "region").agg(
        F.avg(100 * (F.col("supply_b_mw") - F.col("supply_a_mw")) / F.col("dc_mean_mw")).alias("ps"),
        F.avg(100 * (F.col("supply_c_mw") - F.col("supply_b_mw")) / F.col("dc_mean_mw")).alias("cascade"),
        F.avg("dc_mean_mw").alias("dem"))
    return by_region.rollup("bloc").agg(
        weighted_mean("ps", "dem").alias("ps_gain_pct"), weighted_mean("cascade", "dem").alias("cascade_gain_pct"),
        F.count(F.lit(1)).alias("n_regions"))


def corridor_map(corridors: DataFrame, trade: DataFrame, min_mw: float = 50.0) -> DataFrame:
    """V-12: used corridors directed to the net importer, with signed square roots of net trade."""
    def net(side):
        return trade.select(F.col("region").alias(f"region_{side}"), F.col("net_export_mw").alias(f"net_{side}"))
    at = corridors.filter(F.col("used_mw") >= min_mw).join(net("a"), "region_a", "left").join(net("b"), "region_b", "left")
    na, nb = F.coalesce("net_a", F.lit(0.0)), F.coalesce("net_b", F.lit(0.0))
    turned = na < nb
    return at.select(
        F.when(turned, F.col("region_b")).otherwise(F.col("region_a")).alias("frm"),
        F.when(turned, F.col("region_a")).otherwise(F.col("region_b")).alias("to"), "used_mw",
        (F.signum(na) * F.sqrt(F.abs(na))).alias("net_root_a"), (F.signum(nb) * F.sqrt(F.abs(nb))).alias("net_root_b"))


def footprint_change(effects: DataFrame, keys: Sequence[str], new: str = "dc_a", conv: str = "conv", typical: str = "bal_c") -> DataFrame:
    """V-13, A-21: % affected, median change of the affected and relative change against two baselines.

    Groups are whole station inventories, so medians go through ``exact_quantiles``.
    """
    from headrace.operators.ranking import exact_quantiles

    known = effects.filter(F.col(new).isNotNull() & F.col(conv).isNotNull() & F.col(typical).isNotNull())
    known = reliable_checkpoint(known.select(*keys, new, conv, typical))  # read once per statistic below
    out = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    for tag, base in (("conv", conv), ("typ", typical)):
        d = F.col(new) - F.col(base)
        hit = F.abs(d) > EPS
        share = known.groupBy(*keys).agg((100 * F.avg(hit.cast("int"))).alias(f"pct_{tag}"))
        affected = known.filter(hit)
        middle = exact_quantiles(affected, keys, d, {f"med_{tag}": 0.5})
        based = affected.filter(F.abs(base) > EPS)
        rel = exact_quantiles(based, keys, F.abs(d / F.col(base)) * 100, {f"rel_{tag}": 0.5})
        out = out.join(share, list(keys)).join(middle, list(keys), "left").join(rel, list(keys), "left")
        out = out.withColumn(f"med_{tag}", F.coalesce(f"med_{tag}", F.lit(0.0)))
    return out


def increment_ratio(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V-14: mean increment over the typical grid as % of the mean change from conventional, affected only."""
    aff = effects.filter(F.abs("conv") > EPS).groupBy(*keys).agg(
        F.avg("typ").alias("typ"), F.avg("conv").alias("conv"), F.count(F.lit(1)).alias("n"))
    return aff.withColumn("ratio_pct", F.when(F.abs("conv") > EPS, F.col("typ") / F.abs("conv") * 100))


def basin_fill(points: DataFrame, poly: str, effect: str, how: str = "mean") -> DataFrame:
    """V-15, A-11: basin value from its points: mean, or the effect of largest size."""
    at = points.filter(F.col(poly).isNotNull())
    agg = F.avg(effect) if how == "mean" else F.max_by(effect, F.struct(F.abs(effect), -F.col("point")))
    return at.groupBy(poly).agg(agg.alias(effect))


def conservation_overlay(reaches: DataFrame, keys: Sequence[str], protected_pct: float = 50.0) -> DataFrame:
    """V-17, A-9: length, protected and threatened share by sign of the effect.

    ``reaches``: keys, eff, length_km, protected_pct, n_threatened.
    """
    at = reaches.withColumn("sign", sign_class("eff")).filter("sign <> 'neutral'")
    safe = F.coalesce(F.col("protected_pct") >= protected_pct, F.lit(False))
    fish = F.coalesce(F.col("n_threatened") > 0, F.lit(False))
    length = F.col("length_km")

    def where(c: Column, v: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    out = at.groupBy(*keys, "sign").agg(
        F.count(F.lit(1)).alias("n_reach"), F.sum("length_km").alias("length_km"),
        where(safe, length).alias("len_in_pa_km"), where(fish, length).alias("len_in_fish_km"),
        F.coalesce(F.sum(F.when(fish, F.col("n_threatened"))), F.lit(0)).alias("n_threatened_sp"),
        where(safe, F.abs("eff") * length).alias("wexp_pa"))
    total = F.when(F.col("length_km") != 0, F.col("length_km"))
    return out.select("*", F.coalesce(100 * F.col("len_in_pa_km") / total, F.lit(0.0)).alias("pa_share_pct"),
                      F.coalesce(100 * F.col("len_in_fish_km") / total, F.lit(0.0)).alias("fish_share_pct"))


def net_sign_table(overlay: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V-18: 100 (harm - benefit) / length and the protected share."""
    harm = F.sum(F.when(F.col("sign") == "harmful", F.col("length_km")).otherwise(0.0))
    good = F.sum(F.when(F.col("sign") == "beneficial", F.col("length_km")).otherwise(0.0))
    sums = overlay.groupBy(*keys).agg(harm.alias("harm_km"), good.alias("benefit_km"), F.sum("len_in_pa_km").alias("pa_km"),
                                      F.sum("n_threatened_sp").alias("n_threatened_sp"))
    length = F.col("harm_km") + F.col("benefit_km")
    return sums.filter(length > 0).select(
        *keys, length.alias("length_km"), (100 * F.col("pa_km") / length).alias("pa_share_pct"),
        (100 * (F.col("harm_km") - F.col("benefit_km")) / length).alias("net_pct"), "n_threatened_sp")


def equity_master(regions: DataFrame) -> DataFrame:
    """V-19: domestic share and the grid factor implied by intensity and avoided carbon."""
    need = F.col("dc_mean_mw")
    return regions.select(
        "*", (100 * F.try_divide(clip("supply_c_mw", None, need), need)).alias("dom_share_pct"),
        (F.col("net_carbon_avoided") / 1e6).alias("carbon_mt"),
        (F.col("dc_carbon_intensity") + F.try_divide(F.col("net_carbon_avoided") * 1000.0, need * 8760.0)).alias("ef_grid"))


def income_rollup(master: DataFrame, keys: Sequence[str] = ("income_group",)) -> DataFrame:
    """V-20: totals and domestic share by income group, with the group's share of avoided carbon."""
    sums = master.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_regions"), F.sum("dc_mean_mw").alias("dc_mean_mw"),
        F.sum(F.when(F.col("dc_mean_mw").isNotNull(), clip("supply_c_mw", None, F.col("dc_mean_mw")))).alias("firm_to_dc_mw"),
        F.sum("grid_resid_c_mw").alias("firm_to_grid_mw"),
        F.sum(F.when(F.col("carbon_mt") > 0, F.col("carbon_mt"))).alias("carbon_mt"))
    return sums.select("*", (100 * F.try_divide("firm_to_dc_mw", "dc_mean_mw")).alias("dom_share_pct"),
                       (100 * F.try_divide(F.col("carbon_mt"), F.sum("carbon_mt").over(Window.partitionBy()))).alias("carbon_share_pct"))


def flow_matrix(flows: DataFrame, groups: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """V-21: delivered power by exporting and importing income group."""
    src = groups.select(F.col("region").alias("src_region"), F.col("income_group").alias("src_group"))
    dst = groups.select(F.col("region").alias("dc_region"), F.col("income_group").alias("dc_group"))
    return (flows.join(src, "src_region").join(dst, "dc_region").groupBy(*keys, "src_group", "dc_group")
            .agg(F.sum("delivered_mw").alias("delivered_mw")))


def corridor_injustice(flows: DataFrame, burdens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V-21: a source's burden per exported MW, carried to each of its flows."""
    sent = flows.groupBy("src_region").agg(F.sum("sent_mw").alias("export_mw"))
    per_mw = sent.join(burdens.withColumnRenamed("region", "src_region"), "src_region").select(
        "src_region", ratio("burden", "export_mw").alias("burden_per_mw"))
    return flows.join(per_mw, "src_region", "left").groupBy(*keys).agg(
        F.sum("delivered_mw").alias("delivered_mw"), F.max("burden_per_mw").alias("burden_per_mw"))


def richness_classes(basins: DataFrame, species: DataFrame, top: int = 6) -> DataFrame:
    """V-22: threatened-species classes 1..6 (6 and more together) of the basins that have any."""
    at = basins.join(species, "basin", "left").filter("n_threatened > 0")
    return at.withColumn("richness_class", F.least("n_threatened", F.lit(top)).cast("int"))


def species_exposure(basin_effects: DataFrame, species: DataFrame) -> DataFrame:
    """A-18, U-4: number of species only in harmed, only in benefiting, and in both kinds of basin.

    One flag pair per species replaces the set differences.
    """
    at = basin_effects.filter("eff <> 0").join(species, "basin")
    flags = at.groupBy("species").agg(F.bool_or(F.col("eff") > 0).alias("harm"), F.bool_or(F.col("eff") < 0).alias("good"))
    return flags.agg(F.count_if(F.col("harm") & ~F.col("good")).alias("only_harm"),
                     F.count_if(F.col("good") & ~F.col("harm")).alias("only_benefit"),
                     F.count_if(F.col("harm") & F.col("good")).alias("both"))


def both_ends(df: DataFrame, value: str, key: str, top: int = 7, bottom: int = 6) -> DataFrame:
    """W-11: the largest and smallest rows, each once."""
    high = top_per_group(df, [], [F.desc(value), F.asc(key)], top)
    low = top_per_group(df, [], [F.asc(value), F.asc(key)], bottom)
    return high.unionByName(low).distinct()



def category_order(df: DataFrame, column: str, order: DataFrame, out: str = "ord", last: int = 99) -> DataFrame:
    """O-2: add the place of a category from an order table (``column``, ``out``); unknown and missing ones come last."""
    table = order.select(F.col(column), F.col(out).cast("int").alias(out)).groupBy(column).agg(F.min(out).alias(out))
    rest = [c for c in df.columns if c != out]
    return df.select(*rest).join(small_side(table), column, "left").select(*rest, F.coalesce(out, F.lit(last)).alias(out))
