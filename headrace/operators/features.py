"""Learning tables for streamflow correction, and scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.functions.core import BROADCAST_ROWS, ColumnLike, col
from headrace.operators import series as S
from headrace.operators.spatial import nearest
from headrace.session import reliable_checkpoint

# Fixed values.
LAG_HOURS = (1, 3, 6, 12, 24)
RAIN_HOURS = (6, 12, 24, 72, 168)
MIN_SCORED = 5


def mapped_daily_mean(daily: DataFrame, mapping: DataFrame, unit: str, fields: Sequence[str], prefix: str) -> DataFrame:
    """J-2: daily mean over the units mapped to a channel. ``mapping``: channel, unit."""
    at = mapping.select("channel", unit).distinct().join(daily, unit)
    return at.groupBy("channel", "date").agg(*[F.avg(f).alias(f"{prefix}_{f}") for f in fields])


def hourly_features(flow: DataFrame, rain: DataFrame | None = None, daily: Sequence[DataFrame] = (),
                    target: DataFrame | None = None) -> DataFrame:
    """M-1: lags, rain sums and time features for all channels in one plan.

    ``flow``: channel, ts, flo_out. ``rain``: channel, ts, precip_mm. Each of
    ``daily``: channel, date, fields. ``target`` (channel, ts, y) is joined inner, last.
    """
    at = flow if rain is None else flow.join(rain, ["channel", "ts"], "left")
    if rain is None:
        at = at.withColumn("precip_mm", F.lit(None).cast("double"))
    at = S.lags(at, ["channel"], "ts", "flo_out", LAG_HOURS)
    at = S.rolling_sums(at, ["channel"], "ts", "precip_mm", RAIN_HOURS, name="precip_sum_{k}h")
    at = at.withColumn("date", F.to_date("ts"))
    for table in daily:
        at = at.join(table, ["channel", "date"], "left")
    at = at.select("*", *cal.cyclic_features(F.hour("ts"), F.dayofyear("ts")))
    return at if target is None else at.join(target, ["channel", "ts"])


def channel_mapping(channels: DataFrame, units: DataFrame, subbasin_aquifers: DataFrame) -> DataFrame:
    """M-2: channel to land units (own, else the nearest), their sub-basins and aquifers.

    ``channels``: channel, lat, lon. ``units``: unit, channel, subbasin, lat, lon.
    """
    own = channels.select("channel").join(units.select("channel", "unit", "subbasin"), "channel")
    rest = channels.join(own.select("channel"), "channel", "left_anti")
    near = nearest(rest, units, "channel", "unit", ["lat", "lon"]).select("channel", "unit")
    near = near.join(units.select("unit", "subbasin"), "unit")
    both = own.withColumn("by_distance", F.lit(False)).unionByName(
        near.select("channel", "unit", "subbasin", F.lit(True).alias("by_distance")))
    return _spread_join(both, subbasin_aquifers, "subbasin")


#: Rows of a result that one task should make.
PAIRS_PER_TASK = 2_000_000


def _spread_join(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join on a key of few values, whose pairs are counted first: the rows of a key are dealt to as many salts as its pairs need."""
    rows = reliable_checkpoint(rows)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).join(
        other.groupBy(key).agg(F.count(F.lit(1)).alias("__m")), key)
    salts = reliable_checkpoint(sizes.select(key, F.ceil(F.col("__n") * F.col("__m") / PAIRS_PER_TASK).alias("__salts")))
    tasks = salts.agg(F.sum("__salts")).first()[0] or 1
    dealt = rows.join(F.broadcast(salts) if tasks <= BROADCAST_ROWS else salts, key, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__salts", F.lit(1)))).drop("__salts")
    copies = other.join(salts, key).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__salts")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, tasks)
    return dealt.repartition(parts, key, "__salt").join(copies, [key, "__salt"], "left").drop("__salt")


def training_set(features: DataFrame, n_val: int, n_test: int, min_peak: float = 0.1, seed: int = 42,
                 target: str = "y", mode: str = "discrete") -> DataFrame:
    """M-3: drop low-flow rivers, then rows with a missing value, then hold out months."""
    peaks = features.groupBy("channel").agg(F.max(target).alias("__peak")).filter(F.col("__peak") >= min_peak)
    kept = features.join(peaks.select("channel"), "channel", "left_semi").dropna()
    return S.month_split(kept, "ts", n_val, n_test, seed, mode)


def valid_rivers(table: DataFrame, min_train: int = 1200, min_val: int = 720) -> DataFrame:
    """M-4: rivers with enough training and validation hours."""
    counts = table.groupBy("channel").agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                          F.count_if(F.col("split") == "val").alias("n_val"))
    return counts.filter((F.col("n_train") >= min_train) & (F.col("n_val") >= min_val))


def train_scaler(table: DataFrame, features: Sequence[str], target: str = "y") -> DataFrame:
    """M-5: mean and sample deviation of each feature on training rows; tiny deviations count as 1."""
    train = table.filter(F.col("split") == "train")

    def spread(f):
        s = F.stddev_samp(f)
        return F.when(s < 1e-8, 1.0).otherwise(s)
    scale = F.avg(target)
    return train.groupBy("channel").agg(
        *[F.avg(f).alias(f"mean_{f}") for f in features], *[spread(f).alias(f"sd_{f}") for f in features],
        F.when(scale < 1e-8, 1.0).otherwise(scale).alias("target_scale"))


def standardise(table: DataFrame, scaler: DataFrame, features: Sequence[str], target: str = "y") -> DataFrame:
    """M-5: centre and scale the features; scale the target, floor 1e-4."""
    at = table.join(scaler, "channel")
    return at.select("channel", "ts", "split",
                     *[((F.col(f) - F.col(f"mean_{f}")) / F.col(f"sd_{f}")).alias(f) for f in features],
                     (F.greatest(F.col(target), F.lit(1e-4)) / F.col("target_scale")).alias(target))


def skill_columns(obs: ColumnLike, sim: ColumnLike, where: Column | None = None) -> dict[str, Column]:
    """M-6: aggregates NSE, KGE, R2, PBIAS, RMSE over pairs that are both known; needs 5 pairs.

    One pass: NSE uses n var_pop(obs) for the spread of the observations.
    """
    both = col(obs).isNotNull() & col(sim).isNotNull()
    if where is not None:
        both = both & where
    o, s = F.when(both, col(obs)), F.when(both, col(sim))
    n = F.count(o)
    enough = n >= MIN_SCORED
    sd_o, sd_s, mean_o, mean_s = F.stddev_pop(o), F.stddev_pop(s), F.avg(o), F.avg(s)
    # The built-in correlation raises on a constant series in ANSI mode; here it is NULL.
    r = F.try_divide(F.covar_pop(o, s), sd_o * sd_s)
    err = F.sum(_sq(o - s))
    a = F.when(sd_o > 0, sd_s / sd_o)
    b = F.when(mean_o != 0, mean_s / mean_o)
    return {
        "nse": F.when(enough, 1 - F.try_divide(err, n * F.var_pop(o))),
        "kge": F.when(enough, 1 - F.sqrt(_sq(r - 1) + _sq(a - 1) + _sq(b - 1))),
        "r2": F.when(enough, r * r),
        "pbias": F.when(enough & (F.sum(o) != 0), 100 * F.try_divide(F.sum(s - o), F.sum(o))),
        "rmse": F.when(enough, F.sqrt(F.avg(_sq(o - s)))),
    }


def _sq(c: Column) -> Column:
    return c * c


def skill(predictions: DataFrame, keys: Sequence[str], obs: str, sim: str) -> DataFrame:
    return predictions.groupBy(*keys).agg(*[e.alias(n) for n, e in skill_columns(obs, sim).items()])


def skill_observed(predictions: DataFrame, keys: Sequence[str], obs: str, sim: str, flag: str = "is_observed") -> DataFrame:
    """M-7: NSE and KGE on observed hours only."""
    seen = F.coalesce(F.col(flag) == 1, F.lit(False))
    scores = skill_columns(obs, sim, where=seen)
    return predictions.groupBy(*keys).agg(*[scores[n].alias(f"{n}_obs") for n in ("nse", "kge")])


def interval_skill(predictions: DataFrame, keys: Sequence[str], obs: str, low: str, high: str) -> DataFrame:
    """M-8: share of observations within the bounds and mean width over the observed range."""
    span = F.max(obs) - F.min(obs)
    inside = F.col(obs).between(F.col(low), F.col(high)).cast("int")
    return predictions.groupBy(*keys).agg(
        F.avg(inside).alias("picp"), F.try_divide(F.avg(F.col(high) - F.col(low)), span).alias("pinaw"))


def scenario_change(future: DataFrame, history: DataFrame, keys: Sequence[str], by: str, value: str) -> DataFrame:
    """M-10: mean of each scenario, of history, and their ratio (denominator at least 1e-8)."""
    fut = future.groupBy(*keys, by).agg(F.avg(value).alias("fut_mean"))
    hist = history.groupBy(by).agg(F.avg(value).alias("hist_mean"))
    at = fut.join(hist, by, "left")
    return at.withColumn("ratio_fut_hist", F.when(
        F.col("hist_mean").isNotNull(), F.col("fut_mean") / F.greatest("hist_mean", F.lit(1e-8))))


def env_flow_target(flow: DataFrame, keys: Sequence[str], value: str = "q", share: float = 0.10) -> DataFrame:
    """M-12: 10 % of the long-term mean, not below 0."""
    return flow.groupBy(*keys).agg((share * F.greatest(F.coalesce(F.avg(value), F.lit(0.0)), F.lit(0.0))).alias("q_env"))


def merge_predictions(parts: Sequence[DataFrame]) -> DataFrame:
    """M-13, U-1: long table of all predictions; columns a part lacks are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def missing_share(table: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """A-20: share of missing values of every feature by key."""
    shares = table.groupBy(*keys).agg(*[F.avg(F.col(f).isNull().cast("int")).alias(f) for f in features])
    return shares.unpivot(list(keys), list(features), "feature", "missing_share")


def best_trial(trials: DataFrame, key: str = "channel") -> DataFrame:
    """O-3: positive validation NSE first, then the lowest CRPS, then the highest NSE, then the trial number."""
    rest = [c for c in trials.columns if c != key]
    order = F.struct((F.col("val_nse") > 0).cast("int"), -F.col("val_crps"), F.col("val_nse"), -F.col("trial"))
    best = trials.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(key, "b.*")

