"""Time-series operators on long tables: one row per (keys, year, hoy) or (keys, ts).

Contract: inputs are first reduced to one row per key and time step (``time_grain``,
``hourly_mean``), an aggregate with map-side combine. After that a key's series is
no longer than the calendar (14 years of hours: 122 736 rows), which bounds every
window partition below whatever share of the raw rows one key held.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrace.functions import calendar as cal
from headrace.functions.core import ColumnLike, col

BASELINE = "nat"


def time_grain(df: DataFrame, keys: Sequence[str], ts: ColumnLike, unit: str,
               aggregates: Sequence[Column]) -> DataFrame:
    """A-2, A-3: reduce raw rows to one row per key and time step."""
    return df.groupBy(*keys, F.date_trunc(unit, col(ts)).alias("ts")).agg(*aggregates)


def hourly_mean(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """A-3: sub-hourly readings to the hourly mean; hours without a reading are absent."""
    out = time_grain(df, keys, ts, "hour", [F.avg(value).alias(value)])
    return out.filter(F.col(value).isNotNull())


def attach_baseline(df: DataFrame, at: Sequence[str], value: str = "q", baseline: str = BASELINE) -> DataFrame:
    """J-17: put the baseline scenario's value beside every other scenario's, same ``at`` keys.

    One exchange in place of a self-join; a partition holds one row per scenario.
    """
    window = Window.partitionBy(*at)
    nat = F.max(F.when(F.col("scenario") == baseline, F.col(value))).over(window)
    return (df.withColumn(f"{value}_nat", nat).filter(F.col("scenario") != baseline)
            .withColumnRenamed(value, f"{value}_reg"))


def finite_pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P-2: hours where the baseline and the scenario are both present and not negative."""
    pairs = attach_baseline(df, [*keys, "year", "hoy"])
    return pairs.filter((F.col("q_nat") >= 0) & (F.col("q_reg") >= 0))


def daily(flow: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """A-4, A-5: 24-hour blocks by position in the year; a trailing partial block is dropped."""
    day = F.floor(F.col("hoy") / 24).cast("int")
    whole = day < F.floor(cal.hours_in_year("year") / 24)
    return (flow.filter(whole).groupBy(*keys, "year", (day + 1).alias("doy"))
            .agg(*[e.alias(n) for n, e in aggregates.items()]))


def monthly_means(flow: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-6: mean per calendar month on a dense year x month grid; missing months are NULL.

    Each month emits itself and the gap up to the next one, so the grid needs no join.
    """
    means = (flow.withColumn("month", cal.month_of("year", "hoy"))
             .groupBy(*keys, "year", "month").agg(F.avg("q").alias("q")))
    window = Window.partitionBy(*keys).orderBy("__t")
    at = means.select(*keys, "q", (F.col("year") * 12 + F.col("month") - 1).alias("__t"))
    january = F.floor(F.col("__t") / 12) * 12
    first = F.when(F.lag("__t").over(window).isNull(), january).otherwise(F.col("__t"))
    last = F.coalesce(F.lead("__t").over(window) - 1, january + 11)
    dense = at.select(*keys, "q", "__t", first.alias("__a"), last.alias("__b")).select(
        *keys, "q", "__t", F.explode(F.sequence("__a", "__b")).alias("__m"))
    return dense.select(*keys, F.floor(F.col("__m") / 12).cast("int").alias("year"),
                        (F.col("__m") % 12 + 1).cast("int").alias("month"), F.when(F.col("__m") == F.col("__t"), F.col("q")).alias("q"))


def lags(df: DataFrame, keys: Sequence[str], order: str, value: str, steps: Sequence[int],
         name: str = "{value}_lag{k}h") -> DataFrame:
    """W-1: values ``k`` rows back on the sorted series."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *[F.lag(value, k).over(window).alias(name.format(value=value, k=k)) for k in steps])


def rolling_sums(df: DataFrame, keys: Sequence[str], order: str, value: str, widths: Sequence[int],
                 name: str = "{value}_sum_{k}h") -> DataFrame:
    """W-2: sums over the last ``k`` rows; NULLs skipped, all-NULL gives NULL."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *[
        F.sum(value).over(window.rowsBetween(1 - k, 0)).alias(name.format(value=value, k=k)) for k in widths
    ])


def rolling_mean_extremes(df: DataFrame, keys: Sequence[str], order: str, value: str,
                          widths: Sequence[int]) -> DataFrame:
    """W-3: minimum and maximum of the rolling mean over full windows; input without NULLs."""
    window = Window.partitionBy(*keys).orderBy(order)
    place = F.row_number().over(window)
    rolled = df.select(*keys, *[
        F.when(place >= k, F.avg(value).over(window.rowsBetween(1 - k, 0))).alias(f"r{k}") for k in widths
    ])
    return rolled.groupBy(*keys).agg(*[
        f(f"r{k}").alias(f"{n}{k}day") for k in widths for n, f in (("min", F.min), ("max", F.max))
    ])


def step_change(value: ColumnLike, position: ColumnLike, window, step: int = 1) -> Column:
    """W-4: first difference; a gap (the previous position is not one step back) gives NULL."""
    v, p = col(value), col(position)
    return F.when(F.lag(p).over(window) == p - step, v - F.lag(v).over(window))


def direction_change(step: ColumnLike, dead_band: ColumnLike, window) -> Column:
    """W-5: true where a step above the dead band turns against the last such step."""
    s = col(step)
    sign = F.when((F.abs(s) > col(dead_band)) & (s != 0), F.signum(s))
    before = F.last(sign, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(sign != before, F.lit(False))


def pulse_stats(df: DataFrame, keys: Sequence[str], order: str, mask: ColumnLike) -> DataFrame:
    """W-6: number and mean length of the runs of true; no run gives 0 and 0."""
    window = Window.partitionBy(*keys).orderBy(order)
    inside = F.coalesce(col(mask), F.lit(False))
    start = inside & ~F.coalesce(F.lag(inside).over(window), F.lit(False))
    marked = df.select(*keys, inside.alias("__in"), start.alias("__start"))
    count, rows = F.count_if("__start"), F.count_if("__in")
    return marked.groupBy(*keys).agg(
        count.alias("pulse_count"), F.coalesce(F.try_divide(rows, count), F.lit(0.0)).alias("pulse_mean_len")
    )


def flow_duration_curve(df: DataFrame, keys: Sequence[str], value: str = "q", points: int = 500,
                        min_rows: int = 10) -> DataFrame:
    """W-7: the value at ``points`` exceedance probabilities (k-.5)/points, linearly interpolated.

    Each ranked row emits the grid points that fall between it and the next row,
    so the grid costs no join. Values before the first and after the last plotting
    position take the end value.
    """
    rows = df.filter(F.col(value).isNotNull())
    window = Window.partitionBy(*keys)
    ordered = window.orderBy(F.desc(value))
    ranked = rows.select(
        *keys, F.col(value).alias("__v"), F.row_number().over(ordered).alias("__i"),
        F.lead(value).over(ordered).alias("__next"), F.count(F.lit(1)).over(window).alias("__n"),
    ).filter(F.col("__n") >= min_rows)
    i, n = F.col("__i"), F.col("__n")
    first = F.when(i == 1, 1).otherwise(F.ceil((i - 0.5) * points / n + 0.5))
    last = F.when(i == n, points).otherwise(F.ceil((i + 0.5) * points / n + 0.5) - 1)
    grid = F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))))
    at = ranked.select("*", grid.alias("k"))
    share = (F.col("k") - 0.5) / points * n + 0.5 - i
    step = F.coalesce(F.col("__next") - F.col("__v"), F.lit(0.0))
    return at.select(*keys, "k", (F.col("__v") + F.greatest(share, F.lit(0.0)) * step).alias("fdc"))


def recurrence_quantile(df: DataFrame, keys: Sequence[str], value: str, interval: float = 1.67,
                        min_rows: int = 5, out: str = "q_ri") -> DataFrame:
    """W-8: value at non-exceedance 1-1/interval on Weibull plotting positions, ends clamped."""
    target = 1.0 - 1.0 / interval
    rows = df.filter(F.col(value).isNotNull())
    window = Window.partitionBy(*keys)
    ordered = window.orderBy(value)
    ranked = rows.select(
        *keys, F.col(value).alias("__v"), F.row_number().over(ordered).alias("__i"),
        F.lead(value).over(ordered).alias("__next"), F.count(F.lit(1)).over(window).alias("__n"),
    )
    place = F.lit(target) * (F.col("__n") + 1)
    bracket = F.least(F.greatest(F.floor(place), F.lit(1)), F.col("__n"))
    share = F.greatest(place - F.col("__i"), F.lit(0.0))
    at = F.col("__v") + share * F.coalesce(F.col("__next") - F.col("__v"), F.lit(0.0))
    found = F.max(F.when((F.col("__i") == bracket) & (F.col("__n") >= min_rows), at))
    return ranked.groupBy(*keys).agg(found.alias(out))


def roll_hours(df: DataFrame, shift: ColumnLike, hoy: str = "hoy") -> DataFrame:
    """W-12: circular shift of each year's hours; a positive shift moves values later."""
    n = cal.hours_in_year("year")
    return df.withColumn(hoy, F.pmod(F.col(hoy) + col(shift), n).cast("int"))


def _drawn(seed: int, k: int) -> Column:
    """The k-th number of a seed, 0 to 2^32 - 1; the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.lit(f"{seed}/{k}")), 1, 8), 16, 10).cast("long")


def month_split(df: DataFrame, ts: str, n_val: int, n_test: int, seed: int = 42,
                mode: str = "discrete") -> DataFrame:
    """W-13: hold out whole months; ``discrete`` draws them, ``contiguous`` takes two blocks.

    The draw is the order of md5(seed/number) over the distinct months, so it does not
    depend on partitioning. Months are few (the calendar), hence one small window.
    """
    month = F.date_trunc("month", F.col(ts))
    months = df.select(month.alias("__m")).distinct()
    by_time = Window.orderBy("__m")
    numbered = months.select("__m", F.row_number().over(by_time).alias("__i"),
                             F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"))
    if mode == "discrete":
        draw = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("/", F.lit(seed), "__i")), "__i"))
        label = F.when(draw <= n_val, "val").when(draw <= n_val + n_test, "test").otherwise("train")
        table = numbered.select("__m", label.alias("split"), "__n")
    elif mode == "contiguous":
        room = F.col("__n") - n_val - n_test
        start = F.pmod(_drawn(seed, 1), room + 1) + 1
        before, after = F.greatest(start - n_test, F.lit(0)), F.greatest(room - start + 2, F.lit(0))
        pick = F.pmod(_drawn(seed, 2), before + after)
        test = F.when(pick < before, pick + 1).otherwise(start + n_val + pick - before)
        i = F.col("__i")
        label = (F.when((i >= start) & (i < start + n_val), "val")
                 .when((i >= test) & (i < test + n_test), "test").otherwise("train"))
        table = numbered.select("__m", label.alias("split"), "__n")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    enough = F.when(F.col("__n") > n_val + n_test, F.col("split")).otherwise(
        F.raise_error(F.lit("too few months for the split")).cast("string"))
    table = table.select("__m", enough.alias("split"))
    # One row per calendar month: a bounded table.
    joined = df.withColumn("__m", month).join(F.broadcast(table), "__m")
    return joined.drop("__m")


def sequences(df: DataFrame, keys: Sequence[str], order: str, features: Sequence[str], length: int,
              target: str) -> DataFrame:
    """W-14: the ``length`` rows before each row as one array; the row itself is the target."""
    window = Window.partitionBy(*keys).orderBy(order)
    history = F.collect_list(F.struct(*features)).over(window.rowsBetween(-length, -1))
    made = df.select(*keys, order, F.col(target).alias("y"), history.alias("x"))
    return made.filter(F.size("x") == length)


def pchip_hourly(df: DataFrame, keys: Sequence[str], ts: str, value: str, step_hours: int = 3,
                 tail_hours: int = 2) -> DataFrame:
    """W-16: monotone cubic (Fritsch-Carlson) interpolation to hours, clamped at 0.

    Slopes come from the neighbouring intervals; every interval then emits its own
    hours. The curve runs ``tail_hours`` past the last reading, on the last cubic.
    """
    window = Window.partitionBy(*keys).orderBy(ts)
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    base = df.select(*keys, ts, F.col(value).alias("y"), seconds.alias("__s"))
    base = base.select(
        "*", ((F.lead("__s").over(window) - F.col("__s")) / 3600.0).alias("h"),
        F.lead("y").over(window).alias("y1"),
    ).withColumn("d", (F.col("y1") - F.col("y")) / F.col("h"))
    base = base.select("*", F.lag("h").over(window).alias("h0"), F.lag("d").over(window).alias("d0"),
                       F.lead("h").over(window).alias("h2"), F.lead("d").over(window).alias("d2"),
                       F.lag("h", 2).over(window).alias("h00"), F.lag("d", 2).over(window).alias("d00"))
    h, d, h0, d0 = (F.col(c) for c in ("h", "d", "h0", "d0"))
    w1, w2 = 2 * h + h0, h + 2 * h0
    harmonic = (w1 + w2) / (w1 / d0 + w2 / d)
    inner = F.when(F.signum(d0) * F.signum(d) > 0, harmonic).otherwise(0.0)

    def edge(ha, hb, da, db):
        raw = ((2 * ha + hb) * da - ha * db) / (ha + hb)
        kept = F.when(F.signum(raw) != F.signum(da), 0.0).when(
            (F.signum(da) != F.signum(db)) & (F.abs(raw) > 3 * F.abs(da)), 3 * da).otherwise(raw)
        return F.when(db.isNull(), da).otherwise(kept)

    slope = (F.when(h0.isNull(), edge(h, F.col("h2"), d, F.col("d2")))
             .when(h.isNull(), edge(h0, F.col("h00"), d0, F.col("d00"))).otherwise(inner))
    base = base.withColumn("m", slope)
    base = base.select("*", F.lead("m").over(window).alias("m1"))
    last = F.lead(ts, 2).over(window).isNull()
    pieces = base.withColumn("__last", last).filter(F.col("y1").isNotNull())
    hours = F.when(F.col("__last"), F.col("h") + tail_hours).otherwise(F.col("h") - 1).cast("int")
    at = pieces.select("*", F.explode(F.sequence(F.lit(0), hours)).alias("__k"))
    t = F.col("__k") / F.col("h")
    cubic = ((2 * t * t * t - 3 * t * t + 1) * F.col("y") + (t * t * t - 2 * t * t + t) * F.col("h") * F.col("m")
             + (3 * t * t - 2 * t * t * t) * F.col("y1") + (t * t * t - t * t) * F.col("h") * F.col("m1"))
    seen = (F.col("__k") == 0) | (F.col("__last") & (F.col("__k") == F.col("h")))
    hour = F.timestamp_add("HOUR", F.col("__k"), F.col(ts))
    return at.select(*keys, hour.alias(ts), F.greatest(cubic, F.lit(0.0)).alias(value),
                     seen.cast("int").alias("is_observed"))


def linear_fill(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """W-17: linear between known neighbours; leading gaps stay, trailing gaps repeat the last value."""
    window = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("v")))
    back = F.last(known, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    # Backwards order: a frame that only grows is linear, one that shrinks is not.
    reverse = Window.partitionBy(*keys).orderBy(F.desc(order))
    ahead = F.last(known, ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, 0))
    at = df.select("*", back.alias("__b"), ahead.alias("__a"))
    run = F.col("__a.x") - F.col("__b.x")
    line = F.col("__b.v") + (F.col("__a.v") - F.col("__b.v")) * F.try_divide(F.col(order) - F.col("__b.x"), run)
    return at.withColumn(value, F.coalesce(F.col(value), line, F.col("__b.v"))).drop("__a", "__b")


def climatology(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """M-9: mean by hour of year on all 8760 hours, gaps filled by ``linear_fill``."""
    means = (df.select(*keys, cal.hour_of_year(ts).alias("hoy"), value)
             .groupBy(*keys, "hoy").agg(F.avg(value).alias(value)))
    grid = means.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(8759))).alias("hoy"))
    return linear_fill(grid.join(means, [*keys, "hoy"], "left"), keys, "hoy", value)


def align_to_calendar(df: DataFrame, keys: Sequence[str], ts: str, value: str,
                      first_year: int, last_year: int) -> DataFrame:
    """M-11: each value at its true hour; a year's gaps take its mean; negatives and dry years are 0."""
    at = df.select(*keys, F.year(ts).alias("year"), cal.hour_of_year(ts).alias("hoy"), F.col(value).alias("q"))
    at = at.groupBy(*keys, "year", "hoy").agg(F.max("q").alias("q"))
    span = F.sequence(F.lit(first_year), F.lit(last_year))
    grid = at.select(*keys).distinct().select(*keys, F.explode(span).alias("year"))
    grid = grid.select(*keys, "year", F.explode(F.sequence(F.lit(0), cal.hours_in_year("year") - 1)).alias("hoy"))
    mean = F.avg("q").over(Window.partitionBy(*keys, "year"))
    filled = grid.join(at, [*keys, "year", "hoy"], "left")
    return filled.select(
        *keys, "year", "hoy",
        F.greatest(F.coalesce("q", mean, F.lit(0.0)), F.lit(0.0)).alias("q"))


def deviation_and_swing(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """W-19, W-20: deviation from the row mean, peak-to-peak swing and share of the peak."""
    window = Window.partitionBy(*keys)
    peak = F.max(value).over(window)
    return df.select(
        "*", (F.col(value) - F.avg(value).over(window)).alias("deviation"),
        (peak - F.min(value).over(window)).alias("swing"),
        F.when(peak > 0, F.try_divide(F.col(value), peak)).otherwise(F.col(value)).alias("peak_share"),
    )


def lagged_value(flow: DataFrame, keys: Sequence[str], tau: str, first_year: int, last_year: int,
                 value: str = "q") -> DataFrame:
    """J-19: the series ``tau`` hours later; the end of a year runs into the next, the last into the first.

    The shift moves each row to the hour where it arrives: an expression, no join.
    """
    n = cal.hours_in_year("year")
    arrives = F.col("hoy") + F.col(tau)
    wraps = arrives >= n
    next_year = F.when(F.col("year") == last_year, F.lit(first_year)).otherwise(F.col("year") + 1)
    return flow.select(
        *keys, F.when(wraps, next_year).otherwise(F.col("year")).cast("int").alias("year"),
        F.when(wraps, arrives - n).otherwise(arrives).cast("int").alias("hoy"), value,
    )
