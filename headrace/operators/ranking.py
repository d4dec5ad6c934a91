"""Ordered work over groups of unbounded size.

A plain window puts a whole group into one task. Series windows may do that: one
station's series is no longer than the calendar. Groups of plants, sites or
reaches have no such bound, so the operators here measure the groups first and
cut each one above ``hot_rows`` into range slices, which are ranked apart and
then joined up by slice offsets. Results are exact in both cases.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrace.functions.core import ColumnLike, col
from headrace.session import reliable_checkpoint

HOT_ROWS = 4_000_000
#: A slice need not be smaller than this, beyond the first FEW_SLICES: each slice costs a task and rows sampled by the driver.
SLICE_ROWS, FEW_SLICES = 200_000, 64
QUANTILE_HOT_ROWS = 200_000
SKETCH_ACCURACY = 10_000
BROADCAST_GROUPS = 50_000
RANK_SALTS, HOT_SHARE = 64, 1000
SLICE = "__slice"


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int) -> tuple[DataFrame, bool]:
    """Add a slice number that grows with ``order`` inside every hot group."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    n_groups, n_rows = sizes.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    if n_groups == 0:
        return df.withColumn(SLICE, F.lit(0)), False
    if keys:
        hot_keys = _few(reliable_checkpoint(sizes.select(*keys)), n_groups)
        cold = df.join(hot_keys, list(keys), "left_anti").withColumn(SLICE, F.lit(0))
        hot = df.join(hot_keys, list(keys), "left_semi")
    else:
        cold, hot = None, df
    pieces = _pieces(n_rows, hot_rows)
    ranged = hot.repartitionByRange(pieces, *[F.col(k) for k in keys], *order)
    sliced = reliable_checkpoint(ranged.withColumn(SLICE, F.spark_partition_id()))
    return (sliced if cold is None else cold.select(sliced.columns).unionAll(sliced)), True


def _few(groups: DataFrame, n_groups: int) -> DataFrame:
    """Broadcast one row per group while that is few: a join by a shuffle puts all rows of a group into one task."""
    return F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups


def _pieces(n_rows: int, hot_rows: int) -> int:
    """Slices of half of ``hot_rows``, but a low ``hot_rows`` does not cut the rows finer than tasks should be."""
    return max(2, min(2 * math.ceil(n_rows / hot_rows), max(FEW_SLICES, 2 * math.ceil(n_rows / SLICE_ROWS))))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike],
                   sums: Mapping[str, Column], row_number: str | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inclusive prefix sums, and optionally the row number, in ``order`` (a total order)."""
    order = [col(o) for o in order]
    sliced, any_hot = _slices(df, keys, order, hot_rows)
    if row_number:
        sums = {**sums, row_number: F.lit(1).cast("long")}
    part = [*keys, SLICE]
    # Every (group, slice) holds at most about max(hot_rows, SLICE_ROWS) rows, as measured above.
    window = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not any_hot:
        return sliced.select("*", *[F.sum(e).over(window).alias(n) for n, e in sums.items()]).drop(SLICE)
    totals = sliced.groupBy(*part).agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select(
        *part, *[F.coalesce(F.sum(f"__t_{n}").over(before), zero).alias(f"__o_{n}") for n in sums]
    )
    local = sliced.select("*", *[F.sum(e).over(window).alias(f"__l_{n}") for n, e in sums.items()])
    joined = local.join(offsets, part)
    return joined.select(
        *df.columns, *[(F.coalesce(f"__l_{n}", zero) + F.col(f"__o_{n}")).alias(n) for n in sums]
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: ColumnLike, probs: Mapping[str, float],
                    hot_rows: int = QUANTILE_HOT_ROWS) -> DataFrame:
    """A-7: linearly interpolated quantiles per group, exact for groups of any size."""
    if not keys:
        whole = exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, hot_rows)
        return whole.drop("__all")
    rows = df.select(*keys, col(value).alias("__v")).filter(F.col("__v").isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = reliable_checkpoint(sizes.filter(F.col("__n") > hot_rows).select(*keys))
    built_in = [F.percentile("__v", F.lit(p)).alias(n) for n, p in probs.items()]
    n_hot = hot.count()
    if n_hot == 0:
        return rows.groupBy(*keys).agg(*built_in)
    hot_keys = _few(hot, n_hot)
    small = rows.join(hot_keys, list(keys), "left_anti").groupBy(*keys).agg(*built_in)
    large = _large_quantiles(rows.join(hot_keys, list(keys), "left_semi"), keys, probs, hot_rows)
    return small.unionByName(large)


def _large_quantiles(rows: DataFrame, keys: Sequence[str], probs: Mapping[str, float],
                     hot_rows: int) -> DataFrame:
    """Quantiles of hot groups without sorting them.

    Mergeable sketches bracket each quantile; one more pass counts what lies below a
    bracket and keeps the few values inside it. The counts prove whether the wanted
    ranks are inside; should one not be, all groups are ranked in full.
    """
    edges = [min(max(p + s * 2.0 / SKETCH_ACCURACY, 0.0), 1.0) for p in probs.values() for s in (-1, 1)]
    sketch = reliable_checkpoint(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", edges, SKETCH_ACCURACY).alias("__s")))
    brackets = []
    for i, (name, p) in enumerate(probs.items()):
        low = F.when(F.lit(edges[2 * i] == 0.0), F.col("__min")).otherwise(F.col("__s")[2 * i])
        high = F.when(F.lit(edges[2 * i + 1] == 1.0), F.col("__max")).otherwise(F.col("__s")[2 * i + 1])
        brackets.append(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), low.alias("lo"), high.alias("hi")))
    table = sketch.select(*keys, "__n", F.array(*brackets).alias("__b"))
    # One row per hot group, so at most rows / hot_rows; broadcast while that is few.
    table = _few(table, table.count())
    at = rows.join(table, list(keys))
    v = F.col("__v")
    below = at.groupBy(*keys).agg(*[
        F.count_if(v < F.col("__b")[i]["lo"]).alias(f"__below_{i}") for i in range(len(probs))])
    inside = at.select(*keys, "__v", F.explode("__b").alias("b")).filter((v >= F.col("b.lo")) & (v <= F.col("b.hi")))
    counts = reliable_checkpoint(inside.groupBy(*keys, F.col("b.name").alias("__q"), F.col("b.p").alias("__p"), "__v").agg(
        F.count(F.lit(1)).alias("__c")))
    ranked = running_totals(counts, [*keys, "__q"], ["__v"], {"__hi": F.col("__c")}, hot_rows=hot_rows)
    offsets = below.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), F.col(f"__below_{i}").alias("below")) for i, name in enumerate(probs)])).alias("o"))
    offsets = offsets.select(*keys, F.col("o.q").alias("__q"), F.col("o.below").alias("__below"))
    ranked = ranked.join(offsets, [*keys, "__q"]).join(sketch.select(*keys, "__n"), list(keys))
    position = F.col("__p") * (F.col("__n") - 1)
    top = F.col("__hi") + F.col("__below")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((top - F.col("__c") <= rank) & (rank < top), v))
    picked = reliable_checkpoint(ranked.groupBy(*keys, "__q").agg(
        value_at(F.floor(position)).alias("a"), value_at(F.ceil(position)).alias("b"),
        F.max(position - F.floor(position)).alias("share")))
    found, proven = picked.agg(F.count("*"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())).first()
    if found != proven or found != sketch.count() * len(probs):
        return _ranked_quantiles(rows, keys, probs, hot_rows)
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("share")
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("__q") == name, value)).alias(name) for name in probs])


def _ranked_quantiles(rows: DataFrame, keys: Sequence[str], probs: Mapping[str, float],
                      hot_rows: int) -> DataFrame:
    """Copies of a value are counted before the shuffle, then ranks are read off prefix counts."""
    counts = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    counts = reliable_checkpoint(counts)
    ranked = running_totals(counts, keys, ["__v"], {"__hi": F.col("__c")}, hot_rows=hot_rows)
    ranked = ranked.withColumn("__lo", F.col("__hi") - F.col("__c"))
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    ranked = ranked.join(_few(totals, totals.count()), list(keys))
    picks, outs = [], []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("__n") - 1)
        for side, at in (("a", F.floor(position)), ("b", F.ceil(position))):
            inside = (F.col("__lo") <= at) & (at < F.col("__hi"))
            picks.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{side}_{name}"))
        low, high = F.col(f"__a_{name}"), F.col(f"__b_{name}")
        share = F.lit(p) * (F.col("__n") - 1) - F.floor(F.lit(p) * (F.col("__n") - 1))
        outs.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys, "__n").agg(*picks).select(*keys, *outs)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], n: int,
                  salts: int = 64) -> DataFrame:
    """O-4, W-11: the first ``n`` rows per group in ``order`` (a total order).

    Two steps: each salted part of a group keeps its own first ``n``, so the
    last window sees at most ``salts * n`` rows of a group.
    """
    order = [col(o) for o in order]
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("__salt")
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    part = df.select("*", salt).withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= n)
    best = part.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= n)
    return best.drop("__salt", "__r")


def percent_rank_average(df: DataFrame, keys: Sequence[str], value: str, out: str = "pct_rank",
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """W-10: rank with ties averaged, divided by the count; NULL values get NULL.

    Ranks are found on distinct values, so a value held by a third of the rows is one row here. In the join
    back its rows are dealt to RANK_SALTS tasks. Such values hold over 1 / HOT_SHARE of all rows each, so there
    are fewer than HOT_SHARE of them to broadcast.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_totals(counts, keys, [value], {"__hi": F.col("__c")}, hot_rows=hot_rows)
    if keys:
        ranked = ranked.join(counts.groupBy(*keys).agg(F.sum("__c").alias("__n")), list(keys))
    else:
        ranked = ranked.withColumn("__n", F.lit(counts.agg(F.sum("__c")).first()[0]))
    table = ranked.select(
        *keys, value, ((F.col("__hi") - (F.col("__c") - 1) / 2) / F.col("__n")).alias(out)
    )
    total = counts.agg(F.sum("__c").alias("__all"))  # one row
    hot = counts.join(F.broadcast(total)).filter(F.col("__c") * HOT_SHARE > F.col("__all")).select(*keys, value, F.lit(True).alias("__hot"))
    hot = F.broadcast(reliable_checkpoint(hot))
    at = [*keys, value]
    copies = table.join(hot, at, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("__hot"), RANK_SALTS - 1).otherwise(0)))).drop("__hot")
    dealt = df.filter(F.col(value).isNotNull()).join(hot, at, "left").withColumn(
        "__salt", F.when(F.col("__hot"), (F.monotonically_increasing_id() % RANK_SALTS).cast("int")).otherwise(0)).drop("__hot")
    # NULL values have no rank and would all meet in one task of the join.
    ranked = dealt.join(copies, [*at, "__salt"]).select(*df.columns, out)
    bare = df.filter(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.unionByName(bare.select(ranked.columns))


def capacity_fill(demand: DataFrame, capacity: DataFrame, keys: Sequence[str], need: str, cap: str,
                  site: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """W-15, R-11: serve the largest needs first from the capacity of their group.

    delivered = min(need, what the needs before it left); no sequential loop.
    """
    wants = demand.filter(F.col(need) > 0)
    ordered = running_totals(wants, keys, [F.desc(need), F.asc(site)], {"__upto": F.col(need)},
                             hot_rows=hot_rows)
    joined = ordered.join(capacity.select(*keys, cap), list(keys), "left")
    left = F.greatest(F.lit(0.0), F.coalesce(F.col(cap), F.lit(0.0)) - (F.col("__upto") - F.col(need)))
    return joined.withColumn("delivered_mw", F.least(F.col(need), left)).drop("__upto")
