"""Data-quality checks: each returns the violations, so an empty table means a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    """Q-1: raise if a required column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks {missing}")
    return df


def missing_columns(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Q-1: (table_name, column_name, reason) of required columns that are absent, or hold no value in any row (a pass per table)."""
    out = None
    for name in sorted(required):
        df, wanted = tables[name], sorted(set(required[name]))
        there = [c for c in wanted if c in df.columns]
        known = df.agg(F.count(F.lit(1)), *[F.count(F.col(c)).alias(c) for c in there])  # one row
        reason = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.when(F.col(c) == 0, "empty") if c in there else F.lit("absent")).alias("reason")) for c in wanted])
        part = known.select(F.lit(name).alias("table_name"), F.explode(reason).alias("m")).select("table_name", "m.*").filter("reason IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def not_one_row(df: DataFrame, keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Q-1: expected keys that do not have exactly one row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    at = expected.select(*keys).distinct().join(counts, list(keys), "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return at.filter("n_rows <> 1")


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]],
                     name: str = "var", value: str = "value") -> DataFrame:
    """Q-2: variables with values outside their range, or with no value at all."""
    v = F.col(value)
    bad = F.lit(False)
    for var, (low, high) in ranges.items():
        out = F.lit(False)
        if low is not None:
            out = out | (v < low)
        if high is not None:
            out = out | (v > high)
        bad = bad | ((F.col(name) == var) & out)
    sums = df.groupBy(name).agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("n_outside"), F.count(v).alias("n_known"),
                                F.min(v).alias("lowest"), F.max(v).alias("highest"))
    return sums.filter("n_outside > 0 or n_known = 0")


def line_violations(lines: DataFrame) -> DataFrame:
    """Q-3: bad type or status, repeated name, empty source, existing line without capacity."""
    copies = lines.groupBy("line_name").agg(F.count(F.lit(1)).alias("__n"))
    at = lines.join(copies, "line_name")
    blank = F.coalesce(F.trim("source_url"), F.lit("")) == ""
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin("AC", "HVDC", "MIXED"), F.lit(False)), "type"),
        F.when(~F.coalesce(F.col("status").isin("existing", "under_construction", "planned", "inactive"), F.lit(False)), "status"),
        F.when(F.col("__n") > 1, "duplicate"), F.when(blank, "source"),
        F.when((F.col("status") == "existing") & ~F.coalesce(F.col("capacity_mw") > 0, F.lit(False)), "capacity")))
    return at.select("line_name", F.explode(problems).alias("problem"))


def scenario_order_violations(supply: DataFrame, keys: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Q-4: regions where C >= B >= A does not hold."""
    broken = (F.col("supply_b_mw") + eps < F.col("supply_a_mw")) | (F.col("supply_c_mw") + eps < F.col("supply_b_mw"))
    return supply.filter(broken).select(*keys, "supply_a_mw", "supply_b_mw", "supply_c_mw")


def missing_combinations(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q-5: expected keys that are absent."""
    return expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q-5: keys that occur more than once, as repeated coordinates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def dangling(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q-6: child keys without a parent."""
    return child.select(*keys).distinct().join(parent.select(*keys), list(keys), "left_anti")


def parameter_violations(parameters: DataFrame) -> DataFrame:
    """Q-7: settings outside their domain. ``parameters``: name, kind (atc, loss, scale or iterations), value.

    A transfer factor lies in (0, 1], a loss in [0, 1), the others are positive; NULL is outside, unknown kinds too.
    """
    v, kind = F.col("value"), F.col("kind")
    good = F.when(kind == "atc", (v > 0) & (v <= 1)).when(kind == "loss", (v >= 0) & (v < 1)).when(kind == "scale", v > 0).when(kind == "iterations", v >= 1)
    return parameters.filter(~F.coalesce(good, F.lit(False))).select("name", "kind", "value")


def check_parameters(atc: Mapping[str, float], loss: Mapping[str, float], scale: float = 1.0, max_iterations: int = 1) -> None:
    """Q-7: raise on a transfer factor outside (0, 1], a loss outside [0, 1), or non-positive settings."""
    for name, value in atc.items():
        if not 0 < value <= 1:
            raise ValueError(f"{name} must be in (0, 1]: {value}")
    for name, value in loss.items():
        if not 0 <= value < 1:
            raise ValueError(f"{name} must be in [0, 1): {value}")
    if scale <= 0 or max_iterations < 1:
        raise ValueError("scale and max_iterations must be positive")


def coverage_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q-8: known share and quartiles of every column, one row per column."""
    from headrace.operators.ranking import exact_quantiles

    long = df.unpivot([], list(columns), "field", "value")
    share = long.groupBy("field").agg((100 * F.avg(F.col("value").isNotNull().cast("int"))).alias("known_pct"))
    quart = exact_quantiles(long, ["field"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return share.join(quart, "field", "left")


def write_observed(df: DataFrame, path: str, columns: Sequence[str], ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Q-2, Q-8, A-20: write ``df`` to ``path``; counts taken by the same pass: (field, n_rows, n_known, n_outside, lowest, highest).

    One row per number column of ``columns``, a handful of values each; an unbounded side of a range is None. The table is not read again.
    """
    counts = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        low, high = ranges.get(c, (None, None))
        out = (F.lit(False) if low is None else v < low) | (F.lit(False) if high is None else v > high)
        counts += [F.count(v).alias(f"known_{i}"), F.count_if(F.coalesce(out, F.lit(False))).alias(f"outside_{i}"), F.min(v).alias(f"low_{i}"), F.max(v).alias(f"high_{i}")]
    seen = Observation()
    df.observe(seen, *counts).write.parquet(path)
    got = seen.get
    rows = [(c, got["n_rows"], *(got[f"{k}_{i}"] for k in ("known", "outside", "low", "high"))) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "field string, n_rows long, n_known long, n_outside long, lowest double, highest double")
