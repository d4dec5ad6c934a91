"""Result tables, run manifests and station weather files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrace.functions.core import optional_columns, tidy
from headrace.schemas import METRIC

RUN_KEYS = ("region", "gcm", "ssp", "scenario_tag")


def metric_rows(df: DataFrame, topic: str, metric: str | Column, nat: str | Column | None, reg: str | Column | None,
                param: str | Column | None = None, year_agg: str = "mean", notes: str | Column | None = None) -> DataFrame:
    """P-23: the 19 columns of the tidy metric table from any keyed result."""
    def text(v):
        return v if isinstance(v, Column) else F.lit(v if v is not None else "")

    def val(v):
        return F.lit(None).cast("double") if v is None else (F.col(v) if isinstance(v, str) else v)
    new = {"topic", "metric", "param", "value_nat", "value_reg", "delta", "ratio", "year_agg", "notes"}
    kept = [c for c in df.columns if c not in new]
    made = df.select(*kept, F.lit(topic).alias("topic"), text(metric).alias("metric"), text(param).alias("param"),
                     *tidy(val(nat), val(reg)), F.lit(year_agg).alias("year_agg"), text(notes).alias("notes"))
    return optional_columns(made, METRIC)


def write_long_table(rows: DataFrame, path: str, partitions: Sequence[str] = RUN_KEYS) -> None:
    """S-18: metric rows as parquet by run, so a re-run replaces only its own folders."""
    (optional_columns(rows, METRIC).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def write_outputs(tables: Mapping[str, DataFrame], folder: str, partitions: Sequence[str] = ()) -> None:
    """S-19: one folder per named table."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{folder}/{name}")


def with_metadata(df: DataFrame, notes: Mapping[str, Mapping]) -> DataFrame:
    """S-20: facts about columns, kept in the parquet schema."""
    return df.select(*[F.col(c).alias(c, metadata=dict(notes[c])) if c in notes else F.col(c) for c in df.columns])


def dataset_card(df: DataFrame, ts: str, features: Sequence[str], split: str = "split") -> DataFrame:
    """S-20: one row: features, months per split, time range and row count."""
    month = F.date_format(F.date_trunc("month", ts), "yyyy-MM")
    months = df.select(split, month.alias("m")).distinct().groupBy(split).agg(F.array_sort(F.collect_list("m")).alias("months"))
    # One entry per split and calendar month.
    listed = months.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "months")))).alias("split_months"))
    span = df.groupBy().agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))
    one = F.lit(1)
    return listed.withColumn("__k", one).join(span.withColumn("__k", one), "__k").select(
        F.lit(json.dumps(list(features))).alias("features"), "split_months", "first_ts", "last_ts", "n_rows")


def run_manifest(runs: DataFrame) -> DataFrame:
    """S-21: runs counted by program and status, with their total time. ``runs``: program, status, seconds."""
    return runs.groupBy("program", "status").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("seconds").alias("seconds"))


def station_weather_lines(series: DataFrame, ext: str, station: str = "station") -> DataFrame:
    """S-22: fixed-width lines of one variable per station, the header lines first; missing is -99, rain 0.

    ``series``: station, lat, lon, date, and pcp by hour (``pcp``: hour, value) or
    tmax and tmin (``tmp``) or value (others).
    """
    year, jday = F.year("date"), F.dayofyear("date")
    if ext == "pcp":
        line = F.format_string("%d %d %d %d %d %10.5f", year, jday, F.month("date"), F.dayofmonth("date"), F.col("hour"),
                               F.coalesce("value", F.lit(0.0)))
        order = F.unix_date("date") * 24 + F.col("hour")
    elif ext == "tmp":
        line = F.format_string("%d %d %10.5f %10.5f", year, jday, F.coalesce("tmax", F.lit(-99.0)),
                               F.coalesce("tmin", F.lit(-99.0)))
        order = F.unix_date("date")
    else:
        line = F.format_string("%d %d %10.5f", year, jday, F.coalesce("value", F.lit(-99.0)))
        order = F.unix_date("date")
    body = series.select(F.col(station).alias("station"), F.lit(ext).alias("ext"), order.cast("long").alias("ord"), line.alias("value"))
    facts = series.groupBy(F.col(station).alias("station")).agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.countDistinct(F.year("date")).alias("years"))
    place = F.format_string("%d %d %10.4f %10.4f %10.3f", F.col("years"), F.lit(24 if ext == "pcp" else 0), F.col("lat"),
                            F.col("lon"), F.lit(0.0))
    heads = F.array(F.struct(F.lit(-(10**9)).cast("long").alias("ord"), F.concat("station", F.lit(f".{ext}")).alias("value")),
                    F.struct(F.lit(-(10**9) + 1).cast("long").alias("ord"), F.lit("nbyr tstep lat lon elev").alias("value")),
                    F.struct(F.lit(-(10**9) + 2).cast("long").alias("ord"), place.alias("value")))
    top = facts.select("station", F.lit(ext).alias("ext"), F.explode(heads).alias("h")).select("station", "ext", "h.*")
    return top.unionByName(body)


def write_station_weather(lines: DataFrame, folder: str) -> None:
    """S-22: a folder per station and variable; a station's lines are bounded by the calendar."""
    spread = lines.repartition("station", "ext").sortWithinPartitions("station", "ext", "ord")
    spread.select("station", "ext", "value").write.mode("overwrite").partitionBy("station", "ext").text(folder)
