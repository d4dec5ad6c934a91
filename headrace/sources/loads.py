"""Readers of load data in its many published layouts; all return (area, ts, load_mw) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headrace.functions.core import number


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",",
                   header_starts: str | None = None) -> DataFrame:
    """S-8: delimited text by declared columns; lead-in lines and the header are dropped by content.

    With ``header_starts`` the lines are parsed as text; a line that repeats the header or
    does not parse to all declared columns is not data. Quoted fields may hold the separator.
    """
    ddl = ", ".join(f"`{c}` STRING" for c in columns)
    if header_starts is None:
        return spark.read.csv(path, schema=ddl, sep=sep, header=True)
    lines = spark.read.text(path).filter(~F.col("value").startswith(header_starts))
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    parsed = lines.select(F.from_csv("value", f"{ddl}, __bad STRING", options).alias("r"))
    return parsed.filter("r.__bad IS NULL").select(*[F.col(f"r.`{c}`") for c in columns])


def load_rows(df: DataFrame, area: Column, ts: Column, mw: Column) -> DataFrame:
    """Typed load rows; rows without a time or a number are dropped."""
    rows = df.select(area.alias("area"), ts.alias("ts"), mw.alias("load_mw"))
    return rows.filter(F.col("ts").isNotNull() & F.col("load_mw").isNotNull())


def parse_time(text: str, pattern: str) -> Column:
    return F.try_to_timestamp(F.col(text), F.lit(pattern)).cast("timestamp_ntz")


def wide_areas(df: DataFrame, ts: Column, columns: dict[str, str]) -> DataFrame:
    """Country columns to rows. ``columns``: column to area."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("area"), number(c).alias("mw")) for c, a in columns.items()]))
    at = df.select(ts.alias("ts"), pairs.alias("p"))
    return load_rows(at, F.col("p.area"), F.col("ts"), F.col("p.mw"))


def hourly_columns(df: DataFrame, area: Column, date: Column, hours: Sequence[str]) -> DataFrame:
    """S-9: a row per day with 24 hour columns to hourly rows; the first column is hour 0."""
    at = df.select(area.alias("area"), date.alias("d"), F.posexplode(F.array(*[number(h) for h in hours])).alias("h", "mw"))
    return load_rows(at, F.col("area"), F.timestamp_add("HOUR", F.col("h"), F.col("d").cast("timestamp_ntz")), F.col("mw"))


def nested_json(texts: DataFrame, area: Column, column: str = "value") -> DataFrame:
    """S-10: ``Items[].Date, HourlyEntities[].Values.Hour01..Hour24`` in kWh to hourly MW rows."""
    hours = [f"Hour{h:02d}" for h in range(1, 25)]
    values = ", ".join(f"{h}: DOUBLE" for h in hours)
    ddl = f"Items ARRAY<STRUCT<Date: STRING, HourlyEntities: ARRAY<STRUCT<Values: STRUCT<{values}>>>>>"
    items = texts.select(area.alias("area"), F.explode(F.from_json(column, ddl)["Items"]).alias("i"))
    entities = items.select("area", F.to_date(F.substring("i.Date", 1, 10)).alias("d"),
                            F.explode("i.HourlyEntities").alias("e"))
    at = entities.select("area", "d", F.posexplode(F.array(*[F.col(f"e.Values.{h}") for h in hours])).alias("h", "kwh"))
    return load_rows(at, F.col("area"), F.timestamp_add("HOUR", F.col("h"), F.col("d").cast("timestamp_ntz")),
                     F.col("kwh") / 1000.0)


def read_xml(spark: SparkSession, path: str, row_tag: str = "DataTable", time: str = "DT", mw: str = "MW",
             area: str = "") -> DataFrame:
    """S-11: ``<DataTable><DT/><MW/></DataTable>`` rows."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(f"{time} STRING, {mw} STRING").load(path)
    return load_rows(rows, F.lit(area), F.try_to_timestamp(F.col(time)).cast("timestamp_ntz"), number(mw))


def packed_hours(df: DataFrame, area: str, value: str, row_ord: str = "row_ord") -> DataFrame:
    """S-12: values without a time, in file order (``row_ord`` from 0): hour of day and day of year by position."""
    i = F.col(row_ord)
    return df.select(F.col(area).alias("area"), (i % 24).cast("int").alias("hod"),
                     (F.floor(i / 24) % 365 + 1).cast("int").alias("doy"), number(value).alias("load_mw"))
