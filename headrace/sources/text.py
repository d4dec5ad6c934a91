"""Simulator and weather text files: whitespace tables behind title, header and unit lines.

Lines are split in parallel; header lines are told apart by content, because a
large file is read by many tasks and only one of them sees its head.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headrace.functions.calendar import julian_date
from headrace.functions.core import finite, small_side


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines as token arrays, with the file they came from."""
    lines = spark.read.text(path)
    return tokens(lines.select(F.col("_metadata.file_name").alias("file"), "value"))


def tokens(lines: DataFrame) -> DataFrame:
    """(file, value) lines to (file, tok)."""
    return lines.select("file", F.split(F.trim("value"), r"\s+").alias("tok"))


def token(names: Sequence[str], name: str, kind: str = "string") -> Column:
    text = F.try_element_at("tok", F.lit(list(names).index(name) + 1))
    return text if kind == "string" else text.try_cast(kind)


def data_rows(lines: DataFrame, names: Sequence[str], id_column: str, ids: DataFrame | None = None,
               prefix: str | None = None, leading: str = "yr") -> DataFrame:
    """S-3: data rows of a whitespace table, kept if their id is wanted.

    A data row has a number in ``leading``. ``prefix`` takes the id from the
    digits of a name such as ``rtu00012``. ``ids``: id.
    """
    rows = lines.filter(token(names, leading, "int").isNotNull())
    raw = token(names, id_column)
    ident = raw if prefix is None else F.nullif(F.regexp_extract(raw, rf"^{prefix}0*(\d+)", 1), F.lit(""))
    rows = rows.withColumn("id", ident.try_cast("int")).filter(F.col("id").isNotNull())
    return rows if ids is None else rows.join(ids.select(F.col("id").cast("int").alias("id")).distinct(), "id", "left_semi")


def _date(names: Sequence[str]) -> Column:
    return F.make_date(token(names, "yr", "int"), token(names, "mon", "int"), token(names, "day", "int"))


def channel_subday(lines: DataFrame, names: Sequence[str], ids: DataFrame | None = None) -> DataFrame:
    """S-4: hourly channel flow in m3/s. Steps run 1..24 or 0..23 in a file; anything else is an error."""
    rows = data_rows(lines, names, "gis_id", ids).withColumn("step", token(names, "tstep", "int"))
    # One row per file, joined by broadcast: the rows of a large file are never moved to one key.
    spans = rows.groupBy("file").agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    at = rows.join(small_side(spans), "file")
    hour = (F.when((F.col("lo") == 1) & (F.col("hi") == 24), F.col("step") - 1)
            .when((F.col("lo") == 0) & (F.col("hi") == 23), F.col("step"))
            .otherwise(F.raise_error(F.concat(F.lit("unexpected step range in "), "file")).cast("int")))
    flow = finite(token(names, "flo_out", "double")) / 3600.0
    ts = F.timestamp_add("HOUR", hour, _date(names).cast("timestamp_ntz"))
    return at.select(F.col("id").alias("channel"), ts.alias("ts"), flow.alias("flo_out"))


def daily_table(lines: DataFrame, names: Sequence[str], fields: Sequence[str], id_column: str = "gis_id",
               prefix: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """S-5: daily tables of channels, land units or aquifers; unreadable numbers are NULL."""
    rows = data_rows(lines, names, id_column, ids, prefix)
    return rows.select("id", _date(names).alias("date"), *[finite(token(names, f, "double")).alias(f) for f in fields])


def rain(lines: DataFrame) -> DataFrame:
    """S-6: hourly rain per station file: year, day of year, month, day, hour, mm."""
    names = ("yr", "jday", "mon", "day", "hour", "mm")
    rows = lines.filter((F.size("tok") >= 6) & token(names, "yr", "int").isNotNull())
    ts = F.timestamp_add("HOUR", token(names, "hour", "int"), _date(names).cast("timestamp_ntz"))
    return rows.select("file", ts.alias("ts"), finite(token(names, "mm", "double")).alias("precip_mm"))


def temperature(lines: DataFrame) -> DataFrame:
    """S-6: daily extremes per station file; the mean is their midpoint. -99 is missing."""
    names = ("yr", "jday", "tmax", "tmin")
    rows = lines.filter((F.size("tok") == 4) & token(names, "yr", "int").isNotNull()
                                          & token(names, "tmin", "double").isNotNull())

    def degrees(name):
        v = finite(token(names, name, "double"))
        return F.when(v > -99, v)
    date = julian_date(token(names, "yr", "int"), token(names, "jday", "int"))
    return rows.select("file", date.alias("date"), degrees("tmax").alias("tmax"), degrees("tmin").alias("tmin"),
                       ((degrees("tmax") + degrees("tmin")) / 2).alias("tmp_ave"))


def weather_stations(lines: DataFrame) -> DataFrame:
    """S-6: station catalogue with its data-file references and coordinates."""
    from headrace.functions.geo import grid_station_coords

    names = ("name", "wgn", "pcp", "tmp", "slr", "hmd", "wnd", "wnd_dir", "atmo_dep")
    rows = lines.filter((F.size("tok") >= 9) & (token(names, "name") != "name"))
    return rows.select(*[token(names, n).alias(n) for n in names], *grid_station_coords(token(names, "name")))


def connections(lines: DataFrame, id_at: int = 1, lat_at: int = 5, lon_at: int = 6,
                     weather_at: int = 8, keyword: str = "aqu") -> DataFrame:
    """S-7: connection table: id, coordinates, weather station, and the id after a keyword token if present."""
    rows = lines.filter(F.try_element_at("tok", F.lit(id_at)).try_cast("int").isNotNull())
    place = F.array_position("tok", keyword)
    linked = F.when(place > 0, F.try_element_at("tok", (place + 1).cast("int")).try_cast("int"))
    return rows.select(
        F.try_element_at("tok", F.lit(id_at)).try_cast("int").alias("id"),
        F.try_element_at("tok", F.lit(lat_at)).try_cast("double").alias("lat"),
        F.try_element_at("tok", F.lit(lon_at)).try_cast("double").alias("lon"),
        F.try_element_at("tok", F.lit(weather_at)).alias("weather"), linked.alias(keyword))
