"""Station, grid and scenario tables from CSV, parquet and array files."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headrace.functions.core import nan_to_null, number, small_side

REGION_IN_PATH = r"([^/]+)/[^/]+/[^/]+$"


def path_part(pattern: str = REGION_IN_PATH, path: str = "_metadata.file_path") -> Column:
    return F.regexp_extract(F.col(path), pattern, 1)


def read_station_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
                     region_pattern: str | None = None) -> DataFrame:
    """S-1: many CSV files with differing columns to one declared schema.

    Columns are matched by name in each file; absent ones are NULL, unreadable
    numbers are NULL, extra ones are ignored. ``row_ord`` orders all rows: by the place
    of the file in ``paths``, then by the line. All files are one scan, whatever their
    headers; the table of headers has one row per file. A line that repeats its header is
    not data.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"), "value")
    heads = lines.filter("__block = 0").groupBy(F.col("__file").alias("__of")).agg(F.min(F.struct("__line", "value")).alias("h"))
    plain = F.regexp_replace("h.value", '"[^"]*"', "q")  # quoted names may hold the separator
    width = heads.agg(F.max(F.size(F.split(plain, ",")))).first()[0] or 1
    ddl = ", ".join(f"c{i} STRING" for i in range(width))

    def fields(text: str) -> Column:
        return F.transform(F.array(F.from_csv(text, ddl)), lambda r: F.array(*[r[f"c{i}"] for i in range(width)]))[0]
    given = F.transform(F.array(*[F.lit(p.rstrip("/")) for p in paths]), lambda p: F.contains(F.concat("__of", F.lit("/")), F.concat(F.lit("/"), F.ltrim(F.regexp_replace(p, "^[a-z0-9]+:", ""), F.lit("/")), F.lit("/"))))
    heads = heads.select("__of", F.col("h.value").alias("__header"), F.array_position(given, True).alias("__place"))
    heads = heads.withColumn("__names", F.transform(fields("__header"), F.trim))
    rows = lines.join(small_side(heads), F.col("__file") == F.col("__of")).filter("value <> __header").withColumn("__values", fields("value"))
    cols = []
    for f in schema:
        at = F.array_position("__names", f.name)
        text = F.when(at > 0, F.try_element_at("__values", at.cast("int")))
        rows = rows.withColumn(f"__{f.name}", text)
        typed = F.nullif(F.trim(f"__{f.name}"), F.lit("")) if isinstance(f.dataType, T.StringType) else number(f"__{f.name}").cast(f.dataType)
        cols.append(typed.alias(f.name))
    if region_pattern is not None:
        cols.append(path_part(region_pattern, "__file").alias("path_region"))
    order = F.struct(F.col("__place").alias("place"), F.col("__file").alias("file"), F.col("__block").alias("block"), F.col("__line").alias("line"))
    return rows.select(*cols, order.alias("row_ord"))


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """S-2: some columns of a parquet table, NaN as NULL."""
    return nan_to_null(spark.read.parquet(path).select(*columns))


def read_grid(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """S-13: the periods of a gridded variable as one long table; see ``duplicate_cells``."""
    out = None
    for path in paths:
        part = read_columns(spark, path, columns)
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_cells(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S-13, Q-5: grid cells given twice at one time."""
    return grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_cubes(spark: SparkSession, path: str, arrays: dict[str, str]) -> DataFrame:
    """S-14: ``[hour, year, station]`` array archives to long flow rows; done once, then parquet.

    ``arrays``: array name to scenario. The padded tail of short years has no
    rows. Files are decoded in parallel, one year of one array at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def decode(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    years, hours = z["simulation_years"], z["hrs_byyear"].astype(int)
                    for array, scenario in arrays.items():
                        if array not in z.files:
                            continue
                        cube = z[array]
                        for y, year in enumerate(years):
                            block = cube[: hours[y], y, :]
                            n_h, n_s = block.shape
                            yield pd.DataFrame({
                                "path": name, "scenario": scenario,
                                "station_idx": np.tile(np.arange(n_s, dtype="int32"), n_h), "year": np.int32(year),
                                "hoy": np.repeat(np.arange(n_h, dtype="int32"), n_s), "q": block.reshape(-1).astype(float)})

    schema = "path STRING, scenario STRING, station_idx INT, year INT, hoy INT, q DOUBLE"
    return nan_to_null(files.mapInPandas(decode, schema), ["q"])


def scenario_catalog(spark: SparkSession, path: str, regions: Sequence[str] | None = None, tag: str | None = None,
                     contains: str | None = None) -> DataFrame:
    """S-15: the (region, gcm, ssp, tag) combinations of a partitioned table.

    The filters are on partition columns, so they prune folders.
    """
    df = spark.read.parquet(path)
    if regions is not None:
        df = df.filter(F.col("region").isin(*regions))
    if tag is not None:
        df = df.filter(F.col("tag") == tag)
    if contains is not None:
        df = df.filter(F.contains("region", F.lit(contains)))
    return df.select("region", "gcm", "ssp", "tag").distinct()


def freshest_per_key(files: DataFrame, keys: Sequence[str], path: str = "path", modified: str = "modified") -> DataFrame:
    """S-16: the newest file of each key; the later path wins a tie."""
    return files.groupBy(*keys).agg(F.max_by(path, F.struct(modified, path)).alias(path))


def combined_or_parts(files: DataFrame, folder: str = "folder", combined: str = "is_combined") -> DataFrame:
    """S-17: a folder's combined file alone if there is one, else all of its parts."""
    has = files.groupBy(folder).agg(F.max(F.col(combined).cast("int")).alias("__has"))
    return files.join(has, folder).filter(F.col(combined).cast("int") == F.col("__has")).drop("__has")
