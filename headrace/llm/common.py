"""Tables, shared storage and text helpers used by all operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from headrace.session import shuffles_removed

#: A-Z to a-z, byte by byte; other letters stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and every ASCII byte that is neither a letter nor a digit becomes a space.
ALNUM = bytes(LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Bytes of one Arrow batch to a Python worker.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def find_code(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did (clusters may also install it)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def small_batches(spark: SparkSession) -> None:
    """Let Python workers of this session get texts by BATCH_BYTES at a time, unless the user has set a size.

    A batch lies in the JVM's buffers and, with copies, in the worker; 10,000 rows of two texts each are hundreds of MB over an executor's cores.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    find_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of bytes that are not ASCII white space (``bytes.split`` knows just those six)."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a local master without that setting gets a temporary folder. The path goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go when it ends, not when the driver's garbage is collected, unless the user has set that otherwise.
    ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``stored`` for tables that only what is computed inside the block reads; their files go with the block."""
    paths = []

    def put(df: DataFrame) -> DataFrame:
        paths.append(shared_folder(spark))
        return stored(df, paths[-1])

    try:
        yield put
    finally:
        for path in paths:
            removed(spark, path)


def with_results(df: DataFrame, keep: list[str], compute: Callable[[list], list[dict]], fields: str, *inputs: str) -> DataFrame:
    """The columns ``keep`` as they are (NULLs and types too) and ``fields`` of ``compute``, a dict per row.

    ``compute`` gets the values of ``inputs`` (default: text), a list for each. Other columns go, so
    their names can't clash.
    """
    inputs = inputs or ("text",)
    made = StructType.fromDDL(fields)
    arrow = to_arrow_schema(made)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.RecordBatch.from_pylist(compute(*(b.column(f"in_{i}").to_pylist() for i in range(len(inputs)))), schema=arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(f"keep_{i}") for i in range(len(keep))), *new.columns],
                                             names=[*keep, *made.names])

    asked = df.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"in_{i}") for i, c in enumerate(inputs)])
    return asked.mapInArrow(rows, StructType([*df.select(*keep).schema.fields, *made.fields]))


def kept_rows(df: DataFrame, accept: Callable[[list], list[bool]], column: str = "text") -> DataFrame:
    """The rows whose text ``accept`` takes, with all their columns."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(accept(b.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(rows, df.schema)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
