"""Session settings and the reliable lineage cut used by iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "headrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, ANSI and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master, as in tests, gets a temporary folder when none is named."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """A new path in the shared folder for files of this run; it goes when the driver ends."""
    path = f"{shared_base(spark).rstrip('/')}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames that are made and computed inside the block go with their action, unless the user has set that otherwise."""
    ours = spark.conf.get(_CLEANUP, None) is None
    if ours:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(_CLEANUP)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; the shuffle files that this took go.

    ``get_spark`` has Spark remove checkpoints that are no longer referenced.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)
