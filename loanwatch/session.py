"""Session settings and the shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_PINS: list[str] = []        # tables pin() wrote in this process
#: Spark's setting by which a query's shuffle files are deleted as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The settings results rely on (time zone) and the ones plans profit from."""
    return (builder
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true"))


def scratch_root(spark: SparkSession) -> str:
    """The folder cut lineage is written to.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    has none gets a new temporary folder; on a cluster a missing setting is an
    error, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(root)
    return root


def pin(df: DataFrame) -> DataFrame:
    """Write a frame to the scratch folder and read it back.

    Used where a value is assigned by physical layout (a sampled range
    partitioning, a row's index in its partition) and must not change when a
    lost task is run again, and where a costly frame is read several times. A
    parquet table instead of ``checkpoint()``: later passes read only the
    columns they need, and what was shuffled on the way is deleted at once.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pin-{uuid.uuid4().hex}"
    _PINS.append(path)
    with _without_leftovers(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside delete their shuffle files when they end.

    Otherwise the files stay until the garbage collector of a driver that has
    little to do finds their plans, and those of several steps add up on disk.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def only_last_pin(spark: SparkSession) -> Iterator[None]:
    """On leaving, deletes the tables that were pinned inside but the last, which holds all that is needed of them."""
    first = len(_PINS)
    yield
    passed, _PINS[first:] = _PINS[first:-1], _PINS[first:][-1:]
    _delete(spark, passed)


@contextmanager
def dropped_pins(spark: SparkSession) -> Iterator[None]:
    """On leaving, deletes the tables that were pinned inside. For work whose results are on the driver."""
    first = len(_PINS)
    yield
    passed, _PINS[first:] = _PINS[first:], []
    _delete(spark, passed)


def drop_pins(spark: SparkSession) -> None:
    """Delete the pinned tables this session wrote. For the end of a job: frames
    built on them can no longer be read afterwards."""
    while _PINS:
        _delete(spark, [_PINS.pop()])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A side that should be small, with its size checked before it is broadcast.

    At most ``max_rows + 1`` rows reach the driver. Within the bound they come
    back as a local relation with a broadcast hint; beyond it the frame is
    returned as it was and is joined by shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def keep(df: DataFrame) -> DataFrame:
    """Spill-backed cache for frames several MLlib jobs read."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
