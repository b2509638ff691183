"""Where intermediate tables go: a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: a cluster must name the folder that its executors share")
        found = "file://" + tempfile.mkdtemp(prefix="presswork-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: dict[str, SparkSession] = {}


def _remove(path: str, spark: SparkSession) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


@atexit.register
def _remove_all() -> None:
    for path, spark in _MADE.items():
        _remove(path, spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when a scratch around it or the session's driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the intermediate tables that are made within it at its end: what reads them has to be written by then."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in set(_MADE) - before:
            _remove(path, _MADE.pop(path))


def drop(path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    if path in _MADE:
        _remove(path, _MADE.pop(path))


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, and the loss of an executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a file that is likely to be one row group, which no scan divides.
ROW_GROUP_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read from fewer files than there are cores, none of them larger than a row group.

    Such a file is one task's work however much there is to do with its rows, so that moving them pays: no more than a row group for each core. A large
    table has more files, or larger ones that are read in parts, and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < files < cores and size <= files * ROW_GROUP_BYTES else df


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df where a condition on computed columns holds, without computing these twice.

    The optimizer pushes a filter below a projection by putting the columns' expressions in its place. That pays for plain columns; here it would
    evaluate large expressions once more for the filter. A row number in the projection keeps the filter above it.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).where((F.col("_row") >= 0) & condition).drop("_row")
