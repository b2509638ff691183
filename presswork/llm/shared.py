"""Joins whose small side is measured first, and the shared folder's functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from ..shared import drop, new_path, scratch, shared_dir, stage

#: Ids up to this number are broadcast (16 bytes each in Spark's long map); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes of a batch that goes to a Python worker: by rows alone, a batch of long texts takes hundreds of MB of a task's memory on either side.
BATCH_BYTES = 4 << 20


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in ids (one column, doc_id); a null doc_id stays. ids are broadcast only up to BROADCAST_IDS."""
    ids = stage(ids.select(F.col("doc_id").alias("_gone")).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs["doc_id"] == side["_gone"], "left_anti")


def bounded_batches(spark: SparkSession) -> None:
    """Lets no Arrow batch of the session hold more than about BATCH_BYTES; a lower bound of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def has(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns, whatever their names, can't clash with those that an operator adds. Python gets them in bounded batches."""
    bounded_batches(df.sparkSession)
    return df.select(*[df[f"`{n}`"] for n in names])


def filter_texts(docs: DataFrame, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns as they are, whose text judge keeps: texts in, one boolean for each out. Columns may have any names."""
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(judge(batch.column(text)), pa.bool_()))

    return plain.mapInArrow(run, schema)


__all__ = ["BROADCAST_IDS", "bounded_batches", "drop", "filter_texts", "has", "new_path", "scratch", "shared_dir", "stage", "without_ids"]
