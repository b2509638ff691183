"""Feed health: a status for each probe, their order and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("ok", "ok_with_warning", "empty", "failed")


def statuses(probes: DataFrame) -> DataFrame:
    """probes (entries_count, error_message) with status: an unreadable feed that has entries all the same is a warning."""
    bad = F.coalesce("error_message", F.lit("")) != ""
    return probes.withColumn("status", F.when(F.col("entries_count") > 0, F.when(bad, "ok_with_warning").otherwise("ok")).otherwise(F.when(bad, "failed").otherwise("empty")))


def in_order(results: DataFrame) -> DataFrame:
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")), F.lit(0))
    return results.orderBy(F.when(rank == 0, 100).otherwise(rank), "name")


def counts(results: DataFrame) -> DataFrame:
    """(status, n) for all four statuses, 0 where there is none; other values count for nothing."""
    known = results.sparkSession.createDataFrame([(s, i) for i, s in enumerate(STATUSES)], "status string, pos int")
    return known.join(results.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
