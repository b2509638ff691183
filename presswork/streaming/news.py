"""An extension: the candidate scan over a stream of entries. The batch reports don't need it.

Each batch report forgets what it showed; a stream can hold a candidate's key for as long as the watermark lets it arrive late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import links
from ..functions import text as tx


def candidates(entries: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """Entries (feed_name, title, link, summary, published_ts) once for each normalised link within the watermark; no Python in the plan."""
    named = entries.withColumns({"link": tx.strip(F.col("link")), "title": tx.clean(F.col("title"), False), "summary": tx.clean(F.col("summary"), False)}).withColumn("normalized_link", links.normalize_link(F.col("link")))
    named = named.withColumn("article_id", links.article_id(F.col("normalized_link"), F.col("feed_name"), F.col("title"), F.col("published_ts")))
    return named.withColumn("key", links.dedupe_key(F.col("normalized_link"), F.col("article_id"))).withWatermark("published_ts", lateness).dropDuplicatesWithinWatermark(["key"])


def counts(found: DataFrame, window: str = "1 hour") -> DataFrame:
    """Candidates of each feed and window; a window is final once the watermark has passed it."""
    return found.groupBy(F.window("published_ts", window), "feed_name").agg(F.count("*").alias("n"))
