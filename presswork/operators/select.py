"""Ordered selection: caps, top rows, duplicates, and folds for what no window can say.

Rows have an arrival order (feed_ord, entry_ord or ord), which breaks every tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stage, where_computed

Rows = Iterator[dict]


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return at_most(df, keys, order, 1)


def at_most(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark drops the rest before the shuffle too."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def ranked(df: DataFrame, order: Sequence[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first limit rows of all, numbered from 1: a top-n in each partition, then among those."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(W.orderBy(*order)))


def capped_top(df: DataFrame, identity: Sequence[str], group: str, order: Sequence[Column], cap: int, limit: int) -> DataFrame:
    """Duplicates of identity dropped, then at most cap of each group, then the first limit: exact where duplicates are."""
    return ranked(at_most(first_by(df, identity, order), [group], order, cap), order, limit)


def fold(df: DataFrame, order: Sequence[Column], choose: Callable[[Rows], Rows], schema: str | T.StructType) -> DataFrame:
    """What choose yields from the rows in order, one at a time, by one task.

    For selections whose state depends on what was picked before. The sort is spread; the task reads its sorted parts one after another
    and stops where choose stops, so pass narrow rows, and a choose that ends when its caps are full.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in frame.astype(object).where(frame.notna(), None).to_dict("records"))
        picked = list(choose(rows))
        if picked:
            yield pd.DataFrame(picked)

    return df.orderBy(*order).coalesce(1).mapInPandas(run, schema)


def dedupe_and_cap(df: DataFrame, key: str, feed: str, order: Sequence[Column], cap: int) -> DataFrame:
    """First rows of each key over all feeds, and at most cap of each feed, in one pass feed by feed.

    A row beyond its feed's cap doesn't claim its key: a later feed may still have it. That is why two windows can't say this. The state is
    what was picked, at most cap for each feed. One task folds over the feeds that share a key with another, the first row of each key in each alone; the other
    feeds don't meet anybody and are capped by a window. order begins with the feed.
    """
    firsts = stage(first_by(df, [feed, key], order), "firsts")  # read three times
    met = firsts.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    shared = firsts.join(met, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(F.col(feed).alias("_feed")).distinct()
    apart = firsts.join(shared, F.col(feed).eqNullSafe(F.col("_feed")), "left_anti")
    df = firsts.join(shared, F.col(feed).eqNullSafe(F.col("_feed")), "left_semi")

    def choose(rows: Rows) -> Rows:
        seen, counts = set(), {}
        for row in rows:
            k, f = row[key], row[feed]
            if k in seen or counts.get(f, 0) >= cap:
                continue
            seen.add(k)
            counts[f] = counts.get(f, 0) + 1
            yield row

    return fold(df, order, choose, df.schema).unionByName(at_most(apart, [feed], order, cap))


def two_caps(df: DataFrame, identity: Sequence[str], group: str, kind: str, kind_value: str, order: Sequence[Column], group_cap: int, kind_cap: int, limit: int) -> DataFrame:
    """The first limit rows where a row that one cap turns away doesn't use up the other. Duplicates of identity count before any cap.

    The pre-filter keeps what could ever be picked: of each group and kind, group_cap rows of the first occurrences.
    """
    narrowed = at_most(first_by(df, identity, order), [group, F.col(kind) == kind_value], order, group_cap)

    def choose(rows: Rows) -> Rows:
        groups, kinds, n = {}, 0, 0
        for row in rows:
            g, special = row[group], row[kind] == kind_value
            if groups.get(g, 0) >= group_cap or (special and kinds >= kind_cap):
                continue
            groups[g] = groups.get(g, 0) + 1
            kinds += special
            n += 1
            yield row
            if n >= limit:
                return

    return fold(narrowed, order, choose, df.schema)


def first_category(df: DataFrame, matched: str, categories: Sequence[str]) -> DataFrame:
    """Each row with the first of categories that it matches; rows without one go."""
    named = F.array_intersect(F.array(*[F.lit(c) for c in categories]), F.map_keys(matched))  # in the order of categories; no lambda, in which the map would be made anew for each
    return where_computed(df.withColumn("category", F.try_element_at(named, F.lit(1))), F.col("category").isNotNull())


def category_order(categories: Sequence[str], configured: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*[c for c in configured if c in categories], *categories]))


def displayed(counts: DataFrame, n: str, cap: int) -> DataFrame:
    """How many rows a report shows where each group shows at most cap."""
    return counts.agg(F.coalesce(F.sum(F.least(F.col(n), F.lit(cap))), F.lit(0)).alias("displayed"))
