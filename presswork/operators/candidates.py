"""From feed entries to candidates and items: cleaning, windows, identities, the keyword gate, first-seen duplicates and caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import ReportConfig
from ..functions import links
from ..functions import text as tx
from ..functions.vocab import match_keywords
from ..shared import where_computed
from .select import at_most, dedupe_and_cap, first_by

ARRIVAL = ("feed_ord", "entry_ord")


def candidates(entries: DataFrame, config: ReportConfig, report_date: date, as_of: datetime, entities: bool = True) -> DataFrame:
    """entries (feed_name, feed_role, feed_ord, entry_ord, language, title, link, summary, description, author, published, updated, published_ts, updated_ts) as candidates.

    Dropped are entries without title and link, with an old date in their URL, without link and time, or outside the window: the last
    lookback_hours before as_of for digests, else the days before the end of report_date. as_of stands for the clock, so a run can be
    repeated. A missing time passes both windows.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
    out = entries.withColumns({"_title": tx.clean(F.col("title"), entities), "_link": tx.strip(text("link"))}).where("_title <> '' or _link <> ''")
    if config.filter_stale_by_url_date:
        out = out.where((F.col("_link") == "") | ~links.stale_by_url(F.col("_link"), now, config.lookback_hours, config.stale_url_date_tolerance_days))
    out = out.withColumn("_at", tx.entry_time(F.col("published_ts"), F.col("updated_ts"), F.col("published"), F.col("updated"))).where("_link <> '' or _at is not null")
    if config.report_type in ("digest", "overnight_brief"):
        out = out.where(links.within_lookback(F.col("_at"), now, config.lookback_hours))
    else:
        out = out.where(links.within_days(F.col("_at"), F.lit(report_date), config.days_back))
    out = out.withColumns({"_title": F.when(F.col("_title") == "", "Untitled").otherwise(F.col("_title")), "_norm": links.normalize_link(F.col("_link"))})
    return out.select(
        links.article_id(F.col("_norm"), F.col("feed_name"), F.col("_title"), F.col("_at")).alias("article_id"),
        F.col("_title").alias("title"),
        tx.clean(F.coalesce(F.nullif(text("summary"), F.lit("")), text("description")), entities).alias("summary"),
        F.col("feed_name").alias("source"),
        "feed_name",
        "feed_role",
        F.col("_at").alias("published_at"),
        F.col("_link").alias("link"),
        F.col("_norm").alias("normalized_link"),
        F.lit(report_date).alias("report_date"),
        now.alias("collected_at"),
        tx.format_published(F.col("published"), F.col("updated"), F.col("_at"), entities).alias("published"),
        tx.clean(F.col("author"), entities).alias("author"),
        tx.language(F.col("language")).alias("language"),
        F.lower(tx.clean(F.concat_ws(" ", text("title"), text("summary"), text("description")), entities)).alias("legacy_match_text"),
        *ARRIVAL,
    )


def match_text() -> F.Column:
    return F.lower(F.coalesce(F.nullif(F.col("legacy_match_text"), F.lit("")), tx.clean(F.concat_ws(" ", "title", "summary"))))


def unique_candidates(found: DataFrame) -> DataFrame:
    """The first candidate of each normalised link, or of each id where there is no link, over all feeds."""
    key = links.dedupe_key(F.col("normalized_link"), F.col("article_id"))
    return first_by(found.withColumn("_key", key), ["_key"], [F.col(c) for c in ARRIVAL]).drop("_key")


def items(found: DataFrame, keywords: Mapping[str, Sequence[str]], mode: F.Column | None = None) -> DataFrame:
    """Candidates with a link and their matched keywords; where the feed's mode is keyword, only those that match."""
    mode = F.lit("keyword") if mode is None else F.coalesce(mode, F.lit("keyword"))
    matched = found.where("link <> ''").withColumn("_text", match_text()).withColumn("matched_keywords", match_keywords(F.col("_text"), keywords)).drop("_text")
    return where_computed(matched, (mode != "keyword") | (F.size(F.map_keys("matched_keywords")) > 0))


def with_feed_mode(found: DataFrame, feeds: DataFrame) -> DataFrame:
    """found with mode from feeds (name, mode), keyword where the feed is unknown. Spark broadcasts the list by its size."""
    return found.join(feeds.select(F.col("name").alias("_feed"), F.col("mode").alias("mode")), F.col("feed_name") == F.col("_feed"), "left").drop("_feed").withColumn("mode", F.coalesce("mode", F.lit("keyword")))


def collect_news(gated: DataFrame, config: ReportConfig) -> DataFrame:
    """Items of all feeds in order: each raw link once, at most max_items_per_feed of a feed."""
    return dedupe_and_cap(gated, "link", "feed_name", [F.col(c) for c in ARRIVAL], config.max_items_per_feed)


def legacy_items(unique: DataFrame, keywords: Mapping[str, Sequence[str]], feeds: DataFrame, per_feed: int) -> DataFrame:
    """Unique candidates through the gate of their feed's mode, at most per_feed of each feed: a window, as the links are unique already."""
    order = [F.col(c) for c in ARRIVAL]
    gated = items(with_feed_mode(unique, feeds), keywords, F.col("mode")).drop("mode")
    return at_most(first_by(gated, ["link"], order), ["feed_name"], order, per_feed)


def trace(unique: DataFrame, selected: DataFrame) -> DataFrame:
    """Each candidate with what became of it: left join on the normalised link, of selected items with one link the last."""
    last = W.partitionBy("_norm").orderBy(*[F.col(c).desc() for c in ARRIVAL])
    right = selected.select(links.normalize_link(F.col("link")).alias("_norm"), F.col("matched_keywords").alias("_matched"), *ARRIVAL).where("_norm <> ''")
    right = right.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("_norm", "_matched", F.lit(True).alias("_hit"))
    joined = unique.join(right, F.col("normalized_link") == F.col("_norm"), "left")
    return joined.select(
        "article_id", "title", "source", "feed_name", "feed_role", tx.iso_utc(F.col("published_at")).alias("published_at"), "link", "normalized_link", F.col("report_date").cast("string").alias("report_date"),
        (F.coalesce(F.size(F.map_keys("_matched")), F.lit(0)) > 0).alias("legacy_keyword_matched"), F.coalesce("_matched", F.create_map().cast("map<string,array<string>>")).alias("legacy_matched_keywords"),
        F.coalesce("_hit", F.lit(False)).alias("legacy_selected"), F.lit(None).cast("int").alias("legacy_score"), F.lit("").alias("legacy_category"),
        F.when(F.col("_hit").isNull(), "not_selected_by_legacy_keyword_gate_or_limits").otherwise("").alias("legacy_reject_reason"),
    )


def windows(found: DataFrame) -> DataFrame:
    """First and last publication and collection, one row."""
    return found.agg(F.min("published_at").alias("window_start"), F.max("published_at").alias("window_end"), F.min("collected_at").alias("collected_start"), F.max("collected_at").alias("collected_end"))
