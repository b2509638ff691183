"""Curated responses as tables: contract violations, content policy, projections and evaluation against a reference.

A response is rows of events (response_id, pos, event_id, ..., evidence_article_ids, uncertainties) and of rejections (response_id, pos,
article_id, reject_reason). What breaks the contract is a row of violations (response_id, priority, code, path, article_id); the one with
the least priority is the one that is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocab import Vocabulary, default_vocabulary

TEXTS = ("event_id", "canonical_title", "summary", "why_important")
ENUMS = ("category", "importance", "novelty", "confidence")
_OUT = ("response_id", "priority", "code", "path", "article_id")


def _violation(df: DataFrame, when: Column, priority: Column | int, code: str, path: str, article: Column | None = None) -> DataFrame:
    base = priority if isinstance(priority, Column) else F.lit(priority)
    return df.where(when).select("response_id", base.cast("long").alias("priority"), F.lit(code).alias("code"), F.lit(path).alias("path"), (F.lit("") if article is None else article).alias("article_id"))


def violations(responses: DataFrame, events: DataFrame, rejected: DataFrame, articles: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """All violations. responses (response_id, schema_version, report_date, expected_version, expected_date, max_events), articles (response_id, article_id).

    Priorities follow the order in which a reader would meet them: the head, then event by event and check by check, rejections, overlaps.
    """
    v = vocabulary or default_vocabulary()
    blank = lambda c: F.coalesce(tx.strip(F.col(c)), F.lit("")) == ""
    known = articles.select("response_id", F.col("article_id").alias("_id")).distinct()
    out = [
        _violation(responses, ~F.col("schema_version").eqNullSafe(F.col("expected_version")), 10, "schema_version_mismatch", "schema_version"),
        _violation(responses, ~F.col("report_date").eqNullSafe(F.col("expected_date")), 20, "report_date_mismatch", "report_date"),
        _violation(articles.groupBy("response_id", "article_id").agg(F.count("*").alias("n")), F.col("n") > 1, 30, "duplicate_request_article_id", "request.articles.article_id"),
        _violation(responses.join(events.groupBy("response_id").agg(F.count("*").alias("n")), "response_id"), F.col("n") > F.col("max_events"), 50, "max_events_exceeded", "events"),
    ]
    at = lambda check: 1000 + F.col("pos") * 100 + check
    for i, c in enumerate(TEXTS):
        out.append(_violation(events, blank(c), at(i), "missing_required_field", f"events.{c}"))
    for i, c in enumerate(ENUMS):
        out.append(_violation(events, blank(c), at(10 + i), "missing_required_field", f"events.{c}"))
        out.append(_violation(events, ~blank(c) & ~tx.strip(F.col(c)).isin(*v[f"curator.{c}"]), at(10 + i), "invalid_enum_value", f"events.{c}"))
    path = "events.evidence_article_ids"
    size = F.coalesce(F.size("evidence_article_ids"), F.lit(0))
    out.append(_violation(events, size == 0, at(20), "evidence_required", path))
    ids = events.select("response_id", "pos", F.explode("evidence_article_ids").alias("_id")).withColumn("_id", tx.strip(F.col("_id")))
    out.append(_violation(ids.join(known, ["response_id", "_id"], "left_anti"), F.lit(True), at(21), "unknown_evidence_article_id", path))
    out.append(_violation(events, size > F.size(F.array_distinct(F.transform("evidence_article_ids", tx.strip))), at(22), "duplicate_evidence_article_id", path))
    seen = events.groupBy("response_id", "event_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("p"))
    out.append(_violation(seen.where("n > 1").withColumn("pos", F.col("p")[1]), F.lit(True), at(30), "duplicate_event_id", "events.event_id"))
    late = lambda check: 10**9 + F.col("pos") * 10 + check
    path = "rejected_article_ids.article_id"
    named = rejected.withColumn("_id", tx.strip(F.coalesce("article_id", F.lit(""))))
    out.append(_violation(named.join(known, ["response_id", "_id"], "left_anti"), F.lit(True), late(0), "unknown_rejected_article_id", path))
    twice = named.groupBy("response_id", "_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("p"))
    out.append(_violation(twice.where("n > 1").withColumn("pos", F.col("p")[1]), F.lit(True), late(1), "duplicate_rejected_article_id", path))
    out.append(_violation(rejected, ~F.coalesce(tx.strip(F.col("reject_reason")), F.lit("low_significance")).isin(*v["curator.reject_reason"]), late(2), "invalid_reject_reason", "rejected_article_ids.reject_reason"))
    both = ids.select("response_id", "_id").intersect(named.select("response_id", "_id")).groupBy("response_id").agg(F.min("_id").alias("_id"))
    out.append(_violation(both, F.lit(True), 2 * 10**9, "selected_rejected_overlap", "selected_rejected_article_ids", F.col("_id")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select(*_OUT)


def first_violation(found: DataFrame) -> DataFrame:
    """The violation that is reported of each response."""
    first = F.min(F.struct("priority", "code", "path", "article_id"))
    return found.groupBy("response_id").agg(first.alias("v")).select("response_id", "v.code", "v.path", "v.article_id")


def _any(words: str) -> str:
    return f"(?:{'|'.join(words.split())})"


_ACTS, _DO = _any("买入 卖出 加仓 减仓 做多 做空 持有 增持 减持 止损 止盈"), _any("buy sell hold")
_URGES, _READER, _MAY = _any("建议 推荐 可考虑 应该 应当 适合 不妨"), _any("您 你 读者 用户 投资者"), _any("应 应该 应当 可以 可考虑 请 务必")
_SAYS, _MOVES = _any("recommend recommended advise advised should suggest"), _any("buy sell hold short long add reduce")
ADVICE = (
    rf"(?U){_URGES}\s*{_ACTS}",
    rf"(?U){_READER}\s*{_MAY}\s*{_ACTS}",
    rf"(?U){_ACTS}\s*{_any('该股 这只股票 该股票 这只股')}",
    rf"(?iU)\b{_SAYS}\s+(?:to\s+)?{_MOVES}\b",
    rf"(?iU)\b{_DO}\s+{_any('this that the')}\s+{_any('stock shares? company')}\b",
)


def gives_advice(texts: Column) -> Column:
    """Whether any of an array of texts gives direct trading advice."""
    return F.coalesce(F.exists(texts, lambda t: F.greatest(*[t.rlike(p) for p in ADVICE])), F.lit(False))


def projected(candidates: DataFrame, summary_chars: int = 500) -> DataFrame:
    return candidates.withColumn("summary", F.substring("summary", 1, summary_chars))


def projection_counts(candidates: DataFrame, excluded_sources: tuple[str, ...], summary_chars: int = 500) -> DataFrame:
    """(original, excluded, capped, unchanged) in one pass."""
    kept = ~F.coalesce(F.col("source"), F.lit("")).isin(*excluded_sources)
    long = F.coalesce(F.length("summary") > summary_chars, F.lit(False))
    return candidates.agg(F.count("*").alias("original"), F.count_if(~kept).alias("excluded"), F.count_if(kept & long).alias("capped"), F.count_if(kept & ~long).alias("unchanged"))


def canonical_events(events: DataFrame) -> DataFrame:
    """Evidence ids once each, in order."""
    return events.withColumn("evidence_article_ids", F.array_distinct("evidence_article_ids"))


def request_json(candidates: DataFrame) -> DataFrame:
    """(article_id, json, bytes): candidates as compact JSON with sorted keys and nulls kept, and its length in UTF-8."""
    text = ["article_id", "author", "collected_at", "feed_name", "feed_role", "language", "link", "normalized_link", "published_at", "report_date", "source", "summary", "title"]
    as_text = {"collected_at": tx.iso_utc(F.col("collected_at")), "published_at": tx.iso_utc(F.col("published_at")), "report_date": F.col("report_date").cast("string")}
    body = F.to_json(F.struct(*[as_text.get(c, F.col(c)).alias(c) for c in text]), {"ignoreNullFields": "false"})
    return candidates.select("article_id", body.alias("json")).withColumn("bytes", F.octet_length("json"))


def evaluate(events: DataFrame, gold: DataFrame, markers: tuple[str, ...] | None = None) -> DataFrame:
    """(metric, reference_id, ids) of a response's events against gold (reference_id, tier, supporting, forbidden, attribution_required, uncertainty_expected).

    must_include_missing, background_over_priority (with event ids), forbidden_evidence_binding (with the ids in gold's order),
    attribution_required_missing and uncertainty_expected_missing.
    """
    markers = markers or default_vocabulary()["quality.attribution_markers"]
    support = gold.select("reference_id", F.explode("supporting").alias("article_id"))
    used = events.select("event_id", F.explode("evidence_article_ids").alias("article_id"))
    pairs = support.join(used, "article_id").select("reference_id", "event_id").distinct()
    missing = gold.join(pairs, "reference_id", "left_anti")
    none = F.array().cast("array<string>")
    out = missing.where("tier = 'must_include_at_10'").select(F.lit("must_include_missing").alias("metric"), "reference_id", none.alias("ids"))
    late = events.where("importance = 'background'").join(missing.select(F.lit(1).alias("_one")).limit(1), how="cross")
    out = out.unionByName(late.groupBy().agg(F.sort_array(F.collect_list("event_id")).alias("ids")).where(F.size("ids") > 0).select(F.lit("background_over_priority").alias("metric"), F.lit("").alias("reference_id"), "ids"))
    matched = pairs.join(events, "event_id").join(gold, "reference_id")
    barred = matched.groupBy("reference_id", "forbidden").agg(F.flatten(F.collect_list("evidence_article_ids")).alias("all")).select("reference_id", F.filter("forbidden", lambda i: F.array_contains(F.col("all"), i)).alias("ids")).where(F.size("ids") > 0)
    out = out.unionByName(barred.select(F.lit("forbidden_evidence_binding").alias("metric"), "reference_id", "ids"))
    unnamed = ~tx.has_attribution(F.col("canonical_title"), markers) | ~tx.has_attribution(F.col("summary"), markers)
    sure = (F.col("confidence") == "high") & (F.coalesce(F.size("uncertainties"), F.lit(0)) == 0)
    for metric, flag, bad in (("attribution_required_missing", "attribution_required", unnamed), ("uncertainty_expected_missing", "uncertainty_expected", sure)):
        out = out.unionByName(matched.where(F.col(flag) & bad).select(F.lit(metric).alias("metric"), "reference_id", none.alias("ids")).distinct())
    return out
