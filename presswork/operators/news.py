"""Market news: four streams of insights, consolidation, themes and matches with holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import news as fn
from ..functions.vocab import Vocabulary, contained, contains_any, default_vocabulary
from ..shared import stage, where_computed
from .select import first_by, ranked, two_caps

INSIGHT = ["ord", "title", "source", "link", "reason", "score", "news_type"]


def by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("ord")]


def insights(articles: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """articles with ord, scored, those that are excluded, weak or unmapped overseas listings gone; blanks of title and source filled in."""
    v = vocabulary or default_vocabulary()
    kept = where_computed(fn.score_articles(articles.where(~fn.excluded(v)), v), fn.investable() & ~fn.unmapped_overseas_ipo(v))
    blank = lambda c: fn.tx.strip(F.coalesce(F.col(c), F.lit("")))
    return kept.withColumns({"title": F.coalesce(F.nullif(blank("title"), F.lit("")), F.lit("Untitled")), "source": F.coalesce(F.nullif(blank("source"), F.lit("")), F.nullif(blank("feed_name"), F.lit("")), F.lit("Unknown")), "link": blank("link")})


def consolidate_policies(events: DataFrame) -> DataFrame:
    """Events of one policy become one: the best one's place and reason, the others' titles in score order behind it, 20 points more for each."""
    key = F.coalesce(fn.policy_key(), F.concat(F.lit("#"), F.col("ord").cast("string")))
    keyed = events.select(*INSIGHT, key.alias("key"))
    best = lambda c: F.max_by(c, F.struct("score", (-F.col("ord")).alias("o")))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "title")))
    grouped = keyed.groupBy("key").agg(F.max("score").alias("top"), F.count("*").alias("n"), *[best(c).alias(c) for c in ("ord", "title", "source", "link", "reason", "news_type")], parts.alias("parts"))
    later = F.array_join(F.transform(F.slice(F.col("parts"), 2, 1 << 30), lambda p: F.concat(F.lit(" 同主题政策线索："), p["title"], F.lit("。"))), "")
    return grouped.select("ord", fn.policy_title(F.col("key"), F.col("title")).alias("title"), "source", "link", F.concat("reason", later).alias("reason"), (F.col("top") + 20 * (F.col("n") - 1)).cast("int").alias("score"), "news_type", "top")


def important(events: DataFrame, limit: int, per_source: int = 2, financing: int = 2) -> DataFrame:
    order = [F.col("score").desc(), F.col("top").desc(), F.col("ord")]
    return two_caps(events, ["link", "title"], "source", "news_type", fn.FINANCING, order, per_source, financing, limit)


def best_insights(found: DataFrame, limit: int) -> DataFrame:
    """The best row of each (link, title), then the best limit rows."""
    return ranked(first_by(found, ["link", "title"], by_score()), by_score(), limit)


def themes(catalysts: DataFrame, limit: int, vocabulary: Vocabulary | None = None, least_count: int = 2, least_score: int = 75) -> DataFrame:
    """(theme, n, top): confirmed by count or by score, best first, first seen first among equals."""
    v = vocabulary or default_vocabulary()
    stats = catalysts.withColumn("theme", fn.theme(v)).where("theme is not null").groupBy("theme").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("ord").alias("first"))
    return ranked(stats.where((F.col("n") >= least_count) | (F.col("top") >= least_score)), [F.col("top").desc(), F.col("first")], limit)


def holding_terms(holdings: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """holdings (ord, code, name, sector, watch_tags) with the terms that news is matched by, and the precise ones among them."""
    v = vocabulary or default_vocabulary()
    blank = lambda c: fn.tx.strip(F.coalesce(c, F.lit("")))
    tags = F.filter(F.transform(F.coalesce("watch_tags", F.array().cast("array<string>")), blank), lambda t: (t != "") & ~t.isin(*v["news.broad_holding_watch_tags"]))
    terms = F.filter(F.concat(F.array(*[blank(F.col(c)) for c in ("code", "name", "sector")]), tags), lambda t: t != "")
    return holdings.withColumn("terms", terms).withColumn("precise", F.filter("terms", lambda t: (F.length(t) >= 2) & ~t.isin(*v["news.holding_low_precision_sectors"])))


def holding_matches(found: DataFrame, holdings: DataFrame, limit: int, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(holding_title, holding_ord, rank, insight columns, holding_relation): of each holding and article the first term with a relation, then the best limit.

    A theta join by containment: each text is read once for all distinct terms, and what it holds is joined by the term.
    """
    own = holding_terms(holdings, vocabulary).select(F.col("ord").alias("holding_ord"), "code", "name", "precise", F.posexplode("terms").alias("pos", "term"))
    terms = [r["t"] for r in own.select(F.lower("term").alias("t")).distinct().collect()]  # a watch list's
    hits = found.withColumn("_held", contained(F.lower("news_text"), terms)).where(F.size("_held") > 0).withColumn("_hit", F.explode("_held")).drop("_held")
    pairs = hits.join(own, F.col("_hit") == F.lower("term")).drop("_hit")
    related = pairs.withColumn("holding_relation", fn.holding_relation(F.col("term"), F.col("code"), F.col("name"), F.col("precise"), F.col("score"))).where("holding_relation is not null")
    first = first_by(related, ["holding_ord", "ord"], [F.col("pos")])
    said = first.withColumns({"reason": fn.holding_reason(F.col("reason"), F.col("term"), F.col("holding_relation"), F.col("name")), "holding_title": F.concat_ws(" ", "code", "name")})
    once = first_by(said, ["holding_ord", "link", "title"], by_score())
    return once.withColumn("rank", F.row_number().over(W.partitionBy("holding_ord").orderBy(*by_score()))).where(F.col("rank") <= limit)


def analyze(articles: DataFrame, holdings: DataFrame | None = None, limit: int = 5, vocabulary: Vocabulary | None = None) -> DataFrame:
    """All sections in one frame: market_events, industry_catalysts, environment_points, theme_clues, watch_points, deep_dive_questions, holding_related_news.

    Articles are scored once for all streams and holdings.
    """
    v = vocabulary or default_vocabulary()
    found = stage(insights(articles, v).select(*INSIGHT, "news_text"), "insights")  # scored once for all streams and holdings
    lowered = F.lower("news_text")
    events = important(consolidate_policies(found.where(F.col("news_type").isin(fn.MACRO, fn.POLICY, fn.FINANCING, fn.OPERATING))), limit).withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), F.col("top").desc(), "ord")))
    catalysts = found.where((F.col("news_type") == fn.CATALYST) & (F.col("score") >= 55))
    best = best_insights(catalysts.select(*INSIGHT), limit)
    risky = found.where(contains_any(lowered, v["news.risk"]) & (F.col("score") >= 50)).select(*INSIGHT, F.lit(0).alias("late"), F.col("ord").alias("place"))
    added = events.where(F.col("news_type") == fn.POLICY).select(*INSIGHT, F.lit(1).alias("late"), F.col("rank").cast("long").alias("place"))
    order = [F.col("score").desc(), F.col("late"), F.col("place")]
    risks = ranked(first_by(risky.unionByName(added), ["link", "title"], order), order, limit)
    sentences = ranked(first_by(risks.withColumn("text", fn.risk_variable()), ["text"], [F.col("rank")]).select("text", F.col("rank").alias("r")), [F.col("r")], 2)
    watched = best_insights(found.where(contains_any(lowered, v["news.watch"])).select(*INSIGHT), limit)
    none = F.lit(None).cast("string")

    def long(df: DataFrame, section: str, **columns: Column) -> DataFrame:
        have = {c: F.col(c) for c in ("title", "source", "link", "reason", "score", "news_type", "holding_title", "holding_relation") if c in df.columns} | columns
        return df.select(F.lit(section).alias("section"), F.col("rank").cast("int").alias("rank"), *[have.get(c, none).cast("int" if c == "score" else "string").alias(c) for c in ("title", "source", "link", "reason", "score", "news_type", "holding_title", "holding_relation")])

    head = articles.agg(F.count("*").alias("n")).select(F.lit(0).alias("rank"), F.concat(F.lit("RSS 候选新闻 "), F.col("n").cast("string"), F.lit(" 条；以下只基于新闻线索做观察。")).alias("title"))
    questions = ranked(events.select("title", F.lit(0).alias("g"), F.col("rank").alias("r")).unionByName(best.select("title", F.lit(1).alias("g"), F.col("rank").alias("r"))), [F.col("g"), F.col("r")], limit)
    parts = [
        long(events, "market_events"),
        long(best, "industry_catalysts"),
        long(head, "environment_points"),
        long(sentences, "environment_points", title=F.concat(F.lit("风险/反证："), F.col("text"))),
        long(themes(catalysts, limit, v), "theme_clues", title=F.concat(F.lit("新闻线索指向："), F.col("theme")), score=F.col("top")),
        long(watched.withColumn("said", fn.watch_variable()), "watch_points", title=F.col("said")),
        long(questions, "deep_dive_questions", title=F.concat(F.col("title"), F.lit("：后续是否能被真实行情、成交结构或公司公告验证？"))),
    ]
    if holdings is not None:
        parts.append(long(holding_matches(found, holdings, limit, v), "holding_related_news"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
