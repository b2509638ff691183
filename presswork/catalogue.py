"""All queries over the library's operators on the star-schema and document tables, with their DuckDB counterparts.

The verbatim vocabularies hardly occur in the synthetic texts, so queries run with a vocabulary of syllable pairs that do; tests run the default
one on hand-written headlines. The SQL is written from the operators' meaning, not generated from their expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FEED_ROLES, ReportConfig
from .functions import links
from .functions import news as fn
from .functions import text as tx
from .functions.digest import Item, scored, with_match_texts
from .functions.vocab import contains_any, count_terms, default_vocabulary, format_matched, match_keywords, matched_terms
from .shared import spread, where_computed
from .operators import candidates, curation, digest, health, news, quotes, select, similar, stories

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df  # the tables with texts, of which much is made


# -- vocabulary and article frame

_SYLLABLES = "th er on an re he in ed nd ha at en es or ti st ou ea ing tion ly ble sh wh nt".split()


def _pairs(name: str, n: int) -> tuple[str, ...]:
    out: list[str] = []
    i = 0
    while len(out) < n:
        d = hashlib.md5(f"{name}/{i}".encode()).digest()
        term = _SYLLABLES[d[0] % len(_SYLLABLES)] + _SYLLABLES[d[1] % len(_SYLLABLES)]
        out += [term] if term not in out else []
        i += 1
    return tuple(out)


#: Names whose terms should be rare, so that what they suppress doesn't suppress everything.
_RARE = ("news.roundup", "news.weak_related", "policy_background", "local_promo", "news.negated_financing", "news.directory_or_ranking", "config.", "discussion", "core_low", "market_event_noise", "news.negated_signal")
VOCABULARY = {name: ((r"er[a-z]{0,2} (?:an|of)",) if name == "watch_time" else _pairs(name, 1 if name.startswith(_RARE) else 3)) for name in default_vocabulary()}
CONFIG = replace(ReportConfig(report_type="digest"), low_value_patterns=_pairs("low", 1), quick_scan_low_value_patterns=_pairs("quick", 1), core_event_negative_patterns=_pairs("negative", 2))
KEYWORDS = {"alpha": _pairs("alpha", 3), "beta": ("Ment", "eau", "ung"), "gamma": _pairs("gamma", 2)}
AS_OF = datetime(2024, 1, 31)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """documents as articles: the head of the first line (80 characters) as title, the whole text as summary, one of seven roles, a minute back for each id."""
    return article_rows(table(spark, sf, "documents"))


def article_rows(documents: DataFrame) -> DataFrame:
    roles = F.array(*[F.lit(r) for r in FEED_ROLES])
    return documents.select(
        F.col("doc_id").alias("ord"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("summary"),
        "source",
        F.col("source").alias("feed_name"),
        F.element_at(roles, (F.pmod("doc_id", F.lit(7)) + 1).cast("int")).alias("feed_role"),
        F.concat(F.lit("https://news.example/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("link"),
        (F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.pmod("doc_id", F.lit(20000)).cast("int"))).alias("published_at"),
    )


def gated(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    a = a.withColumn("_text", F.lower(tx.clean(F.concat_ws(" ", "title", "summary"))))
    return a.withColumn("matched_keywords", match_keywords(F.col("_text"), KEYWORDS)).drop("_text")


_NUM = r"\d+(?:\.\d+)?"


def _list(terms) -> str:
    return "[" + ", ".join("'" + t.lower().replace("'", "''") + "'" for t in terms) + "]"


def _n(terms, column: str) -> str:
    return f"len(list_filter({_list(terms)}, lambda z: contains({column}, z)))"


def _has(terms, column: str) -> str:
    return f"({_n(terms, column)} > 0)"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


_A = f"""a0 AS (
  SELECT doc_id AS ord, substr(string_split(text, chr(10))[1], 1, 80) AS title, text AS summary, source, source AS feed_name,
    {"[" + ", ".join(f"'{r}'" for r in FEED_ROLES) + "]"}[doc_id % 7 + 1] AS feed_role, 'https://news.example/' || source || '/' || doc_id AS link,
    TIMESTAMP '2024-01-31 00:00:00' - to_minutes(doc_id % 20000) AS published_at FROM documents
), a AS (
  SELECT *, {_clean("title")} AS rt, lower({_clean("title")}) AS ti, lower({_clean("title || ' ' || summary")}) AS t,
    lower({_clean("title || ' ' || summary || ' ' || source || ' ' || feed_name")}) AS cx FROM a0
)"""


# -- keywords, terms, categories


@query(
    f"""WITH {_A}, m AS (SELECT ord, {", ".join(f"list_filter([{', '.join(chr(39) + x + chr(39) for x in k)}], lambda x: contains(t, lower(x))) AS {c}" for c, k in KEYWORDS.items())} FROM a)
    SELECT ord, array_to_string(list_filter([{", ".join(f"CASE WHEN len({c}) > 0 THEN '{c}: ' || array_to_string({c}, ', ') END" for c in KEYWORDS)}], lambda x: x IS NOT NULL), '; ') AS matched
    FROM m WHERE {" OR ".join(f"len({c}) > 0" for c in KEYWORDS)}"""
)
def q_keyword_match(spark, sf):
    return where_computed(gated(spark, sf), F.size(F.map_keys("matched_keywords")) > 0).select("ord", format_matched(F.col("matched_keywords")).alias("matched"))


@query(f"""WITH {_A} SELECT ord, CAST({_n(VOCABULARY["market_signal"], "t")} AS INTEGER) AS signals, CAST({_n(VOCABULARY["watch"], "t")} AS INTEGER) AS watched, {_has(CONFIG.low_value_patterns, "cx")} AS low_value FROM a""")
def q_term_counts(spark, sf):
    own = Item(VOCABULARY, CONFIG)
    return with_match_texts(articles(spark, sf)).select("ord", own.n("market_signal").cast("int").alias("signals"), own.n("watch").cast("int").alias("watched"), own.low_value().alias("low_value"))


_CATEGORY = f"""CASE {" ".join(f"WHEN {_has(k, 't')} THEN '{c}'" for c, k in KEYWORDS.items())} END"""


@query(f"""WITH {_A}, c AS (SELECT {_CATEGORY} AS category FROM a), names AS (SELECT unnest({"[" + ", ".join(f"'{c}'" for c in (*KEYWORDS, "never"))}]) AS category)
    SELECT names.category, count(c.category) AS n FROM names LEFT JOIN c ON c.category = names.category GROUP BY 1""")
def q_first_category(spark, sf):
    counts = select.first_category(gated(spark, sf), "matched_keywords", list(KEYWORDS)).groupBy("category").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(c,) for c in (*KEYWORDS, "never")], "category string")
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_A}, c AS (SELECT ord, {_CATEGORY} AS category FROM a) SELECT category, ord FROM c WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY ord) <= 8""")
def q_category_topn(spark, sf):
    return select.at_most(select.first_category(gated(spark, sf), "matched_keywords", list(KEYWORDS)).select("category", "ord"), ["category"], [F.col("ord")], 8)


@query(f"""WITH {_A}, c AS (SELECT {_CATEGORY} AS category, count(*) AS n FROM a GROUP BY 1) SELECT CAST(coalesce(sum(least(n, 8)), 0) AS BIGINT) AS displayed FROM c WHERE category IS NOT NULL""")
def q_displayed_count(spark, sf):
    counts = select.first_category(gated(spark, sf), "matched_keywords", list(KEYWORDS)).groupBy("category").agg(F.count("*").alias("n"))
    return select.displayed(counts, "n", 8)


# -- text


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def q_candidate_dedupe(spark, sf):
    return select.first_by(table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key")), ["key"], [F.col("doc_id")]).select("doc_id", "source")


_URL = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_NORM = rf"""lower(regexp_extract(url, '{_URL}', 1)) || '://' || lower(regexp_extract(url, '{_URL}', 2))
    || CASE WHEN regexp_replace(regexp_extract(url, '{_URL}', 3), '/+$', '') = '' THEN regexp_extract(url, '{_URL}', 3) ELSE regexp_replace(regexp_extract(url, '{_URL}', 3), '/+$', '') END
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""
_PAGES = rf"""p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '{_URL}', 4), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|fbclid=|gclid=)')) AS kept FROM pages), n AS (SELECT page_id, {_NORM} AS link FROM p)"""


@query(f"WITH {_PAGES} SELECT page_id, link FROM n")
def q_normalize_link(spark, sf):
    return table(spark, sf, "pages").select("page_id", links.normalize_link(F.col("url")).alias("link"))


@query(f"WITH {_PAGES} SELECT page_id, 'art_' || substr(sha256('link:' || link), 1, 24) AS article_id FROM n")
def q_article_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", links.article_id(links.normalize_link(F.col("url")), F.lit(""), F.lit(""), F.lit(None).cast("timestamp")).alias("article_id"))


_DATED = "CASE page_id % 7 WHEN 0 THEN '2024-01/' || d || '/x' WHEN 1 THEN '2024/01-' || d WHEN 2 THEN '2024/01/' || d || '/' WHEN 3 THEN '2023-12-' || d WHEN 4 THEN '2024/13/01/2024-01-05' WHEN 5 THEN '2024/01/32/' ELSE 'about' END"
_PATTERN = [r"/(\d{4})" + a + r"(\d{2})" + b + r"(\d{2})" + "(?:/|$)" for a, b in ("-/", "/-", "//", "--")]


@query(
    f"""WITH u AS (SELECT page_id, 'https://x.example/' || {_DATED} AS url FROM (SELECT page_id, lpad(CAST(page_id % 31 + 1 AS VARCHAR), 2, '0') AS d FROM pages)),
    f AS (SELECT page_id, CASE {" ".join(f"WHEN regexp_matches(url, '{p}') THEN regexp_extract(url, '{p}', 1) || '-' || regexp_extract(url, '{p}', 2) || '-' || regexp_extract(url, '{p}', 3)" for p in _PATTERN)} END AS x FROM u)
    SELECT page_id, try_cast(x AS DATE) AS url_date, coalesce(try_cast(x AS DATE) < DATE '2024-01-28', false) AS stale FROM f"""
)
def q_url_date(spark, sf):
    d = F.lpad((F.pmod("page_id", F.lit(31)) + 1).cast("string"), 2, "0")
    path = F.expr(_DATED.replace("|| d", "|| lpad(cast(page_id % 31 + 1 as string), 2, '0')"))
    url = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://x.example/"), path).alias("url"), d.alias("d"))
    return url.select("page_id", links.url_date(F.col("url")).alias("url_date"), links.stale_by_url(F.col("url"), F.lit("2024-01-31 00:00:00").cast("timestamp"), 24, 2).alias("stale"))


@query(rf"""SELECT page_id, md5({_clean("html")}) AS digest, CAST(length({_clean("html")}) AS INTEGER) AS n FROM pages""")
def q_clean_html(spark, sf):
    own = table(spark, sf, "pages").select("page_id", tx.clean(F.col("html"), False).alias("x"))
    return own.select("page_id", F.md5("x").alias("digest"), F.length("x").alias("n"))


_DECODED = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _entity, _char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©")):  # those that stand in the pages
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char}')"


@query(rf"""SELECT page_id, md5(trim(regexp_replace(regexp_replace({_DECODED}, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def q_clean_entities(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.clean(F.col("html"))).alias("digest"))


@query(
    rf"""WITH {_A}, t AS (SELECT ord, lower(title || ' $ 1.5 billion 2 billion') AS x FROM a0)
    SELECT ord, trim(regexp_replace(regexp_replace(regexp_replace(x, '\$\s?({_NUM})\s?(?:bn?|billion)\b', '\1b', 'g'), '\b({_NUM})\s?billion\b', '\1b', 'g'), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g')) AS normal,
    regexp_replace(x, '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS story FROM t"""
)
def q_normalized_title(spark, sf):
    x = F.concat("title", F.lit(" $ 1.5 billion 2 billion"))
    return articles(spark, sf).select("ord", tx.normalized_title(x).alias("normal"), tx.story_key(x).alias("story"))


@query(
    rf"""WITH {_A}, c AS (SELECT ord, {_clean("summary")} AS x FROM a0), w AS (SELECT *, list_filter(string_split_regex(x, '\s+'), lambda y: y <> '') AS w FROM c)
    SELECT ord, CASE WHEN length(x) > 120 THEN rtrim(substr(x, 1, 120)) || '……' ELSE x END AS chars,
    CASE WHEN len(w) > 12 THEN regexp_replace(array_to_string(w[1:12], ' '), '[ ,;:]+$', '') || '...' ELSE x END AS words FROM w"""
)
def q_truncate(spark, sf):
    return articles(spark, sf).select("ord", tx.truncate(F.col("summary"), 120).alias("chars"), tx.truncate_words(tx.clean(F.col("summary")), 12).alias("words"))


@query(rf"""WITH {_A} SELECT ord, len(list_filter(regexp_extract_all(summary, '[\p{{L}}\p{{N}}_\p{{M}}]+'), lambda z: regexp_matches(z, '^[A-Za-z][A-Za-z0-9]*$'))) > len(regexp_extract_all(summary, '[\x{{4e00}}-\x{{9fff}}]')) AS english FROM a0""")
def q_is_english(spark, sf):
    return articles(spark, sf).select("ord", tx.is_english(F.col("summary")).alias("english"))


_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda y: y <> '')"


@query(
    rf"""WITH {_A}, c AS (SELECT ord, {_clean("summary")} AS x, len(list_filter(regexp_extract_all(summary, '[\p{{L}}\p{{N}}_\p{{M}}]+'), lambda z: regexp_matches(z, '^[A-Za-z][A-Za-z0-9]*$'))) > len(regexp_extract_all(summary, '[\x{{4e00}}-\x{{9fff}}]')) AS english FROM a0),
    p AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(x, '([。！？；;])\s*', '\1' || chr(31), 'g'), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda z: trim(z)), lambda z: z <> '')[1:3] AS s FROM c),
    n AS (SELECT *, list_transform(s, lambda z: len({_WORDS.format("z")})) AS n, list_transform(s, lambda z: length(z)) AS m FROM p),
    j AS (SELECT ord, x, english, CASE WHEN len(s) = 0 THEN x WHEN len(s) >= 2 AND n[1] + n[2] <= 90 THEN CASE WHEN len(s) = 3 AND n[1] + n[2] + n[3] <= 90 THEN array_to_string(s, ' ') ELSE s[1] || ' ' || s[2] END ELSE s[1] END AS e,
      CASE WHEN len(s) = 0 THEN x WHEN len(s) >= 2 AND m[1] + m[2] <= 180 THEN CASE WHEN len(s) = 3 AND m[1] + m[2] + m[3] <= 180 THEN array_to_string(s, '') ELSE s[1] || s[2] END ELSE s[1] END AS o FROM n)
    SELECT ord, CASE WHEN x = '' THEN 'none' WHEN english THEN CASE WHEN len({_WORDS.format("e")}) > 90 THEN regexp_replace(array_to_string({_WORDS.format("e")}[1:90], ' '), '[ ,;:]+$', '') || '...' ELSE e END
      WHEN length(o) <= 180 THEN o ELSE regexp_replace(substr(o, 1, 180), '[，,；;：: ]+$', '') || '……' END AS packed FROM j"""
)
def q_summary_pack(spark, sf):
    cleaned = articles(spark, sf).select("ord", tx.clean(F.col("summary")).alias("x"))
    return cleaned.select("ord", tx.pack_summary(F.col("x"), "none").alias("packed"))


@query(rf"""WITH {_A} SELECT ord, len(regexp_extract_all(summary, '(?:then|nd)[^.,\n]*')) AS parts, list_filter({_list(_pairs("neg", 6))}, lambda t: contains(summary, t)
    AND NOT len(list_filter(regexp_extract_all(summary, '(?:then|nd)[^.,\n]*'), lambda p: contains(p, t))) > 0) AS terms FROM a0""")
def q_negated_terms(spark, sf):
    parts = tx.negated_parts(F.col("summary"), ("then", "nd"), ".,\\n")
    terms = F.filter(matched_terms(F.col("summary"), _pairs("neg", 6)), lambda t: ~F.exists(parts, lambda p: F.contains(p, t)))
    return articles(spark, sf).select("ord", F.size(parts).cast("long").alias("parts"), terms.alias("terms"))


_ADVICE = ("the", "and", "heon")


@query(
    rf"""WITH {_A} SELECT ord, replace(replace(replace(title, 'the', '*'), 'and', '*'), 'heon', '*') AS terms, replace(title, '|', '\|') AS escaped,
    CASE WHEN regexp_matches(source, '^[A-Za-z0-9_.:-]*$') THEN source ELSE 'redacted' END AS token, CASE WHEN regexp_matches(title, '^[A-Za-z0-9_.:-]*$') THEN title ELSE 'redacted' END AS unsafe,
    CASE WHEN contains(lower(title), 'timeout') THEN 'timeout' WHEN contains(lower(title), 'parse') OR contains(lower(title), 'xml') THEN 'parse_error' WHEN contains(lower(title), 'url') OR contains(lower(title), 'http') THEN 'network_error' ELSE 'unknown_failure' END AS failure
    FROM a0"""
)
def q_redact(spark, sf):
    a, t = articles(spark, sf), F.col("title")
    return a.select("ord", tx.replace_all(t, _ADVICE, "*").alias("terms"), tx.markdown(t).alias("escaped"), tx.safe_token(F.col("source")).alias("token"), tx.safe_token(t).alias("unsafe"), tx.failure_code(t).alias("failure"))


@query("SELECT doc_id, CASE replace(lower(trim(l)), '_', '-') WHEN 'zh-cn' THEN 'zh-CN' WHEN 'en' THEN 'en' ELSE 'und' END AS language FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' ZH_CN ' ELSE lang END AS l FROM documents)")
def q_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.language(F.when(F.pmod("doc_id", F.lit(3)) == 0, " ZH_CN ").otherwise(F.col("lang"))).alias("language"))


# -- windows and limits over events


@query("SELECT event_id FROM events WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'")
def q_lookback(spark, sf):
    return table(spark, sf, "events").where(links.within_lookback(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 24)).select("event_id")


@query("SELECT event_id FROM events WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-14 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00')")
def q_day_window(spark, sf):
    return table(spark, sf, "events").where(links.within_days(F.col("ts"), F.lit("2024-01-15").cast("date"), 2)).select("event_id")


@query(
    """WITH d AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY value DESC, event_id) = 1), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3)
    SELECT event_id, CAST(row_number() OVER (ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 50"""
)
def q_source_cap_topk(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "props", "value")
    return select.capped_top(e, ["user_id", "props"], "user_id", [F.col("value").desc(), F.col("event_id")], 3, 50).select("event_id", F.col("rank").cast("int").alias("rank"))


@query(
    """WITH RECURSIVE first AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) = 1),
    feeds AS (SELECT dense_rank() OVER (ORDER BY user_id) AS i, list({'k': props, 'e': event_id} ORDER BY event_id) AS own FROM first GROUP BY user_id),
    r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST([] AS BIGINT[]) AS picked
      UNION ALL SELECT i, list_concat(seen, list_transform(p, lambda x: x.k)), list_transform(p, lambda x: x.e) FROM (SELECT f.i AS i, r.seen AS seen, list_filter(f.own, lambda x: NOT list_contains(r.seen, x.k))[1:3] AS p FROM r JOIN feeds f ON f.i = r.i + 1))
    SELECT e.event_id, e.user_id, e.props FROM (SELECT unnest(picked) AS id FROM r) JOIN events e ON e.event_id = id"""
)
def q_dedupe_cap_fold(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "props")
    return select.dedupe_and_cap(e, "props", "user_id", [F.col("user_id"), F.col("event_id")], 3)


@query(
    """WITH RECURSIVE first AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY value DESC, event_id) = 1),
    rows AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS i FROM first),
    r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS users, CAST(0 AS BIGINT) AS special, CAST([] AS BIGINT[]) AS ids
      UNION ALL SELECT i, CASE WHEN ok THEN list_append(users, u) ELSE users END, special + CAST(ok AND s AS BIGINT), CASE WHEN ok THEN list_append(ids, e) ELSE ids END
      FROM (SELECT w.i AS i, users, special, ids, w.user_id AS u, w.event_id AS e, w.event_type = 'purchase' AS s, len(list_filter(users, lambda z: z = w.user_id)) < 2 AND NOT (w.event_type = 'purchase' AND special >= 5) AS ok
        FROM r JOIN rows w ON w.i = r.i + 1 WHERE len(ids) < 40))
    SELECT event_id, user_id, props, event_type, value FROM events WHERE event_id IN (SELECT unnest(ids) FROM (SELECT ids FROM r ORDER BY i DESC LIMIT 1))"""
)
def q_two_caps_fold(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "props", "event_type", "value")
    return select.two_caps(e, ["user_id", "props"], "user_id", "event_type", "purchase", [F.col("value").desc(), F.col("event_id")], 2, 5, 40)


@query("SELECT count(*) FILTER (event_id % 2 = 0) AS n, min(ts) AS first, max(ts) AS last FROM events")
def q_windows_minmax(spark, sf):
    return table(spark, sf, "events").agg(F.count_if(F.pmod("event_id", F.lit(2)) == 0).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


# -- digest


def _v(name: str, column: str = "t") -> str:
    return _has(VOCABULARY[name], column)


_ACTIONS = r"\b(?:" + "|".join("raises? raised files? filed withdraws? withdrew nabs? nabbed reaches? reached hits? valued acquires? acquired acquisition merger launches? launched".split()) + r")\b"
_BILLION = rf"(regexp_matches(ti, '\$\s?{_NUM}\s?(?:bn?|billion)\b') OR regexp_matches(ti, '\b{_NUM}\s?billion\b'))"
_MONEY = rf"(regexp_matches(ti, '\$\s?{_NUM}\s?(?:k|mm?|bn?|[mb]illion)\b') OR regexp_matches(ti, '\b{_NUM}\s?[mb]illion\b'))"
_HARD = ("capital", "payment", "regulatory", "enterprise", "platform", "business_impact")
_FLAGS = f"""{_A}, s0 AS (
  SELECT *, {_v("global_tech_deal", "ti")} AND ({_v("global_tech_deal_market", "ti")} OR {_BILLION}) AS deal, regexp_matches(ti, '{_ACTIONS}') AS act,
    {_v("event_capital", "ti")} OR {_v("global_tech_backing", "ti")} AS backed, feed_role IN ('global_tech_business', 'ai_industry') AS tech,
    {_has(VOCABULARY["discussion_format"], "(' ' || ti || '  ' || lower(link) || ' ' || lower(source) || ' ' || lower(feed_name))")} OR {_has(VOCABULARY["discussion_title"], "(' ' || ti || ' ')")} AS talk FROM a
), s1 AS (
  SELECT *, deal OR ({_MONEY} AND (backed OR act)) OR (act AND backed) OR {_v("event_concrete", "ti")} AS concrete FROM s0
), s2 AS (
  SELECT *, CASE WHEN concrete THEN true WHEN talk THEN false WHEN NOT {_v("global_tech_domain")} THEN false
    WHEN {_v("ai_tech_discussion", "ti")} AND NOT ({" OR ".join(_v(f"global_tech_{h}", "ti") for h in (*_HARD, "deal", "deal_market"))}) THEN false
    WHEN {_v("ai_tech_discussion")} AND NOT ({" OR ".join(_v(f"global_tech_{h}") for h in _HARD)}) THEN false
    WHEN {_v("global_tech_payment")} AND {_v("global_tech_action")} THEN true WHEN {_v("global_tech_capital")} THEN true WHEN {_v("global_tech_regulatory")} THEN true
    WHEN {_n(VOCABULARY["global_tech_enterprise"], "t")} >= 2 THEN true WHEN {_v("global_tech_platform")} AND {_v("platform_commercial")} THEN true
    ELSE {_v("global_tech_shutdown")} AND {_v("global_tech_business_impact")} END AS global FROM s1
), s3 AS (
  SELECT *, CASE WHEN {_v("local_promo")} AND NOT {_v("market_strong")} THEN false WHEN {_v("policy_background")} AND NOT {_v("market_strong")} THEN false
    WHEN {_v("market_event_noise")} AND NOT {_v("market_hard")} THEN false WHEN tech THEN global WHEN feed_role = 'tech_industry' THEN {_v("market_strong")}
    WHEN {_v("market_strong")} THEN true WHEN {_v("ai_tech_context")} THEN false WHEN {_v("market_generic")} THEN false
    WHEN {_v("industry")} AND NOT {_v("market_hard")} THEN false ELSE {_v("market_signal")} END AS market,
    NOT {_v("policy_background")} AND NOT ({_v("watch_past_activity")} AND NOT {_v("watch_strong_future")}) AND ({_v("watch")} OR regexp_matches(t, '{VOCABULARY["watch_time"][0]}'))
      AND {_v("watch_variable")} AND NOT ({_v("product_or_consumer")} AND NOT {_v("market_signal")}) AS watch,
    NOT ({_has(CONFIG.core_event_negative_patterns, "t")} AND NOT {_v("core_negative_overrides")}) AND NOT ({_v("core_low_importance")} AND NOT {_v("core_low_importance_overrides")})
      AND NOT (tech AND NOT global) AND {_v("core_event")} AS core FROM s2
), s4 AS (
  SELECT *, NOT {_has(CONFIG.low_value_patterns, "cx")} AND feed_role <> 'ai_tools'
    AND (feed_role NOT IN ('tech_industry', 'global_tech_business', 'ai_industry') OR {_v("policy")} OR {_v("industry")} OR {_v("global_tech_business")} OR market) AS enters FROM s3
), s5 AS (
  SELECT *, CASE WHEN NOT enters THEN NULL WHEN feed_role IN ('market', 'breaking_news', 'general', 'global_tech_business', 'ai_industry') AND watch THEN 'watch'
    WHEN feed_role IN ('market', 'global_tech_business', 'ai_industry') AND market THEN 'market'
    WHEN feed_role IN ('breaking_news', 'general', 'global_tech_business', 'ai_industry') AND core THEN 'core' END AS section FROM s4
), s6 AS (
  SELECT *, CAST(2 * ({" + ".join(f"CAST({_has(k, 't')} AS INTEGER)" for k in KEYWORDS.values())}) + {_n(VOCABULARY["market_signal"], "t")} + {_n(VOCABULARY["watch"], "t")}
    + 4 * {_n(VOCABULARY["market_strong"], "ti")} + 3 * {_n(VOCABULARY["market_price"], "ti")} + 4 * {_n(VOCABULARY["capital_market"], "ti")}
    + CASE WHEN tech THEN {" + ".join(f"{w} * {_n(VOCABULARY[f'global_tech_{x}'], 'ti')}" for x, w in (("payment", 5), ("capital", 4), ("backing", 4), ("deal", 4), ("deal_market", 4), ("regulatory", 4), ("enterprise", 3), ("platform", 3)))}
      + CASE WHEN {_BILLION} THEN 4 ELSE 0 END - CASE WHEN {_v("ai_tech_discussion", "ti")} AND NOT global THEN 8 ELSE 0 END ELSE 0 END AS INTEGER) AS importance FROM s5
)"""


@query(f"WITH {_FLAGS} SELECT ord, section, feed_role FROM s5")
def q_classify(spark, sf):
    return scored(gated(spark, sf), VOCABULARY, CONFIG).select("ord", "section", "feed_role")


@query(f"WITH {_FLAGS} SELECT ord, deal, concrete, talk, global, market, watch, core, enters FROM s5")
def q_signals(spark, sf):
    i = Item(VOCABULARY, CONFIG)
    a = with_match_texts(gated(spark, sf))
    return a.select("ord", i.deal().alias("deal"), i.concrete_event().alias("concrete"), i.discussion().alias("talk"), i.global_tech().alias("global"), i.market().alias("market"), i.watch().alias("watch"), i.core().alias("core"), i.can_enter().alias("enters"))


@query(rf"""WITH {_FLAGS}, k AS (SELECT ord, importance, published_at, length(trim(regexp_replace(ti, '[^a-z0-9]+', ' ', 'g'))) AS n FROM s6)
    SELECT ord, importance, CAST(row_number() OVER (ORDER BY importance DESC, n DESC, published_at DESC NULLS LAST, ord) AS INTEGER) AS rank FROM k QUALIFY rank <= 100""")
def q_importance(spark, sf):
    s = scored(gated(spark, sf), VOCABULARY, CONFIG).select("ord", "importance", "title_length", "published_at")
    return select.ranked(s, digest.order(), 100).select("ord", "importance", F.col("rank").cast("int").alias("rank"))


@query(
    f"""WITH {_FLAGS} SELECT ord, CASE WHEN feed_role = 'ai_industry' THEN 'AI 产业' WHEN feed_role = 'global_tech_business' THEN '全球科技商业' WHEN feed_role = 'tech_industry' THEN '科技产业'
    WHEN feed_role = 'market' THEN CASE WHEN {_v("market_signal")} OR {_v("market_generic")} THEN '市场边缘信号' ELSE '公司动态' END WHEN {_v("quick_policy")} THEN '政策背景' WHEN {_v("quick_world")} THEN '国际观察'
    WHEN {_v("quick_company")} THEN '公司动态' WHEN feed_role = 'breaking_news' THEN '综合新闻' ELSE '其他观察' END AS kind FROM s5"""
)
def q_quick_scan_type(spark, sf):
    return with_match_texts(gated(spark, sf)).select("ord", Item(VOCABULARY, CONFIG).quick_scan_type().alias("kind"))


def _first(name: str, column: str = "t") -> str:
    return f"list_filter({_list(VOCABULARY[name])}, lambda z: contains({column}, z))[1]"


@query(
    f"""WITH {_FLAGS} SELECT ord, CASE WHEN {_v("policy")} THEN '涉及' || {_first("policy")} || '相关信息，适合作为今日宏观和产业背景观察。' WHEN {_v("global_tech_domain")} AND global THEN '涉及' || {_first("global_tech_domain")} || '相关全球科技商业进展，可能影响 AI 商业化或基础设施生态。'
    WHEN {_v("core_event")} THEN '涉及' || {_first("core_event")} || '，属于需要优先关注的高影响事件。' WHEN {_v("industry")} THEN '涉及' || {_first("industry")} || '方向，可能影响相关产业关注度。' ELSE '作为背景信息观察，暂不强行外推为市场影响。' END AS rule,
    CASE WHEN {_v("overseas_rate")} THEN '需观察' || p || '是否影响风险偏好、汇率利率预期或 A 股情绪。' WHEN {_v("policy")} THEN '需观察' || p || '是否改变政策预期和相关板块关注度。' WHEN {_v("ai_impact")} THEN '需观察' || p || '是否带动 AI 产业关注度。'
    WHEN {_v("industry")} THEN '作为产业动态观察，短期市场影响可能有限。' ELSE '作为背景信息观察。' END AS watched FROM (SELECT *, coalesce({_first("watch")} || '相关进展', '后续进展') AS p FROM s5)"""
)
def q_explanations(spark, sf):
    i = Item(VOCABULARY, CONFIG)
    return with_match_texts(gated(spark, sf)).select("ord", i.rule_reason().alias("rule"), i.watch_impact().alias("watched"))


_RULES = "，可作为监管、合规或反垄断风险信号观察。"
_CAPITAL, _COMPANY = "，可作为营收、利润率、估值或资本市场信号观察。", "，可作为资本市场或公司估值信号观察。"
_MOOD, _CHIPS, _PLATFORM = "，可观察其对市场交易情绪的影响。", "，可作为企业客户、云、芯片或算力订单信号观察。", "，可作为平台集成、分发渠道或商业发布信号观察。"
_IMPACTS = [
    ("global_tech_backing", "ti", "，可作为估值、融资或战略背书信号观察。"), ("market_price", "ti", _MOOD), ("global_tech_capital", "ti", _CAPITAL), ("capital_market", "ti", _COMPANY),
    ("global_tech_payment", "ti", "，可作为 AI 支付、agent commerce 或支付基础设施信号观察。"), ("global_tech_regulatory", "ti", _RULES), ("global_tech_enterprise", "ti", _CHIPS), ("global_tech_platform", "ti", _PLATFORM),
    ("market_price", "t", _MOOD), ("global_tech_capital", "t", _CAPITAL), ("capital_market", "t", _COMPANY), ("global_tech_payment", "t", "，可作为支付基础设施或 commerce 生态信号观察。"), ("global_tech_regulatory", "t", _RULES),
    ("global_tech_enterprise", "t", _CHIPS), ("global_tech_platform", "t", _PLATFORM), ("policy", "t", "，可能影响政策预期和相关板块关注度。"), ("global_tech_domain", "t", "，可作为 AI 商业化、支付基础设施或平台生态信号观察。"),
]


@query(
    f"""WITH {_FLAGS} SELECT ord, CASE WHEN {_v("overseas_rate")} THEN '涉及' || {_first("overseas_rate")} || '，可能影响风险偏好、汇率利率预期或 A 股情绪。'
    WHEN deal THEN '涉及' || array_to_string(list_filter([{_first("global_tech_deal", "ti")}, {_first("global_tech_deal_market", "ti")}, CASE WHEN {_BILLION} THEN 'billion-scale amount' END], lambda z: z IS NOT NULL), ' / ') || '，可作为并购、交易规模、IPO 或估值信号观察。'
    {" ".join(f"WHEN {_v(n, c)}{' AND global' if n in ('global_tech_payment', 'global_tech_domain') else ''} THEN '涉及' || {_first(n, c)} || '{x}'" for n, c, x in _IMPACTS)}
    WHEN {_v("industry")} THEN '作为产业动态观察，短期市场影响可能有限。' ELSE '作为市场边缘信号观察。' END AS impact FROM s5"""
)
def q_market_impact(spark, sf):
    return with_match_texts(gated(spark, sf)).select("ord", Item(VOCABULARY, CONFIG).market_impact().alias("impact"))


_NAMES = r"list_filter(regexp_extract_all(rt, '\b[A-Z][A-Za-z0-9.]+\b'), lambda z: NOT list_contains({0}, z))"
_ONCE = "list_filter({0}, lambda z, i: list_position({0}, z) = i)"


@query(
    rf"""WITH {_FLAGS}, e AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(ti, '\$\s?({_NUM})\s?(?:bn?|billion)\b', '\1b', 'g'), '\b({_NUM})\s?billion\b', '\1b', 'g'), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g')) AS normal,
      list_transform({_NAMES.format("['AI', 'IPO', 'GPT', 'LLM']")}, lambda z: lower(z)) AS d0, list_transform(list_filter(regexp_extract_all(rt, '\b[A-Z][A-Za-z0-9.]+\b'), lambda z: NOT list_contains(['AI', 'ROI', 'IPO', 'IPOS', 'LLM', 'CEO'], upper(z))), lambda z: lower(z)) AS t0 FROM s1),
    k AS (SELECT *, {_ONCE.format("d0")} AS d, {_ONCE.format("t0")} AS u, regexp_extract(normal, '\b{_NUM}b\b') AS amount, {_first("discussion_topic", "ti")} AS topic FROM e)
    SELECT ord, CASE WHEN NOT deal THEN '' WHEN amount <> '' AND len(d) >= 2 THEN 'deal:' || amount || ':' || array_to_string(list_sort(d[1:3]), ':') ELSE 'deal:' || normal END AS deal_key,
    CASE WHEN talk AND len(u) >= 2 AND topic IS NOT NULL THEN 'discussion:' || array_to_string(u[1:3], ':') || ':' || topic ELSE '' END AS discussion_key FROM k"""
)
def q_event_keys(spark, sf):
    return scored(gated(spark, sf), VOCABULARY, CONFIG).select("ord", "deal_key", "discussion_key")


@query()
def q_digest_sections(spark, sf):
    return digest.sections(gated(spark, sf), CONFIG, VOCABULARY).select("section", "rank", "ord", "source")


@query(
    rf"""WITH {_FLAGS}, d AS (SELECT * FROM s6 WHERE section IS NOT NULL AND ({_CATEGORY}) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ti ORDER BY ord) = 1),
    k AS (SELECT *, length(trim(regexp_replace(ti, '[^a-z0-9]+', ' ', 'g'))) AS n FROM d), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY importance DESC, n DESC, published_at DESC, ord) <= 3)
    SELECT ord, section, source, importance, CAST(row_number() OVER (ORDER BY importance DESC, n DESC, published_at DESC, ord) AS INTEGER) AS rank FROM c QUALIFY rank <= 25"""
)
def q_flagship(spark, sf):
    """Keyword gate, first of each title, section, at most three of a source, the best 25."""
    a = where_computed(gated(spark, sf), F.size(F.map_keys("matched_keywords")) > 0)
    s = where_computed(scored(a, VOCABULARY, CONFIG), F.col("section").isNotNull()).select("ord", "section", "source", "importance", "title_length", "published_at", F.md5(F.lower(tx.clean(F.col("title")))).alias("key"))
    best = select.ranked(select.at_most(select.first_by(s, ["key"], [F.col("ord")]), ["source"], digest.order(), 3), digest.order(), 25)
    return best.select("ord", "section", "source", "importance", F.col("rank").cast("int").alias("rank"))


# -- market news


def _terms(name: str, column: str) -> str:
    return f"list_filter({_list(VOCABULARY[f'news.{name}'])}, lambda z: contains({column}, z))"


def _w(name: str, column: str) -> str:
    return _has(VOCABULARY[f"news.{name}"], column)


_STRONG = "list_filter({0}, lambda z: list_contains(" + _list(VOCABULARY["news.strong_policy"]) + ", z))"
_B = "CASE WHEN len({0}) > 0 THEN {1} + least(len({0}) * {2}, {3}) ELSE 0 END"
_NEWS = f"""{_A}, n0 AS (SELECT *, lower(trim(title) || ' ' || trim(summary) || ' ' || source || ' ' || feed_role || ' ') AS x, lower(trim(title)) AS h FROM a0), n1 AS (
  SELECT *, {", ".join(f"{_terms(v, 'h' if n[0] == 'h' else 'x')} AS {n}" for n, v in fn._STEPS)},
    {_w("ai_application", "h")} AND (contains(h, 'ai') OR contains(h, '人工智能')) AS app, {_w("a_share_policy_event", "x")} AND {_w("a_share_policy_context", "x")} AS pe,
    {_w("earnings_profit", "x")} AND {_w("earnings_size", "x")} AND {_w("earnings_broker", "h")} AS ep, {_w("directory_or_ranking", "h")} AND NOT {_w("concrete_capital_event", "h")} AS dir,
    {_w("government_regulator", "h")} AND {_w("regulatory_action", "h")} AS reg, {_w("roundup", "h")} AS roundup, {_w("negated_financing", "x")} AS nofin, {_w("negated_signal", "x")} AS neg FROM n0
), n2 AS (
  SELECT * REPLACE (CASE WHEN nofin OR dir THEN [] ELSE h_financing END AS h_financing, CASE WHEN nofin OR dir THEN [] ELSE t_financing END AS t_financing,
    CASE WHEN reg THEN [] ELSE h_operating END AS h_operating, CASE WHEN reg THEN [] ELSE h_operating_action END AS h_operating_action) FROM n1
), n3 AS (
  SELECT * REPLACE (CASE WHEN len(t_financing) > 0 AND len(h_policy) = 0 THEN list_filter(t_policy, lambda z: NOT list_contains({_list(VOCABULARY["news.generic_exchange_policy"])}, z)) ELSE t_policy END AS t_policy) FROM n2
), n4 AS (SELECT *, {_STRONG.format("t_policy")} AS t_strong, {_STRONG.format("h_policy")} AS h_strong, len(t_compute) + len(t_power) > 0 AS direct FROM n3), n5 AS (
  SELECT *, roundup OR (len(t_weak) > 0 AND (len(t_policy) + len(t_financing) + len(t_operating) + len(h_macro) + len(h_policy) = 0 OR neg)) AS weak FROM n4
), n6 AS (
  SELECT *, {_B.format("t_macro", 30, 4, 16)} + {_B.format("t_policy", 50, 5, 25)} + {_B.format("t_strong", 12, 3, 18)} + {_B.format("t_financing", 34, 4, 16)} + {_B.format("t_operating", 30, 4, 16)}
    + {_B.format("t_industry", 14, 3, 15)} + {_B.format("t_catalyst", 24, 4, 16)} + 42 * CAST(pe AS INTEGER) + 104 * CAST(ep AS INTEGER) + 60 * CAST(direct AS INTEGER) + 48 * CAST(app AS INTEGER)
    + 10 * CAST(len(t_risk) > 0 AS INTEGER) + 50 * CAST(reg AS INTEGER) - 100 * CAST(dir AS INTEGER) + 18 * CAST(len(h_financing) > 0 AS INTEGER) + 16 * CAST(len(h_operating) > 0 AS INTEGER)
    + 10 * CAST(len(h_macro) > 0 AS INTEGER) + 28 * CAST(len(h_policy) > 0 AS INTEGER) + 12 * CAST(len(h_strong) > 0 AS INTEGER) + 14 * CAST(len(h_catalyst) > 0 AND len(h_industry) > 0 AS INTEGER)
    - 140 * CAST(roundup AS INTEGER) - CASE WHEN len(t_weak) = 0 THEN 0 WHEN weak THEN 90 ELSE 18 END AS p FROM n5
), n7 AS (
  SELECT *, CAST(greatest(p, 0) AS INTEGER) AS score, CASE WHEN weak THEN '{fn.WEAK}' WHEN reg OR len(h_strong) > 0 OR pe THEN '{fn.POLICY}' WHEN len(h_financing_action) > 0 THEN '{fn.FINANCING}'
    WHEN len(h_operating_action) > 0 THEN '{fn.OPERATING}' WHEN (len(h_catalyst) > 0 OR direct OR app) AND (len(h_industry) > 0 OR direct OR app) AND len(h_financing) = 0 THEN '{fn.CATALYST}'
    WHEN len(h_operating) > 0 OR (len(t_operating) > 0 AND len(h_financing) = 0 AND len(t_financing) = 0) THEN '{fn.OPERATING}' WHEN len(t_strong) > 0 THEN '{fn.POLICY}'
    WHEN len(h_financing) + len(t_financing) > 0 THEN '{fn.FINANCING}' WHEN len(t_operating) > 0 THEN '{fn.OPERATING}' WHEN len(h_macro) > 0 OR (len(t_macro) > 0 AND len(t_financing) = 0) THEN '{fn.MACRO}'
    WHEN (len(h_catalyst) + len(t_catalyst) > 0) AND (len(h_industry) + len(t_industry) > 0) THEN '{fn.CATALYST}' WHEN p < 40 THEN '{fn.WEAK}' ELSE '{fn.BUSINESS}' END AS news_type FROM n6
), kept AS (
  SELECT * FROM n7 WHERE feed_role <> 'ai_tools' AND NOT ({_w("weak_related", "h")} AND NOT {_w("title_hard", "h")}) AND NOT weak AND news_type <> '{fn.WEAK}' AND score >= 45
    AND NOT (news_type = '{fn.FINANCING}' AND {_w("overseas_ipo", "x")} AND NOT {_w("a_share_related_ipo", "x")})
)"""


@query(f"WITH {_NEWS} SELECT ord, score, news_type, weak AS weak_related FROM n7")
def q_news_score(spark, sf):
    return fn.score_articles(articles(spark, sf), VOCABULARY).select("ord", "score", "news_type", "weak_related")


@query(f"WITH {_NEWS} SELECT ord, score, news_type FROM kept")
def q_investable(spark, sf):
    return news.insights(articles(spark, sf), VOCABULARY).select("ord", "score", "news_type")


@query()
def q_market_news(spark, sf):
    return news.analyze(articles(spark, sf), _holdings(spark, sf), 5, VOCABULARY)


_KEY = "['减持', '退市', '并购重组', '问询', 'x'][event_id % 5 + 1]"
_EV = f"e AS (SELECT event_id AS ord, {_KEY} || ' ' || event_type AS title, CAST(floor(value) AS INTEGER) AS score, {_KEY} AS k FROM events)"


@query(
    f"""WITH {_EV}, s AS (SELECT CASE WHEN k = 'x' THEN '#' || ord ELSE k END AS key, max(score) AS top, count(*) AS n, arg_min(ord, -score * 1000000 + ord) AS first,
      array_to_string(list(title ORDER BY score DESC, ord)[2:], '|') AS rest FROM e GROUP BY 1)
    SELECT first AS ord, CAST(top + 20 * (n - 1) AS INTEGER) AS score, length(rest) + CASE WHEN n > 1 THEN 10 * (n - 1) - (n - 2) ELSE 0 END AS more FROM s"""
)
def q_policy_merge(spark, sf):
    e = table(spark, sf, "events")
    name = F.element_at(F.array(*[F.lit(x) for x in ("减持", "退市", "并购重组", "问询", "x")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    rows = e.select(F.col("event_id").alias("ord"), F.concat_ws(" ", name, "event_type").alias("title"), F.lit("s").alias("source"), F.lit("").alias("link"), F.lit("").alias("reason"), F.floor("value").cast("int").alias("score"), F.lit(fn.POLICY).alias("news_type"))
    return news.consolidate_policies(rows).select("ord", "score", F.length("reason").cast("long").alias("more"))


@query(
    f"""WITH {_NEWS}, c AS (SELECT *, CASE WHEN len(t_power) > 0 THEN '数据中心电力' WHEN len(t_compute) > 0 THEN '算力' {" ".join(f"WHEN {_has(VOCABULARY['theme:' + t], 'x')} THEN '{t}'" for t in ("AI 应用 / 企业软件", "电网设备 / 特高压", "风电", "半导体 / 芯片", "新能源 / 储能"))} ELSE t_industry[1] END AS theme FROM kept WHERE news_type = '{fn.CATALYST}' AND score >= 55)
    SELECT theme, count(*) AS n, max(score) AS top, CAST(row_number() OVER (ORDER BY max(score) DESC, min(ord)) AS INTEGER) AS rank FROM c WHERE theme IS NOT NULL GROUP BY theme HAVING count(*) >= 2 OR max(score) >= 75 QUALIFY rank <= 5"""
)
def q_theme_having(spark, sf):
    found = news.insights(articles(spark, sf), VOCABULARY)
    return news.themes(found.where((F.col("news_type") == fn.CATALYST) & (F.col("score") >= 55)), 5, VOCABULARY).select("theme", "n", "top", F.col("rank").cast("int").alias("rank"))


def _holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as watched names: of each, a code that no text holds, and syllable pairs as name, sector and tags."""
    a, b = _pairs("name", 5), _pairs("sector", 4)
    pick = lambda terms, by: F.element_at(F.array(*[F.lit(t) for t in terms]), (F.pmod(by, F.lit(len(terms))) + 1).cast("int"))
    p = table(spark, sf, "part").where("p_partkey <= 20")
    return p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("zq"), F.col("p_partkey").cast("string")).alias("code"), pick(a, F.col("p_partkey")).alias("name"), pick(b, F.col("p_partkey")).alias("sector"), F.array(F.lit("ouin"), pick(b, F.col("p_size"))).alias("watch_tags"))


_LOW = _list(VOCABULARY["news.holding_low_precision_sectors"])
_BROAD = _list(VOCABULARY["news.broad_holding_watch_tags"])


@query(
    f"""WITH {_NEWS}, hold AS (SELECT p_partkey AS ho, 'zq' || p_partkey AS code, {_list(_pairs("name", 5))}[p_partkey % 5 + 1] AS name, {_list(_pairs("sector", 4))}[p_partkey % 4 + 1] AS sector, {_list(_pairs("sector", 4))}[p_size % 4 + 1] AS tag FROM part WHERE p_partkey <= 20),
    ht AS (SELECT ho, code, name, 0 AS pos, code AS term FROM hold UNION ALL SELECT ho, code, name, 1, name FROM hold UNION ALL SELECT ho, code, name, 2, sector FROM hold
      UNION ALL SELECT ho, code, name, 3, 'ouin' FROM hold WHERE NOT list_contains({_BROAD}, 'ouin') UNION ALL SELECT ho, code, name, 4, tag FROM hold WHERE NOT list_contains({_BROAD}, tag)),
    m AS (SELECT ho, ord, pos, score, h AS ti2, link, CASE WHEN term = code OR term = name THEN '{fn.CLEAR}' WHEN list_contains({_LOW}, term) AND score >= 60 THEN NULL WHEN score < 60 OR list_contains({_LOW}, term) THEN '{fn.WEAKLY}' ELSE '{fn.CLEAR}' END AS rel
      FROM kept JOIN ht ON contains(x, term)),
    f AS (SELECT * FROM m WHERE rel IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ho, ord ORDER BY pos) = 1)
    SELECT ho AS holding_ord, ord, rel AS holding_relation, CAST(row_number() OVER (PARTITION BY ho ORDER BY score DESC, ord) AS INTEGER) AS rank FROM f QUALIFY rank <= 5"""
)
def q_holding_theta(spark, sf):
    m = news.holding_matches(news.insights(articles(spark, sf), VOCABULARY), _holdings(spark, sf), 5, VOCABULARY)
    return m.select("holding_ord", "ord", "holding_relation", F.col("rank").cast("int").alias("rank"))


# -- joins, sets and validation over the star schema


_SCAN = replace(CONFIG, report_type="list", days_back=3, max_items_per_feed=5)
_DAY = datetime(2024, 1, 31)


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """documents as feed entries, their source as feed: some without title, link or time, pairs with one link but for its tracking keys."""
    i = F.col("doc_id")
    path = F.concat(F.lit("https://News.Example/"), "source", F.lit("/"), (i - i % 2).cast("string"), F.lit("/?utm_source=x&a="), (F.floor(i / 2) % 3).cast("string"), F.lit("#f"))
    none = F.lit(None).cast("string")
    return table(spark, sf, "documents").select(
        F.col("source").alias("feed_name"), F.lit("general").alias("feed_role"), F.regexp_extract("source", r"\d+", 0).cast("int").alias("feed_ord"), i.alias("entry_ord"), F.col("lang").alias("language"),
        F.when(i % 11 == 0, "").otherwise(F.substring(F.substring_index("text", "\n", 1), 1, 80)).alias("title"), F.when(i % 13 == 0, "").otherwise(path).alias("link"), F.col("text").alias("summary"),
        *[none.alias(c) for c in ("description", "author", "published", "updated")],
        F.when(i % 17 != 0, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.pmod("doc_id", F.lit(20000)).cast("int"))).cast("timestamp").alias("published_ts"), F.lit(None).cast("timestamp").alias("updated_ts"),
    )


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.candidates(entries(spark, sf), _SCAN, _DAY.date(), _DAY)


def _feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"src{i}", "all" if i % 5 == 0 else "keyword") for i in range(12)], "name string, mode string")


_GATE = " OR ".join(_has(k, "match") for k in KEYWORDS.values())
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S+00:00')"
_E = f"""en AS (
  SELECT doc_id, source AS feed_name, CAST(regexp_extract(source, '\\d+') AS INTEGER) AS feed_ord, doc_id AS entry_ord, lang, CASE WHEN doc_id % 11 = 0 THEN '' ELSE substr(string_split(text, chr(10))[1], 1, 80) END AS raw,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'https://News.Example/' || source || '/' || (doc_id - doc_id % 2) || '/?utm_source=x&a=' || (doc_id // 2 % 3) || '#f' END AS link,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'https://news.example/' || source || '/' || (doc_id - doc_id % 2) || '?a=' || (doc_id // 2 % 3) END AS norm, text AS summary,
    CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_minutes(doc_id % 20000) END AS tm FROM documents
), ca AS (
  SELECT *, CASE WHEN {_clean("raw")} = '' THEN 'Untitled' ELSE {_clean("raw")} END AS title, lower({_clean("raw || ' ' || summary")}) AS match FROM en
  WHERE ({_clean("raw")} <> '' OR link <> '') AND (link <> '' OR tm IS NOT NULL) AND (tm IS NULL OR (tm >= TIMESTAMP '2024-01-29 00:00:00' AND tm < TIMESTAMP '2024-02-01 00:00:00'))
), cand AS (
  SELECT *, 'art_' || substr(sha256(CASE WHEN norm <> '' THEN 'link:' || norm ELSE 'fallback:' || lower(feed_name) || ':' || lower(title) || ':' || coalesce({_ISO.format("tm")}, '') END), 1, 24) AS article_id FROM ca
), uniq AS (
  SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY CASE WHEN norm <> '' THEN norm ELSE article_id END ORDER BY feed_ord, entry_ord) = 1
), gate AS (SELECT * FROM {{0}} WHERE link <> '' AND (feed_name IN ('src0', 'src5', 'src10') OR {_GATE}))"""


@query(f"""WITH {_E.format("cand")} SELECT article_id, feed_name, entry_ord, title, norm AS normalized_link, {_ISO.format("tm")} AS published_at, md5({_clean("summary")}) AS summary, md5(match) AS match_text, CASE lower(lang) WHEN 'en' THEN 'en' WHEN 'zh-cn' THEN 'zh-CN' ELSE 'und' END AS language FROM cand""")
def q_candidates(spark, sf):
    return _found(spark, sf).select("article_id", "feed_name", "entry_ord", "title", "normalized_link", tx.iso_utc(F.col("published_at")).alias("published_at"), F.md5("summary").alias("summary"), F.md5("legacy_match_text").alias("match_text"), "language")


@query(f"WITH {_E.format('cand')} SELECT article_id, entry_ord FROM uniq")
def q_unique_candidates(spark, sf):
    return candidates.unique_candidates(_found(spark, sf)).select("article_id", "entry_ord")


@query(f"""WITH {_E.format("cand")} SELECT entry_ord, array_to_string(list_filter([{", ".join(f"CASE WHEN {_n(k, 'match')} > 0 THEN '{c}: ' || array_to_string(list_filter([{', '.join(chr(39) + x + chr(39) for x in k)}], lambda z: contains(match, lower(z))), ', ') END" for c, k in KEYWORDS.items())}], lambda z: z IS NOT NULL), '; ') AS matched FROM gate""")
def q_gated_items(spark, sf):
    own = candidates.items(candidates.with_feed_mode(_found(spark, sf), _feeds(spark)), KEYWORDS, F.col("mode"))
    return own.select("entry_ord", format_matched(F.col("matched_keywords")).alias("matched"))


_LEGACY = "legacy AS (SELECT * FROM (SELECT * FROM gate QUALIFY row_number() OVER (PARTITION BY link ORDER BY feed_ord, entry_ord) = 1) QUALIFY row_number() OVER (PARTITION BY feed_name ORDER BY feed_ord, entry_ord) <= 5)"


def _legacy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    unique = candidates.unique_candidates(_found(spark, sf))
    return unique, candidates.legacy_items(unique, KEYWORDS, _feeds(spark), 5)


@query(f"WITH {_E.format('uniq')}, {_LEGACY} SELECT feed_name, entry_ord FROM legacy")
def q_legacy_items(spark, sf):
    return _legacy(spark, sf)[1].select("feed_name", "entry_ord")


@query(
    f"""WITH {_E.format("uniq")}, {_LEGACY} SELECT u.article_id, l.norm IS NOT NULL AS legacy_selected, coalesce({_GATE.replace("match", "l.match")}, false) AS legacy_keyword_matched,
    CASE WHEN l.norm IS NULL THEN 'not_selected_by_legacy_keyword_gate_or_limits' ELSE '' END AS legacy_reject_reason FROM uniq u LEFT JOIN legacy l ON l.norm = u.norm"""
)
def q_trace_left_join(spark, sf):
    return candidates.trace(*_legacy(spark, sf)).select("article_id", "legacy_selected", "legacy_keyword_matched", "legacy_reject_reason")


@query(f"""WITH {_E.format("cand")} SELECT {_ISO.format("min(tm)")} AS window_start, {_ISO.format("max(tm)")} AS window_end FROM cand""")
def q_candidate_windows(spark, sf):
    return candidates.windows(_found(spark, sf)).select(*[tx.iso_utc(F.col(c)).alias(c) for c in ("window_start", "window_end")])


@query(
    f"""WITH RECURSIVE {_E.format("cand")}, feeds AS (SELECT feed_ord, feed_name, dense_rank() OVER (ORDER BY feed_ord) AS i, list({{'k': link, 'e': entry_ord}} ORDER BY entry_ord) AS own FROM (SELECT * FROM gate QUALIFY row_number() OVER (PARTITION BY feed_name, link ORDER BY entry_ord) = 1) GROUP BY 1, 2),
    r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST([] AS BIGINT[]) AS picked
      UNION ALL SELECT i, list_concat(seen, list_transform(p, lambda x: x.k)), list_transform(p, lambda x: x.e) FROM (SELECT f.i AS i, r.seen AS seen, list_filter(f.own, lambda x: NOT list_contains(r.seen, x.k))[1:5] AS p FROM r JOIN feeds f ON f.i = r.i + 1))
    SELECT unnest(picked) AS entry_ord FROM r"""
)
def q_collect_news(spark, sf):
    gate = candidates.items(candidates.with_feed_mode(_found(spark, sf), _feeds(spark)), KEYWORDS, F.col("mode"))
    return candidates.collect_news(gate.select("entry_ord", "feed_ord", "feed_name", "link"), _SCAN).select("entry_ord")


_PCT = "CASE WHEN avg(c_acctbal) > 0 THEN round(avg(c_acctbal) - 4500) / 100 END"
_QUOTE = f"q AS (SELECT c_nationkey AS k, {_PCT} AS pct FROM customer WHERE c_nationkey % 4 <> 3 GROUP BY 1), i AS (SELECT avg(pct) AS average FROM q WHERE k < 5)"


@query(
    f"""WITH {_QUOTE}, j AS (SELECT n_nationkey AS ord, n_name AS name, pct, average FROM nation LEFT JOIN q ON k = n_nationkey, i)
    SELECT ord, name, pct AS pct_change, CASE WHEN pct IS NULL OR average IS NULL THEN '相对观察：主要指数或个股涨跌数据不足。' WHEN average > 0.5 AND pct < -2 THEN '相对观察：逆势走弱。' WHEN average < -0.5 AND pct > 2 THEN '相对观察：逆势走强。' WHEN pct - average >= 1.5 THEN '相对观察：明显强于主要指数均值。'
    WHEN pct - average >= 0.5 THEN '相对观察：小幅强于主要指数均值。' WHEN pct - average <= -1.5 THEN '相对观察：明显弱于主要指数均值。' WHEN pct - average <= -0.5 THEN '相对观察：小幅弱于主要指数均值。' ELSE '相对观察：接近主要指数均值。' END AS relative FROM j"""
)
def q_quote_left_join(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey % 4 <> 3").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"))
    q = c.select(F.col("c_nationkey").cast("string").alias("code"), F.lit("").alias("name"), F.when(F.col("a") > 0, F.round(F.col("a") - 4500) / 100).alias("pct_change"), F.lit(0).cast("long").alias("epoch"))
    watched = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.lit("s").alias("sector"))
    own = quotes.with_quotes(watched, q, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    average = own.where("ord < 5").agg(F.avg("pct_change").alias("average"))
    return own.crossJoin(average).select("ord", "name", "pct_change", quotes.relative_to_average(F.col("pct_change"), F.col("average")).alias("relative"))


@query(
    """WITH s AS (SELECT s_nationkey AS ord, round(avg(s_acctbal) - 4500) / 1000 AS p FROM supplier GROUP BY 1), m AS (SELECT count(*) FILTER (p > 0) AS positive, count(*) FILTER (p < 0) AS negative, avg(p) AS average FROM s)
    SELECT positive, negative, average, CASE WHEN average IS NULL THEN '主要指数行情数据不足，本次不判断市场强弱。' WHEN positive > 0 AND negative > 0 THEN '主要指数涨跌分化，新闻主线需要继续用后续行情和板块表现验证。' WHEN average >= 0.6 THEN '主要指数整体偏强，但仍需观察后续持续性。'
    WHEN average <= -0.6 THEN '主要指数整体偏弱，风险偏好仍需等待后续数据确认。' ELSE '主要指数整体偏震荡，暂不把单日波动解读为趋势。' END AS note, (SELECT p FROM s WHERE ord = 3) AS leader, (SELECT avg(p) FROM s WHERE ord <> 3) AS others FROM m"""
)
def q_temperature(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("ord")).agg((F.round(F.avg("s_acctbal") - 4500) / 1000).alias("pct_change"))
    indexes = s.select("ord", "pct_change", F.when(F.col("ord") == 3, "000688").otherwise("x").alias("code"), F.lit("n").alias("name"))
    return quotes.index_mood(indexes).crossJoin(quotes.leader_gap(indexes).select("leader", "others"))


_EVENTS = "ev AS (SELECT o_orderkey AS event_ord, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


def _events(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf, "orders").select("o_orderkey")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("event_ord")).agg(ids.alias("evidence_article_ids"))


def _parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("article_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("source"), F.concat(F.lit("https://x.example/"), F.col("p_size").cast("string")).alias("link"), F.lit("").alias("normalized_link"))


@query(f"WITH {_EVENTS} SELECT event_ord, CAST(pos - 1 AS INTEGER) AS pos, p_name AS title FROM (SELECT event_ord, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM ev) JOIN part ON p_partkey = id WHERE p_partkey % 3 <> 0")
def q_evidence_explode(spark, sf):
    return stories.evidence(_events(spark, sf), _parts(spark, sf)).select("event_ord", "pos", "title")


@query(f"WITH {_EVENTS} SELECT DISTINCT 'h' || (p_size % 5) AS holding_title, event_ord FROM (SELECT event_ord, unnest(ids) AS id FROM ev) JOIN part ON p_partkey = id WHERE p_partkey % 3 <> 0 AND p_size <= 20")
def q_holding_events(spark, sf):
    sizes = spark.range(1, 21)
    matches = sizes.select(F.concat(F.lit("h"), (F.col("id") % 5).cast("string")).alias("holding_title"), F.concat(F.lit("https://X.example/"), F.col("id").cast("string"), F.lit("/?utm_a=1#f")).alias("link"), F.lit("明确相关").alias("holding_relation"))
    return stories.events_of_holding(_events(spark, sf), _parts(spark, sf), matches)


_GOLD = """g AS (SELECT 'r' || n_nationkey AS reference_id, CASE WHEN n_nationkey % 2 = 0 THEN 'must_include_at_10' ELSE 'strong_candidate' END AS tier, [n_nationkey * 37 + 1, n_nationkey * 53 + 2] AS sup, [n_nationkey * 11 + 3, n_nationkey * 7 + 1, 5] AS forb FROM nation),
pairs AS (SELECT DISTINCT reference_id, event_ord FROM g, ev WHERE list_has_any(sup, ids))"""


@query(
    f"""WITH {_EVENTS}, {_GOLD}, bg AS (SELECT list('e' || event_ord ORDER BY 'e' || event_ord) AS ids FROM ev WHERE event_ord % 50 = 0)
    SELECT 'must_include_missing' AS metric, reference_id, CAST([] AS VARCHAR[]) AS ids FROM g WHERE tier = 'must_include_at_10' AND reference_id NOT IN (SELECT reference_id FROM pairs)
    UNION ALL SELECT 'background_over_priority', '', ids FROM bg WHERE len(ids) > 0 AND (SELECT count(*) FROM g WHERE reference_id NOT IN (SELECT reference_id FROM pairs)) > 0
    UNION ALL SELECT * FROM (SELECT 'forbidden_evidence_binding', reference_id, list_transform(list_filter(forb, lambda f: list_contains(seen, f)), lambda f: CAST(f AS VARCHAR)) AS ids
      FROM (SELECT reference_id, any_value(forb) AS forb, flatten(list(ids)) AS seen FROM pairs JOIN g USING (reference_id) JOIN ev USING (event_ord) GROUP BY 1)) WHERE len(ids) > 0
    UNION ALL SELECT DISTINCT 'attribution_required_missing', reference_id, CAST([] AS VARCHAR[]) FROM pairs WHERE CAST(substr(reference_id, 2) AS INTEGER) % 3 = 0 AND event_ord % 2 = 0
    UNION ALL SELECT DISTINCT 'uncertainty_expected_missing', reference_id, CAST([] AS VARCHAR[]) FROM pairs WHERE CAST(substr(reference_id, 2) AS INTEGER) % 5 = 0 AND event_ord % 3 = 0"""
)
def q_gold_overlap(spark, sf):
    o = F.col("event_ord")
    events = _events(spark, sf).select(
        F.concat(F.lit("e"), o.cast("string")).alias("event_id"), "evidence_article_ids", F.when(o % 50 == 0, "background").otherwise("important").alias("importance"), F.when(o % 2 == 0, "plain").otherwise("x said y").alias("canonical_title"),
        F.lit("z said w").alias("summary"), F.when(o % 3 == 0, "high").otherwise("low").alias("confidence"), F.array().cast("array<string>").alias("uncertainties"),
    )
    k = F.col("n_nationkey").cast("int")
    text = lambda *c: F.array(*[x.cast("string") for x in c])
    gold = table(spark, sf, "nation").select(
        F.concat(F.lit("r"), k.cast("string")).alias("reference_id"), F.when(k % 2 == 0, "must_include_at_10").otherwise("strong_candidate").alias("tier"), text(k * 37 + 1, k * 53 + 2).alias("supporting"), text(k * 11 + 3, k * 7 + 1, F.lit(5)).alias("forbidden"),
        (k % 3 == 0).alias("attribution_required"), (k % 5 == 0).alias("uncertainty_expected"),
    )
    return curation.evaluate(events, gold, (" said ",))


@query("SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0")
def q_orphans(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).join(table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id")), "id", "left_anti").distinct()


@query("SELECT min(id) AS id, count(*) AS n FROM (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q_overlap(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return a.intersect(table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(
    """WITH used AS (SELECT event_id, 0 AS section_ord FROM events WHERE value > 190 UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'purchase' AND value > 150)
    SELECT event_id, section_ord FROM used UNION ALL SELECT event_id, 2 FROM events WHERE value > 100 AND event_id NOT IN (SELECT event_id FROM used)"""
)
def q_used_anti(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    used = e.where("value > 190").select("event_id", F.lit(0).alias("section_ord")).unionByName(e.where("event_type = 'purchase' and value > 150").select("event_id", F.lit(1).alias("section_ord")))
    rest = e.where("value > 100").select("event_id").join(used.select("event_id").distinct(), "event_id", "left_anti")
    return used.unionByName(rest.select("event_id", F.lit(2).alias("section_ord")))


@query(
    """WITH p AS (SELECT page_id % 4 AS k, CASE WHEN page_id % 4 = 2 THEN 0 ELSE length(url) END AS n FROM pages WHERE page_id % 4 <> 3), s AS (SELECT CASE WHEN n > 0 THEN CASE WHEN k = 1 THEN 'ok_with_warning' ELSE 'ok' END ELSE CASE WHEN k = 1 THEN 'failed' ELSE 'empty' END END AS status FROM p)
    SELECT e.status, count(s.status) AS n FROM (SELECT unnest(['ok', 'ok_with_warning', 'empty', 'failed']) AS status) e LEFT JOIN s ON s.status = e.status GROUP BY 1"""
)
def q_status_hist(spark, sf):
    k = F.col("page_id") % 4
    probes = table(spark, sf, "pages").where(k != 3).select(F.when(k == 2, 0).otherwise(F.length("url")).alias("entries_count"), F.when(k == 1, "bad").otherwise("").alias("error_message"))
    return health.counts(health.statuses(probes))


@query(
    """WITH c AS (SELECT conv_id, turn, role, text FROM conversations), ok AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 2 = 0),
    v AS (SELECT CAST(conv_id AS VARCHAR) AS response_id, 20 AS p, 'report_date_mismatch' AS code FROM c WHERE conv_id % 7 = 0 GROUP BY conv_id
      UNION ALL SELECT CAST(conv_id AS VARCHAR), 50, 'max_events_exceeded' FROM c GROUP BY conv_id HAVING count(*) > 8
      UNION ALL SELECT CAST(conv_id AS VARCHAR), 1000 + 100 * turn + 10, 'invalid_enum_value' FROM c WHERE role = 'system'
      UNION ALL SELECT CAST(conv_id AS VARCHAR), 1000 + 100 * turn + 21, 'unknown_evidence_article_id' FROM c WHERE CAST(conv_id + turn AS VARCHAR) NOT IN (SELECT id FROM ok))
    SELECT response_id, arg_min(code, p) AS code FROM v GROUP BY 1"""
)
def q_validate(spark, sf):
    c = table(spark, sf, "conversations")
    rid = F.col("conv_id").cast("string").alias("response_id")
    day = F.lit("2024-01-31")
    responses = c.select(rid, "conv_id").distinct().select("response_id", F.lit("v").alias("schema_version"), F.when(F.col("conv_id") % 7 == 0, "x").otherwise(day).alias("report_date"), F.lit("v").alias("expected_version"), day.alias("expected_date"), F.lit(8).alias("max_events"))
    text = F.lit("t")
    events = c.select(
        rid, F.col("turn").alias("pos"), F.col("turn").cast("string").alias("event_id"), text.alias("canonical_title"), text.alias("summary"), text.alias("why_important"), F.when(F.col("role") == "system", "no").otherwise("other").alias("category"), F.lit("important").alias("importance"),
        F.lit("new_event").alias("novelty"), F.lit("low").alias("confidence"), F.array((F.col("conv_id") + F.col("turn")).cast("string")).alias("evidence_article_ids"),
    )
    ids = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("article_id"))
    # what a response may cite: only the ids that it does cite, so that the table of known ids stays in proportion
    known = events.select("response_id", F.explode("evidence_article_ids").alias("article_id")).distinct().join(ids, "article_id").select("response_id", "article_id")
    rejected = events.select("response_id", "pos", F.lit("").alias("article_id"), F.lit("").alias("reject_reason")).where("false")
    return curation.first_violation(curation.violations(responses, events, rejected, known)).select("response_id", "code")


@query(r"SELECT conv_id, turn, regexp_matches(lower(text || CASE WHEN turn % 5 = 0 THEN ' You should  buy.' WHEN turn % 5 = 1 THEN ' sell the shares' ELSE ' should buyer' END), '\b(?:should|suggest)\s+(?:to\s+)?(?:buy|sell)\b|\b(?:buy|sell|hold)\s+(?:this|that|the)\s+(?:stock|shares?|company)\b') AS advice FROM conversations")
def q_content_policy(spark, sf):
    t = F.col("turn") % 5
    more = F.when(t == 0, " You should  buy.").when(t == 1, " sell the shares").otherwise(" should buyer")
    return table(spark, sf, "conversations").select("conv_id", "turn", curation.gives_advice(F.array(F.concat("text", more))).alias("advice"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT p_partkey, CASE WHEN lower(trim(m)) IN ('sh', '上海') THEN '1.' WHEN lower(trim(m)) = 'sz' THEN '0.' WHEN substr(c, 1, 1) IN ('5', '6', '9') THEN '1.' ELSE '0.' END || c AS security FROM (SELECT p_partkey, ['SH', ' sz ', '', '上海'][p_partkey % 4 + 1] AS m, CAST(p_partkey AS VARCHAR) AS c FROM part)")
def q_security_id(spark, sf):
    m = F.element_at(F.array(*[F.lit(x) for x in ("SH", " sz ", "", "上海")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", links.security_id(F.col("p_partkey").cast("string"), m).alias("security"))


@query(
    """SELECT count(*) AS original, count(*) FILTER (source IN ('src1', 'src2')) AS excluded, count(*) FILTER (source NOT IN ('src1', 'src2') AND length(text) > 500) AS capped, count(*) FILTER (source NOT IN ('src1', 'src2') AND length(text) <= 500) AS unchanged FROM documents"""
)
def q_projection_counts(spark, sf):
    return curation.projection_counts(table(spark, sf, "documents").select("source", F.col("text").alias("summary")), ("src1", "src2"))


@query()
def q_fuzzy_pairs(spark, sf):
    """Titles of one source and the same first two characters that are similar: the query is defined by these blocks. Equal titles of a block are a class,
    named by its first document: pairs are of classes, and a row of ratio 1 gives a copy's class."""
    d = spark.read.parquet(f"{sf}/documents.parquet")  # heads of texts are little work, so the texts stay where they are
    a = article_rows(d).select("ord", "source", tx.story_key(F.col("title")).alias("k")).where(F.length("k") >= 10)
    return similar.similar_pairs(a.withColumn("head", F.substring("k", 1, 2)), ["source", "head"])


__all__ = ["articles", "contains_any", "count_terms", "oracle_sql", "queries"]

from . import catalogue_rows  # noqa: E402, F401 - it registers its queries here
