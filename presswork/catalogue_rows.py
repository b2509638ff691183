"""More queries: what is said of single rows, quotes and payloads, and constraints on rows. The catalogue registers them with its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _A, _CATEGORY, _NEWS, _PCT, VOCABULARY, articles, gated, query, table
from .functions import links
from .functions import news as fn
from .functions import text as tx
from .functions.vocab import category_label
from .operators import curation, news, quotes, stories, validate


def _pick(values, by):
    """The value at by modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


# -- figures, times and labels


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '涨跌幅 数据暂不可用' ELSE CASE WHEN p > 0 THEN '+' ELSE '' END || printf('%.2f%%', p) END AS pct,
    CASE WHEN c_custkey % 8 = 0 THEN '成交额 数据暂不可用' ELSE '成交额 ' || printf('%.1f', c_custkey / 10.0) || ' 亿' END AS amount,
    CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '，来源 s，截至 t' ELSE '，截至 t' END AS meta, CASE c_custkey % 5 WHEN 2 THEN 1.5 WHEN 4 THEN -3.0 END AS number
    FROM (SELECT c_custkey, (CAST(round(c_acctbal * 100) AS BIGINT) % 1000) / 100.0 AS p FROM customer)"""
)
def q_figures(spark, sf):
    k = F.col("c_custkey")
    p = (F.round(F.col("c_acctbal") * 100).cast("long") % 1000) / 100
    meta = tx.quote_meta(F.when(k % 3 == 1, "s").otherwise(""), F.when(k % 3 == 0, "").otherwise("t"))
    number = links.to_float(_pick(("", "-", "1.5", "x", "-3"), k))
    return table(spark, sf, "customer").select("c_custkey", tx.percent(F.when(k % 9 != 0, p)).alias("pct"), tx.amount(F.when(k % 8 != 0, k * 1e7)).alias("amount"), meta.alias("meta"), number.alias("number"))


_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')"
_MAIL = "strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000'"


@query(
    f"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts, event_id % 4 AS k FROM events)
    SELECT event_id, CASE WHEN k <> 3 THEN {_STAMP} END AS found, CASE k WHEN 0 THEN {_STAMP} WHEN 3 THEN 'Unknown' ELSE {_MAIL} END AS said,
    CASE k WHEN 3 THEN 'Unknown' ELSE strftime(ts, '%m-%d %H:%M') END AS short FROM e"""
)
def q_item_times(spark, sf):
    """A time as a column, as the text of one of two fields, or not at all."""
    k = F.col("event_id") % 4
    ts = F.date_trunc("second", "ts")
    mail = F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    none = F.lit(None).cast("timestamp")
    e = table(spark, sf, "events").select("event_id", F.when(k == 0, ts.cast("timestamp")).alias("at"), F.when(k == 1, mail).alias("published"), F.when(k == 2, mail).alias("updated"))
    e = e.withColumn("found", tx.entry_time(F.col("at"), none, F.col("published"), F.col("updated")))
    return e.select("event_id", tx.iso_utc(F.col("found")).alias("found"), tx.format_published(F.col("published"), F.col("updated"), F.col("found")).alias("said"), tx.digest_time(F.col("found"), F.lit("")).alias("short"))


@query(f"""WITH {_A} SELECT ord, coalesce({_CATEGORY}, CASE WHEN ord % 2 = 0 THEN source END, 'none') AS label, CASE WHEN ord % 3 = 0 THEN 'f' ELSE source END AS owner FROM a""")
def q_labels(spark, sf):
    own = gated(spark, sf).withColumn("feed", F.when(F.col("ord") % 2 == 0, F.col("source")).otherwise(""))
    return own.select("ord", category_label(F.col("matched_keywords"), F.col("feed"), F.lit("none")).alias("label"), tx.source_key(F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("source")), F.lit("f")).alias("owner"))


_ONE_LINE = r"trim(regexp_replace(raw, '\s+', ' ', 'g'))"


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    for sign in "\\`*_[]()#!>|~":
        x = f"replace({x}, '{sign}', '\\{sign}')"
    return x


@query(
    rf"""WITH {_A}, x AS (SELECT ord, '  <b> & "' || title || '''  [a](b) | #1_*  ' AS raw, title, summary FROM a0)
    SELECT ord, {_escaped(_ONE_LINE)} AS shown, substr(trim(regexp_replace(summary, '\s+', ' ', 'g')), 1, 256) AS meta,
    CASE WHEN length(summary) > 128 THEN 'redacted' WHEN regexp_matches(summary, '^[A-Za-z0-9_.:-]*$') THEN summary ELSE 'redacted' END AS diagnostic FROM x"""
)
def q_review_texts(spark, sf):
    raw = F.concat(F.lit('  <b> & "'), "title", F.lit("'  [a](b) | #1_*  "))
    return articles(spark, sf).select("ord", tx.review_text(raw).alias("shown"), tx.metadata_text(F.col("summary")).alias("meta"), tx.safe_diagnostic(F.col("summary")).alias("diagnostic"))


@query(
    rf"""WITH {_A}, x AS (SELECT ord, title || CASE ord % 5 WHEN 0 THEN ' 责任编辑： someone next' WHEN 1 THEN ' 责编:x' WHEN 2 THEN ' 点击进入专题： all the rest' WHEN 3 THEN ' 免责声明：none of it' ELSE ' 免责声明 kept' END AS t FROM a0)
    SELECT ord, trim(regexp_replace(CASE ord % 5 WHEN 0 THEN regexp_replace(t, '责任编辑： \S+', '') WHEN 1 THEN regexp_replace(t, '责编:\S+', '') WHEN 2 THEN regexp_replace(t, '点击进入专题：.*$', '')
      WHEN 3 THEN regexp_replace(t, '免责声明：.*$', '') ELSE t END, '\s+', ' ', 'g')) AS stripped FROM x"""
)
def q_strip_noise(spark, sf):
    more = _pick((" 责任编辑： someone next", " 责编:x", " 点击进入专题： all the rest", " 免责声明：none of it", " 免责声明 kept"), F.col("ord"))
    return articles(spark, sf).select("ord", tx.strip_noise(F.concat("title", more)).alias("stripped"))


# -- news


_WATCHED = {
    fn.FINANCING: " 的上市后成交热度、估值变化和可比公司反馈。",
    fn.OPERATING: " 的营收、利润或经营数据是否延续，并影响同类公司预期。",
    fn.POLICY: " 是否出现正式文件、处罚范围或交易所后续问询。",
    fn.CATALYST: " 是否落到订单、招标、中标、扩产或商业化数据。",
    fn.MACRO: " 对汇率、利率、黄金、股指或成交量的延续影响。",
}
_RISKS = {
    fn.POLICY: "监管变量：后续是否出现正式处罚、问询范围扩大或同类公司合规风险重估。",
    fn.FINANCING: "资本市场变量：IPO / 融资 / 估值新闻后续交易热度是否退潮，并影响同类公司预期。",
    fn.OPERATING: "经营变量：财报、营收或利润变化是否能持续，并影响同类公司基本面预期。",
    fn.MACRO: "宏观变量：价格、汇率、利率或流动性信号是否继续压制风险偏好。",
}


@query(
    f"""WITH {_NEWS} SELECT ord, '观察 ' || trim(title) || CASE news_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WATCHED.items())} ELSE ' 是否被公告、成交结构或后续新闻验证。' END AS watched,
    CASE news_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RISKS.items())} ELSE '反证变量：主题新闻是否缺少订单、公告或成交结构验证。' END AS risk FROM kept"""
)
def q_news_variables(spark, sf):
    return news.insights(articles(spark, sf), VOCABULARY).select("ord", fn.watch_variable().alias("watched"), fn.risk_variable().alias("risk"))


@query(f"""WITH {_NEWS}, f AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY trim(link), trim(title) ORDER BY score DESC, ord) = 1) SELECT ord, score, CAST(row_number() OVER (ORDER BY score DESC, ord) AS INTEGER) AS rank FROM f QUALIFY rank <= 40""")
def q_best_insights(spark, sf):
    return news.best_insights(news.insights(articles(spark, sf), VOCABULARY), 40).select("ord", "score", F.col("rank").cast("int").alias("rank"))


@query(
    """WITH e AS (SELECT event_id, ['证监会 再融资 x', '减持', '退市 令', '并购重组', '问询', '处罚', '监管函', '证监会', 'none'][event_id % 9 + 1] AS t, event_id % 2 = 0 AS policy FROM events), k AS (
    SELECT event_id, t, CASE WHEN NOT policy THEN NULL WHEN event_id % 9 = 0 THEN 'policy:csrc-refinancing-private-placement' ELSE CASE event_id % 9 WHEN 1 THEN 'policy:shareholding-reduction' WHEN 2 THEN 'policy:delisting' WHEN 3 THEN 'policy:ma-restructuring'
      WHEN 4 THEN 'policy:inquiry' WHEN 5 THEN 'policy:penalty' WHEN 6 THEN 'policy:penalty' END END AS key FROM e)
    SELECT event_id, key, CASE WHEN key = 'policy:csrc-refinancing-private-placement' THEN '证监会完善上市公司再融资规则，并拟建立定增储架发行制度' ELSE t END AS title FROM k"""
)
def q_policy_keys(spark, sf):
    e = table(spark, sf, "events").select("event_id", _pick(("证监会 再融资 x", "减持", "退市 令", "并购重组", "问询", "处罚", "监管函", "证监会", "none"), F.col("event_id")).alias("title"), F.lit("").alias("reason"), F.when(F.col("event_id") % 2 == 0, fn.POLICY).otherwise(fn.MACRO).alias("news_type"))
    return e.withColumn("key", fn.policy_key()).select("event_id", "key", fn.policy_title(F.col("key"), F.col("title")).alias("title"))


# -- quotes


@query(
    """WITH p AS (SELECT p_size, p_partkey, p_partkey % 40 AS code, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS pos FROM part)
    SELECT p_size, CAST(code AS VARCHAR) AS code, p_partkey % 7 / 2.0 AS pct_change, p_partkey AS epoch FROM (SELECT * FROM p WHERE p_size = 7 QUALIFY row_number() OVER (PARTITION BY code ORDER BY pos DESC) = 1) WHERE p_partkey % 7 <> 3
    UNION ALL SELECT p_size, CAST(code AS VARCHAR), NULL, p_partkey FROM (SELECT * FROM p WHERE p_size = 7 QUALIFY row_number() OVER (PARTITION BY code ORDER BY pos DESC) = 1) WHERE p_partkey % 7 = 3"""
)
def q_quote_payload(spark, sf):
    k = F.col("p_partkey")
    rows = F.struct((k % 40).cast("string").alias("f12"), F.lit("n").alias("f14"), F.when(k % 7 == 3, "-").otherwise((k % 7 / 2).cast("string")).alias("f3"), k.cast("string").alias("f124"))
    body = table(spark, sf, "part").where("p_size = 7").agg(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), rows.alias("r")))), lambda x: x["r"]).alias("diff"))
    payload = body.select(F.to_json(F.struct(F.struct("diff").alias("data"))).alias("json"))
    return quotes.parse_payload(payload).select(F.lit(7).alias("p_size"), "code", "pct_change", "epoch")


_Q = f"q AS (SELECT c_nationkey AS k, {_PCT} AS pct FROM customer WHERE c_nationkey % 4 <> 3 GROUP BY 1), i AS (SELECT avg(pct) AS average FROM q WHERE k < 5)"


@query(
    f"""WITH {_Q}, j AS (SELECT n_nationkey AS ord, n_name, pct, average, pct - average AS apart FROM nation LEFT JOIN q ON k = n_nationkey, i)
    SELECT ord, pct AS pct_change, ord % 2 = 0 AND ord < 12 AS clear_news, CASE WHEN average > 0.5 AND pct < -2 THEN '异常提示：主要指数整体偏强，但该持仓明显逆势走弱；RSS 候选新闻暂未解释该波动，后续需观察是否来自板块、公司消息或资金行为。'
      WHEN average < -0.5 AND pct > 2 THEN '异常提示：主要指数整体偏弱，但该持仓明显逆势走强；RSS 候选新闻暂未解释该波动，后续需观察是否来自板块、公司消息或资金行为。' ELSE '' END AS anomaly FROM j"""
)
def q_observations(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey % 4 <> 3").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"))
    own = c.select(F.col("c_nationkey").cast("string").alias("code"), F.when(F.col("a") > 0, F.round(F.col("a") - 4500) / 100).alias("pct_change"), F.lit(None).cast("double").alias("amount"), F.lit("s").alias("source"), F.lit("t").alias("as_of"), F.col("c_nationkey").alias("k"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    matches = n.where("ord < 12").select(F.concat_ws(" ", "code", "name").alias("holding_title"), F.when(F.col("ord") % 2 == 0, fn.CLEAR).otherwise(fn.WEAKLY).alias("holding_relation"))
    return quotes.observations(n, own.drop("k"), own.where("k < 5"), matches).select("ord", "pct_change", "clear_news", "anomaly")


@query("""SELECT coalesce(max(CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) END), DATE '2020-01-01') AS market_data_date, count(*) FILTER (event_id % 3 = 0) AS undated FROM events""")
def q_data_date(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("as_of"))
    return quotes.data_date(e, F.lit("2020-01-01").cast("date")).crossJoin(e.agg(F.count_if(F.col("as_of") == "no date").alias("undated")))


# -- curated responses and constraints


@query(
    """WITH d AS (SELECT doc_id, source, text, lang FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS article_id, CAST(strlen(j) AS INTEGER) AS bytes FROM (SELECT doc_id, '{"article_id":"' || doc_id || '","author":null,"collected_at":"2024-01-31T00:00:00+00:00","feed_name":"' || source || '","feed_role":"general","language":"' || lang || '","link":"","normalized_link":"","published_at":null,"report_date":"2024-01-31","source":"'
      || source || '","summary":' || CAST(to_json(text) AS VARCHAR) || ',"title":"t"}' AS j FROM d)"""
)
def q_request_bytes(spark, sf):
    none = F.lit(None).cast("string")
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("article_id"), none.alias("author"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("collected_at"), F.col("source").alias("feed_name"), F.lit("general").alias("feed_role"), F.col("lang").alias("language"),
        F.lit("").alias("link"), F.lit("").alias("normalized_link"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("2024-01-31").cast("date").alias("report_date"), "source", F.col("text").alias("summary"), F.lit("t").alias("title"),
    )
    return curation.request_json(d).select("article_id", "bytes")


@query("""SELECT conv_id, turn, [role, 'user', 'x'][1:CASE WHEN role = 'user' THEN 1 ELSE 2 END] || ['x'] AS ids, CASE WHEN turn % 3 = 0 THEN 'market' ELSE 'core' END AS part FROM conversations""")
def q_canonical_events(spark, sf):
    """Evidence ids once each, and events by the section that their category goes to."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.array(F.col("role"), F.lit("user"), F.lit("x"), F.lit("x")).alias("evidence_article_ids"), F.when(F.col("turn") % 3 == 0, "energy_commodities").otherwise("other").alias("category"))
    core, market = stories.partitions(curation.canonical_events(c))
    return core.withColumn("part", F.lit("core")).unionByName(market.withColumn("part", F.lit("market"))).select("conv_id", "turn", F.col("evidence_article_ids").alias("ids"), "part")


@query(
    """WITH p AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'c' END AS code, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'm' END AS market, 's' AS sector FROM part)
    SELECT ord, 'holdings[' || ord || '].' || f || ' must be a non-empty string' AS error FROM (SELECT ord, unnest(['code', 'name', 'market', 'sector']) AS f, unnest([code, name, market, sector]) AS v FROM p) WHERE trim(coalesce(v, '')) = ''"""
)
def q_holding_rows(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("ord"), F.when(k % 5 == 0, " ").otherwise("c").alias("code"), F.when(k % 7 != 0, F.col("p_name")).alias("name"), F.when(k % 4 == 0, "").otherwise("m").alias("market"), F.lit("s").alias("sector"))
    return validate.holding_rows(p)


@query(
    """WITH d AS (SELECT doc_id AS ord, doc_id % 12 AS k FROM documents), c AS (
    SELECT ord, CASE k WHEN 1 THEN 'missing_title' WHEN 2 THEN 'missing_source' WHEN 3 THEN 'missing_feed_name' WHEN 4 THEN 'missing_feed_role' WHEN 5 THEN 'bad_published_at' WHEN 6 THEN 'report_date_mismatch' WHEN 7 THEN 'link_required'
      WHEN 8 THEN 'normalized_link_conflict' WHEN 9 THEN 'article_id_conflict' END AS code, k = 10 AND row_number() OVER (PARTITION BY k = 10 ORDER BY ord) > 1 AS again FROM d)
    SELECT ord, coalesce(code, CASE WHEN again THEN 'duplicate_candidate_key' END) AS code FROM c WHERE code IS NOT NULL OR again"""
)
def q_candidate_rows(spark, sf):
    """Each kind of breach, and a link that stands again."""
    k = F.col("doc_id") % 12
    link = F.when(k == 7, "").when(k == 10, "https://x.example/same").otherwise(F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")))
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), F.when(k == 9, "art_0").otherwise("").alias("article_id"), F.when(k == 1, " ").otherwise("t").alias("title"), F.when(k == 2, "").otherwise("s").alias("source"), F.when(k == 3, None).otherwise("f").alias("feed_name"),
        F.when(k == 4, "").otherwise("general").alias("feed_role"), F.when(k == 5, "yesterday").when(k != 7, "2024-01-31T00:00:00Z").alias("published_at"), link.alias("link"), F.when(k == 8, "https://y.example/").otherwise("").alias("normalized_link"),
        F.when(k == 6, "2024-02-01").otherwise("2024-01-31").alias("report_date"), F.lit("2024-01-31").alias("expected_date"),
    )
    return validate.candidate_rows(d)
