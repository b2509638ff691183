"""Typing and scoring of market news, as expressions over one article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .vocab import Vocabulary, contains_any, default_vocabulary, distinct_terms, first_term

MACRO, POLICY, FINANCING, OPERATING, CATALYST, BUSINESS, WEAK = "宏观风险", "政策监管", "公司融资 / IPO", "公司经营 / 财报", "产业催化", "普通商业新闻", "弱相关内容"
CLEAR, WEAKLY = "明确相关", "弱相关变量"


def article_text(keywords: Column | None = None) -> Column:
    """Title, summary, source, role and keywords, each trimmed, with one space between them even where one is blank."""
    blank = lambda c: tx.strip(F.coalesce(F.col(c), F.lit("")))
    words = F.array_join(F.flatten(F.map_values(keywords)), " ") if keywords is not None else F.lit("")
    return F.concat(blank("title"), F.lit(" "), blank("summary"), F.lit(" "), blank("source"), F.lit(" "), blank("feed_role"), F.lit(" "), F.coalesce(words, F.lit("")))


def _some(terms: Column) -> Column:
    return F.size(terms) > 0


def _bonus(terms: Column, base: int, each: int, most: int) -> Column:
    return F.when(_some(terms), base + F.least(F.size(terms) * each, F.lit(most))).otherwise(0)


def _strong(terms: Column, v: Vocabulary) -> Column:
    own = F.filter(terms, lambda t: t.isin(*v["news.strong_policy"]))
    combined = F.array_contains(terms, "监管") & F.arrays_overlap(terms, F.array(*[F.lit(t) for t in v["news.regulation_combo"] if t != "监管"])) & ~F.array_contains(own, "监管")
    return F.when(combined, F.concat(own, F.array(F.lit("监管")))).otherwise(own)


def _not_negated(text: Column, terms: Column, in_title: Column) -> Column:
    parts = tx.negated_parts(text)
    return F.filter(terms, lambda t: F.array_contains(in_title, t) | ~F.exists(parts, lambda p: F.contains(p, t)))


_STEPS = [  # terms found in the text (t) or in the title (h): name and vocabulary
    ("h_macro", "macro_risk"), ("h_policy", "policy_regulation"), ("h_financing", "company_financing"), ("h_operating", "company_operating"), ("h_industry", "high_value_industry_themes"),
    ("h_catalyst", "concrete_catalyst"), ("h_financing_action", "financing_title_action"), ("h_operating_action", "operating_title_action"), ("t_compute", "compute_direct"),
    ("t_power", "data_center_power_direct"), ("t_macro", "macro_risk"), ("t_policy", "policy_regulation"), ("t_financing", "company_financing"), ("t_operating", "company_operating"),
    ("t_industry", "high_value_industry_themes"), ("t_catalyst", "concrete_catalyst"), ("t_risk", "risk"), ("t_weak", "weak_related"),
]


def score_articles(articles: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """articles (title, summary, source, feed_name, feed_role, matched_keywords, link) with news_text, score, news_type, reason and weak_related."""
    v = vocabulary or default_vocabulary()
    keywords = F.col("matched_keywords") if "matched_keywords" in articles.columns else None
    blank = lambda c: tx.strip(F.coalesce(F.col(c), F.lit("")))
    out = articles.withColumns({"news_text": article_text(keywords), "_head": blank("title"), "_from": F.coalesce(F.nullif(blank("source"), F.lit("")), F.nullif(blank("feed_name"), F.lit("")), F.lit("Unknown"))})
    out = out.withColumns({"_t": F.lower("news_text"), "_h": F.lower("_head")})
    out = out.withColumns({f"_{name}": distinct_terms(F.col("_t" if name[0] == "t" else "_h"), v[f"news.{vocab}"]) for name, vocab in _STEPS})
    c = lambda name: F.col(f"_{name}")
    t = lambda name: contains_any(c("t"), v[f"news.{name}"])
    h = lambda name: contains_any(c("h"), v[f"news.{name}"])
    out = out.withColumns(
        {
            "_ai_application": h("ai_application") & contains_any(c("h"), ("AI", "人工智能")),
            "_policy_event": t("a_share_policy_event") & t("a_share_policy_context"),
            "_earnings": t("earnings_profit") & t("earnings_size") & h("earnings_broker"),
            "_directory": h("directory_or_ranking") & ~h("concrete_capital_event"),
            "_regulator": h("government_regulator") & h("regulatory_action"),
            "_roundup": h("roundup"),
            "_t_policy": _not_negated(F.col("news_text"), c("t_policy"), c("h_policy")),
            "_no_financing": t("negated_financing"),
            "_negated": t("negated_signal"),
        }
    )
    empty = F.array().cast("array<string>")
    no_money = c("no_financing") | c("directory")
    out = out.withColumns(
        {
            "_h_financing": F.when(no_money, empty).otherwise(c("h_financing")),
            "_t_financing": F.when(no_money, empty).otherwise(c("t_financing")),
            "_h_operating": F.when(c("regulator"), empty).otherwise(c("h_operating")),
            "_h_operating_action": F.when(c("regulator"), empty).otherwise(c("h_operating_action")),
            "_h_strong": _strong(c("h_policy"), v),
        }
    )
    generic = v["news.generic_exchange_policy"]
    out = out.withColumn("_t_policy", F.when(_some(c("t_financing")) & ~_some(c("h_policy")), F.filter(c("t_policy"), lambda x: ~x.isin(*generic))).otherwise(c("t_policy")))
    out = out.withColumn("_t_strong", _strong(c("t_policy"), v))
    direct = _some(c("t_compute")) | _some(c("t_power"))
    some = lambda name: _some(c(name))
    flag = lambda condition, points: F.when(condition, points).otherwise(0)
    points = (
        _bonus(c("t_macro"), 30, 4, 16) + _bonus(c("t_policy"), 50, 5, 25) + _bonus(c("t_strong"), 12, 3, 18) + _bonus(c("t_financing"), 34, 4, 16) + _bonus(c("t_operating"), 30, 4, 16) + _bonus(c("t_industry"), 14, 3, 15) + _bonus(c("t_catalyst"), 24, 4, 16)
        + flag(c("policy_event"), 42) + flag(c("earnings"), 104) + flag(direct, 60) + flag(c("ai_application"), 48) + flag(some("t_risk"), 10) + flag(c("regulator"), 50) - flag(c("directory"), 100)
        + flag(some("h_financing"), 18) + flag(some("h_operating"), 16) + flag(some("h_macro"), 10) + flag(some("h_policy"), 28) + flag(some("h_strong"), 12) + flag(some("h_catalyst") & some("h_industry"), 14)
    )
    hard = some("t_policy") | some("t_financing") | some("t_operating") | some("h_macro") | some("h_policy")
    out = out.withColumn("weak_related", c("roundup") | (some("t_weak") & (~hard | c("negated"))))
    out = out.withColumn("_points", points - flag(c("roundup"), 140) - F.when(some("t_weak"), F.when(F.col("weak_related"), 90).otherwise(18)).otherwise(0))
    listing = lambda terms: F.filter(terms, lambda x: x != "上市")
    special, special_h = _some(listing(c("t_financing"))), _some(listing(c("h_financing")))
    evidence = direct | c("ai_application")
    kind = (
        F.when(F.col("weak_related"), WEAK)
        .when(c("regulator") | some("h_strong") | c("policy_event"), POLICY)
        .when(some("h_financing_action"), FINANCING)
        .when(some("h_operating_action"), OPERATING)
        .when((some("h_catalyst") | evidence) & (some("h_industry") | evidence) & ~special_h, CATALYST)
        .when(some("h_operating") | (some("t_operating") & ~special_h & ~special), OPERATING)
        .when(some("t_strong"), POLICY)
        .when(some("h_financing") | some("t_financing"), FINANCING)
        .when(some("t_operating"), OPERATING)
        .when(some("h_macro") | (some("t_macro") & ~some("t_financing")), MACRO)
        .when((some("h_catalyst") | some("t_catalyst")) & (some("h_industry") | some("t_industry")), CATALYST)
        .when(c("points") < 40, WEAK)
        .otherwise(BUSINESS)
    )
    out = out.withColumns({"news_type": kind, "score": F.greatest(c("points"), F.lit(0)).cast("int")})
    out = out.withColumn("reason", _reason(c))
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def _reason(c) -> Column:
    four = lambda *groups: F.array_join(F.slice(F.array_distinct(F.concat(*groups)), 1, 4), "、")
    kind = F.col("news_type")
    company = F.when(kind == OPERATING, c("t_operating")).otherwise(F.concat(c("t_financing"), c("t_operating")))
    first = F.array_join(F.slice(company, 1, 4), "、")
    head = F.concat(F.lit("「"), c("head"), F.lit("」"))
    said = F.concat(c("from"), F.lit(" 报道的"), head)
    line = lambda a, terms, b: F.concat(said, F.lit(a), terms, F.lit(b))
    rest = four(c("t_industry"), company, c("t_macro"))
    return (
        F.when(kind == MACRO, line("包含 ", four(c("t_macro"), c("t_risk")), " 等宏观或资产价格变量，重点看它是否继续影响风险偏好、汇率利率预期或跨市场联动。"))
        .when(kind == POLICY, line("出现 ", four(c("t_policy"), c("t_risk")), " 等正式政策或监管线索，可能改变相关板块合规风险和资金定价。"))
        .when(kind == CATALYST, line("同时具备 ", four(c("t_catalyst"), c("t_industry")), " 等产业主题和可验证催化，后续看订单、投资节奏或产业链扩散。"))
        .when(kind == FINANCING, line("属于 ", first, " 等公司资本事件，适合观察可比公司估值、上市后交易热度或融资环境。"))
        .when(kind == OPERATING, line("包含 ", first, " 等经营或财报变量，适合观察公司基本面变化和同类公司预期。"))
        .when(kind == WEAK, "内容形态或主题偏泛，缺少明确行情、政策、订单、监管或公司资本事件支撑。")
        .otherwise(F.concat(head, F.lit("包含 "), F.when(rest == "", "商业动态").otherwise(rest), F.lit(" 线索，但缺少更强市场验证变量，作为普通商业新闻低优先级观察。")))
    )


def excluded(v: Vocabulary) -> Column:
    blank = lambda c: tx.strip(F.coalesce(F.col(c), F.lit("")))
    source = F.lower(F.coalesce(F.nullif(blank("source"), F.lit("")), blank("feed_name")))
    title = F.lower(blank("title"))
    return (blank("feed_role") == "ai_tools") | F.contains(source, F.lit("github trending")) | (contains_any(title, v["news.weak_related"]) & ~contains_any(title, v["news.title_hard"]))


def investable() -> Column:
    return ~F.col("weak_related") & (F.col("news_type") != WEAK) & (F.col("score") >= 45)


def unmapped_overseas_ipo(v: Vocabulary) -> Column:
    text = F.lower("news_text")
    return (F.col("news_type") == FINANCING) & contains_any(text, v["news.overseas_ipo"]) & ~contains_any(text, v["news.a_share_related_ipo"])


def theme(v: Vocabulary) -> Column:
    text = F.lower("news_text")
    out = F.when(contains_any(text, v["news.data_center_power_direct"]), "数据中心电力").when(contains_any(text, v["news.compute_direct"]), "算力")
    order = ("AI 应用 / 企业软件", "电网设备 / 特高压", "风电", "半导体 / 芯片", "新能源 / 储能")
    for name in sorted((n[6:] for n in v if n.startswith("theme:")), key=lambda n: (order.index(n) if n in order else len(order), n)):
        out = out.when(contains_any(text, v[f"theme:{name}"]), name)
    return out.otherwise(first_term(distinct_terms(text, v["news.high_value_industry_themes"])))


def policy_key() -> Column:
    text = F.concat_ws(" ", "title", "reason")
    has = lambda *terms: F.greatest(F.lit(False), *[F.contains(text, F.lit(t)) for t in terms])
    return F.when(
        F.col("news_type") == POLICY,
        F.when(has("证监会") & has(*"再融资 定增 储架发行 征求意见".split()), "policy:csrc-refinancing-private-placement")
        .when(has("减持"), "policy:shareholding-reduction")
        .when(has("退市"), "policy:delisting")
        .when(has("并购重组"), "policy:ma-restructuring")
        .when(has("问询"), "policy:inquiry")
        .when(has("处罚", "监管函"), "policy:penalty"),
    )


def policy_title(key: Column, fallback: Column) -> Column:
    return F.when(key == "policy:csrc-refinancing-private-placement", "证监会完善上市公司再融资规则，并拟建立定增储架发行制度").otherwise(fallback)


def holding_relation(term: Column, code: Column, name: Column, precise: Column, score: Column) -> Column:
    """Clear for code and name; null where an imprecise term meets a high score; weak below 60 or where imprecise."""
    sharp = F.array_contains(precise, term)
    return F.when((term == code) | (term == name), CLEAR).when(~sharp & (score >= 60), F.lit(None)).when(~sharp | (score < 60), WEAKLY).otherwise(CLEAR)


def holding_reason(base: Column, term: Column, relation: Column, name: Column) -> Column:
    clear = F.concat(base, F.lit(" 命中关注对象高精度线索："), term, F.lit("。"))
    weak = F.concat(F.lit("弱相关变量：仅命中 "), term, F.lit(" 等行业或外部变量，当前 RSS 候选未出现与"), F.coalesce(F.nullif(name, F.lit("")), F.lit("该持仓")), F.lit("直接相关的订单、业绩、公告或公司消息。"))
    return F.when(relation == CLEAR, clear).otherwise(weak)


def risk_variable() -> Column:
    kind, text = F.col("news_type"), F.concat_ws(" ", "title", "reason")
    funding = F.greatest(*[F.contains(text, F.lit(t)) for t in ("再融资", "定增", "储架发行")])
    return (
        F.when((kind == POLICY) & funding, "政策变量：再融资和定增储架发行制度落地细则、适用范围和市场解读，可能影响上市公司融资节奏与资金偏好。")
        .when(kind == POLICY, "监管变量：后续是否出现正式处罚、问询范围扩大或同类公司合规风险重估。")
        .when(kind == FINANCING, "资本市场变量：IPO / 融资 / 估值新闻后续交易热度是否退潮，并影响同类公司预期。")
        .when(kind == OPERATING, "经营变量：财报、营收或利润变化是否能持续，并影响同类公司基本面预期。")
        .when(kind == MACRO, "宏观变量：价格、汇率、利率或流动性信号是否继续压制风险偏好。")
        .otherwise("反证变量：主题新闻是否缺少订单、公告或成交结构验证。")
    )


def watch_variable() -> Column:
    kind = F.col("news_type")
    say = lambda rest: F.concat(F.lit("观察 "), F.col("title"), F.lit(rest))
    return (
        F.when(kind == FINANCING, say(" 的上市后成交热度、估值变化和可比公司反馈。"))
        .when(kind == OPERATING, say(" 的营收、利润或经营数据是否延续，并影响同类公司预期。"))
        .when(kind == POLICY, say(" 是否出现正式文件、处罚范围或交易所后续问询。"))
        .when(kind == CATALYST, say(" 是否落到订单、招标、中标、扩产或商业化数据。"))
        .when(kind == MACRO, say(" 对汇率、利率、黄金、股指或成交量的延续影响。"))
        .otherwise(say(" 是否被公告、成交结构或后续新闻验证。"))
    )
