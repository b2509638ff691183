"""Predicates, importance and explanations of digest items, as expressions over one article."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TECH_ROLES, ReportConfig
from . import text as tx
from .vocab import Vocabulary, contains_any, count_terms, default_vocabulary, distinct_terms, first_term, matched_terms

_MATCH = ("_text", "_title", "_raw_title", "_context")


def with_match_texts(items: DataFrame, entities: bool = True) -> DataFrame:
    """items (title, summary, source, feed_name, ...) with the texts that terms are looked for in, each cleaned and lowered once."""
    text = lambda *c: tx.clean(F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit("")) for x in c]), entities)
    out = items.withColumns({"_raw_title": text("title"), "_text": F.lower(text("title", "summary")), "_context": F.lower(text("title", "summary", "source", "feed_name"))})
    return out.withColumn("_title", F.lower("_raw_title"))


def without_match_texts(items: DataFrame) -> DataFrame:
    return items.drop(*_MATCH)


def _money(title: Column, after_dollar: str, alone: str) -> Column:
    """A number with a dollar sign and one of these units, or with a word."""
    units = lambda names: rf"{tx.NUMBER}\s?(?:{'|'.join(names.split())})\b"
    return title.rlike(rf"(?iU)\$\s?{units(after_dollar)}") | title.rlike(rf"(?iU)\b{units(alone)}")


def billion_amount(title: Column) -> Column:
    return _money(title, "b bn billion", "billion")


def money_amount(title: Column) -> Column:
    return _money(title, "k m mm b bn million billion", "million billion")


_ACTION = r"(?iU)\b(?:" + "|".join("raise raises raised file files filed withdraw withdraws withdrew nab nabs nabbed reach reaches reached hit hits valued acquire acquires acquired acquisition merger launch launches launched".split()) + r")\b"


@dataclass(frozen=True)
class Item:
    """The columns of a frame that with_match_texts made, a vocabulary and a configuration."""

    vocabulary: Vocabulary
    config: ReportConfig = ReportConfig()
    #: Signals that the frame has as columns already, so that what builds on them doesn't repeat them.
    ready: frozenset[str] = frozenset()
    _made: dict = field(default_factory=dict, compare=False)

    def _once(self, name: str, make: Callable[[], Column]) -> Column:
        if name in self.ready:
            return F.col(f"_{name}")
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    text = property(lambda self: F.col("_text"))
    title = property(lambda self: F.col("_title"))
    raw_title = property(lambda self: F.col("_raw_title"))
    context = property(lambda self: F.col("_context"))
    role = property(lambda self: F.coalesce(F.col("feed_role"), F.lit("")))

    def n(self, name: str) -> Column:
        return self._once(f"n {name}", lambda: count_terms(self.text, self.vocabulary[name]))

    def nt(self, name: str) -> Column:
        return self._once(f"nt {name}", lambda: count_terms(self.title, self.vocabulary[name]))

    def has(self, name: str) -> Column:
        return self._once(f"has {name}", lambda: contains_any(self.text, self.vocabulary[name]))

    def has_t(self, name: str) -> Column:
        return self._once(f"has_t {name}", lambda: contains_any(self.title, self.vocabulary[name]))

    def tech(self) -> Column:
        return self.role.isin(*TECH_ROLES)

    # -- signals

    def deal(self) -> Column:
        return self._once("deal", self._make_deal)

    def _make_deal(self) -> Column:
        return self.has_t("global_tech_deal") & (self.has_t("global_tech_deal_market") | billion_amount(self.raw_title))

    def concrete_event(self) -> Column:
        return self._once("concrete_event", self._make_concrete_event)

    def _make_concrete_event(self) -> Column:
        action = self.raw_title.rlike(_ACTION)
        backed = self.has_t("event_capital") | self.has_t("global_tech_backing")
        return self.deal() | (money_amount(self.raw_title) & (backed | action)) | (action & backed) | self.has_t("event_concrete")

    def discussion(self) -> Column:
        return self._once("discussion", self._make_discussion)

    def _make_discussion(self) -> Column:
        padded = F.concat(F.lit(" "), self.title, F.lit(" "))
        around = F.lower(F.concat_ws(" ", padded, *[F.coalesce(F.col(c), F.lit("")) for c in ("link", "source", "feed_name")]))
        return contains_any(around, self.vocabulary["discussion_format"]) | contains_any(padded, self.vocabulary["discussion_title"])

    def global_tech(self) -> Column:
        return self._once("global_tech", self._make_global_tech)

    def _make_global_tech(self) -> Column:
        """The first rule that applies decides."""
        hard = ("global_tech_capital", "global_tech_payment", "global_tech_regulatory", "global_tech_enterprise", "global_tech_platform", "global_tech_business_impact")
        any_of = lambda f, names: F.greatest(*[f(x) for x in names])
        concrete = self.concrete_event()
        return (
            F.when(concrete, True)
            .when(self.discussion() | ~self.has("global_tech_domain"), False)
            .when(self.has_t("ai_tech_discussion") & ~any_of(self.has_t, (*hard, "global_tech_deal", "global_tech_deal_market")), False)
            .when(self.has("ai_tech_discussion") & ~any_of(self.has, hard), False)
            .otherwise(
                (self.has("global_tech_payment") & self.has("global_tech_action"))
                | self.has("global_tech_capital")
                | self.has("global_tech_regulatory")
                | (self.n("global_tech_enterprise") >= 2)
                | (self.has("global_tech_platform") & self.has("platform_commercial"))
                | (self.has("global_tech_shutdown") & self.has("global_tech_business_impact"))
            )
        )

    def market(self) -> Column:
        return self._once("market", self._make_market)

    def _make_market(self) -> Column:
        strong = self.has("market_strong")
        return (
            F.when((self.has("local_promo") | self.has("policy_background")) & ~strong, False)
            .when(self.has("market_event_noise") & ~self.has("market_hard"), False)
            .when(self.tech(), self.global_tech())
            .when((self.role == "tech_industry") | strong, strong)
            .when(self.has("ai_tech_context") | self.has("market_generic"), False)
            .when(self.has("industry") & ~self.has("market_hard"), False)
            .otherwise(self.has("market_signal"))
        )

    def watch(self) -> Column:
        return self._once("watch", self._make_watch)

    def _make_watch(self) -> Column:
        when = self.has("watch")
        for pattern in self.vocabulary["watch_time"]:
            when = when | self.text.rlike(pattern)
        return ~self.has("policy_background") & ~(self.has("watch_past_activity") & ~self.has("watch_strong_future")) & when & self.has("watch_variable") & ~(self.has("product_or_consumer") & ~self.has("market_signal"))

    def core(self) -> Column:
        return self._once("core", self._make_core)

    def _make_core(self) -> Column:
        negative = contains_any(self.text, self.config.core_event_negative_patterns) & ~self.has("core_negative_overrides")
        low = self.has("core_low_importance") & ~self.has("core_low_importance_overrides")
        return ~negative & ~low & ~(self.tech() & ~self.global_tech()) & self.has("core_event")

    def industry(self) -> Column:
        return self._once("industry", self._make_industry)

    def _make_industry(self) -> Column:
        return self.has("policy") | self.has("industry") | self.has("global_tech_business")

    def low_value(self) -> Column:
        return contains_any(self.context, self.config.low_value_patterns)

    def quick_scan_low_value(self) -> Column:
        return contains_any(self.context, self.config.quick_scan_low_value_patterns)

    def can_enter(self) -> Column:
        return self._once("can_enter", self._make_can_enter)

    def _make_can_enter(self) -> Column:
        special = self.role.isin("tech_industry", *TECH_ROLES)
        return ~self.low_value() & ~self.role.isin(*self.config.digest_exclude_roles) & (~special | self.industry() | self.market())

    def section(self) -> Column:
        """watch, market, core or null: the first that the role allows and a signal supports."""
        roles = [*self.config.market_signal_roles, *(["tech_industry"] if self.config.allow_tech_industry_in_market else [])]
        return F.when(
            self.can_enter(),
            F.when(self.role.isin(*self.config.watch_item_roles) & self.watch(), "watch").when(self.role.isin(*roles) & self.market(), "market").when(self.role.isin(*self.config.core_event_roles) & self.core(), "core"),
        )

    def can_quick_scan(self) -> Column:
        """What doesn't depend on the items chosen before."""
        c = self.config
        return self.role.isin(*c.quick_scan_roles) & ~self.role.isin(*c.digest_exclude_roles, *c.quick_scan_exclude_roles) & ~self.low_value() & ~self.quick_scan_low_value()

    # -- ranking and keys

    def importance(self) -> Column:
        weights = {"market_strong": 4, "market_price": 3, "capital_market": 4}
        tech = {"payment": 5, "capital": 4, "backing": 4, "deal": 4, "deal_market": 4, "regulatory": 4, "enterprise": 3, "platform": 3}
        score = 2 * F.coalesce(F.size(F.map_keys("matched_keywords")), F.lit(0)) + self.n("market_signal") + self.n("watch")
        for name, weight in weights.items():
            score = score + weight * self.nt(name)
        more = 4 * billion_amount(self.raw_title).cast("int") - 8 * (self.has_t("ai_tech_discussion") & ~self.global_tech()).cast("int")
        for name, weight in tech.items():
            more = more + weight * self.nt(f"global_tech_{name}")
        return (score + F.when(self.tech(), more).otherwise(0)).cast("int")

    def deal_key(self) -> Column:
        """deal:amount:three entities in order, or the whole normalised title; "" for what is no deal."""
        normal = tx.normalized_title(self.raw_title)
        amount = F.regexp_extract(normal, rf"\b{tx.NUMBER}b\b", 0)
        names = F.filter(_entities(self.raw_title), lambda e: ~e.isin("AI", "IPO", "GPT", "LLM"))
        own = F.array_distinct(F.transform(names, F.lower))
        return F.when(self.deal(), F.concat(F.lit("deal:"), F.when((amount != "") & (F.size(own) >= 2), F.concat_ws(":", amount, F.array_join(F.array_sort(F.slice(own, 1, 3)), ":"))).otherwise(normal))).otherwise("")

    def discussion_key(self) -> Column:
        names = F.filter(_entities(self.raw_title), lambda e: ~F.upper(e).isin(*"AI ROI IPO IPOS LLM CEO".split()))
        own = F.array_distinct(F.transform(names, F.lower))
        topic = F.lower(first_term(matched_terms(self.title, self.vocabulary["discussion_topic"])))
        return F.when(self.discussion() & (F.size(own) >= 2) & topic.isNotNull(), F.concat(F.lit("discussion:"), F.array_join(F.slice(own, 1, 3), ":"), F.lit(":"), topic)).otherwise("")

    # -- explanations

    def _first(self, name: str, column: Column | None = None) -> Column:
        return first_term(matched_terms(self.text if column is None else column, self.vocabulary[name]))

    def quick_scan_type(self) -> Column:
        own = F.when(self.role == "ai_industry", "AI 产业").when(self.role == "global_tech_business", "全球科技商业").when(self.role == "tech_industry", "科技产业")
        own = own.when(self.role == "market", F.when(self.has("market_signal") | self.has("market_generic"), "市场边缘信号").otherwise("公司动态"))
        return own.when(self.has("quick_policy"), "政策背景").when(self.has("quick_world"), "国际观察").when(self.has("quick_company"), "公司动态").when(self.role == "breaking_news", "综合新闻").otherwise("其他观察")

    def rule_reason(self) -> Column:
        say = lambda term, rest: F.concat(F.lit("涉及"), term, F.lit(rest))
        policy, domain, core, industry = (self._first(n) for n in ("policy", "global_tech_domain", "core_event", "industry"))
        return (
            F.when(policy.isNotNull(), say(policy, "相关信息，适合作为今日宏观和产业背景观察。"))
            .when(domain.isNotNull() & self.global_tech(), say(domain, "相关全球科技商业进展，可能影响 AI 商业化或基础设施生态。"))
            .when(core.isNotNull(), say(core, "，属于需要优先关注的高影响事件。"))
            .when(industry.isNotNull(), say(industry, "方向，可能影响相关产业关注度。"))
            .otherwise("作为背景信息观察，暂不强行外推为市场影响。")
        )

    def market_impact(self) -> Column:
        """The first of its lines that applies: (vocabulary, in the title alone, what is said, condition)."""
        capital, company, chips = "，可作为营收、利润率、估值或资本市场信号观察。", "，可作为资本市场或公司估值信号观察。", "，可作为企业客户、云、芯片或算力订单信号观察。"
        mood, rules, platform = "，可观察其对市场交易情绪的影响。", "，可作为监管、合规或反垄断风险信号观察。", "，可作为平台集成、分发渠道或商业发布信号观察。"
        everything = F.lit(True)
        lines = [
            ("global_tech_backing", True, "，可作为估值、融资或战略背书信号观察。", everything),
            ("market_price", True, mood, everything),
            ("global_tech_capital", True, capital, everything),
            ("capital_market", True, company, everything),
            ("global_tech_payment", True, "，可作为 AI 支付、agent commerce 或支付基础设施信号观察。", self.global_tech()),
            ("global_tech_regulatory", True, rules, everything),
            ("global_tech_enterprise", True, chips, everything),
            ("global_tech_platform", True, platform, everything),
            ("market_price", False, mood, everything),
            ("global_tech_capital", False, capital, everything),
            ("capital_market", False, company, everything),
            ("global_tech_payment", False, "，可作为支付基础设施或 commerce 生态信号观察。", self.global_tech()),
            ("global_tech_regulatory", False, rules, everything),
            ("global_tech_enterprise", False, chips, everything),
            ("global_tech_platform", False, platform, everything),
            ("policy", False, "，可能影响政策预期和相关板块关注度。", everything),
            ("global_tech_domain", False, "，可作为 AI 商业化、支付基础设施或平台生态信号观察。", self.global_tech()),
        ]
        rate = self._first("overseas_rate")
        parts = F.filter(
            F.array(self._first("global_tech_deal", self.title), self._first("global_tech_deal_market", self.title), F.when(billion_amount(self.raw_title), "billion-scale amount")), lambda x: x.isNotNull()
        )
        out = F.when(rate.isNotNull(), F.concat(F.lit("涉及"), rate, F.lit("，可能影响风险偏好、汇率利率预期或 A 股情绪。")))
        out = out.when(self.deal(), F.concat(F.lit("涉及"), F.array_join(parts, " / "), F.lit("，可作为并购、交易规模、IPO 或估值信号观察。")))
        for name, in_title, rest, condition in lines:
            term = self._first(name, self.title if in_title else self.text)
            out = out.when(term.isNotNull() & condition, F.concat(F.lit("涉及"), term, F.lit(rest)))
        return out.when(self.has("industry"), "作为产业动态观察，短期市场影响可能有限。").otherwise("作为市场边缘信号观察。")

    def watch_impact(self) -> Column:
        term = self._first("watch")
        prefix = F.when(term.isNotNull(), F.concat(term, F.lit("相关进展"))).otherwise("后续进展")
        say = lambda rest: F.concat(F.lit("需观察"), prefix, F.lit(rest))
        return (
            F.when(self.has("overseas_rate"), say("是否影响风险偏好、汇率利率预期或 A 股情绪。"))
            .when(self.has("policy"), say("是否改变政策预期和相关板块关注度。"))
            .when(self.has("ai_impact"), say("是否带动 AI 产业关注度。"))
            .when(self.has("industry"), "作为产业动态观察，短期市场影响可能有限。")
            .otherwise("作为背景信息观察。")
        )


def _entities(title: Column) -> Column:
    return F.regexp_extract_all(title, F.lit(r"(?U)\b[A-Z][A-Za-z0-9.]{1,}\b"), F.lit(0))


#: Signals in the order in which they build on one another.
_STAGES = (("deal", "discussion"), ("concrete_event",), ("global_tech",), ("market", "watch", "core", "industry"), ("can_enter",))


def with_signals(items: DataFrame, vocabulary: Vocabulary, config: ReportConfig = ReportConfig()) -> tuple[DataFrame, Item]:
    """A frame of with_match_texts with its signals as columns, each computed once, and the item that reads them."""
    own = Item(vocabulary, config)
    for stage in _STAGES:
        items = items.withColumns({f"_{name}": getattr(own, name)() for name in stage})
        own = replace(own, ready=own.ready | set(stage), _made={k: v for k, v in own._made.items() if k not in stage})
    return items, own


def scored(items: DataFrame, vocabulary: Vocabulary | None = None, config: ReportConfig = ReportConfig(), entities: bool = True) -> DataFrame:
    """items with section, importance, title_length, quick_scannable and the keys of duplicate events: each computed once for all that follows."""
    frame, own = with_signals(with_match_texts(items, entities), vocabulary or default_vocabulary(), config)
    frame = frame.withColumn("_normal", tx.normalized_title(F.col("title")))
    columns = {
        "section": own.section(),
        "importance": own.importance(),
        "title_length": F.length("_normal"),
        "quick_scannable": own.can_quick_scan(),
        "deal_key": own.deal_key(),
        "discussion_key": own.discussion_key(),
        "title_key": F.replace(F.col("_normal"), F.lit(" "), F.lit("")),
        "source_key": tx.source_key(F.col("source"), F.col("feed_name")),
    }
    return frame.select(*items.columns, *[c.alias(n) for n, c in columns.items()])


__all__ = ["Item", "distinct_terms", "scored", "with_match_texts", "without_match_texts"]
