"""Headlines with the default vocabulary, and the folds that no window can say."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from presswork.config import ReportConfig
from presswork.functions import news as fn
from presswork.functions.digest import Item, scored, with_match_texts
from presswork.functions.vocab import default_vocabulary
from presswork.operators import digest, news, select, stories

SCHEMA = "ord long, title string, summary string, source string, feed_name string, feed_role string, link string, published_at timestamp, published string, matched_keywords map<string,array<string>>"


def items(spark, rows):
    """(title, role[, source[, summary]])"""
    full = [(i, r[0], r[3] if len(r) > 3 else "", r[2] if len(r) > 2 else f"s{i}", r[2] if len(r) > 2 else f"s{i}", r[1], f"https://x.example/{i}", datetime(2024, 1, 1, 0, i % 60), "", {}) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


CONFIG = ReportConfig(report_type="digest", max_quick_scan_items=20)
HEADLINES = [
    ("美联储今晚公布利率决议", "market", "watch"),
    ("某某大作口碑逆袭 | 游戏风向标", "general", None),
    ("我国成功发射一颗遥感卫星", "breaking_news", "core"),
    ("Visa adds checkout payments to a shopping agent", "ai_industry", "market"),
    ("AI benchmark debate raises questions about small model performance", "ai_industry", None),
    ("GitHub Trending: a useful tool", "ai_tools", None),
    ("一名游客遭抢劫受伤", "breaking_news", None),
]


def test_sections_of_headlines(spark):
    got = {r["ord"]: r["section"] for r in scored(items(spark, [(t, r) for t, r, _ in HEADLINES]), config=CONFIG).collect()}
    assert [got[i] for i in range(len(HEADLINES))] == [s for _, _, s in HEADLINES]


def test_one_deal_is_told_once(spark):
    rows = [("Acme to acquire Cursor for $60B in stock, days after IPO", "ai_industry"), ("Acme to acquire the coding startup Cursor for $60 billion", "global_tech_business"), ("中国人民银行宣布将出台六项政策措施", "market")]
    shown = {r["ord"]: (r["section"], r["rank"]) for r in digest.sections(items(spark, rows), CONFIG).collect()}
    assert len({0, 1} & set(shown)) == 1
    keys = [r["deal_key"] for r in scored(items(spark, rows), config=CONFIG).orderBy("ord").collect()]
    assert keys[0] == keys[1] != "" and keys[2] == ""


def test_source_cap_and_quick_scan(spark):
    rows = [(f"公司{n}股价大涨超百分之{n}，市值创新高{n * 37}", "market", "one") for n in range(6)] + [("商务部介绍对外合作进展", "breaking_news", "two")]
    shown = digest.sections(items(spark, rows), CONFIG).collect()
    assert sum(r["section"] == "market" and r["source"] == "one" for r in shown) == 3
    assert sum(r["section"] == "quick_scan" and r["source"] == "one" for r in shown) <= 3
    assert digest.theme_line(digest.sections(items(spark, rows), CONFIG))


def test_explanations(spark):
    a = with_match_texts(items(spark, [("央行宣布降准，人民币汇率走强", "market"), ("Acme raises $2 billion at a new valuation", "global_tech_business")]))
    i = Item(default_vocabulary(), CONFIG)
    got = a.select(i.rule_reason().alias("r"), i.market_impact().alias("m"), i.watch_impact().alias("w"), i.quick_scan_type().alias("q")).collect()
    assert all(r["r"] and r["m"] and r["w"] for r in got) and got[1]["q"] == "全球科技商业"


def test_same_event_needs_cjk_and_numbers():
    row = lambda t: {"deal_key": "", "discussion_key": "", "title_key": t}
    assert digest.same_event(row("中国人民银行宣布出台六项政策措施"), row("中国人民银行宣布将出台六项政策措施"))
    assert not digest.same_event(row("中国人民银行宣布出台6项政策措施"), row("中国人民银行宣布出台7项政策措施"))
    assert not digest.same_event(row("abcdefghijklmnop"), row("abcdefghijklmnoq")) and not digest.same_event(row("短标题"), row("短标题"))


def brute_sections(rows, config):
    """Straight over sorted rows, for the folds."""
    picked = []
    for kind, cap, per in (("core", config.max_core_events, None), ("market", config.max_market_signals, config.max_market_signals_per_source), ("watch", config.max_watch_items, None)):
        own, counts = [], {}
        for r in rows:
            if r["section"] != kind or len(own) >= cap or any(digest.same_event(r, o) for o in picked + own):
                continue
            if per is not None and counts.get(r["source_key"], 0) >= per:
                continue
            counts[r["source_key"]] = counts.get(r["source_key"], 0) + 1
            own.append(r)
        picked += own
    used, own, counts = {r["link"] for r in picked}, [], {}
    for r in rows:
        if len(own) >= config.max_quick_scan_items or not r["quick_scannable"] or r["link"] in used or any(digest.same_event(r, o) for o in picked + own) or counts.get(r["source_key"], 0) >= config.max_quick_scan_items_per_source:
            continue
        counts[r["source_key"]] = counts.get(r["source_key"], 0) + 1
        own.append(r)
    return [r["ord"] for r in picked + own]


def test_folds_match_a_plain_loop(spark):
    rng = random.Random(1)
    parts = ["美联储公布利率决议", "股价大涨", "地震造成伤亡", "政策措施落地", "芯片订单", "上市公司业绩", "将于明日召开会议", "人民币汇率", "发射卫星"]
    rows = [("，".join(rng.sample(parts, 2)) + rng.choice(["", "12", "7"]), rng.choice(["market", "breaking_news", "general"]), f"s{rng.randint(0, 3)}") for _ in range(80)]
    a = items(spark, rows)
    flat = [r.asDict() for r in scored(a, config=CONFIG).orderBy(*digest.order()).collect()]
    got = {r["ord"] for r in digest.sections(a, CONFIG).collect()}
    assert got == set(brute_sections(flat, CONFIG)) and len(got) > 8


def test_dedupe_and_cap_in_one_pass(spark):
    df = spark.createDataFrame([("A", "x", 0, 0), ("A", "y", 0, 1), ("B", "y", 1, 0)], "feed string, link string, f int, e int")
    got = select.dedupe_and_cap(df, "link", "feed", [F.col("f"), F.col("e")], 1).collect()
    assert [(r["feed"], r["link"]) for r in got] == [("A", "x"), ("B", "y")]


def test_two_caps_do_not_use_each_other_up(spark):
    df = spark.createDataFrame([(9, "A", "X", "1"), (8, "A", "X", "2"), (7, "A", "F", "3"), (6, "B", "F", "4"), (5, "C", "F", "5")], "score int, source string, kind string, id string")
    got = select.two_caps(df, ["id"], "source", "kind", "F", [F.col("score").desc()], 2, 2, 10).orderBy(F.col("score").desc()).collect()
    assert [r["id"] for r in got] == ["1", "2", "4", "5"]


def test_two_caps_match_a_plain_loop(spark):
    rng = random.Random(2)
    for _ in range(5):
        rows = [(i, rng.randint(0, 20), rng.choice("ABCD"), rng.choice("FFX"), str(rng.randint(0, 25))) for i in range(60)]
        want, groups, kinds, seen = [], {}, 0, set()
        for r in sorted(rows, key=lambda r: (-r[1], r[0])):
            if r[4] in seen:
                continue
            seen.add(r[4])
            if groups.get(r[2], 0) >= 2 or r[3] == "F" and kinds >= 3:
                continue
            groups[r[2]] = groups.get(r[2], 0) + 1
            kinds += r[3] == "F"
            want.append(r[0])
            if len(want) == 6:
                break
        df = spark.createDataFrame(rows, "i int, score int, source string, kind string, id string")
        got = select.two_caps(df, ["id"], "source", "kind", "F", [F.col("score").desc(), F.col("i")], 2, 3, 6)
        assert sorted(r["i"] for r in got.collect()) == sorted(want)


NEWS = [
    ("领投方共同参与，「某科技」完成超亿元A轮融资", fn.FINANCING),
    ("国泰海通预计上半年归母净利润超200亿元", fn.OPERATING),
    ("文旅部：上半年涉及强迫购物立案数同比增长", fn.POLICY),
    ("中国证监会发布再融资规则征求意见稿", fn.POLICY),
    ("今日早报：多条财经要闻", None),
]


def test_news_types(spark):
    got = {r["ord"]: r for r in fn.score_articles(items(spark, [(t, "market") for t, _ in NEWS])).collect()}
    for i, (_, kind) in enumerate(NEWS):
        assert kind is None or got[i]["news_type"] == kind, (NEWS[i], got[i])
    assert all(r["score"] >= 0 for r in got.values())


def test_policy_events_become_one(spark):
    rows = [(1, "中国证监会就再融资征求意见", "a", "l1", "r1", 90, fn.POLICY), (2, "证监会定增规则解读", "b", "l2", "r2", 95, fn.POLICY), (3, "另一件事", "c", "l3", "r3", 80, fn.POLICY)]
    df = spark.createDataFrame(rows, "ord long, title string, source string, link string, reason string, score int, news_type string")
    got = {r["ord"]: r for r in news.consolidate_policies(df).collect()}
    assert set(got) == {2, 3} and got[2]["score"] == 115 and got[2]["reason"] == "r2 同主题政策线索：中国证监会就再融资征求意见。" and got[2]["title"].startswith("证监会完善")


def test_analysis_with_holdings(spark):
    rows = [("国泰海通预计上半年归母净利润超200亿元", "market"), ("中国证监会发布再融资规则征求意见稿", "market"), ("某公司获特高压订单并扩产", "market", "s", "电网设备订单落地"), ("领投方参与，某科技完成超亿元A轮融资", "market")]
    holdings = spark.createDataFrame([(0, "601211", "国泰海通", "sh", "证券", ["券商"], ""), (1, "000001", "无关", "sz", "没有", [], "")], "ord long, code string, name string, market string, sector string, watch_tags array<string>, notes string")
    got = news.analyze(items(spark, rows), holdings).collect()
    by = {}
    for r in got:
        by.setdefault(r["section"], []).append(r)
    assert by["market_events"] and by["environment_points"][0]["title"].startswith("RSS 候选新闻 4 条")
    assert {r["holding_title"] for r in by["holding_related_news"]} == {"601211 国泰海通"} and by["holding_related_news"][0]["holding_relation"] == fn.CLEAR


def test_stories():
    s = lambda t, link="": {"title": t, "link": link}
    assert stories.same_story(s("x", "l"), s("y", "l")) and stories.same_story(s("Big News!"), s("big news")) and stories.same_story(s("abcde"), s("xxabcdexx"))
    assert not stories.same_story(s("abc"), s("abcd")) and not stories.same_story(s(""), s(""))
    assert stories.watch_points(["a", " a ", None, "", "told story x", "b", "c", "d"], ["Told Story"]) == ["a", "b", "c"]


def test_unique_stories(spark):
    df = spark.createDataFrame([(0, "first tale here", "1"), (1, "First tale, here!", "2"), (2, "second", "3"), (3, "third", "4")], "ord int, title string, link string")
    got = stories.unique_stories(df, [F.col("ord")], [{"title": "second", "link": ""}], 2).collect()
    assert [r["ord"] for r in got] == [0, 3]
