"""The queries that SQL can't say, against plain Python loops over the rows that they read."""

import difflib
import re

from pyspark.sql import functions as F

from presswork import catalogue
from presswork.functions import news as fn
from presswork.functions.digest import scored
from presswork.operators import news

from .conftest import SF


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def in_order(rows):
    rows = sorted(rows, key=lambda r: r["ord"])
    rows = sorted(rows, key=lambda r: (r["published_at"] is not None, r["published_at"] or 0), reverse=True)
    return sorted(rows, key=lambda r: (r["importance"], r["title_length"]), reverse=True)


def told_before(new, old):
    if any(new[k] and new[k] == old[k] for k in ("deal_key", "discussion_key")):
        return True
    a, b = new["title_key"], old["title_key"]
    if len(a) < 12 or len(b) < 12 or not re.search("[一-鿿]", a + b):
        return False
    return re.findall(r"\d+(?:\.\d+)?", a) == re.findall(r"\d+(?:\.\d+)?", b) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.78


def test_digest_sections(spark):
    config = catalogue.CONFIG
    frame = scored(catalogue.gated(spark, SF), catalogue.VOCABULARY, config)
    rows = in_order(rows_of(frame.select("ord", "section", "importance", "title_length", "published_at", "deal_key", "discussion_key", "title_key", "source_key", "link", "quick_scannable")))
    shown = []
    for kind, cap, per in (("core", config.max_core_events, 10**9), ("market", config.max_market_signals, config.max_market_signals_per_source), ("watch", config.max_watch_items, 10**9), ("quick_scan", config.max_quick_scan_items, config.max_quick_scan_items_per_source)):
        before = [r for _, _, r in shown]
        own = []
        for r in rows:
            if len(own) == cap:
                break
            if not (r["quick_scannable"] if kind == "quick_scan" else r["section"] == kind):
                continue
            if kind == "quick_scan" and r["link"] in {x["link"] for x in before}:
                continue
            if any(told_before(r, x) for x in before + own) or sum(x["source_key"] == r["source_key"] for x in own) >= per:
                continue
            own.append(r)
        shown += [(kind, i, r) for i, r in enumerate(own, 1)]
    got = {(r["section"], r["rank"], r["ord"]) for r in rows_of(catalogue.queries()["q_digest_sections"](spark, SF))}
    assert got == {(kind, i, r["ord"]) for kind, i, r in shown} and len(got) > 10


def expanded(links):
    """All pairs of rows: copies have their class in a row of ratio 1, which no other pair has."""
    members, pairs = {}, {}
    for r in links:
        if r["ratio"] == 1:
            members.setdefault(r["other"], {r["other"]}).add(r["ord"])
    for own in members.values():
        pairs |= {(i, j): 1.0 for i in own for j in own if i > j}
    for r in links:
        if r["ratio"] < 1:
            pairs |= {(i, j): r["ratio"] for i in members.get(r["ord"], {r["ord"]}) for j in members.get(r["other"], {r["other"]}) if i > j}
    return pairs


def test_fuzzy_pairs(spark):
    docs = rows_of(catalogue.table(spark, SF, "documents").select("doc_id", "text", "source"))
    keys = [(d["doc_id"], d["source"], re.sub("[^0-9a-z一-鿿]+", "", d["text"].split("\n")[0][:80].lower())) for d in docs]
    want = {}
    for i, s, k in keys:
        for j, t, m in keys:
            if j < i and s == t and len(k) >= 10 and len(m) >= 10 and k[:2] == m[:2] and (ratio := difflib.SequenceMatcher(None, k, m).ratio()) >= 0.88:
                want[i, j] = ratio
    assert expanded(rows_of(catalogue.queries()["q_fuzzy_pairs"](spark, SF))) == want


def policy_of(r):
    text = f"{r['title']} {r['reason']}"
    if r["news_type"] != fn.POLICY:
        return None
    if "证监会" in text and any(t in text for t in ("再融资", "定增", "储架发行", "征求意见")):
        return "csrc"
    return next((t for t in ("减持", "退市", "并购重组", "问询", "处罚", "监管函") if t in text), None)


def test_market_news(spark):
    articles = catalogue.articles(spark, SF)
    rows = rows_of(news.insights(articles, catalogue.VOCABULARY).select("ord", "title", "source", "link", "reason", "score", "news_type"))
    groups = {}
    for r in sorted((r for r in rows if r["news_type"] in (fn.MACRO, fn.POLICY, fn.FINANCING, fn.OPERATING)), key=lambda r: (-r["score"], r["ord"])):
        groups.setdefault(policy_of(r) or ("#", r["ord"]), []).append(r)
    events = [g[0] | {"top": g[0]["score"], "score": g[0]["score"] + 20 * (len(g) - 1)} for g in groups.values()]
    picked, seen = [], set()
    for e in sorted(events, key=lambda e: (-e["score"], -e["top"], e["ord"])):
        if (e["link"], e["title"]) in seen:
            continue
        seen.add((e["link"], e["title"]))
        if len(picked) < 5 and sum(p["source"] == e["source"] for p in picked) < 2 and not (e["news_type"] == fn.FINANCING and sum(p["news_type"] == fn.FINANCING for p in picked) >= 2):
            picked.append(e)

    def best(kept):
        own, met = [], set()
        for r in sorted(kept, key=lambda r: (-r["score"], r["ord"])):
            if (r["link"], r["title"]) not in met:
                met.add((r["link"], r["title"]))
                own.append(r)
        return own[:5]

    catalysts = best([r for r in rows if r["news_type"] == fn.CATALYST and r["score"] >= 55])
    got = {}
    for r in sorted(rows_of(catalogue.queries()["q_market_news"](spark, SF)), key=lambda r: r["rank"]):
        got.setdefault(r["section"], []).append(r)
    assert [(r["title"], r["score"], r["source"]) for r in got["market_events"]] == [(e["title"], e["score"], e["source"]) for e in picked] and picked
    assert [(r["title"], r["score"]) for r in got["industry_catalysts"]] == [(r["title"], r["score"]) for r in catalysts]
    questions = [r["title"] for r in (*picked, *catalysts)][:5]
    assert [r["title"].split("：后续是否")[0] for r in got["deep_dive_questions"]] == questions
    assert got["environment_points"][0]["title"].startswith(f"RSS 候选新闻 {articles.select(F.count('*')).first()[0]} 条")
    assert len(got["holding_related_news"]) > 0 and all(r["holding_relation"] for r in got["holding_related_news"])
