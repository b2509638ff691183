"""Selections that read heads, split feeds or use an automaton give what the plain forms give."""

import random

from pyspark.sql import functions as F

from presswork.functions import vocab
from presswork.operators import digest, news, select


def test_feeds_that_share_nothing_are_windows(spark):
    rng = random.Random(1)
    rows = [(f, e, f"k{rng.randint(0, 30)}" if f % 3 else (f"own{f}-{rng.randint(0, 9)}" if rng.random() < 0.9 else None)) for f in range(12) for e in range(20)]
    df = spark.createDataFrame(rows, "feed int, entry int, key string")
    seen, want, counts = set(), [], {}
    for f, e, k in rows:
        if k not in seen and counts.get(f, 0) < 4:
            seen.add(k)
            counts[f] = counts.get(f, 0) + 1
            want.append((f, e, k))
    got = select.dedupe_and_cap(df, "key", "feed", [F.col("feed"), F.col("entry")], 4).collect()
    assert sorted((r["feed"], r["entry"]) for r in got) == sorted((f, e) for f, e, _ in want)


def test_an_automaton_finds_what_an_expression_finds(spark, monkeypatch):
    rng = random.Random(2)
    terms = ["".join(rng.choice("abé漢") for _ in range(rng.randint(1, 4))) for _ in range(60)] + [""]
    texts = ["".join(rng.choice("abé漢 ") for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {i: {x for x in terms if x and t and x in t} for i, t in enumerate(texts)}
    for few in (200, 3):
        monkeypatch.setattr(vocab, "FEW_TERMS", few)
        got = {r["i"]: r["c"] for r in df.select("i", vocab.contained(F.col("t"), terms).alias("c")).collect()}
        assert {i: set(c) for i, c in got.items()} == want and all(len(c) == len(set(c)) for c in got.values())
    assert all(r["c"] == [] for r in df.select(vocab.contained(F.col("t"), []).alias("c")).collect())


def test_holdings_of_one_term(spark):
    found = spark.createDataFrame([(i, f"Title {i}", "s", f"l{i}", "r", 80, "x", t) for i, t in enumerate(["Acme rises", "nothing", "ACME and Sector"])], "ord long, title string, source string, link string, reason string, score int, news_type string, news_text string")
    holdings = spark.createDataFrame([(j, f"c{j}", "acme", "sector", []) for j in range(3)], "ord long, code string, name string, sector string, watch_tags array<string>")
    got = sorted((r["holding_ord"], r["ord"]) for r in news.holding_matches(found, holdings, 5).collect())
    assert got == [(j, i) for j in range(3) for i in (0, 2)]


def test_heads_grow_until_a_section_is_full(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        source = "hot" if i < 550 else f"s{i}"
        rows.append((i, rng.choice(["core", "market", "watch"]), 1000 - i, 5, None, "", "", f"t{i}", source, f"l{i}", True))
    schema = "ord long, section string, importance int, title_length int, published_at timestamp, deal_key string, discussion_key string, title_key string, source_key string, link string, quick_scannable boolean"
    narrow = spark.createDataFrame(rows, schema)
    want = []
    per = {}
    for r in sorted((r for r in rows if r[1] == "market"), key=lambda r: -r[2]):
        if per.get(r[8], 0) < 2 and len(want) < 6:
            per[r[8]] = per.get(r[8], 0) + 1
            want.append(r[0])
    for most in (digest.MOST, 32):  # by heads, and by the fold beyond them
        monkeypatch.setattr(digest, "FIRST", 1)
        monkeypatch.setattr(digest, "MOST", most)
        heads = digest._Heads(narrow, {"market": 6})
        assert [p["ord"] for p in heads.pick("market", 6, digest._pick("market", 6, 2, []))] == want
