import random

from pyspark.sql import functions as F

from presswork.llm import warc_index as wi


def test_loser_tree_merges_like_sorting():
    rng = random.Random(1)
    for _ in range(300):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        pieces = wi.merge_order(runs)
        merged = [(runs[r][i], r, i) for r, a, b in pieces for i in range(a, b)]
        assert merged == sorted((k, r, i) for r, keys in enumerate(runs) for i, k in enumerate(keys))


def test_url_keys(spark):
    urls = ["HTTP://WWW2.Ex.com:80/A/?b=C#f", "https://u@m.ex.com//", "nohost", None, ""]
    got = [r["k"] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(wi.url_key(F.col("u")).alias("k")).collect()]
    assert got == ["com,ex)/a/?b=c", "com,ex,m)", "", "", ""]


def brute(rows):
    key = lambda r: (r["urlkey"].encode(), *[(v is not None, v) for v in (r["captured"], r["page_id"])], (r["url"] is not None, r["url"] or ""), (r["digest"] is not None, r["digest"] or ""))
    out, last, n = [], None, 0
    for i, r in enumerate(sorted(rows, key=key), 1):
        n = n + 1 if last is not None and last["urlkey"] == r["urlkey"] else 1
        before = last["captured"] if n > 1 else None
        out.append((i, r["urlkey"], r["captured"], r["page_id"], n, None if before is None or r["captured"] is None else r["captured"] - before, n == 1 or last["digest"] != r["digest"]))
        last = r
    return out


def test_history(spark, monkeypatch):
    monkeypatch.setattr(wi, "RUN_ROWS", 40)
    monkeypatch.setattr(wi, "RANGE_ROWS", 50)
    rng = random.Random(2)
    rows = [(rng.choice([i, i, None]), rng.choice([f"http://h{rng.randint(0, 9)}.example/p{rng.randint(0, 5)}?x", f"http://é{i}.example/", None, "", "bad"]), rng.choice(["<a>", "<b>", None]), rng.choice([rng.randint(0, 20), None]), "clash") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, t long, urlkey string").repartition(5)
    want = brute([r.asDict() for r in wi.captures(df, F.col("t")).collect()])
    got = sorted((r["position"], r["urlkey"], r["captured"], r["page_id"], r["capture_no"], r["since_previous"], r["changed"]) for r in wi.history(df, F.col("t")).collect())
    assert got == want
    assert wi.history(df.limit(0), F.col("t")).count() == 0


def test_a_hot_key_is_cut_by_time(spark, monkeypatch):
    monkeypatch.setattr(wi, "RUN_ROWS", 60)
    monkeypatch.setattr(wi, "RANGE_ROWS", 50)
    monkeypatch.setattr(wi, "BLOCK_ROWS", 7)
    monkeypatch.setattr(wi, "OUT_ROWS", 20)
    rng = random.Random(4)
    rows = [(rng.randint(0, 90), "http://hot.example/" if rng.random() < 0.9 else f"http://h{rng.randint(0, 5)}.example/", rng.choice(["<a>", "<b>", None]), rng.choice([rng.randint(0, 60), None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, t long").repartition(4)
    want = brute([r.asDict() for r in wi.captures(df, F.col("t")).collect()])
    got = sorted((r["position"], r["urlkey"], r["captured"], r["page_id"], r["capture_no"], r["since_previous"], r["changed"]) for r in wi.history(df, F.col("t")).collect())
    assert got == want


def test_borders():
    keys = [(b"a", 0, 0)] * 3 + [(b"h", i, 0) for i in range(20)] + [(b"z", 0, 0)]
    borders, hot = wi.borders_of(keys, 6)
    assert hot == {b"h"} and len(borders) == 5 and borders == sorted(borders)
    assert wi.borders_of([], 4) == ([], set()) and wi.borders_of(keys, 1) == ([], set())
