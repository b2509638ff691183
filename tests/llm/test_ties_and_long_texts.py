"""Texts beyond a run of the kernels, ties, and what a row of them gives."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.llm import arrowtext as at
from presswork.llm import chat_format, decontaminate, gam, langid, mixing, near_dedup, quality_rules, suffix_dedup, url_filter, warc_index

from .cases import frame, hard


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(1)
    body = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(160_000))
    assert len(body) > 3 * at.CHUNK_BYTES
    tail = " ".join(f"t{i}" for i in range(60))
    leak = "one two three four five six seven eight nine ten"
    return frame(spark, [f"{body} {tail} {leak}", f"short {tail}", f"{body} {tail} {leak}", "plain words of no matter"]), body, tail, leak


def test_long_texts_are_worked_on_whole(spark, long_docs):
    docs, body, tail, leak = long_docs
    n = len(body.split())
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    start = len(body) + len(tail) + 2
    assert sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect()) == [(i, 1, start, start + len(leak)) for i in (0, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [1, 3]
    assert {tuple(r) for r in near_dedup.duplicates(docs).collect()} == {(2, 0)}
    assert sorted(tuple(r)[:4] for r in suffix_dedup.repeats(docs).collect()) == [(1, 1, 61, 0), (2, 0, n + 70, 0)]
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup(docs).collect()}
    assert set(kept) == {0, 1, 3} and kept[1].split() == ["short"] and len(kept[0].split()) == n + 70
    assert {r["doc_id"]: r["tokens"] for r in mixing.sample(docs, 1.0).collect()} == {0: n + 70, 1: 61, 2: n + 70, 3: 5}
    judged = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert judged[0]["bits_per_char"] == judged[2]["bits_per_char"] and judged[0]["language"] == "en"


@pytest.mark.parametrize("module", [gam, quality_rules])
def test_ties_of_scores_and_labels(spark, long_docs, module):
    docs = long_docs[0]
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (3, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in module.score(docs, labels).collect()}
    assert got[0][1] == got[2][1]  # the same text, labelled or not
    greater = spark.createDataFrame([(0, 1), (1, 0), (3, 1)], "doc_id long, quality int")
    assert {k: r[1] for k, r in got.items()} == {r["doc_id"]: r[1] for r in module.score(docs, greater).collect()}
    twice = docs.unionByName(docs.where("doc_id = 1"))
    rows = [r[1] for r in module.score(twice, labels).collect() if r["doc_id"] == 1]
    assert len(rows) == 2 and rows[0] == rows[1]


def test_a_probability_at_the_threshold_is_kept(spark):
    docs = frame(spark, ["a", "a", "b", "b"])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    p = gam.score(docs, labels).first()["quality"]
    assert all(r["keep"] for r in gam.score(docs, labels, keep=p).collect())


def test_turns_of_one_number_go_by_role_and_text(spark):
    rows = [(1, 0, "b", "x", "k"), (1, 0, "a", "z", "k"), (1, 0, "a", None, "k"), (1, None, "c", "", "k"), (1, 0, "a", "z", "k"), (None, 1, None, None, "k"), (2, 0, "u", "y" * 2_000_000 + "<|end|>", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = {r["conv_id"]: r for r in chat_format.chat(df).collect()}
    assert chat_format.parse(got[1]["rendered"]) == [("c", ""), ("a", None), ("a", "z"), ("a", "z"), ("b", "x")] and got[1]["n_turns"] == 5
    assert chat_format.parse(got[None]["rendered"]) == [(None, None)]
    assert chat_format.parse(got[2]["rendered"]) == [("u", rows[-1][3])] and got[2]["n_escaped"] == 1
    assert chat_format.chat(df.limit(0)).count() == 0


def test_captures_that_agree_are_captures_each(spark):
    rows = [(5, "http://a.example/x", "<p>", 7)] * 3 + [(None, None, None, None), (6, "http://a.example/x", "q" * 2_000_000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured long").select("*", *[F.lit("clash").alias(c) for c in ("urlkey", "position", "range", "run", "k")])
    got = sorted(tuple(r)[:4] + (r["capture_no"], r["changed"]) for r in warc_index.history(df, F.col("captured")).collect())
    assert got == [(1, "", None, None, 1, True), (2, "example,a)/x", 7, 5, 1, True), (3, "example,a)/x", 7, 5, 2, False), (4, "example,a)/x", 7, 5, 3, False), (5, "example,a)/x", 7, 6, 4, True)]
    big = df.select((F.lit(2**62) + F.col("page_id")).alias("p")).where("p is not null").select(warc_index.captured_at(F.col("p")).alias("t"))
    assert all(1704067200 <= r["t"] < 1704067200 + 31536000 for r in big.collect())


def test_url_lists_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x"), (1, "http://a.example/x"), (None, "http://b.example/"), (2, None)], "page_id long, url string").select("*", *[F.lit("clash").alias(c) for c in ("keys", "digests", "shard", "pos", "blocked_by", "_url", "a.b")])
    entries = spark.createDataFrame([("a.example", "k"), ("A.example/", "k")], "entry string, key string")
    for most in (1 << 30, 0):
        got = sorted(((r["page_id"], r["blocked_by"]) for r in url_filter.blocked(pages, entries, most).collect()), key=repr)
        assert got == sorted([(1, "a.example"), (1, "a.example"), (None, None), (2, None)], key=repr)


def test_which_hard_rows_stay(spark):
    docs = hard(spark)
    texts = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in langid.accept(docs).collect()), key=repr)
    judged = langid.identify(docs).where("accepted").count()
    assert len(texts) == judged and all(any(c.isalpha() for c in t) for _, t in texts)
    everything = {(r["doc_id"], r["source"]) for r in mixing.sample(docs, 1.0).collect()}
    assert everything == {(r["doc_id"], r["source"]) for r in docs.collect()} - {(None, None)} | ({(None, None)} if (None, None) in everything else set())
    assert {r["doc_id"] for r in mixing.mix(docs, 1.0).collect()} == {r["doc_id"] for r in mixing.sample(docs, 1.0).collect()} - {None}
