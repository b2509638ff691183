import random

import numpy as np

from presswork.llm import mixing as mx

from .cases import frame, hard


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 300))
        p, t = np.full(n, rng.uniform(0.05, 0.95)), rng.integers(0, 1000, n)
        before = p.sum(), (p * t).sum()
        mx.flight(p, t, rng)
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert abs(p.sum() - before[0]) < 1e-6 and abs((p * t).sum() - before[1]) < 1e-3


def test_inclusion_is_as_asked():
    n, runs = 12, 4000
    t = np.array([1, 5, 9, 14, 2, 2, 30, 7, 8, 1, 0, 11])
    hits = np.zeros(n)
    for seed in range(runs):
        rng = np.random.default_rng(seed)
        p = np.full(n, 0.3)
        mx.flight(p, t, rng)
        mx.landing(p, rng)
        assert set(p) <= {0.0, 1.0} and p.sum() in (3.0, 4.0)
        hits += p
    assert np.abs(hits / runs - 0.3).max() < 0.04


def test_targets(spark, monkeypatch):
    monkeypatch.setattr(mx, "GROUP", 64)
    rng = random.Random(3)
    sources = ["hot"] * 3000 + ["mid"] * 400 + ["small"] * 30
    texts = [" ".join(["w"] * rng.randint(1, 200)) for _ in sources]
    docs = frame(spark, texts, sources=sources)
    got = mx.sample(docs).toPandas()
    again = mx.sample(docs.repartition(7)).toPandas()
    assert sorted(got.doc_id) == sorted(again.doc_id) and got.doc_id.is_unique
    tokens = {s: np.array([len(t.split()) for t, x in zip(texts, sources) if x == s]) for s in set(sources)}
    totals = {s: v.sum() for s, v in tokens.items()}
    factor = mx.level(np.array(list(totals.values())), mx.SHARE, mx.POWER)
    for s, v in tokens.items():
        target = min(totals[s], factor * totals[s] ** mx.POWER)
        own = got[got.source == s]
        assert abs(own.tokens.sum() - target) <= 2 * v.max() and abs(len(own) - target / totals[s] * len(v)) <= 1


def test_hard_rows(spark):
    docs = hard(spark)
    assert 0 < mx.sample(docs).count() <= docs.count()
    assert mx.mix(docs).columns == docs.columns
    assert mx.sample(docs.limit(0)).count() == 0 and mx.mix(docs.limit(0)).count() == 0
    everything = {r["source"] for r in mx.sample(docs, share=1.0).collect()}
    assert everything == {None, "a", "b", "c"}
