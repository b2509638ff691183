"""Quality models on held-out rows, their parts against plain computation, and hard rows."""

import random

import numpy as np
import pytest

from presswork.llm import gam, quality_rules

from .cases import frame, hard


def corpus(spark, n=400):
    rng = random.Random(3)
    texts, quality = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        good = i % 3 != 0
        if not good:
            w = rng.choice([[x.upper() + "!!" for x in w], [x + rng.choice(["%%%", "$$$", "###"]) for x in w], [x + " |" for x in w]])
        texts.append(" ".join(w))
        quality.append(int(good))
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality) if i < n // 2], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels, quality


@pytest.mark.parametrize("module", [gam, quality_rules])
def test_held_out_accuracy(spark, module):
    docs, labels, quality = corpus(spark)
    got = {r["doc_id"]: r["keep"] for r in module.score(docs, labels).collect()}
    held = range(len(quality) // 2, len(quality))
    assert np.mean([got[i] == bool(quality[i]) for i in held]) > 0.97
    again = {r["doc_id"]: r["keep"] for r in module.score(docs.repartition(5), labels).collect()}
    assert again == got


def test_probabilities_are_calibrated(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aaa", "bbb", "ccc"]) for _ in range(30)) for _ in range(800)]
    chance = [min(0.95, max(0.05, (t.count("aaa") - 5) / 10)) for t in texts]
    labels = spark.createDataFrame([(i, int(rng.random() < c), 0) for i, c in enumerate(chance)], "doc_id long, quality int, toxic int")
    got = quality_rules.score(frame(spark, texts), labels, bound=800).toPandas().sort_values("doc_id")
    p, c = got.probability.to_numpy(), np.array(chance)
    for lo in (0.0, 0.35, 0.65):
        some = (p >= lo) & (p < lo + 0.35)
        if some.sum() > 40:
            assert abs(p[some].mean() - c[some].mean()) < 0.12


@pytest.mark.parametrize("module", [gam, quality_rules])
def test_hard_rows(spark, module):
    docs = hard(spark)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, None), (None, 1, 0), (8, None, 0), (99, 1, 0), (8, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.score(docs, labels).count() == docs.count()
    none = module.score(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and all(r["keep"] and r[1] is None for r in none)
    assert module.score(docs.limit(0), labels).count() == 0


def test_features_by_hand():
    text = b"Ab cd! 12\n\nAb zz%"
    x = dict(zip(gam.FEATURES, gam.features(np.frombuffer(text + b"Q", np.uint8), np.array([0, len(text), len(text) + 1]))[0]))
    n = len(text)
    assert x["upper"] == 2 / n and x["digit"] == 2 / n and x["sign"] == 2 / n and x["line_ends"] == 2 / n and x["distinct_words"] == 4 / 5
    assert x["words_a_line"] == 5 / 2 and x["wordless"] == 1 / 5 and x["sign_ended"] == 2 / 5 and x["capitals"] == 0 and x["distinct_lines"] == 1


def test_a_tree_cuts_where_it_gains():
    g, h = np.array([1.0, 1, -5, -5, 1]), np.ones(5)
    out = gam._tree(g, h, 3)
    assert out[0] == out[1] > 0 > out[2] == out[3] and out[4] > 0
    grid, gain = gam._grid(np.array([[3.0, -3], [-3, 3]]), np.ones((2, 2)))
    assert gain > 0 and grid[0, 0] > 0 > grid[0, 1] and grid[1, 1] > 0 > grid[1, 0]


def test_scores_are_sums_of_weights():
    rules = quality_rules.Rules.__new__(quality_rules.Rules)
    rng = np.random.default_rng(1)
    rules.weights, rules.bias, rules.a, rules.b = rng.normal(size=quality_rules.GROUPS << quality_rules.HASH_BITS).astype(np.float32), 0.3, 1.0, 0.0
    texts = ["one two three", "", "é x", "one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    p = rules.probability(data, offsets)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        slots, shares = quality_rules._bag(raw, np.array([0, len(raw)]))
        assert abs(1 / (1 + np.exp(-(rules.bias + rules.weights[slots.astype(int)] @ shares))) - p[i]) < 1e-6
