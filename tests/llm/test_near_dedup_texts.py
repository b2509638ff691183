"""Candidates of op4 are held against one another by their texts."""

import random

import numpy as np

from presswork.llm import near_dedup as nd

from .cases import frame
from .test_near_dedup import brute, words


def found(spark, texts):
    return {tuple(r) for r in nd.duplicates(frame(spark, texts)).collect()}


def pairs(text):
    w = text.split()
    return set(zip(w, w[1:])) or set(w)


def test_short_texts_that_share_long_words_are_no_copies(spark):
    rng = random.Random(3)
    short = lambda k: ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(2)) for _ in range(k)]
    texts = []
    for k in (1, 2, 3, 4, 5, 6):
        texts += [" ".join([*short(k), "constitution", *short(k)]) for _ in range(15)]
        texts += [" ".join([*short(k), "Wirtschaftsprüfer", *short(k), "institution", *short(k), "experiment"]) for _ in range(15)]
    texts += ["The patient died", "A patient slept", "the patient lived", "man bites dog", "dog bites man"]
    _, alike = brute(texts)
    assert len(alike) > 500  # their fingerprints are near
    assert found(spark, texts) == set()


def test_long_texts_of_the_same_words_are_no_copies(spark):
    rng = random.Random(4)
    vocabulary = words(rng, 80)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(900)) for _ in range(6)]
    assert found(spark, texts) == set()
    assert found(spark, [*texts, texts[2] + " and more"]) == {(6, 2)}


def test_same_copies_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        w = words(rng, 40)
        texts += [" ".join(x if rng.random() > 0.04 else words(rng, 1)[0] for x in w) for _ in range(12)]
    rng.shuffle(texts)
    whole = found(spark, texts)
    monkeypatch.setattr(nd, "TASK_WORDS", 100)
    assert found(spark, texts) == whole and len(whole) > 60


def test_alike_matches_all_pairs():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    root = np.array([rng.randint(-2, 1) for _ in texts])
    raw = [t.encode() for t in texts]
    h, _, rows = nd.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    found, offsets = nd.word_pairs(h, rows)
    sets = [pairs(t) for t in texts]
    assert np.diff(offsets).tolist() == [len(x) for x in sets]
    near = [[j for j in range(len(texts)) if root[i] == root[j] and len(sets[i] & sets[j]) >= nd.SHARE * len(sets[i] | sets[j])] for i in range(len(texts))]
    want, before = list(range(len(texts))), None
    while want != before:
        before, want = want, [min(want[j] for j in near[i]) for i in range(len(texts))]
    assert nd.alike(root, offsets, found).tolist() == want
