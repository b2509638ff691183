import random

import numpy as np

from presswork.llm import arrowtext as at
from presswork.llm import near_dedup as nd

from .cases import frame, hard


def words(rng, n):
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]


def brute(texts):
    data = np.frombuffer("".join(t.lower() for t in texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.lower().encode()) for t in texts])))
    fp = nd.simhash(data, offsets)
    n = len(fp)
    apart = sum(np.bitwise_count(fp[:, None, k] ^ fp[None, :, k]).astype(int) for k in range(4))
    return fp, [(i, j) for i in range(n) for j in range(i) if apart[i, j] <= nd.DISTANCE and fp[i].any()]


def test_matches_all_pairs(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(500):
        w = words(rng, rng.randint(5, 200))
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            texts.append(" ".join(x if rng.random() > 0.06 else words(rng, 1)[0] for x in w))
    _, pairs = brute(texts)
    got = dict((r["doc_id"], r["duplicate_of"]) for r in nd.duplicates(frame(spark, texts)).collect())
    root = lambda i: got.get(i, i)
    found = sum(root(a) == root(b) for a, b in pairs)
    assert len(pairs) > 300 and found >= 0.95 * len(pairs)
    # whatever is called a copy is linked by pairs
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(find(a) == find(b) for a, b in got.items())


def test_recall_in_deep_tries(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAF", 4)
    monkeypatch.setattr(nd, "SUBTREE", 32)
    rng = random.Random(2)
    texts = []
    for _ in range(300):
        w = words(rng, 60)
        texts += [" ".join(w), " ".join(x if rng.random() > 0.08 else words(rng, 1)[0] for x in w)]
    _, pairs = brute(texts)
    got = dict((r["doc_id"], r["duplicate_of"]) for r in nd.duplicates(frame(spark, texts)).collect())
    assert sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.9 * len(pairs) > 200


def test_dense_subtrees_are_split(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAF", 8)
    monkeypatch.setattr(nd, "SUBTREE", 128)
    monkeypatch.setattr(nd, "DENSE", 150)
    rng = random.Random(3)
    family = words(rng, 80)
    texts = [" ".join(x if rng.random() > 0.04 else words(rng, 1)[0] for x in family) for _ in range(500)]  # one dense family
    for _ in range(100):
        w = words(rng, 60)
        texts += [" ".join(w), " ".join(x if rng.random() > 0.05 else words(rng, 1)[0] for x in w)]
    _, pairs = brute(texts)
    got = dict((r["doc_id"], r["duplicate_of"]) for r in nd.duplicates(frame(spark, texts)).collect())
    assert sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.95 * len(pairs) and len({got.get(i, i) for i in range(500)}) == 1


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(101, 100)], "v long, u long")
    assert {(r["v"], r["root"]) for r in nd.components(pairs).collect()} == {(i, 0) for i in range(1, 51)} | {(101, 100)}


def test_hard_rows(spark):
    docs = hard(spark)
    assert [tuple(r) for r in nd.duplicates(docs).collect()] == []  # 6 is there twice: one document
    kept = nd.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert nd.duplicates(docs.limit(0)).count() == 0


def test_copies_of_hard_texts(spark):
    docs = frame(spark, ["", "", None, None, "x y", "x y", "X, y!"])
    assert {tuple(r) for r in nd.duplicates(docs).collect()} == {(5, 4), (6, 4)}


def test_rows_without_words_have_no_print():
    fp = nd.simhash(np.frombuffer(b"  ab", np.uint8), np.array([0, 1, 2, 2, 4]))
    assert fp.any(axis=1).tolist() == [False, False, False, True]


def test_span_hash_does_not_depend_on_place():
    data = np.frombuffer(b"abc xx abc", np.uint8)
    s = at.prefix_sums(data)
    assert len(set(at.span_hash(s, np.array([0, 7]), np.array([3, 10])).tolist())) == 1


def test_links_of_a_leaf_by_brute_force():
    rng = np.random.default_rng(4)
    for n, families in ((0, 1), (1, 1), (40, 3), (700, 1), (900, 60), (300, 300)):
        centres = rng.integers(0, 2**63, (families, 4)).astype(np.uint64)
        fp = centres[rng.integers(0, families, n)]
        for _ in range(int(rng.integers(5, 30))):  # a few bits of each row flipped
            fp[np.arange(n), rng.integers(0, 4, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        label = nd._linked(fp, 30)
        near = nd._apart(fp, fp) <= 30
        want = np.arange(n)
        while True:
            new = np.where(near, want[None, :], n).min(axis=1) if n else want
            if (new == want).all():
                break
            want = new
        assert (label == want).all()
