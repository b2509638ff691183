import random

import numpy as np
import pytest

from presswork.llm import arrowtext as at
from presswork.llm import suffix_dedup as sd

from .cases import frame, hard


def brute(texts, size):
    """Spans of doc -> list, by every window's first place."""
    first, spans = {}, {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in first:
                s = spans.setdefault(d, [])
                if s and s[-1][1] >= i:
                    s[-1][1] = i + size
                else:
                    s.append([i, i + size])
            else:
                first[k] = (d, i)
    return {d: [tuple(x) for x in s] for d, s in spans.items()}


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(50, 120))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(1, 6)):
            w += rng.choice(passages)[rng.choice([0, 0, 5]) :] if rng.random() < 0.3 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    out.append(" ".join(["a b c d"] * 60))
    out.append(" ".join(["z"] * 130))
    out.append(out[0])
    return out


@pytest.mark.parametrize("hot", [sd.HOT, 3])
def test_matches_every_window(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)  # 3: most anchors go through two rounds
    texts = corpus(random.Random(5), 150)
    got = {}
    rows = sd.repeats(frame(spark, texts)).collect()
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["begin_word"], r["end_word"]))
        a, b = texts[r["doc_id"]].split(), texts[r["of_doc_id"]].split()
        assert a[r["begin_word"] : r["begin_word"] + 50] == b[r["of_begin_word"] : r["of_begin_word"] + 50]
        assert (r["of_doc_id"], r["of_begin_word"]) < (r["doc_id"], r["begin_word"])
    assert {d: sorted(s) for d, s in got.items()} == brute(texts, 50)


def test_cut_leaves_no_repeat_of_the_first_pass(spark):
    texts = corpus(random.Random(6), 60)
    spans = brute(texts, 50)
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        gone = {i for a, b in spans.get(d, []) for i in range(a, b)}
        want[d] = [x for i, x in enumerate(w) if i not in gone]
    got = {r["doc_id"]: r for r in sd.dedup(frame(spark, texts)).collect()}
    assert {d: r["text"].split() for d, r in got.items()} == {d: w for d, w in want.items() if w}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_corpus_order_is_the_suffix_order():
    rng = np.random.default_rng(3)
    for _ in range(30):
        h = rng.integers(0, 3, 200).astype(np.uint64)
        h = at.mix(h)
        rows = np.unique(np.concatenate(([0], rng.integers(1, 200, 4), [200])))
        order = sd.corpus_order(h, rows, 200, 3, 2)
        end = {i: rows[np.searchsorted(rows, i, "right")] for i in range(200)}
        suffix = [tuple(h[i : end[i]].tolist()) for i in order]
        assert suffix == sorted(suffix)


def test_hard_rows(spark):
    docs = hard(spark)
    assert sd.repeats(docs).count() == 0
    kept = sd.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert sd.repeats(docs.limit(0)).count() == 0 and sd.dedup(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 8").unionByName(docs.where("doc_id = 8").selectExpr("9 as doc_id", *[f"`{c}`" for c in docs.columns[1:]]))
    assert [tuple(r)[:4] for r in sd.repeats(twice).collect()] == [(9, 0, 80000, 8)]
    assert sd.dedup(twice).count() == 1
