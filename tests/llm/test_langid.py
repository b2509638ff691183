import math
import random
from collections import Counter

import numpy as np

from presswork.llm import arrowtext as at
from presswork.llm import langid as li

from .cases import frame, hard


def text(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


LANGS = {"aa": ["ka", "to", "mi", "ré"], "bb": ["sch", "ung", "eit", "ü"], "cc": ["ión", "os", "ka", "el"]}


def brute(streams, lang, s, order=li.ORDER, d=li.DISCOUNT):
    """log2 probability of s after padding, by the recursion with plain dictionaries."""
    symbols = {c for v in streams.values() for x in v for c in x}
    size = len(symbols) + 2
    grams = {order: Counter()}
    for x in streams[lang]:
        for i in range(len(x) - order + 1):
            grams[order][tuple(x[i : i + order])] += 1
    raw = {k: {tuple(x[i : i + k]) for x in streams[lang] for i in range(len(x) - k + 1)} for k in range(1, order + 1)}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in raw[k + 1])

    def p(g):
        if not g:
            return 1 / size
        own = [c for h, c in grams[len(g)].items() if h[:-1] == g[:-1]]
        if not own:
            return p(g[1:])
        return max(grams[len(g)].get(g, 0) - d, 0) / sum(own) + d * len(own) / sum(own) * p(g[1:])

    return sum(math.log2(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1))


def stream(t):
    raw = np.frombuffer(t.encode(), np.uint8)
    return li.squeeze(*at.code_points(raw, np.array([0, len(raw)])))[0]


def test_models_match_the_recursion():
    rng = random.Random(1)
    streams = {k: [stream(text(rng, v, 30)) for _ in range(3)] for k, v in LANGS.items()}
    models = li.Models(streams)
    probes = [text(rng, LANGS["aa"], 8), text(rng, LANGS["cc"], 8), "QX 99 zz é", "ung", ""]
    data = np.frombuffer("".join(probes).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x.encode()) for x in probes])))
    h, n, _ = models.entropies(data, offsets)
    plain = {k: [x.tolist() for x in v] for k, v in streams.items()}
    for i, probe in enumerate(probes):
        for j, lang in enumerate(models.langs):
            if probe:
                assert abs(-h[i, j] * n[i] - brute(plain, lang, stream(probe).tolist())) < 1e-3


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(2)
    texts, langs = [], []
    for lang, syllables in LANGS.items():
        for _ in range(120):
            texts.append(text(rng, syllables, rng.randint(3, 200)))
            langs.append(lang)
    known = len(texts)
    texts += ["Жукова кошка спит на крыше дома и видит сны о рыбе"] * 3
    langs += [None] * 3
    got = {r["doc_id"]: r for r in li.identify(frame(spark, texts, langs), bound=60).collect()}
    right = [got[i]["language"] == langs[i] for i in range(known)]
    assert np.mean(right) > 0.98 and np.mean([got[i]["accepted"] for i in range(known)]) > 0.98
    assert not any(got[i]["accepted"] for i in range(known, known + 3))


def test_hard_rows(spark):
    docs = hard(spark)
    rows = li.identify(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["language"] is None and not r["accepted"] for r in rows if r["doc_id"] in (1, 2, 9))
    assert li.accept(docs).columns == docs.columns
    assert li.identify(docs.limit(0)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r["language"], r["accepted"]) for r in li.identify(unlabelled).collect()} == {(None, False)}
