import random
import re

from presswork.llm import decontaminate as dc

from .cases import frame, hard


def spans(text, item):
    """(start, end) by comparing word lists."""
    find = lambda t: [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t)]
    d, w = find(text), [x for x, _, _ in find(item)]
    n = min(len(w), dc.WINDOW)
    if len(w) < dc.LEAST_WORDS:
        return [(d[0][1], d[-1][2])] if w and [x for x, _, _ in d] == w else []
    grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for i in range(len(d) - n + 1):
        if tuple(x for x, _, _ in d[i : i + n]) in grams:
            a, b = d[i][1], d[i + n - 1][2]
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def test_matches_word_lists(spark):
    rng = random.Random(4)
    vocabulary = ["Ärger", "the", "of", "été", "x1", "Straße", "ŒUVRE", "naïve", "日本", "go"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 30]))) for _ in range(40)] + ["unique words of a question?\nIts answer."]
    texts = []
    for _ in range(150):
        w = [rng.choice(vocabulary) + rng.choice(["", "", ",", "!"]) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            w += rng.choice(items).upper().replace("SS", "ß").split() if rng.random() < 0.3 else rng.choice(items).split(" ")
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
        texts.append(rng.choice([" ", "\n", " - "]).join(w))
    texts += items
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {tuple(r) for r in dc.leaks(frame(spark, texts), bench).collect()}
    want = {(d, i, a, b) for d, t in enumerate(texts) for i, item in enumerate(items) for a, b in spans(t, item)}
    assert got == want and len(want) > 60


def test_hard_rows(spark):
    docs = hard(spark)
    bench = spark.createDataFrame([(1, "same words here"), (2, None), (None, "word1 of1"), (3, ""), (4, "A"), (5, "word7 of0 word8 of1")], "item_id long, text string")
    got = [tuple(r) for r in dc.leaks(docs, bench).collect()]
    assert sorted(got) == [(3, 4, 0, 1), (6, 1, 0, 15), (6, 1, 0, 15), (8, 5, *got[-1][2:])]
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert dc.leaks(docs, bench.limit(0)).count() == 0 and dc.leaks(docs.limit(0), bench).count() == 0
