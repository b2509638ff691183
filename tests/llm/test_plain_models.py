"""The fitted models against plain Python: boosting, logistic regression, the cube and the language decision, step by step."""

import math
import random
from itertools import combinations

import numpy as np

from presswork.llm import gam, langid, mixing, quality_rules
from presswork.llm import arrowtext as at

from .test_langid import LANGS, text


def best_tree(cells, leaves):
    """The values of a tree on ordered cells (gradient, hessian): of all cuts of all leaves the one that gains most, again and again; the last of equals."""
    weigh = lambda a, b: sum(g for g, _ in cells[a:b]) ** 2 / (sum(h for _, h in cells[a:b]) + 1.0)
    cuts = [0, len(cells)]
    for _ in range(leaves - 1):
        found = []
        for a, b in zip(cuts, cuts[1:]):
            gains = [(weigh(a, c) + weigh(c, b) - weigh(a, b), -c, c) for c in range(a + 1, b)]
            found += [max(gains)] if gains else []
        found = [(x[0], x[2]) for x in found if x[0] > 1e-9]
        if not found:
            break
        cuts = sorted([*cuts, max(found)[1]])
    out = []
    for a, b in zip(cuts, cuts[1:]):
        out += [sum(g for g, _ in cells[a:b]) / (sum(h for _, h in cells[a:b]) + 1.0)] * (b - a)
    return out


def test_boosting_is_what_a_plain_booster_does(monkeypatch):
    for name, value in (("ROUNDS", 6), ("PAIR_ROUNDS", 4), ("PAIRS", 2), ("BINS", 8), ("PAIR_BINS", 4)):
        monkeypatch.setattr(gam, name, value)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(160, 3)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) ^ (rng.random(160) < 0.1)).astype(float)
    x[:5, 2] = 9.0  # ties in a feature
    model = gam.Gam(x, y)
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, 9)[1:-1]).tolist())) for c in x.T]
    coarse = [sorted(set(np.quantile(c, np.linspace(0, 1, 5)[1:-1]).tolist())) for c in x.T]
    bin_of = lambda v, c: sum(v >= z for z in c)
    rate = y.mean()
    score = [math.log(rate / (1 - rate))] * len(y)
    slope = lambda: [(t - 1 / (1 + math.exp(-s)), (1 / (1 + math.exp(-s))) * (1 - 1 / (1 + math.exp(-s)))) for s, t in zip(score, y)]
    clip = lambda v: gam.RATE * min(4, max(-4, v))

    for _ in range(6):
        for j in range(3):
            cells = [[0.0, 0.0] for _ in range(len(cuts[j]) + 1)]
            for i, (g, h) in enumerate(slope()):
                cell = cells[bin_of(x[i, j], cuts[j])]
                cell[0] += g
                cell[1] += h
            step = [clip(v) for v in best_tree(cells, gam.LEAVES)]
            score = [s + step[bin_of(x[i, j], cuts[j])] for i, s in enumerate(score)]
    tables_only = np.array(score)

    def grid_of(i, j):
        cells = [[[0.0, 0.0] for _ in range(len(coarse[j]) + 1)] for _ in range(len(coarse[i]) + 1)]
        for k, (g, h) in enumerate(slope()):
            cell = cells[bin_of(x[k, i], coarse[i])][bin_of(x[k, j], coarse[j])]
            cell[0] += g
            cell[1] += h
        best, gain = [[0.0] * len(cells[0]) for _ in cells], 0.0
        for flip in (False, True):
            own = [list(c) for c in zip(*cells)] if flip else cells
            for cut in range(1, len(own)):
                out, won = [], 0.0
                for part in (own[:cut], own[cut:]):
                    line = [(sum(r[c][0] for r in part), sum(r[c][1] for r in part)) for c in range(len(own[0]))]
                    values = best_tree(line, 2)
                    won += sum(2 * v * g - v * v * h for v, (g, h) in zip(values, line))
                    out += [values] * len(part)
                if won > gain + 1e-9:
                    best, gain = [list(c) for c in zip(*out)] if flip else out, won
        return best, gain

    pairs = sorted(combinations(range(3), 2), key=lambda p: (-grid_of(*p)[1], p))[:2]
    assert model.pairs == pairs
    for _ in range(4):
        for i, j in pairs:
            step = grid_of(i, j)[0]
            score = [s + clip(step[bin_of(x[k, i], coarse[i])][bin_of(x[k, j], coarse[j])]) for k, s in enumerate(score)]
    assert np.allclose(model.probability(x), 1 / (1 + np.exp(-np.array(score))), atol=1e-9)
    assert not np.allclose(tables_only, score)


def words_of(t):
    return [w for w in t.replace("\n", " ").split(" ") if w]


def shares_of(t):
    """Of each kind of n-gram the share of each among the text's, n-grams as they are written."""
    w = words_of(t)
    out = {}
    for kind, units, order in [("w", w, k) for k in quality_rules.WORD_ORDERS] + [("c", t, k) for k in quality_rules.CHAR_ORDERS]:
        grams = [tuple(units[i : i + order]) for i in range(len(units) - order + 1)]
        for g in grams:
            out[kind, order, g] = out.get((kind, order, g), 0) + 1 / len(grams)
    return out


def test_n_grams_by_brute_force():
    rng = random.Random(2)
    seen = {}
    for _ in range(60):
        t = " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8)))
        raw = np.frombuffer(t.encode(), np.uint8)
        slots, values = quality_rules._bag(raw, np.array([0, len(raw)]))
        want = shares_of(t)
        got = sorted(np.round(values, 9))
        assert abs(sum(values) - sum(want.values())) < 1e-9
        if len(slots) == len(want):  # no two n-grams of the text share a slot
            assert np.allclose(got, sorted(np.round(list(want.values()), 9)), atol=1e-6)
        seen[t] = set(slots.tolist())
    assert len(set().union(*seen.values())) > 100
    a, b = (quality_rules._bag(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"ab ab", b"ab ba"))
    assert set(a.tolist()) != set(b.tolist())


def test_logistic_regression_is_what_plain_steps_give():
    rng = random.Random(3)
    texts, y = [], []
    for _ in range(48):
        good = rng.randint(0, 1)
        texts.append(" ".join(rng.choice(["aa", "bb", "cc"] if good else ["bb", "dd", "ee"]) for _ in range(6)))
        y.append(float(good if rng.random() < 0.9 else 1 - good))
    bags = [quality_rules._bag(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    rules = quality_rules.Rules([b[0] for b in bags], [b[1] for b in bags], np.array(y))
    x = [dict(zip(s.tolist(), v.tolist())) for s, v in bags]
    train = [i for i in range(48) if i % quality_rules.HELD_OUT != quality_rules.HELD_OUT - 1]
    held = [i for i in range(48) if i not in train]
    good = sum(y[i] for i in train) / len(train)
    weigh = {1.0: 0.5 / good, 0.0: 0.5 / (1 - good)}
    w, bias, squares, bias_squares = {}, 0.0, {}, 1e-12
    logistic = lambda z: 1 / (1 + math.exp(-z))
    for _ in range(quality_rules.STEPS):
        off = {i: weigh[y[i]] * (logistic(sum(w.get(k, 0) * v for k, v in x[i].items()) + bias) - y[i]) / len(train) for i in train}
        slope = {}
        for i in train:
            for k, v in x[i].items():
                slope[k] = slope.get(k, quality_rules.RIDGE * w.get(k, 0)) + v * off[i]
        for k, g in slope.items():
            squares[k] = squares.get(k, 1e-12) + g * g
            w[k] = w.get(k, 0) - quality_rules.RATE * g / math.sqrt(squares[k])
        total = sum(off.values())
        bias_squares += total**2
        bias -= quality_rules.RATE * total / math.sqrt(bias_squares)
    z = {i: sum(w.get(k, 0) * v for k, v in x[i].items()) + bias for i in range(48)}
    n1 = sum(y[i] for i in held)
    n0 = len(held) - n1
    target = {i: (n1 + 1) / (n1 + 2) if y[i] else 1 / (n0 + 2) for i in held}
    p = np.array([rules.probability(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts])
    # the line is the one of least cross-entropy against the drawn-in targets: no other nearby is better
    loss = lambda a, b: -sum(target[i] * math.log(logistic(a * z[i] + b)) + (1 - target[i]) * math.log(1 - logistic(a * z[i] + b)) for i in held)
    a, b = rules.a, rules.b
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-3 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    assert np.allclose(p, [logistic(a * z[i] + b) for i in range(48)], atol=1e-4)


def plain_cube(tokens, inclusion, rng):
    """Cube method over a whole source in the textbook's way: null vectors of (1, tokens) by linear algebra, one at a time; then the tokens' constraint goes, then the last coin."""
    p = np.full(len(tokens), inclusion)
    for rows in (2, 1, 0):
        while True:
            open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
            if len(open_) <= rows:
                break
            some = open_[: rows + 1]
            a = np.stack([np.ones(len(some)), tokens[some]])[:rows]
            u = np.linalg.svd(a)[2][-1] if rows else np.ones(1)
            up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(some, u) if abs(v) > 1e-12)
            down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(some, u) if abs(v) > 1e-12)
            p[some] += (up if rng.random() * (up + down) < down else -down) * u
    return np.rint(p)


def test_sample_balances_as_a_plain_cube_does(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 32)
    from .cases import frame

    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 120, 600)
    docs = frame(spark, [" ".join(["w"] * n) for n in sizes], sources=["s"] * 600)
    got = mixing.sample(docs, 0.4).toPandas()
    plain = [plain_cube(sizes.astype(float), 0.4, rng) for _ in range(10)]
    want_n, want_t = 0.4 * 600, 0.4 * sizes.sum()
    worst_n, worst_t = max(abs(d.sum() - want_n) for d in plain), max(abs((d * sizes).sum() - want_t) for d in plain)
    assert worst_n <= 1 and worst_t <= 2 * sizes.max()
    assert abs(len(got) - want_n) <= 1 and abs(got.tokens.sum() - want_t) <= 2 * sizes.max()
    assert np.allclose(got.inclusion, 0.4, atol=1e-3)
    # long and short documents alike
    assert abs(np.mean(np.sort(got.tokens)) - sizes.mean()) < 3


def test_the_decision_by_plain_figures():
    rng = random.Random(6)
    samples = {lang: [text(rng, s, rng.randint(5, 60)) for _ in range(80)] for lang, s in LANGS.items()}
    identifier = langid.Identifier(samples)
    probes = [text(rng, s, rng.randint(3, 60)) for s in LANGS.values() for _ in range(15)] + ["Жукова кошка спит", "1234 56", "ka", ""]
    raw = [t.encode() for t in probes]
    best, bits, margin, good, lettered = identifier.judge(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    langs = identifier.models.langs

    def entropies(t):
        data = np.frombuffer(t.encode(), np.uint8)
        h, n, _ = identifier.models.entropies(data, np.array([0, len(data)]))
        return h[0], int(n[0])

    median = lambda v: float(np.median(v))
    rule = {}
    for i, lang in enumerate(langs):
        e, n = zip(*[(h[i], n) for h, n in map(entropies, samples[lang][langid.HELD_OUT - 1 :: langid.HELD_OUT])])
        mean = median(e)
        off = [(1.4826 * (v - mean)) ** 2 for v in e]
        a, b = max(0.01, median(off)), max(1.0, median([o * k for o, k in zip(off, n)]))
        tail = float(np.quantile([(v - mean) / math.sqrt(a + b / k) for v, k in zip(e, n)], 0.9))
        rule[i] = mean, a, b, langid.LIMIT * max(1.0, tail / 1.2816)
    for k, t in enumerate(probes):
        h, n = entropies(t)
        least = int(np.argmin(h))
        mean, a, b, limit = rule[least]
        letters = any(c.isalpha() for c in t)
        assert lettered[k] == letters and best[k] == least
        assert bool(good[k]) == (letters and (h[least] - mean) / math.sqrt(a + b / max(n, 1)) <= limit)
        assert abs(margin[k] - (sorted(h)[1] - h[least])) < 1e-6 and abs(bits[k] - h[least]) < 1e-6
    assert at.CHUNK_BYTES > 0
