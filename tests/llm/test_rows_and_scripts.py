"""Rows that share an id, odd column names, scripts and encodings that plain ASCII texts don't show."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import arrowtext as at
from presswork.llm import decontaminate as dc
from presswork.llm import langid, mixing, near_dedup, suffix_dedup

from .cases import frame, hard

ODD = ["_repeats", "_repeats_of", "_gone", "_drawn", "_labelled", "a.b", "c0", "spans", "of_doc", "text_key", "A b"]


def odd(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in ODD if c not in df.columns])


def unique(rng, n):
    return [f"u{rng.random()}" for _ in range(n)]


def test_each_row_is_cut_by_its_own_spans(spark):
    rng = random.Random(1)
    passage, own, short = unique(rng, 60), unique(rng, 150), unique(rng, 5)
    texts = [" ".join(passage), " ".join([*unique(rng, 100), *passage]), " ".join(own), " ".join(short)]
    docs = odd(frame(spark, texts, ids=[1, 7, 7, 7]))
    kept = suffix_dedup.dedup(docs)
    assert kept.columns == docs.columns
    got = sorted(r["text"].strip() for r in kept.collect())
    assert got == sorted([texts[0], " ".join(texts[1].split()[:100]), texts[2], texts[3]])


def test_equal_rows_of_one_id_are_one_text(spark):
    text = " ".join(unique(random.Random(2), 80))
    docs = frame(spark, [text, text, text], ids=[3, 3, 4])
    assert [tuple(r)[:4] for r in suffix_dedup.repeats(docs).collect()] == [(4, 0, 80, 3)]
    assert sorted(r["doc_id"] for r in suffix_dedup.dedup(docs).collect()) == [3, 3]


def test_an_anchor_in_most_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    rng = random.Random(3)
    line = unique(rng, 55)
    texts = [" ".join([*unique(rng, 40), *line, *unique(rng, 40)]) if rng.random() < 0.9 else " ".join(unique(rng, 90)) for _ in range(120)]
    first = next(i for i, t in enumerate(texts) if line[0] in t)
    want = {(i, 40, 95) for i, t in enumerate(texts) if line[0] in t and i > first}
    assert {tuple(r)[:3] for r in suffix_dedup.repeats(frame(spark, texts)).collect()} == want


@pytest.mark.parametrize("name", ["accept", "near", "repeats", "leaks", "mix"])
def test_odd_names_stay(spark, name):
    bench = spark.createDataFrame([(1, "no such words in any of these texts at all")], "item_id long, text string")
    run = {"accept": langid.accept, "near": near_dedup.dedup, "repeats": suffix_dedup.dedup, "leaks": lambda d: dc.clean(d, bench), "mix": mixing.mix}[name]
    docs = odd(hard(spark))
    kept = run(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert run(docs.limit(0)).count() == 0
    assert {r["a.b"] for r in kept.collect()} == {"clash"}


def test_long_texts_of_few_words_are_no_copies(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}x" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(3000)) for _ in range(2)]
    texts.append(" ".join(rng.sample(texts[0].split(), 3000)))  # its words in another order
    texts.append(texts[0].replace("w7x", "w8x"))
    assert {tuple(r) for r in near_dedup.duplicates(frame(spark, texts)).collect()} == {(3, 0)}


def test_characters_of_unspaced_scripts_are_words(spark):
    rng = random.Random(5)
    chinese = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(n))
    a, thai = chinese(400), "".join(chr(rng.randint(0xE01, 0xE2E)) for _ in range(300))
    changed = a[:200] + "新" + a[201:]
    parted = "。".join(a[i : i + 20] for i in range(0, 400, 20))
    texts = [a, changed, parted, chinese(400), thai, thai[:150] + "ก" + thai[151:], "日本語のテキスト mixed with words", "other words and 漢字"]
    assert {tuple(r) for r in near_dedup.duplicates(frame(spark, texts)).collect()} == {(1, 0), (2, 0), (5, 4)}


def test_words_by_brute_force():
    rng = random.Random(6)
    alphabet = ["a", "Z", "9", " ", "-", "é", "ß", "ж", " ", "«", "漢", "か", "。", "　", "ก", "한", "—", "’", "🙂", "𠀀", "ª", "\n"]
    for _ in range(200):
        rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        want, each = [], [0]
        for row in rows:
            run = ""
            for c in row + " ":
                alone = c in "漢かก𠀀"
                part = (c.isascii() and not c.isalnum()) or c in " «。　—’"
                if (alone or part) and run:
                    want.append(run)
                    run = ""
                if alone:
                    want.append(c)
                elif not part:
                    run += c
            each.append(len(want))
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(r.encode()) for r in rows])))
        _, starts, ends, of = at.words_of(data, offsets)
        assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == want and of.tolist() == each


def test_encodings_of_a_leak(spark):
    item = "Le café naïf coûte très cher à l’office du ﬁnancier Straße"
    plain = item.replace("ﬁ", "fi").replace("ß", "SS")
    texts = ["xx " + unicodedata.normalize(form, t) + " yy" for form in ("NFC", "NFD", "NFKC", "NFKD") for t in (item, item.upper(), plain, plain.upper())]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((tuple(r) for r in dc.leaks(frame(spark, [*texts, "xx cafe naif coute"]), bench).collect()))
    assert [(g[0], g[2], g[3]) for g in got] == [(i, 3, len(t) - 3) for i, t in enumerate(texts)]


def test_offsets_of_folded_text_by_brute_force():
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "é", "ﬁ", "ß", "한", "각", "İ", " ", ".", "ｱ", "½", "́"]
    for _ in range(300):
        rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(3)]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        edges = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        chars, begin, end, of = dc.fold(points, edges)
        for k, row in enumerate(rows):
            own = chars[of[k] : of[k + 1]].tobytes().decode("utf-32-le")
            want = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in dc.folded("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in row)))
            assert own == want
            assert (begin[of[k] : of[k + 1]] >= edges[k]).all() and (end[of[k] : of[k + 1]] <= edges[k + 1]).all() and (begin < end).all()


def test_languages_beyond_the_basic_plane(spark):
    rng = random.Random(8)
    adlam = lambda: " ".join("".join(chr(rng.randint(0x1E922, 0x1E943)) for _ in range(rng.randint(2, 6))) for _ in range(40))
    latin = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 6))) for _ in range(40))
    texts = [adlam() for _ in range(40)] + [latin() for _ in range(40)]
    got = langid.identify(frame(spark, texts, ["ff"] * 40 + ["xx"] * 40)).collect()
    assert all(r["accepted"] and r["language"] == ("ff" if r["doc_id"] < 40 else "xx") for r in got)


def test_target_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 64)
    rng = random.Random(9)
    sources = ["a"] * 2000 + ["b"] * 600 + ["c"] * 20 + [None] * 300 + ["d"] * 100
    texts = [" ".join(["w"] * rng.randint(1, 100)) for _ in sources]
    docs = frame(spark, texts, sources=sources)
    total = {s: sum(len(t.split()) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    weights = {"a": 1.0, "b": 1.0, "c": 5.0, None: 0.5, "absent": 9.0}
    got = mixing.sample(docs, 0.3, weights=weights).toPandas()
    drawn = {s: int(got[got.source.isna() if s is None else got.source == s].tokens.sum()) for s in total}
    want = 0.3 * sum(total.values())
    rest = (want - total["c"]) / 2.5  # c gives all it has
    for s, target in {"a": rest, "b": rest, "c": total["c"], None: rest / 2, "d": 0}.items():
        assert abs(drawn[s] - target) <= 200, s
    table = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 1.0), ("c", 5.0), (None, 0.5), ("d", None), ("d", -1.0)], "source string, weight double")
    assert sorted(mixing.sample(docs, 0.3, weights=table).toPandas().doc_id) == sorted(got.doc_id)
    assert mixing.sample(docs, 0.3, weights={}).count() == 0
    assert {r["doc_id"] for r in mixing.mix(docs, 0.3, weights=weights).collect()} == set(got.doc_id)
    with pytest.raises(ValueError):
        mixing.sample(docs, weights={"a": -1.0})
