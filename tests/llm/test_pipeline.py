"""The pipeline's stages against brute force, on the smallest documents and on hard rows."""

import re

import numpy as np
import pytest

import corpus_pipeline
from presswork.llm import near_dedup as nd

from ..conftest import SF
from .cases import frame, hard


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage leaves, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_stages_only_take_away(kept):
    for before, after in zip(kept, kept[1:]):
        assert list(before.columns) == list(after.columns) and set(after.doc_id) < set(before.doc_id) | {-1} and after.doc_id.is_unique


def test_language_keeps_what_is_in_a_language(kept):
    assert len(kept[1]) >= 0.98 * len(kept[0])


def test_one_document_of_each_group_stays(kept):
    before, after = kept[1], kept[2]
    texts = [t.lower().encode() for t in before.text]
    fp = nd.simhash(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    apart = sum(np.bitwise_count(fp[:, None, k] ^ fp[None, :, k]).astype(int) for k in range(4))
    near = (apart <= nd.DISTANCE) & fp.any(axis=1)[:, None]
    group = np.arange(len(fp))
    for _ in range(len(fp)):
        new = np.where(near, group[None, :], len(fp)).min(axis=1)
        new = np.where(fp.any(axis=1), new, group)
        if (new == group).all():
            break
        group = new
    ids = before.doc_id.to_numpy()
    want = {min(ids[group == g]) for g in set(group)}
    assert set(after.doc_id) == want and len(after) < len(before)


def test_no_passage_stands_twice(kept):
    before, after = kept[2].sort_values("doc_id"), kept[3].set_index("doc_id")
    seen, want = set(), {}
    for d, t in zip(before.doc_id, before.text):
        w = t.split()
        gone = set()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if k in seen:
                gone.update(range(i, i + 50))
            seen.add(k)
        want[d] = [x for i, x in enumerate(w) if i not in gone]
    assert {d: t.split() for d, t in after.text.items()} == {d: w for d, w in want.items() if w}


def test_leaks_go_and_nothing_else(spark, kept):
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 8]) for w in items for i in range(max(1, len(w) - 7))}
    sizes = {len(g) for g in grams}

    def leaks(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert set(kept[4].doc_id) == {d for d, t in zip(kept[3].doc_id, kept[3].text) if not leaks(t)}


def test_mixture_is_drawn_from_all(kept):
    before, after = kept[4], kept[5]
    share = after.text.str.split().str.len().sum() / before.text.str.split().str.len().sum()
    assert 0.4 < share < 0.6 and set(after.source) == set(before.source)


def test_run_is_its_stages(spark, kept):
    assert set(corpus_pipeline.run(spark, SF).toPandas().doc_id) == set(kept[5].doc_id)


def test_hard_rows(spark):
    docs = hard(spark)
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    plain = frame(spark, ["some words of this text here"] * 3 + [None])
    for _name, stage in corpus_pipeline.STAGES:
        stage(spark, plain, SF).collect()
