import random

from presswork.llm import decontaminate as dc

from .cases import frame, hard


def test_a_large_benchmark_is_scanned_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    items = [(i % 25, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 8, 20])))) for i in range(40)]  # some ids have two texts
    texts = [" ".join([*rng.choices(words, k=4), rng.choice(items)[1], *rng.choices(words, k=4)]) for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in dc.leaks(frame(spark, texts), bench).collect())
    whole = found()
    monkeypatch.setattr(dc, "MAX_PATTERN_CHARS", 300)
    assert len(list(dc.parts(iter(sorted(items))))) > 3
    assert found() == whole and len(whole) > 20
    assert dc.clean(hard(spark), bench).count() == hard(spark).count()
