import random

import numpy as np

from presswork.llm import langid as li

from .test_langid import LANGS, text

FOREIGN = ["Жукова кошка спит на крыше дома и видит сны о рыбе", "Вчера вечером мы долго гуляли по набережной и говорили о погоде", "Этот поезд прибывает на третий путь через десять минут"]


def accepted(identifier, texts):
    raw = [t.encode() for t in texts]
    return identifier.judge(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))[3]


def test_wrong_labels_do_not_widen_the_limit():
    rng = random.Random(7)
    samples = {lang: [text(rng, syllables, rng.randint(3, 200)) for _ in range(200)] for lang, syllables in LANGS.items()}
    probes = [text(rng, syllables, rng.randint(3, 200)) for syllables in LANGS.values() for _ in range(100)]
    for noise in ([], FOREIGN[:1], FOREIGN[:2], ["x1 zq ### 77 qqq"]):
        noisy = {k: list(v) for k, v in samples.items()}
        for own in noisy.values():
            for j, t in enumerate(noise):
                own[(j + 1) * li.HELD_OUT - 1] = t  # held out
        identifier = li.Identifier(noisy)
        assert not accepted(identifier, FOREIGN).any()
        assert accepted(identifier, probes).mean() > 0.98
