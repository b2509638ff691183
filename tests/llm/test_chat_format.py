import random

import pytest

from presswork.llm import chat_format as cf

TOKENS = ["<|turn|>", "<|end|>", "<|null|>", "<\\|", "<\\\\|", "<|", "|>", "\n", "a", "%0A", "%25", "%", "<", "\\", "é"]


def test_round_trip_of_anything():
    rng = random.Random(1)
    for _ in range(3000):
        word = lambda: None if rng.random() < 0.1 else "".join(rng.choice(TOKENS) for _ in range(rng.randint(0, 6)))
        turns = [(word(), word()) for _ in range(rng.randint(0, 4))]
        text, _ = cf.render(turns)
        assert cf.parse(text) == turns


def test_plain_text_is_not_touched():
    text, escaped = cf.render([("user", "a < b | c"), ("assistant", "")])
    assert text == "<|turn|>user\na < b | c<|end|>\n<|turn|>assistant\n<|end|>\n" and escaped == 0


@pytest.mark.parametrize("bad", ["x", "<|turn|>user", "<|turn|>user\nx<|end|>", "<|turn|>a\nb<|turn|>c\nd<|end|>\n", "<|turn|>user<|end|>\n"])
def test_what_is_no_rendering(bad):
    with pytest.raises(cf.Malformed):
        cf.parse(bad)


def test_conversations(spark):
    rows = [(1, 1, "b", "two", "x"), (1, 0, "a", "<|end|>", "x"), (None, 0, None, None, "x"), (None, None, "a", "", "x"), (2, 0, "a", "t", "x"), (2, 0, "a", "t", "x"), (3, 0, "a", "y" * 300000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in cf.chat(df).collect()}
    assert cf.parse(got[1]["rendered"]) == [("a", "<|end|>"), ("b", "two")] and got[1]["n_escaped"] == 1
    assert cf.parse(got[None]["rendered"]) == [("a", ""), (None, None)] and got[2]["n_turns"] == 2 and len(got[3]["rendered"]) > 300000
    assert cf.chat(df.limit(0)).count() == 0
