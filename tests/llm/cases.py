"""Rows that every operator on documents must bear: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("key", "id", "h", "p", "f0", "root", "spans", "tokens", "place", "chunk", "language")]])


def frame(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    ids = ids or list(range(n))
    langs = langs or ["en"] * n
    sources = sources or [f"s{i % 2}" for i in range(n)]
    rows = [(i, t, la, s, None if t is None else len(t), *["clash"] * 11) for i, t, la, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{i} of{i % 7}" for i in range(40000))
HARD = [None, "", " \n\t ", "a", "é", "日本語のテキスト", "same words here", "same words here", LONG, "\x00\x01", "🙂 🙂"]


def hard(spark):
    ids = [None, 1, 2, 3, 4, 5, 6, 6, 8, 9, None]
    langs = ["en", None, "en", "en", "fr", None, "en", "en", "en", None, "xx"]
    return frame(spark, HARD, langs, [None, "a", "a", "a", None, "b", "b", "b", "c", "c", "c"], ids)
