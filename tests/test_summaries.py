"""Summaries of long texts: each step once, and the same as over the whole text where the head doesn't do."""

import random
import re

from pyspark.sql import functions as F

from presswork.functions import text as tx

from .test_functions import run, table


def split(v):
    return [s.strip() for s in re.split(r"(?<=[。！？；;])\s*|(?<=[.!?])\s+", v) if s.strip()][:3]


def pack(v):
    for p in (r"责任编辑[:：]\s*\S+", r"责编[:：]\s*\S+", r"点击进入专题[:：]?.*$", r"更多精彩内容.*$", r"免责声明[:：].*$", r"版权声明[:：].*$"):
        v = re.sub(p, "", v)
    v = re.sub(r"\s+", " ", v).strip()
    if not v:
        return tx.NO_SUMMARY
    english = len(re.findall(r"\b[A-Za-z][A-Za-z0-9'-]*\b", v)) > len(re.findall("[一-鿿]", v))
    size, most, sign = (lambda s: len(s.split()), 90, " ") if english else (len, 180, "")
    out = ""
    for s in split(v):
        if out and (size(out) if english else len(out)) + size(s) > most:
            break
        out = out + sign + s if out else s
    out = out or v
    if english:
        return re.sub("[ ,;:]+$", "", " ".join(out.split()[:90])) + "..." if len(out.split()) > 90 else out
    return re.sub("[，,；;：: ]+$", "", out[:180]) + "……" if len(out) > 180 else out


def texts():
    r = random.Random(5)
    signs = ["word", "other ", " x", "3.14", ". ", ".", "! ", "? ", "；", "。", "。 ", " ", ", ", "中国", "证券", "é", "😀", "责任编辑：某人 ", "免责声明：", "责任"]
    out = ["".join(r.choices(signs, [9, 9, 5, 1, s, s, s, s, h / 2, h / 2, h / 2, 9, 1, 3 * h, 3 * h, 1, 1, n, n / 5, n], k=r.choice([3, 30, 300, 900]))) for s in (0, 0.05, 1) for h in (0, 0.05, 3) for n in (0, 0.1) for _ in range(12)]
    for at in range(994, 1004):  # ends about the head's border
        for end in (". ", ".  ", "。", "。 ", ".", "。  x"):
            out += ["One. Two. " + "a" * (at - 10) + end + "Rest is here. And more.", "一。二。" + "字" * (at - 4) + end + "其余。再多。", "a" * at + end, "One. Two. Three. " + "b" * at]
    return out + [" ".join(["word"] * n) + end for n in (89, 90, 91, 92, 93, 200) for end in ("", ".", ". One. Two.", " ")]


def test_summaries_are_those_of_the_whole_text(spark):
    values = texts()
    assert run(spark, values, tx.sentences) == [split(v) for v in values]
    assert run(spark, values, lambda c: tx.pack_summary(tx.clean(c, False))) == [pack(re.sub(r"\s+", " ", v).strip()) for v in values]
    english = lambda v: len(re.findall(r"\b[A-Za-z][A-Za-z0-9'-]*\b", v)) > len(re.findall("[一-鿿]", v))
    assert run(spark, values, tx.is_english) == [english(v) for v in values]


def test_each_step_is_computed_once(spark):
    plan = table(spark, ["a. b."]).repartition(2).select(tx.pack_summary(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("责任编辑[:：]") == 1 and plan.count("aggregate(") == 2
