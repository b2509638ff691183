"""Text functions with the reference's character classes: Unicode white space, lengths in code points."""

from __future__ import annotations

import difflib
import html
from collections.abc import Callable, Sequence
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x1c-\x1f]"
NUMBER = r"\d+(?:\.\d+)?"
_LATIN, _HAN = r"[A-Za-z][A-Za-z0-9'-]*", r"[\x{4e00}-\x{9fff}]"
_EDGES = rf"(?U)^{SPACE}+|{SPACE}+$"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it (a repeated expression isn't, within branches and lambdas)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end (trim takes spaces alone)."""
    return F.regexp_replace(text, _EDGES, "")


#: Runs of white space that aren't one space already: most aren't touched.
_RUNS = rf"(?U) {SPACE}+|[\s\x1c-\x1f&&[^ ]]{SPACE}*"


def squeeze(text: Column) -> Column:
    """Each run of Unicode white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """HTML entities decoded. Only texts with an ampersand go to Python."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def clean(text: Column, entities: bool = True) -> Column:
    """Tags as spaces, then entities decoded, then white space squeezed: once, since a second pass would strip tags that were entities."""
    own = F.coalesce(text, F.lit(""))
    bare = F.when(F.contains(own, F.lit("<")), F.regexp_replace(own, "<[^>]+>", " ")).otherwise(own)
    return squeeze(unescape(bare) if entities else bare)


def markdown(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def replace_all(text: Column, terms: Sequence[str], by: str) -> Column:
    for term in terms:
        text = F.replace(text, F.lit(term), F.lit(by))
    return text


def truncate(text: Column, most: int, entities: bool = True) -> Column:
    """Cleaned; beyond most characters, the first of them without white space at their end, and an ellipsis."""
    own = clean(text, entities)
    return F.when(F.length(own) > most, F.concat(F.regexp_replace(F.substring(own, 1, most), rf"(?U){SPACE}+$", ""), F.lit("……"))).otherwise(own)


_NOISE = [r"(?iU)责任编辑[:：]\s*\S+", r"(?iU)责编[:：]\s*\S+", r"(?iU)点击进入专题[:：]?.*$", r"(?iU)更多精彩内容.*$", r"(?iU)免责声明[:：].*$", r"(?iU)版权声明[:：].*$"]

#: One of these is in every text that a pattern changes.
_NOISY = "责任编辑 责编 点击进入专题 更多精彩内容 免责声明 版权声明".split()


def strip_noise(cleaned: Column) -> Column:
    def stripped(own: Column) -> Column:
        bare = own
        for pattern in _NOISE:
            bare = F.regexp_replace(bare, pattern, "")
        return squeeze(F.when(F.greatest(*[F.contains(own, F.lit(t)) for t in _NOISY]), bare).otherwise(own))

    return once(cleaned, stripped)


def is_english(text: Column) -> Column:
    """More Latin words than CJK characters; without any of these, one word tells."""
    latin = rf"(?U)\b{_LATIN}\b"
    return once(text, lambda own: F.when(own.rlike(_HAN), F.regexp_count(own, F.lit(latin)) > F.regexp_count(own, F.lit(_HAN))).otherwise(own.rlike(latin)))


#: Characters in which most texts have their first sentences.
_HEAD = 1000


def sentences(text: Column, most: int = 3) -> Column:
    """The first sentences, from the text's head where it has that many: an end within it is one of the text too, and each sentence but the last has its sign, so isn't empty."""
    after = lambda signs: f"(?<=[{signs}])"
    split = lambda x: F.split(x, after("。！？；;") + r"(?U:\s*)|" + after(".!?") + r"(?U:\s+)")

    def first(own: Column) -> Column:
        parts = once(split(F.substring(own, 1, _HEAD)), lambda p: F.when((F.size(p) > most) | (F.length(own) <= _HEAD), p).otherwise(split(own)))
        return F.filter(F.transform(F.slice(parts, 1, most), strip), lambda s: s != "")

    return once(text, first)


def first_words(text: Column, most: int) -> Column:
    """All words if they are no more than most, else more than most: those, one or two others, and the rest unsplit."""
    return F.filter(F.split(text, rf"(?U){SPACE}+", most + 3), lambda w: w != "")


def truncate_words(text: Column, most: int) -> Column:
    cut = lambda own: F.concat(F.regexp_replace(F.array_join(F.slice(own, 1, most), " "), "[ ,;:]+$", ""), F.lit("..."))
    return once(text, lambda whole: once(first_words(whole, most), lambda own: F.when(F.size(own) > most, cut(own)).otherwise(whole)))


SUMMARY_CHARS, SUMMARY_WORDS = 180, 90
NO_SUMMARY = "这条新闻的 RSS 摘要信息较少，当前仅能确认标题所述事件。建议打开原文查看完整背景和后续细节。"


def pack_summary(cleaned: Column, fallback: str = NO_SUMMARY) -> Column:
    """As many of the first three sentences of a cleaned text as fit, the first always; hard caps; a fallback where nothing is left.

    The text must be a column already: a Python function (for entities) can't stand within a higher-order one.
    """
    return once(strip_noise(cleaned), lambda own: _packed(own, fallback))


def _packed(own: Column, fallback: str) -> Column:
    parts = sentences(own)
    count = lambda s: F.size(first_words(s, SUMMARY_WORDS))  # noqa: E731 - beyond these the number doesn't matter

    def add(fits, join):
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("over"))
        step = lambda acc, s: F.when(acc["over"] | ((acc["text"] != "") & ~fits(acc, s)), F.struct(acc["text"].alias("text"), acc["n"].alias("n"), F.lit(True).alias("over"))).otherwise(
            F.struct(F.when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit(join), s)).alias("text"), (acc["n"] + count(s)).alias("n"), F.lit(False).alias("over"))
        )
        return F.aggregate(parts, start, step, lambda acc: F.coalesce(F.nullif(acc["text"], F.lit("")), own))

    english = truncate_words(add(lambda acc, s: acc["n"] + count(s) <= SUMMARY_WORDS, " "), SUMMARY_WORDS)
    cut = lambda text: F.concat(F.regexp_replace(F.substring(text, 1, SUMMARY_CHARS), "[，,；;：: ]+$", ""), F.lit("……"))
    other = once(add(lambda acc, s: F.length(acc["text"]) + F.length(s) <= SUMMARY_CHARS, ""), lambda text: F.when(F.length(text) <= SUMMARY_CHARS, text).otherwise(cut(text)))
    return F.when(own == "", F.lit(fallback)).when(is_english(own), english).otherwise(other)


def normalized_title(title: Column) -> Column:
    """Lower case, amounts in billions as "1.45b", then everything but a-z, 0-9 and CJK as a space (the point of an amount too)."""
    own = F.lower(title)
    for before, unit in ((r"\$\s?", "(?:b|bn|billion)"), (r"\b", "billion")):
        own = F.regexp_replace(own, rf"(?U){before}({NUMBER})\s?{unit}\b", "$1b")
    return F.trim(F.regexp_replace(own, r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def story_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")


def negated_parts(text: Column, markers: Sequence[str] = ("没有", "无"), ends: str = "。；;\\n") -> Column:
    """From each negation to the clause's end; a later one in the same clause is part of it."""
    return F.regexp_extract_all(text, F.lit(f"(?:{'|'.join(markers)})[^{ends}]*"), F.lit(0))


def review_text(text: Column) -> Column:
    """One line, HTML-escaped, Markdown signs behind backslashes."""
    own = squeeze(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        own = F.replace(own, F.lit(a), F.lit(b))
    for sign in "\\`*_[]()#!>|~":
        own = F.replace(own, F.lit(sign), F.lit("\\" + sign))
    return own


def safe_token(text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    return F.when(own.rlike(r"\A[A-Za-z0-9_.:-]*\z"), own).otherwise("redacted")


def safe_diagnostic(text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    return F.when(F.length(own) > 128, "redacted").otherwise(safe_token(own))


def metadata_text(text: Column) -> Column:
    return F.substring(squeeze(F.coalesce(text, F.lit(""))), 1, 256)


def failure_code(error: Column) -> Column:
    own = F.lower(F.coalesce(error, F.lit("")))
    any_of = lambda *terms: F.greatest(*[F.contains(own, F.lit(t)) for t in terms])
    return F.when(any_of("timeout", "timed out"), "timeout").when(any_of(*"parse json xml bozo".split()), "parse_error").when(any_of("http", "url", "network", "connect"), "network_error").otherwise("unknown_failure")


def language(value: Column) -> Column:
    own = F.replace(F.lower(strip(F.coalesce(value, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(own == "zh-cn", "zh-CN").when(own == "en", "en").otherwise("und")


def source_key(source: Column, feed: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), feed)


#: A name and what it says of itself or others.
CLAIM = r"[\x{4e00}-\x{9fff}·]{2,12}称" + f"(?:{'|'.join('已 将 正 未 没有 不会 可以 可能 美 中 其 该'.split())})"


def has_attribution(text: Column, markers: Sequence[str], clause: str = CLAIM) -> Column:
    own = F.lower(text)
    return F.greatest(F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(own, m)), own.rlike(clause))


def format_published(published: Column, updated: Column, at: Column, entities: bool = True) -> Column:
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", clean(c, entities))
    return F.coalesce(given(published), given(updated), iso_utc(at), F.lit("Unknown"))


def iso_utc(at: Column) -> Column:
    """ISO 8601 with +00:00, microseconds only where there are some; in a UTC session."""
    return F.when(F.date_format(at, "SSSSSS") == "000000", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def similar(first: str, second: str, least: float) -> bool:
    """Whether the ratio of matching blocks reaches least; the order of the two matters."""
    match = difflib.SequenceMatcher(None, first, second)
    return match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least


@F.pandas_udf(T.DoubleType())
def sequence_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of (candidate, existing)."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(first, second)], dtype="float64")


def _parse_mail_date(value: str | None) -> pd.Timestamp | None:
    try:
        at = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    stamp = pd.Timestamp(at)
    return stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp.tz_convert("UTC")


@F.pandas_udf(T.TimestampType())
def mail_date(values: pd.Series) -> pd.Series:
    """RFC 2822 dates in UTC; null where there is none."""
    return pd.to_datetime(pd.Series([_parse_mail_date(v) for v in values], index=values.index, dtype="object"), utc=True)


def entry_time(published_ts: Column, updated_ts: Column, published: Column, updated: Column) -> Column:
    """The parsed time, else the text of one, else null. Plain RFC 2822 texts are parsed without Python."""
    plain = lambda c: F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    known = F.coalesce(published_ts, updated_ts)
    return F.coalesce(known, plain(published), mail_date(F.when(known.isNull() & plain(published).isNull(), published)), plain(updated), mail_date(F.when(known.isNull() & plain(updated).isNull(), updated)))


def digest_time(at: Column, published: Column) -> Column:
    return F.coalesce(F.date_format(F.coalesce(at, mail_date(F.when(at.isNull(), published))), "MM-dd HH:mm"), F.nullif(published, F.lit("")), F.lit("Unknown"))


def percent(value: Column) -> Column:
    """+0.52%; ties go to the even digit of the binary value, as decimals of it do."""
    text = F.format_string("%.2f%%", F.bround(value.cast("decimal(38,20)"), 2).cast("double"))
    return F.when(value.isNull(), "涨跌幅 数据暂不可用").otherwise(F.concat(F.when(value > 0, "+").otherwise(""), text))


def amount(value: Column) -> Column:
    return F.when(value.isNull(), "成交额 数据暂不可用").otherwise(F.concat(F.lit("成交额 "), F.format_string("%.1f", F.bround((value / 1e8).cast("decimal(38,20)"), 1).cast("double")), F.lit(" 亿")))


def quote_meta(source: Column, as_of: Column) -> Column:
    parts = F.filter(F.array(F.when(source != "", F.concat(F.lit("来源 "), source)), F.when(as_of != "", F.concat(F.lit("截至 "), as_of))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit("，"), F.array_join(parts, "，"))).otherwise("")
