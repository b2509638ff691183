"""Vocabularies as data, and term matching as expressions.

A term matches where its lower case is contained in the text's lower case: a substring, not a token.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Vocabulary = Mapping[str, tuple[str, ...]]


@lru_cache(maxsize=1)
def default_vocabulary() -> dict[str, tuple[str, ...]]:
    """Terms by name, in their order; a term may stand twice."""
    out: dict[str, list[str]] = {}
    for line in (Path(__file__).parent / "vocabulary.tsv").read_text(encoding="utf-8").split("\n"):
        if line:
            name, term = line.split("\t")
            out.setdefault(name, []).append(term)
    day = r"\d{1,2}"
    # a date with its year holds the date without it
    return {k: tuple(v) for k, v in out.items()} | {"watch_time": (f"{day}月{day}日(?:{'|'.join(out['watch_time_verb'])})",)}


def vocabulary_frame(spark: SparkSession, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(vocab, ord, term)."""
    rows = [(name, i, term) for name, terms in (vocabulary or default_vocabulary()).items() for i, term in enumerate(terms)]
    return spark.createDataFrame(rows, "vocab string, ord int, term string")


_PART = "\x1f"


def _terms(terms: Sequence[str]) -> Column:
    """An array literal, once the optimizer has folded it; one literal is far quicker to build than one for each term."""
    return F.split(F.lit(_PART.join(terms)), _PART) if terms else F.array().cast("array<string>")


def _bound(text: Column, say: Callable[[Column], Column]) -> Column:
    """say(text) with the text computed once: the optimizer may put its expression in place of a column, and within a lambda that would be done for each term."""
    return F.get(F.transform(F.array(text), say), F.lit(0))


def matched_terms(lowered: Column, terms: Sequence[str]) -> Column:
    """The terms found in a text that is in lower case already, in their order, as often as they are listed."""
    lower = [t.lower() for t in terms]
    if lower == list(terms):
        return _bound(lowered, lambda x: F.filter(_terms(terms), lambda t: F.contains(x, t)))
    own = _terms(lower)
    return _bound(lowered, lambda x: F.filter(_terms(terms), lambda _, i: F.contains(x, F.get(own, i))))


#: Terms up to which each is looked for by an expression; more are one automaton, which reads a text once.
FEW_TERMS = 200


def contained(lowered: Column, terms: Sequence[str]) -> Column:
    """Those of the distinct lower-case terms that a text in lower case contains, in no order; none for a null text. An empty term is in none."""
    own = sorted({t for t in terms if t})
    none = F.array().cast("array<string>")
    if len(own) <= FEW_TERMS:
        return F.coalesce(matched_terms(lowered, own), none) if own else none

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scan(texts: pd.Series) -> pd.Series:
        machine = _machine(tuple(own))
        return pd.Series([list({t for _, t in machine.iter(x)}) if x else [] for x in texts], dtype="object")

    return scan(lowered)


@lru_cache(maxsize=2)
def _machine(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """One for each worker and list."""
    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t, t)
    out.make_automaton()
    return out


def distinct_terms(lowered: Column, terms: Sequence[str]) -> Column:
    return F.array_distinct(matched_terms(lowered, terms))


def count_terms(lowered: Column, terms: Sequence[str]) -> Column:
    """How many list entries are found; entries that differ in case alone count each."""
    return F.coalesce(F.size(matched_terms(lowered, [t.lower() for t in terms])), F.lit(0))


def contains_any(lowered: Column, terms: Sequence[str]) -> Column:
    own = _terms(list(dict.fromkeys(t.lower() for t in terms)))
    return F.coalesce(_bound(lowered, lambda x: F.exists(own, lambda t: F.contains(x, t))), F.lit(False))


def first_term(terms: Column) -> Column:
    return F.try_element_at(terms, F.lit(1))


def match_keywords(lowered: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Category to the keywords found, in file order, without the categories that have none."""
    if not keywords:
        return F.create_map().cast("map<string,array<string>>")
    hits = F.map_from_arrays(_terms(list(keywords)), F.array(*[matched_terms(lowered, k) for k in keywords.values()]))
    return F.map_filter(hits, lambda _, v: F.size(v) > 0)


def format_matched(matched: Column) -> Column:
    """category: a, b; category: c."""
    return F.array_join(F.transform(F.map_entries(matched), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", "))), "; ")


def category_label(matched: Column, feed: Column, source: Column) -> Column:
    """The first category matched, else the feed, else the source."""
    return F.coalesce(first_term(F.map_keys(matched)), F.nullif(feed, F.lit("")), source)
