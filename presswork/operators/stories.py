"""The overnight brief's selections: stories that aren't told twice, what to watch, alerts, and evidence of curated events."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import normalize_link
from ..functions.text import similar
from .select import Rows, fold

_OTHER = re.compile("[^0-9a-z一-鿿]+")


def key(title: str | None) -> str:
    return _OTHER.sub("", (title or "").lower())


def same_story(new: dict, old: dict, ratio: float = 0.88, contained: int = 4, least: int = 10) -> bool:
    """The same link, equal keys, one within the other, or much the same characters."""
    link = (new.get("link") or "").strip()
    if link and link == (old.get("link") or "").strip():
        return True
    a, b = key((new.get("title") or "").strip()), key((old.get("title") or "").strip())
    if not a or not b:
        return False
    short = min(len(a), len(b))
    return a == b or short >= contained and (a in b or b in a) or short >= least and similar(a, b, ratio)


def unique_stories(rows: DataFrame, order: Sequence[F.Column], reserved: Iterable[dict], limit: int) -> DataFrame:
    """rows (title, link, ...) in order that tell none of the reserved stories nor one picked before."""
    before = [{"title": r.get("title"), "link": r.get("link")} for r in reserved]

    def choose(found: Rows) -> Rows:
        picked: list[dict] = []
        for row in found if limit > 0 else ():
            if not any(same_story(row, old) for old in (*before, *picked)):
                picked.append(row)
                yield row
                if len(picked) >= limit:
                    return

    return fold(rows, order, choose, rows.schema)


def watch_points(points: Iterable[str | None], displayed: Iterable[str | None] = (), limit: int = 3) -> list[str]:
    """The first points that aren't blank, repeated or about a displayed title."""
    told = [k for k in map(key, displayed) if k]
    own = dict.fromkeys(p.strip() for p in points if p and p.strip())
    return [p for p in own if not any(t in key(p) for t in told)][:limit]


def evidence(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """events (event_ord, evidence_article_ids) exploded and joined to candidates; unknown ids go, the order of ids stays in pos."""
    ids = events.select("event_ord", F.posexplode("evidence_article_ids").alias("pos", "article_id"))
    return ids.join(candidates.select("article_id", "title", "source", "link", "normalized_link"), "article_id")


def events_of_holding(events: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """(holding_title, event_ord): events with evidence among the links of a holding's clear matches, each once (a semi join)."""
    clear = matches.where(F.coalesce("holding_relation", F.lit("")).isin("", "明确相关") & (F.coalesce("link", F.lit("")) != "")).select("holding_title", normalize_link(F.col("link")).alias("_norm")).distinct()
    told = evidence(events, candidates).select("event_ord", normalize_link(F.coalesce(F.nullif("link", F.lit("")), "normalized_link")).alias("_norm")).where("_norm <> ''")
    return told.join(clear, "_norm").select("holding_title", "event_ord").distinct()


def partitions(events: DataFrame, market: Sequence[str] = ("financial_markets", "energy_commodities")) -> tuple[DataFrame, DataFrame]:
    """(core, market) by category."""
    is_market = F.col("category").isin(*market)
    return events.where(~is_market), events.where(is_market)
