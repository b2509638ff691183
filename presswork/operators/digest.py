"""The digest's sections: greedy picks in order of importance under caps, each checked against what was picked before."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReportConfig
from ..functions.digest import scored
from ..functions.text import similar
from ..functions.vocab import Vocabulary, default_vocabulary, contains_any
from ..functions import text as tx
from ..shared import stage, where_computed
from .select import Rows, fold, ranked

SECTIONS = ("core", "market", "watch", "quick_scan")
_CJK, _NUMBER = re.compile("[一-鿿]"), re.compile(tx.NUMBER)
_KEYS = ["ord", "section", "importance", "title_length", "published_at", "deal_key", "discussion_key", "title_key", "source_key", "link", "quick_scannable"]


def order() -> list:
    """Score, then title length, then time, all descending; arrival last."""
    return [F.col("importance").desc(), F.col("title_length").desc(), F.col("published_at").desc_nulls_last(), F.col("ord")]


def same_event(new: dict, old: dict, ratio: float = 0.78, least: int = 12) -> bool:
    """Equal keys, or CJK titles with the same numbers and much the same characters. Not transitive, and its order matters."""
    if new["deal_key"] and new["deal_key"] == old["deal_key"] or new["discussion_key"] and new["discussion_key"] == old["discussion_key"]:
        return True
    a, b = new["title_key"], old["title_key"]
    if min(len(a), len(b)) < least or not _CJK.search(a + b) or _NUMBER.findall(a) != _NUMBER.findall(b):
        return False
    return similar(a, b, ratio)


def _pick(kind: str, cap: int, per_source: int | None, before: Sequence[dict], used: set[str] = frozenset()):
    def choose(rows: Rows) -> Rows:
        picked, sources = [], {}
        if cap <= 0:
            return
        for row in rows:
            if row["link"] in used or any(same_event(row, old) for old in (*before, *picked)):
                continue
            source = row["source_key"]
            if per_source is not None and sources.get(source, 0) >= per_source:
                continue
            sources[source] = sources.get(source, 0) + 1
            picked.append(row)
            yield {"ord": row["ord"], "section": kind, "rank": len(picked)} | {k: row[k] for k in ("deal_key", "discussion_key", "title_key", "link")}
            if len(picked) >= cap:
                return

    return choose


_PICKED = "ord long, section string, rank int, deal_key string, discussion_key string, title_key string, link string"
#: Rows of a section that are looked at first for each that it may show; four times as many where these don't fill it, up to MOST rows, beyond which a task folds over all.
FIRST, MOST = 16, 1 << 16


class _Heads:
    """The first rows of each section in order: one job gives those of all sections, by a top-n in each partition."""

    def __init__(self, narrow: DataFrame, caps: dict[str, int]) -> None:
        self.parts = {k: narrow.where("quick_scannable" if k == "quick_scan" else F.col("section") == k) for k in caps}
        self.sizes = {k: FIRST * max(n, 1) for k, n in caps.items()}
        self.rows: dict[str, list[dict]] = {k: [] for k in caps}
        self._read(list(caps))

    def _read(self, kinds: list[str]) -> None:
        if kinds:
            found = [ranked(self.parts[k], order(), self.sizes[k], "_rank").withColumn("_kind", F.lit(k)) for k in kinds]
            got: dict[str, list[dict]] = {k: [] for k in kinds}
            for r in reduce(DataFrame.unionByName, found).collect():  # no more than MOST of each
                got[r["_kind"]].append(r.asDict())
            self.rows |= {k: sorted(v, key=lambda r: r["_rank"]) for k, v in got.items()}

    def pick(self, kind: str, cap: int, choose) -> list[dict]:
        while True:
            picked = list(choose(iter(self.rows[kind])))
            if len(picked) >= cap or len(self.rows[kind]) < self.sizes[kind]:
                return picked
            if 4 * self.sizes[kind] > MOST:
                return [r.asDict() for r in fold(self.parts[kind], order(), choose, _PICKED).collect()]  # at most cap rows
            self.sizes[kind] *= 4
            self._read([kind])


def sections(items: DataFrame, config: ReportConfig, vocabulary: Vocabulary | None = None, entities: bool = True) -> DataFrame:
    """items (ord, title, summary, source, feed_name, feed_role, link, published_at, matched_keywords) that a digest shows, with section and rank.

    Items are scored once; of each section the first rows in order are looked at, more of them until it is full, and no more than the caps are shown.
    """
    narrow = where_computed(scored(items, vocabulary, config, entities).select(*_KEYS), F.col("section").isNotNull() | F.col("quick_scannable"))
    narrow = stage(narrow, "scored")  # all sections read it: as a table it is scored once
    kinds = [("core", config.max_core_events, None), ("market", config.max_market_signals, config.max_market_signals_per_source), ("watch", config.max_watch_items, None)]
    kinds += [("quick_scan", config.max_quick_scan_items, config.max_quick_scan_items_per_source)] if config.include_quick_scan else []
    heads = _Heads(narrow, {kind: cap for kind, cap, _ in kinds})
    picked: list[dict] = []
    for kind, cap, per_source in kinds:
        used = {p["link"] for p in picked} if kind == "quick_scan" else frozenset()
        picked += heads.pick(kind, cap, _pick(kind, cap, per_source, list(picked), used))
    shown = items.sparkSession.createDataFrame([(p["ord"], p["section"], p["rank"]) for p in picked], "_ord long, section string, rank int")
    return items.join(F.broadcast(shown), F.col("ord") == F.col("_ord")).drop("_ord")  # as many rows as the caps allow


def theme_line(shown: DataFrame, vocabulary: Vocabulary | None = None) -> str:
    """One sentence on the sections of a digest."""
    v = vocabulary or default_vocabulary()
    text, main = F.col("_text"), F.col("section") != "quick_scan"
    n = shown.withColumn("_text", F.lower(tx.clean(F.concat_ws(" ", "title", "summary")))).agg(
        F.count_if(main).alias("main"), F.count_if(~main).alias("quick"), F.count_if(F.col("section") == "market").alias("market"), F.count_if(main & contains_any(text, v["overseas_rate"])).alias("rates"), F.count_if(main & contains_any(text, v["policy"])).alias("policy")
    ).first()
    spread = "主线信号仍不够集中，建议重点扫读政策、市场与科技产业动态的后续变化。"
    if n["main"] <= 1:
        return "主栏目有效信号偏少，可通过快速扫读补充了解政策、科技产业与外围市场动态。" if n["quick"] else spread
    if n["rates"] >= 3:
        return "今天重点关注海外风险偏好和汇率利率变化对 A 股情绪的影响。"
    if n["policy"] >= 3:
        return "前三个主栏目中政策相关信息较多，建议继续观察后续落地和市场反馈。"
    return "市场信号较多但主线分散，建议重点观察股价、估值、业绩与政策相关线索。" if n["market"] >= 3 else spread
