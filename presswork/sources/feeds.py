"""Feeds and keywords from configuration, and feed entries as a data source: one partition for each feed.

Without the option network, only files are read: captured payloads beside the list, so that tests and repeats need no network.
"""

from __future__ import annotations

import logging
import time
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import FEED_ROLES, load_json
from ..functions.text import _parse_mail_date

_LOG = logging.getLogger(__name__)
TIMEOUT_S, ATTEMPTS, DELAY_S = 15, 2, 3
_LANGUAGES = {"zh-cn": "zh-CN", "en": "en", "und": "und"}


def language(value: Any) -> str:
    return _LANGUAGES.get(str(value or "").strip().replace("_", "-").lower(), "und")


def normalize_feeds(raw: Any, strict: bool = True) -> list[dict[str, str]]:
    """Feeds with their defaults. Health checks aren't strict: they take any mode and role, and keep the category."""
    if not isinstance(raw, list):
        raise ValueError("feeds must be a list of objects")
    out = []
    for i, feed in enumerate(raw, 1):
        if not isinstance(feed, Mapping):
            raise ValueError(f"feed {i} must be an object")
        word = lambda key, default="": str(feed.get(key, default)).strip()  # noqa: B023, E731
        row = {"name": word("name"), "url": word("url"), "mode": word("mode", "keyword").lower() or "keyword", "role": word("role", "general").lower() or "general", "language": language(feed.get("language"))}
        if not (row["name"] and row["url"]):
            raise ValueError(f"feed {i} needs a name and a url")
        if strict and row["mode"] not in ("keyword", "all"):
            raise ValueError(f"feed {i}: mode is keyword or all")
        if strict and row["role"] not in FEED_ROLES:
            raise ValueError(f"feed {i}: role is one of {', '.join(sorted(FEED_ROLES))}")
        out.append(row if strict else row | {"category": word("category")})
    return out


def normalize_keywords(raw: Any) -> dict[str, list[str]]:
    """Categories in file order with their trimmed keywords; empty ones go."""
    if not isinstance(raw, Mapping):
        raise ValueError("keywords must be an object of categories")
    out: dict[str, list[str]] = {}
    for category, values in raw.items():
        if not isinstance(values, list):
            raise ValueError(f"keywords of {category!r} must be a list")
        if kept := [w for w in (str(v).strip() for v in values) if w]:
            out[str(category)] = kept
    return out


def feed_frame(spark: SparkSession, feeds: list[dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, f["name"], f["url"], f["mode"], f["role"], f["language"]) for i, f in enumerate(feeds)], "feed_ord int, name string, url string, mode string, role string, language string")


def keyword_frame(spark: SparkSession, keywords: Mapping[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(i, c, k, w) for i, (c, ws) in enumerate(keywords.items()) for k, w in enumerate(ws)], "category_ord int, category string, keyword_ord int, keyword string")


ENTRY_SCHEMA = (
    "feed_name string, feed_role string, feed_ord int, entry_ord int, language string, title string, link string, summary string, description string, author string, "
    "published string, updated string, published_ts timestamp, updated_ts timestamp, error string"
)
_TAGS = {"title": "title", "summary": "summary", "description": "description", "author": "author", "creator": "author", "pubDate": "published", "published": "published", "updated": "updated", "date": "published", "content": "summary", "encoded": "summary"}


def parse_payload(payload: bytes) -> tuple[list[dict[str, str]], str]:
    """(entries, error) of RSS or Atom. A document that breaks off keeps the entries before the break; a whole one without entries has neither."""
    entries: list[dict[str, str]] = []
    error = ""
    parser = ET.XMLPullParser(["end"])
    try:
        for lo in range(0, len(payload), 1 << 16):
            parser.feed(payload[lo : lo + (1 << 16)])
            _take(parser, entries)
        parser.close()
    except ET.ParseError as failure:
        error = str(failure)
    _take(parser, entries)
    return entries, error


def _take(parser: ET.XMLPullParser, entries: list[dict[str, str]]) -> None:
    try:
        for _, node in parser.read_events():
            if node.tag.rpartition("}")[2] in ("item", "entry"):
                entries.append(_entry(node))
    except ET.ParseError:  # it is reported by close
        pass


def _entry(node: ET.Element) -> dict[str, str]:
    out: dict[str, str] = {}
    for child in node:
        tag = child.tag.rpartition("}")[2]
        if tag == "link":
            if not out.get("link") or child.get("rel", "alternate") == "alternate":
                out["link"] = child.get("href") or (child.text or "").strip()
        elif tag in _TAGS:
            text = "".join(child.itertext()).strip()
            if text:
                out.setdefault(_TAGS[tag], text)
    return out


def fetch(url: str, network: bool) -> bytes:
    """A file's or URL's bytes."""
    if "://" not in url or url.startswith("file://"):
        return Path(url.removeprefix("file://")).read_bytes()
    if not network:
        raise RuntimeError("the network isn't allowed here: option network")
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/rss+xml, application/atom+xml, text/xml"}), timeout=TIMEOUT_S) as answer:
        return answer.read()


def scan(url: str, network: bool, attempts: int = ATTEMPTS, delay_s: float = DELAY_S, get: Callable[[str, bool], bytes] = fetch) -> tuple[list[dict[str, str]], str]:
    """(entries, error) of a feed. It is tried again where it can't be had or nothing can be read of it; what an attempt can read of it, and a whole feed without entries, stands."""
    error = "no attempt"
    for left in range(attempts - 1, -1, -1):
        try:
            entries, error = parse_payload(get(url, network))
            if entries or not error:
                return entries, error
        except Exception as failure:  # one feed's failure is a row, not the end of the others
            error = str(failure) or type(failure).__name__
        if left and network:
            time.sleep(delay_s)
    return [], error


class _Feed(InputPartition):
    def __init__(self, ord: int, feed: dict[str, str]) -> None:
        super().__init__(ord)
        self.ord, self.feed = ord, feed


class FeedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.feeds = normalize_feeds(load_json(options["path"]), str(options.get("strict", "true")).lower() == "true")
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.base, self.network = Path(options["path"]).parent, str(options.get("network", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Feed(i, f) for i, f in enumerate(self.feeds)]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        feed, url = partition.feed, partition.feed["url"]
        head = (feed["name"], feed["role"], partition.ord)
        entries, error = scan(url if "://" in url else str(self.base / url), self.network, self.attempts)
        if error and entries:
            _LOG.warning("feed %s (%s) is malformed, its %d readable entries are kept: %s", feed["name"], url, len(entries), error)
        elif error:
            _LOG.warning("feed %s (%s) failed: %s", feed["name"], url, error)
            yield (*head, None, feed["language"], *[None] * 9, error)
        at = lambda v: None if (t := _parse_mail_date(v) or _iso(v)) is None else t.to_pydatetime()
        for i, e in enumerate(entries):
            yield (*head, i, feed["language"], *[e.get(c) for c in ("title", "link", "summary", "description", "author", "published", "updated")], at(e.get("published")), at(e.get("updated")), error or None)


def _iso(value: str | None):
    import pandas as pd

    stamp = pd.to_datetime(value, utc=True, errors="coerce") if value else None
    return None if stamp is None or pd.isna(stamp) else stamp


class FeedSource(DataSource):
    """spark.read.format("presswork_feeds").load("feeds.json"): entries of all feeds. A feed that failed is one row with entry_ord null and its error; a whole feed
    without entries is no row; entries of a malformed feed carry its error. Options: network (false), attempts, strict (true: modes and roles must be known)."""

    @classmethod
    def name(cls) -> str:
        return "presswork_feeds"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def probes(spark: SparkSession, path: str, network: bool = False) -> DataFrame:
    """(name, url, category, mode, role, entries_count, error_message): what one attempt at each feed of the list finds."""
    listed = normalize_feeds(load_json(path), strict=False)
    columns = ("name", "url", "category", "mode", "role")
    feeds = spark.createDataFrame([(i, *[f[c] for c in columns]) for i, f in enumerate(listed)], "ord int, " + ", ".join(f"{c} string" for c in columns))
    found = _rows(spark, path, network, attempts="1", strict="false").groupBy("feed_ord").agg(F.count("entry_ord").alias("n"), F.max("error").alias("error"))
    joined = feeds.join(found, F.col("ord") == F.col("feed_ord"), "left")
    return joined.select(*columns, F.coalesce("n", F.lit(0)).alias("entries_count"), F.coalesce("error", F.lit("")).alias("error_message"))


def _rows(spark: SparkSession, path: str, network: bool, **options: str) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return spark.read.format("presswork_feeds").options(network=str(network).lower(), **options).load(path)


def read_feeds(spark: SparkSession, path: str, network: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, failures): feeds that failed don't stop the others."""
    rows = _rows(spark, path, network)
    return rows.where("entry_ord is not null"), rows.where("entry_ord is null").select("feed_name", "error")
