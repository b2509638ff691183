"""Row constraints of holdings, candidate fixtures and reference sets: all violations, in their order."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import date, datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links
from ..functions import text as tx
from ..functions.vocab import default_vocabulary

_V = default_vocabulary()
REQUIRED = "code name market sector".split()
_FORBIDDEN = frozenset(x.lower() for x in _V["curator.forbidden_candidate_fixture_fields"])
FIELDS, SENSITIVE = _V["holding.allowed_holding_fields"], _V["holding.sensitive_holding_fields"]


def holdings_payload(payload: Any) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a holdings file, which is small enough for the driver; every error is listed."""
    if not isinstance(payload, Mapping):
        return ["holdings.json must contain a JSON object"], []
    rows = payload.get("holdings")
    if not isinstance(rows, list):
        return ["holdings must be a list"], []
    errors, warnings = [], []
    for i, row in enumerate(rows):
        label = f"holdings[{i}]"
        if not isinstance(row, Mapping):
            errors.append(f"{label} must be an object")
            continue
        groups = {"contains unsupported fields": set(row) - set(FIELDS) - set(SENSITIVE), "missing required fields": set(FIELDS) - set(row)}
        if private := sorted(set(row) & set(SENSITIVE)):
            warnings.append(f"{label} contains sensitive position/cost fields: {', '.join(private)}")
        errors += [f"{label} {what}: {', '.join(sorted(names))}" for what, names in groups.items() if names]
        errors += [f"{label}.{name} must be a non-empty string" for name in REQUIRED if name in row and not str(row[name] or "").strip()]
        errors += [f"{label}.{name} must be a {kind}" for name, kind, good in (("watch_tags", "list", list), ("notes", "string", str)) if name in row and not isinstance(row[name], good)]
    return errors, warnings


def holding_rows(rows: DataFrame) -> DataFrame:
    """(ord, error) of holdings (ord, code, name, market, sector, watch_tags, notes) as a table, for lists beyond a file."""
    errors = [F.when(F.coalesce(tx.strip(F.col(c)), F.lit("")) == "", F.concat(F.lit("holdings["), F.col("ord").cast("string"), F.lit(f"].{c} must be a non-empty string"))) for c in REQUIRED]
    return rows.select("ord", F.explode(F.filter(F.array(*errors), lambda e: e.isNotNull())).alias("error"))


def candidate_rows(rows: DataFrame) -> DataFrame:
    """(ord, code) of fixture candidates (ord, article_id, title, source, feed_name, feed_role, published_at as text, link, normalized_link, report_date, expected_date): each one's first violation, then repeats."""
    blank = lambda c: F.coalesce(tx.strip(F.col(c)), F.lit("")) == ""
    at = F.try_to_timestamp(F.replace(F.col("published_at"), F.lit("Z"), F.lit("+00:00")))
    derived = links.normalize_link(F.col("link"))
    norm = F.coalesce(F.nullif(tx.strip(F.col("normalized_link")), F.lit("")), derived)
    expected = links.article_id(norm, F.col("source"), F.col("title"), at)
    code = F.lit(None).cast("string")
    checks = [(f"missing_{c}", blank(c)) for c in ("title", "source", "feed_name", "feed_role")] + [
        ("bad_published_at", F.col("published_at").isNotNull() & (at.isNull() | ~F.col("published_at").rlike(r"(?:Z|[+-]\d{2}:\d{2})$"))),
        ("report_date_mismatch", ~F.coalesce("report_date", "expected_date").eqNullSafe(F.col("expected_date"))),
        ("link_required", F.col("published_at").isNull() & blank("link")),
        ("normalized_link_conflict", ~blank("link") & ~blank("normalized_link") & (tx.strip(F.col("normalized_link")) != derived)),
        ("article_id_conflict", ~blank("article_id") & (tx.strip(F.col("article_id")) != expected)),
    ]
    for name, bad in reversed(checks):
        code = F.when(bad, name).otherwise(code)
    own = rows.withColumns({"_code": code, "_key": links.dedupe_key(norm, expected)})
    from pyspark.sql import Window as W

    again = F.row_number().over(W.partitionBy("_key").orderBy("ord")) > 1
    return own.withColumn("_again", again).select("ord", F.coalesce("_code", F.when(F.col("_again"), "duplicate_candidate_key")).alias("code")).where("code is not null")


_TEXT_FIELDS = ("article_id", "title", "summary", "source", "feed_name", "feed_role", "link", "normalized_link", "author", "language")


def candidate_fixture(path: str | Path, collected_at: datetime | None = None) -> tuple[date, list[dict[str, Any]]]:
    """(report date, candidates in their order) of a fixture file, or ValueError: its root, what it may not hold, then the rules of candidate_rows by the first row that breaks one.

    Links are normalised and ids derived as in a scan; collected_at is now unless given. A file is small: its rows are checked by the session in one pass.
    """
    try:
        payload = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ValueError(f"there is no candidate fixture {path}") from None
    except json.JSONDecodeError as failure:
        raise ValueError(f"the candidate fixture {path} isn't JSON: {failure}") from None
    if not isinstance(payload, Mapping) or payload.get("schema_version") != "1.0":
        raise ValueError("a candidate fixture is an object with schema_version 1.0")
    try:
        day = date.fromisoformat(str(payload.get("report_date") or "").strip())
    except ValueError:
        raise ValueError("report_date must be an ISO date") from None
    listed = payload.get("articles")
    if not isinstance(listed, list):
        raise ValueError("articles must be a list")
    rows = []
    for i, raw in enumerate(listed, 1):
        if not isinstance(raw, Mapping):
            raise ValueError(f"article {i} must be an object")
        if barred := sorted(_FORBIDDEN & {str(k).lower() for k in raw}):
            raise ValueError(f"article {i} must not have {', '.join(barred)}")
        if "published_at" not in raw:
            raise ValueError(f"article {i}: missing_published_at")
        at = raw["published_at"]
        rows.append((i, *[str(raw.get(c, "") or "").strip() for c in _TEXT_FIELDS], None if at is None else str(at).strip(), str(raw.get("report_date", day.isoformat())).strip(), day.isoformat()))
    if not rows:
        return day, []
    columns = ["ord int", *[f"{c} string" for c in (*_TEXT_FIELDS, "published_at", "report_date", "expected_date")]]
    given = SparkSession.active().createDataFrame(rows, ", ".join(columns))
    if wrong := candidate_rows(given).orderBy("ord").first():
        raise ValueError(f"article {wrong['ord']}: {wrong['code']}")
    at = F.try_to_timestamp(F.replace(F.col("published_at"), F.lit("Z"), F.lit("+00:00")))
    norm = F.coalesce(F.nullif(F.col("normalized_link"), F.lit("")), links.normalize_link(F.col("link")))
    plain = [c for c in _TEXT_FIELDS if c not in ("article_id", "normalized_link", "language")]
    done = given.select("ord", *plain, norm.alias("normalized_link"), tx.language(F.col("language")).alias("language"), at.alias("at"), links.article_id(norm, F.col("source"), F.col("title"), at).alias("article_id"), F.unix_micros(at).alias("micros"))
    when = collected_at or datetime.now(timezone.utc)
    out = []
    for r in done.orderBy("ord").collect():
        stamp = None if r["micros"] is None else datetime.fromtimestamp(r["micros"] / 1e6, timezone.utc)
        out.append({c: r[c] for c in (*plain, "normalized_link", "language", "article_id")} | {"published_at": stamp, "report_date": day, "collected_at": when})
    return day, out


def gold(payload: Any) -> dict:
    """A reference set as it is, or ValueError."""
    import re

    def ids(row: Mapping, name: str, some: bool) -> list[str]:
        value = row.get(name)
        if not isinstance(value, list) or some and not value:
            raise ValueError(f"{name} must be a list")
        own = [str(x).strip() for x in value]
        if not all(own) or len(set(own)) < len(own):
            raise ValueError(f"{name} must contain unique non-empty ids")
        return own

    if not isinstance(payload, Mapping):
        raise ValueError("the reference must be a JSON object")
    most = payload.get("reference_max_events")
    head = {
        "snapshot_id must be non-empty": isinstance(payload.get("snapshot_id"), str) and payload["snapshot_id"].strip(),
        "snapshot_sha256 must be lowercase SHA-256": re.fullmatch("[0-9a-f]{64}", str(payload.get("snapshot_sha256", ""))),
        "reference_max_events must be positive": isinstance(most, int) and most > 0,
        "events must be a non-empty list": isinstance(payload.get("events"), list) and payload["events"],
    }
    for message, good in head.items():
        if not good:
            raise ValueError(message)
    seen: set[str] = set()
    for row in payload["events"]:
        name = str(row.get("reference_id", "")).strip() if isinstance(row, Mapping) else ""
        if not name or name in seen:
            raise ValueError("reference_id must be non-empty and unique")
        seen.add(name)
        if row.get("tier") not in _V["quality.reference_tiers"]:
            raise ValueError("unsupported tier")
        if set(ids(row, "supporting_article_ids", True)) & set(ids(row, "forbidden_article_ids", False)):
            raise ValueError("supporting and forbidden ids must be disjoint")
        if not all(isinstance(row.get(f), bool) for f in ("attribution_required", "uncertainty_expected")):
            raise ValueError("flags must be boolean")
    ids(payload, "representative_omit_article_ids", False)
    return dict(payload)
