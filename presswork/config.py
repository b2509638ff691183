"""Report configuration and its strict reading."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from .functions.vocab import default_vocabulary

REPORT_TYPES = tuple("list digest market_brief overnight_brief".split())
TECH_ROLES = ("global_tech_business", "ai_industry")
FEED_ROLES = ("breaking_news", "market", "tech_industry", *TECH_ROLES, "ai_tools", "general")
_V = default_vocabulary()
Names = tuple[str, ...]


@dataclass(frozen=True)
class ReportConfig:
    report_type: str = "list"
    output_dir: str = "output"
    output_title: str = "每日早间回顾"
    category_order: Names = ("财经股票", "AI方向")
    lookback_hours: int = 24
    stale_url_date_tolerance_days: int = 2
    days_back: int = 2
    filter_stale_by_url_date: bool = True
    max_items_per_category: int = 8
    max_items_per_feed: int = 3
    summary_max_chars: int = 180
    max_core_events: int = 8
    max_watch_items: int = 5
    max_market_signals: int = 6
    max_market_signals_per_source: int = 3
    max_quick_scan_items: int = 10
    max_quick_scan_items_per_source: int = 3
    include_quick_scan: bool = True
    allow_tech_industry_in_market: bool = False
    core_event_roles: Names = ("breaking_news", "general", *TECH_ROLES)
    market_signal_roles: Names = ("market", *TECH_ROLES)
    watch_item_roles: Names = ("market", "breaking_news", "general", *TECH_ROLES)
    quick_scan_roles: Names = tuple(r for r in FEED_ROLES if r != "ai_tools")
    quick_scan_exclude_roles: Names = ("ai_tools",)
    digest_exclude_roles: Names = ("ai_tools",)
    quick_scan_low_value_patterns: Names = _V["config.quick_scan_low_value"]
    core_event_negative_patterns: Names = _V["config.core_event_negative"]
    low_value_patterns: Names = _V["config.low_value"]


_SWITCH = {word: on for on, words in ((True, "true 1 yes on"), (False, "false 0 no off")) for word in words.split()}


class _Refused(ValueError):
    def __init__(self, name: str, what: str) -> None:
        super().__init__(f"config.{name} must be {what}")


def positive_int(value: Any, default: int, name: str) -> int:
    """A whole number from 1 on, given as one or as its digits; the default where nothing is given."""
    try:
        whole = default if value is None else int(value)
    except (TypeError, ValueError):
        raise _Refused(name, "an integer") from None
    if value is not None and whole <= 0:
        raise _Refused(name, "greater than 0")
    return whole


def boolean(value: Any, default: bool, name: str) -> bool:
    """True or false, or one of the words for them in any case."""
    match value:
        case None:
            return default
        case bool():
            return value
        case str() if (word := value.strip().lower()) in _SWITCH:
            return _SWITCH[word]
    raise _Refused(name, "a boolean")


def strings(value: Any, default: tuple[str, ...], name: str) -> tuple[str, ...]:
    """The entries of a list without blanks around them, blank ones left out; the default where nothing is left or given."""
    if not isinstance(value, (list, tuple, type(None))):
        raise _Refused(name, "a list")
    trimmed = (str(entry).strip() for entry in value or ())
    return tuple(entry for entry in trimmed if entry) or default


def normalize_config(raw: Any) -> ReportConfig:
    raw = {} if raw is None else raw
    if not isinstance(raw, Mapping):
        raise ValueError("config.json must be an object")
    given: dict[str, Any] = {}
    for f in fields(ReportConfig):
        value, default = raw.get(f.name), f.default
        if isinstance(default, bool):
            given[f.name] = boolean(value, default, f.name)
        elif isinstance(default, int):
            given[f.name] = positive_int(value, default, f.name)
        elif isinstance(default, tuple):
            given[f.name] = strings(value, default, f.name)
        else:
            given[f.name] = str(raw.get(f.name, default)).strip() or default
    kind = str(raw.get("report_type", "list")).strip().lower()
    if kind not in REPORT_TYPES:
        raise ValueError(f"config.report_type must be one of {', '.join(map(repr, REPORT_TYPES))}")
    return ReportConfig(**given | {"report_type": kind})


def load_json(path: str | Path, optional: bool = False) -> Any:
    path = Path(path)
    if not path.exists():
        if optional:
            return {}
        raise FileNotFoundError(f"Config file not found: {path}")
    return json.loads(path.read_text(encoding="utf-8"))
