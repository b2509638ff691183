"""Holdings and quotes: loading, normalising, one batched request, and the snapshot without a network."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import security_id
from ..operators import quotes as q
from ..operators.validate import REQUIRED

QUOTE_URL, FIELDS, TIMEOUT_S = "https://push2.eastmoney.com/api/qt/ulist.np/get", "f12,f14,f2,f3,f4,f6,f124", 8
INDEXES = [(name, code, f"{board}.{code}") for name, board, code in (row.split() for row in ("上证指数 1 000001", "深成指 0 399001", "创业板指 0 399006", "科创50 1 000688"))]
HOLDING_SCHEMA = "ord long, code string, name string, market string, sector string, watch_tags array<string>, notes string"
UNAVAILABLE = "行情数据源未返回可用数据，本次不做行情验证。"


def normalize_holdings(payload: Mapping[str, Any]) -> list[tuple]:
    """Trimmed rows; ValueError where a required field is blank."""
    rows = payload["holdings"] if "holdings" in payload else []
    if type(rows) is not list:
        raise ValueError("holdings must be a list")
    out = []
    for i, row in enumerate(rows):
        if not isinstance(row, Mapping):
            raise ValueError(f"holdings[{i}] must be an object")
        text = {c: str(row.get(c) or "").strip() for c in (*REQUIRED, "notes")}
        tags = row.get("watch_tags") or []
        if not isinstance(tags, list):
            raise ValueError(f"holdings[{i}].watch_tags isn't a list")
        if blank := [c for c in REQUIRED if not text[c]]:
            raise ValueError(f"holdings[{i}] missing required fields: {', '.join(blank)}")
        out.append((i, text["code"], text["name"], text["market"], text["sector"], [t for t in (str(x or "").strip() for x in tags) if t], text["notes"]))
    return out


def load_holdings(spark: SparkSession, path: str | Path, example: str | Path) -> tuple[DataFrame, str | None, bool]:
    """(holdings, file that they come from, whether it is the example): the real file, else the example, else none."""
    for file, is_example in ((Path(path), False), (Path(example), True)):
        if file.exists():
            payload = json.loads(file.read_text(encoding="utf-8"))
            if not isinstance(payload, Mapping):
                raise ValueError(f"{file} must contain a JSON object")
            return spark.createDataFrame(normalize_holdings(payload), HOLDING_SCHEMA), file.name, is_example
    return spark.createDataFrame([], HOLDING_SCHEMA), None, False


def quote_url(ids: list[str]) -> str:
    return f"{QUOTE_URL}?{urllib.parse.urlencode({'fltt': '2', 'secids': ','.join(ids), 'fields': FIELDS})}"


Opener = Callable[..., Any]


def fetch_quotes(spark: SparkSession, ids: list[str], opener: Opener | None = None) -> DataFrame:
    """(code, name, pct_change, epoch) of one batched request; no request without ids."""
    body = "{}"
    if ids:
        with (opener or urllib.request.urlopen)(urllib.request.Request(quote_url(ids), headers={"Accept": "application/json"}), timeout=TIMEOUT_S) as answer:
            body = answer.read().decode("utf-8")
        if not isinstance((json.loads(body).get("data") or {}).get("diff", []), list):
            raise RuntimeError("行情数据源返回格式异常")
    return q.parse_payload(spark.createDataFrame([(body,)], "json string"))


def snapshot(spark: SparkSession, holdings: DataFrame, report_date: date, as_of: datetime, opener: Opener | None = None, offline: bool = False) -> dict[str, Any]:
    """indexes and holdings as frames of quotes, failures (scope, message), note and dates. Either scan may fail without the other."""
    failures: list[tuple[str, str]] = []
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
    empty = spark.createDataFrame([], "ord long, name string, code string, pct_change double, amount double, source string, as_of string, industry string, sector string")
    found = {"indexes": empty, "holdings": empty}
    watched = {"indexes": spark.createDataFrame([(i, c, n, "") for i, (n, c, _) in enumerate(INDEXES)], "ord long, code string, name string, sector string"), "holdings": holdings.select("ord", "code", "name", "sector")}
    if offline:
        failures.append(("market_data", "数据暂不可用"))
    else:
        ids = {"indexes": [s for _, _, s in INDEXES], "holdings": [r["s"] for r in holdings.orderBy("ord").select(security_id(F.col("code"), F.col("market")).alias("s")).collect()]}  # a watch list
        for scope, message in (("indexes", "指数行情数据暂不可用"), ("holdings", "持仓行情数据暂不可用")):
            try:
                if ids[scope]:
                    found[scope] = q.with_quotes(watched[scope], fetch_quotes(spark, ids[scope], opener), now)
            except Exception as failure:  # whatever a feed of quotes does
                failures.append((scope, str(failure) or message))
    some = not offline and len(failures) < 2 and "indexes" not in [f for f, _ in failures] or (not offline and "holdings" not in [f for f, _ in failures] and not holdings.isEmpty())
    if some:
        failures.append(("amount", "轻量行情源成交额字段口径未在本项目中完成校验，本次按数据暂不可用处理。"))
    both = found["indexes"].unionByName(found["holdings"])
    day = q.data_date(both, F.lit(report_date)).first()["market_data_date"]
    first = "观察主要指数、成交量和行业轮动是否出现连续性。" if offline else "观察主要指数涨跌和成交额是否支持新闻主线。"
    return found | {
        "failures": failures,
        "note": "已尝试接入轻量公开行情数据；缺失字段不做推断。" if some else UNAVAILABLE,
        "data_date": report_date,
        "market_data_date": day,
        "watch_signals": [first, "观察持仓所属板块是否跟随市场主线。", "观察外部风险偏好、汇率利率和政策变量是否变化。"],
    }
