"""The record of one curator run: staged, read back, and moved into place at once; no run is ever overwritten."""

from __future__ import annotations

import html
import json
import os
import re
import secrets
import shutil
from collections import Counter
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from .curator import LIVE, MODES, Request, canonical_json, check_policy, validate

_ID, _TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*"), re.compile(r"[A-Za-z0-9_.:-]*")
EVALUATIONS = ("not_evaluated", "keyword_gate_approximation")


def create_run_id(now: datetime | None = None) -> str:
    """The UTC time to the microsecond and twelve random hexadecimal digits: runs sort by time and don't collide."""
    at = datetime.now(timezone.utc) if now is None else now.astimezone(timezone.utc)
    return at.strftime("%Y%m%dT%H%M%S.%fZ-") + secrets.token_hex(6)


def token(value: Any) -> str:
    return str(value or "") if _TOKEN.fullmatch(str(value or "")) else "redacted"


def one_line(value: Any, most: int = 256) -> str:
    return " ".join(str(value or "").split())[:most]


def review(value: Any) -> str:
    out = html.escape(" ".join(str(value).split()), quote=True)
    return re.sub(r"([\\`*_\[\]()#!>|~])", r"\\\1", out)


def failure_code(error: Any) -> str:
    text = str(error or "").lower()
    groups = {"timeout": ("timeout", "timed out"), "parse_error": "parse json xml bozo".split(), "network_error": "http url network connect".split()}
    return next((code for code, terms in groups.items() if any(t in text for t in terms)), "unknown_failure")


def check_info(info: Mapping[str, Any], request: Request | None, response: Mapping[str, Any] | None) -> dict[str, Any] | None:
    """The validated response of a run that succeeded; ValueError where the figures of a run contradict each other."""

    def need(good: Any, message: str) -> None:
        if not good:
            raise ValueError(message)

    done = info.get("status") == "succeeded"
    need(info.get("status") in ("succeeded", "failed"), "status is succeeded or failed")
    need(info.get("input_mode", "") in ("", *MODES), "unsupported input_mode")
    need(info.get("legacy_evaluation", EVALUATIONS[0]) in EVALUATIONS, "unsupported legacy_evaluation")
    counts = [k for k in info if k.endswith(("_count", "_chars", "_bytes")) or k == "attempts"]
    need(all(info[k] is None or info[k] >= 0 for k in counts), "counts must be non-negative")
    n, original, excluded = len(request.articles) if request else None, info.get("original_candidate_count"), info.get("source_excluded_count")
    need(n is None or original is None or original == n + (excluded or 0), "original_candidate_count does not match the request")
    need(excluded is None or original is not None, "source_excluded_count requires original_candidate_count")
    capped, unchanged = info.get("summaries_capped_count"), info.get("summaries_unchanged_count")
    need(n is None or capped is None or unchanged is None or capped + unchanged == n, "summary counts do not match the request")
    start, end = info.get("candidate_window_start"), info.get("candidate_window_end")
    need((start is None) == (end is None), "the window requires both ends")
    need(start is None or start <= end, "the window is inverted")
    if not done:
        need(response is None, "a failed run has no response")
        return None
    need(request is not None and response is not None, "a succeeded run requires request and response")
    need(not any(info.get(k) for k in info if k.startswith("failure_")), "a succeeded run has no failure")
    own = validate(response, request)
    check_policy(own)
    return own


def safe_trace(records: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Candidates and fetch failures with their known fields alone; other kinds of record are an error."""
    out: list[dict[str, Any]] = []
    texts = ("article_id", "title", "source", "feed_name", "feed_role", "published_at", "link", "normalized_link", "report_date", "legacy_reject_reason")
    for r in records:
        kind = str(r.get("trace_type") or "candidate")
        if kind == "candidate":
            words = r.get("legacy_matched_keywords")
            words = {str(k): [str(x) for x in v] for k, v in words.items() if isinstance(v, (list, tuple))} if isinstance(words, Mapping) else {}
            out.append({"trace_type": kind, **{k: str(r.get(k, "")) for k in texts}, "legacy_keyword_matched": bool(r.get("legacy_keyword_matched")), "legacy_matched_keywords": words, "legacy_selected": bool(r.get("legacy_selected")), "legacy_score": None, "legacy_category": ""})
        elif kind == "fetch_failures":
            pairs = [(f.get("feed_name", ""), f.get("failure_code", f.get("error", ""))) if isinstance(f, Mapping) else tuple(f)[:2] for f in r["candidate_failures"]]
            out.append({"trace_type": kind, "candidate_failures": [{"feed_name": one_line(a), "failure_code": failure_code(b)} for a, b in pairs]})
        else:
            raise ValueError("unsupported trace_type")
    return out


def render_review(run: Mapping[str, Any], request: Request | None, response: Mapping[str, Any] | None, trace: Sequence[Mapping[str, Any]]) -> str:
    article = {a["article_id"]: a for a in request.articles} if request else {}
    lines = ["# AI Curator Shadow Review", "", *[f"- {k.replace('_', ' ')}: `{review('not applicable' if v is None else v)}`" for k, v in run.items() if not isinstance(v, Mapping)]]
    if diagnostic := run.get("failure_diagnostic"):
        lines.append("- Failure diagnostic: " + "; ".join(f"{k}=`{v}`" for k, v in diagnostic.items()))
    if response is None:
        lines += ["", "## Result", "", "No validated AI response was written.", ""]
    else:
        lines += ["", "## AI Events", ""] + ([] if response["events"] else ["No AI events returned.", ""])
        for e in response["events"]:
            sources = "; ".join(f"{review(article[i]['source'])} — {review(article[i]['title'])}" for i in e["evidence_article_ids"] if i in article)
            lines += [f"### {review(e['canonical_title'])}", "", f"- Summary: {review(e['summary'])}", f"- Why important: {review(e['why_important'])}", f"- Importance: `{e['importance']}`; category: `{e['category']}`; confidence: `{e['confidence']}`"]
            lines += [f"- Evidence: `{review(', '.join(e['evidence_article_ids']))}`", f"- Evidence sources: {sources}"] + [f"- Uncertainties: {review('; '.join(e['uncertainties']))}"] * bool(e["uncertainties"]) + [""]
        if run.get("input_mode") == LIVE:
            lines += ["## Rejection Enumeration", "", "Not collected in live mode.", ""]
        else:
            rows = [f"- {review(article.get(r['article_id'], {}).get('title', r['article_id']))} — `{r['reject_reason']}`" for r in response["rejected_article_ids"]]
            lines += ["## Rejected Articles", "", *(rows or ["No AI-rejected articles returned."]), ""]
    chosen = [review(r["title"]) for r in trace if r["trace_type"] == "candidate" and r["legacy_selected"]]
    lines += ["## Legacy Comparison", "", f"- Legacy-selected candidate count: `{len(chosen)}`", *[f"- {t}" for t in chosen], "", "## Human Review", "", *[f"- [ ] {x}" for x in ("Events and titles are supported by their evidence.", "Importance and novelty are right.", "No advice or unsupported claim goes further.")], ""]
    return "\n".join(lines)


def preview(response: Mapping[str, Any], request: Request, trace: Sequence[Mapping[str, Any]], barred: Sequence[str]) -> str:
    def clean(text: str) -> str:
        for term in barred:
            text = text.replace(term, "交易导向表述")
        return text.replace("|", "\\|").strip()

    title = {a["article_id"]: f"{clean(a['title'])} ({a['source']})" for a in request.articles}
    lines = ["# AI Curator Shadow Preview", "", f"Report date: {response['report_date']}", f"Schema: {response['schema_version']}", "", "## Curated Events", ""] + ([] if response["events"] else ["No curated events in fixture response.", ""])
    for e in response["events"]:
        lines += [f"### {clean(e['canonical_title'])}", *[f"- {k.replace('_', ' ').capitalize()}: {clean(e[k])}" for k in ("importance", "category", "why_important", "novelty", "confidence")], "- Evidence articles:", *[f"  - {title[i]}" for i in e["evidence_article_ids"]]]
        lines += [f"- Uncertainties: {'; '.join(map(clean, e['uncertainties']))}"] * bool(e["uncertainties"]) + [""]
    reasons = sorted(Counter(r["reject_reason"] for r in response["rejected_article_ids"]).items())
    for name, rows in (("Rejected Candidates Summary", [f"- {k}: {n}" for k, n in reasons]), ("Validation Warnings", [f"- {clean(w)}" for w in response["warnings"]])):
        lines += [f"## {name}", "", *(rows or ["- None."]), ""]
    flags = [("Candidate articles", len(request.articles)), ("Legacy keyword matched", sum(bool(r.get("legacy_keyword_matched")) for r in trace)), ("Legacy selected", sum(bool(r.get("legacy_selected")) for r in trace)), ("Curated events", len(response["events"]))]
    return "\n".join([*lines, "## Legacy Comparison Summary", "", *[f"- {k}: {v}" for k, v in flags], ""])


def write_run(root: str | Path, info: Mapping[str, Any], report_date: str, request: Request | None, response: Mapping[str, Any] | None, trace: Sequence[Mapping[str, Any]], run_id: str | None = None) -> Path:
    """root/report_date/run_id with run.json, trace.json, review.md and, where there are such, request.json and response.json."""
    name = run_id or create_run_id()
    if not _ID.fullmatch(name):
        raise ValueError("unsafe run id")
    own = check_info(info, request, response)
    records = safe_trace(trace)
    target = Path(root) / report_date / name
    staging = target.with_name(f".{name}.staging")
    if target.exists() or staging.exists():
        raise FileExistsError(name)
    body = canonical_json(request.to_dict()) if request else None
    if body is not None and info.get("curator_request_bytes") not in (None, len(body)):
        raise ValueError("curator_request_bytes does not match the request")
    diagnostic = {k: token(info.get(f"failure_diagnostic_{k}"))[:128] for k in ("code", "path") if info.get(f"failure_diagnostic_{k}")}
    if request and info.get("failure_diagnostic_article_id") in {a["article_id"] for a in request.articles}:
        diagnostic["article_id"] = token(info["failure_diagnostic_article_id"])
    stamp = lambda v: v.astimezone(timezone.utc).isoformat() if isinstance(v, datetime) else v
    run = {"run_id": name, "report_date": report_date, "candidate_count": len(request.articles) if request else 0, "legacy_selected_count": sum(r.get("legacy_selected", False) for r in records), "ai_event_count": len(own["events"]) if own else 0}
    run |= {k: stamp(v) if not isinstance(v, str) else one_line(v) if k in ("provider_id", "model") else token(v) for k, v in info.items() if not k.startswith("failure_diagnostic")} | {"curator_request_bytes": len(body) if body is not None else None}
    run |= {"failure_diagnostic": diagnostic} if diagnostic and not own else {}
    files = {"run.json": canonical_json(run), "trace.json": canonical_json(records), "review.md": render_review(run, request, own, records).encode("utf-8")}
    files |= {"request.json": body} if body is not None else {}
    files |= {"response.json": canonical_json(own)} if own else {}
    staging.mkdir(parents=True)
    try:
        for file, data in files.items():
            (staging / file).write_bytes(data)
        if {p.name: p.read_bytes() for p in staging.iterdir()} != files or json.loads((staging / "run.json").read_bytes()) != run:
            raise OSError("what was written isn't what is read")
        os.replace(staging, target)
    except Exception:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return target
