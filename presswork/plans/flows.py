"""The four reports from feeds to Markdown, the curator beside them, and the health of feeds."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ReportConfig
from ..operators import candidates as cd
from ..operators import digest, health, news, validate
from ..sources import feeds as fd
from ..sources import market
from . import artifacts
from . import curator as cu
from . import reports
from .delivery import timed


def numbered(items: DataFrame) -> DataFrame:
    """items with ord, their arrival over all feeds: feeds have fewer than 2^31 entries."""
    return items.withColumn("ord", F.col("feed_ord").cast("long") * (1 << 31) + F.col("entry_ord"))


def run(
    spark: SparkSession, entries: DataFrame, feeds: DataFrame, keywords: Mapping[str, Sequence[str]], config: ReportConfig, day: date, as_of: datetime, output: str | Path,
    holdings_path: str | Path = "holdings.json", example_path: str | Path = "holdings.example.json", failures: Sequence[tuple[str, str]] = (), opener: Any = None, offline: bool = False, curator: cu.Curator | None = None,
    artifact_root: str | Path | None = None,
) -> Path:
    """One report, written. entries are a feed scan's; as_of stands for the clock. With artifact_root the curator's run is kept there, whether it succeeded or not."""
    with timed(config.report_type):
        return _run(spark, entries, feeds, keywords, config, day, as_of, output, holdings_path, example_path, failures, opener, offline, curator, artifact_root)


def _run(spark, entries, feeds, keywords, config, day, as_of, output, holdings_path, example_path, failures, opener, offline, curator, artifact_root) -> Path:
    found = cd.candidates(entries, config, day, as_of)
    if config.report_type == "overnight_brief":
        unique = cd.unique_candidates(found).persist()
        items = numbered(cd.legacy_items(unique, keywords, feeds, config.max_items_per_feed))
    else:
        unique = None
        items = numbered(cd.collect_news(cd.items(cd.with_feed_mode(found, feeds), keywords, F.col("mode")), config))
    items = items.persist()
    if config.report_type == "list":
        text = reports.list_report(items, keywords, day, config, failures, as_of)
    elif config.report_type == "digest":
        text = reports.digest_report(items, day, config, failures, as_of)
    else:
        holdings, file, is_example = market.load_holdings(spark, holdings_path, example_path)
        snapshot = market.snapshot(spark, holdings, day, as_of, opener, offline)
        context = reports.MarketContext(snapshot, holdings, news.analyze(items, holdings))
        if config.report_type == "market_brief":
            text = reports.market_brief(context, as_of, file, is_example, failures)
        else:
            response = None
            if curator is not None:
                rows = [r.asDict() for r in unique.orderBy("feed_ord", "entry_ord").limit(cu.MAX_CANDIDATES + 1).collect()]  # one more than a request may hold, so that the limit is seen
                request = cu.build_request(rows, day, cu.MAX_EVENTS)
                response, failure = cu.curate_or_none(curator, request)
                if artifact_root is not None:
                    keep_run(artifact_root, curator, request, response, failure, traces(unique, items, failures), request.window if any(r["published_at"] for r in rows) else None, "keyword_gate_approximation")
            shown = digest.sections(items, config) if response is None else None
            text = reports.overnight_brief(context, shown, day, as_of, response, unique, failures)
    path = reports.write(text, output, config.report_type, day)
    items.unpersist()
    if unique is not None:
        unique.unpersist()
    return path


def traces(unique: DataFrame, items: DataFrame, failures: Sequence[tuple[str, str]] = ()) -> list[dict[str, Any]]:
    """What became of each candidate of a request, and which feeds failed, as records of a run. No more candidates are read than a request may hold."""
    rows = [r.asDict(recursive=True) for r in cd.trace(unique.orderBy("feed_ord", "entry_ord").limit(cu.MAX_CANDIDATES + 1), items).collect()]
    return [*rows, *([{"trace_type": "fetch_failures", "candidate_failures": [tuple(f) for f in failures]}] if failures else [])]


def keep_run(
    root: str | Path, curator: cu.Curator, request: cu.Request, response: Mapping[str, Any] | None, failure: Exception | None, trace: Sequence[Mapping[str, Any]] = (),
    window: tuple[datetime, datetime] | None = None, evaluation: str = "not_evaluated", run_id: str | None = None,
) -> Path:
    """The record of one exchange. The request that is kept is the one that was sent, where the curator prepares one, with the figures of its preparation."""
    http = isinstance(curator, cu.HttpCurator)
    ready = None
    if http:
        try:
            ready = curator.prepare(request)
        except cu.ProviderError:  # it went over a limit: there is no prepared request
            pass
    info: dict[str, Any] = {"status": "failed" if response is None else "succeeded", "validation_status": "passed", "attempts": 1, "legacy_evaluation": evaluation, "input_mode": curator.mode if http else "", "original_candidate_count": len(request.articles)}
    info |= {"provider_id": curator.provider_id, "model": curator.model, "api_key_env": curator.api_key_env} if http else {"provider_id": "fixture", "model": "fixture-response", "api_key_env": ""}
    if window is not None:
        info |= {"candidate_window_start": window[0], "candidate_window_end": window[1]}
    if http:
        info |= {"max_candidate_count": curator.max_candidates, "max_provider_request_body_bytes": curator.max_body_bytes}
    if ready is not None:
        live = curator.mode == cu.LIVE
        info |= {"source_excluded_count": ready.metrics["excluded"], "curator_request_bytes": ready.metrics["request_bytes"], "provider_request_body_bytes": ready.metrics["body_bytes"]}
        info |= {"summary_max_chars": cu.SUMMARY_CHARS, "summaries_capped_count": ready.metrics["capped"], "summaries_unchanged_count": ready.metrics["unchanged"]} if live else {}
    if failure is not None:
        info |= _failure(failure)
    return artifacts.write_run(root, info, request.report_date.isoformat(), ready.request if ready else request, response, trace, run_id)


def _failure(failure: Exception) -> dict[str, Any]:
    match failure:
        case cu.ProviderError():
            stage, code, attempts, diagnostic = failure.stage, failure.code, failure.attempts, failure.diagnostic
            checked = "failed" if stage in ("validation", "content_policy") else "not_run"
        case cu.ContractError():
            stage, code, attempts, diagnostic, checked = "validation", "invalid_curator_response", 1, (failure.code, failure.path, failure.article_id), "failed"
        case json.JSONDecodeError():
            stage, code, attempts, diagnostic, checked = "response_parse", "invalid_json", 1, ("", "", ""), "not_run"
        case _:
            stage, code, attempts, diagnostic, checked = "fixture_provider", "fixture_provider_error", 1, ("", "", ""), "not_run"
    named = {f"failure_diagnostic_{k}": v for k, v in zip(("code", "path", "article_id"), diagnostic) if v}
    return {"failure_stage": stage, "failure_code": code, "attempts": attempts, "validation_status": checked} | named


@dataclass(frozen=True)
class Shadow:
    """How the curator is tried beside the reports: with candidates of a file or of feeds, and an answer of a file or of a provider."""

    candidates: str | Path | None = None
    answer: str | Path | None = None
    provider: cu.HttpCurator | None = None
    dry_run: bool = False
    mode: str = "phase3b_fixture"
    max_events: int | None = None

    def __post_init__(self) -> None:
        real = self.provider is not None
        for wrong, message in (
            (not real and self.answer is None, "an answer is needed where there is no provider"),
            (real and self.candidates is None, "a provider needs candidates from a file"),
            (real and self.answer is not None, "an answer and a provider exclude one another"),
            (self.dry_run and not real, "a dry run is a provider's"),
            (self.mode == cu.LIVE and not real, "live mode needs a provider"),
            (real and self.provider.mode != self.mode, "the provider has another mode"),
            (self.mode not in ("phase3b_fixture", cu.LIVE), f"{self.mode} isn't an input mode"),
        ):
            if wrong:
                raise ValueError(message)

    @property
    def events(self) -> int:
        return self.max_events if self.max_events is not None else cu.MAX_EVENTS if self.mode == cu.LIVE else 5


def shadow(plan: Shadow, root: str | Path, found: DataFrame | None = None, items: DataFrame | None = None, day: date | None = None, failures: Sequence[tuple[str, str]] = (), run_id: str | None = None) -> Path | dict[str, Any]:
    """One trial of the curator, kept under root; of a dry run the figures of the request that would be sent. A failure is kept, then raised.

    Candidates come from plan.candidates, whose date must be day where that is given, or are found, unique ones, with the items that the rules chose.
    """
    if plan.candidates is not None:
        own, rows = validate.candidate_fixture(plan.candidates)
        if day is not None and day != own:
            raise ValueError("the candidates are of another day")
        day, trace, evaluation, window = own, [], "not_evaluated", None
        trace = [{k: r[k] if k != "published_at" else cu.utc(r[k]) for k in ("article_id", "title", "source", "feed_name", "feed_role", "published_at", "link", "normalized_link")} | {"report_date": own.isoformat()} for r in rows]
    else:
        rows = [r.asDict() for r in found.orderBy("feed_ord", "entry_ord").limit(cu.MAX_CANDIDATES + 1).collect()]
        trace, evaluation = traces(found, items, failures), "keyword_gate_approximation"
        times = [r["published_at"].replace(tzinfo=r["published_at"].tzinfo or timezone.utc) for r in rows if r["published_at"]]
        window = (min(times), max(times)) if times else None
    request = cu.build_request(rows, day, plan.events)
    if plan.dry_run:
        ready = plan.provider.prepare(request)
        return {"mode": "dry_run", "provider_id": plan.provider.provider_id, "model": plan.provider.model, "endpoint": plan.provider.endpoint, "input_mode": plan.mode, "original_candidate_count": len(rows), "candidate_count": len(ready.request.articles), "max_events": request.max_events, "max_candidate_count": plan.provider.max_candidates, "max_provider_request_body_bytes": plan.provider.max_body_bytes, "timeout": plan.provider.timeout_s, "max_attempts": plan.provider.max_attempts, "target_language": cu.TARGET_LANGUAGE, "transport_calls": 0} | dict(ready.metrics)
    response = failure = None
    curator: Any = plan.provider
    try:
        if curator is None:
            curator = cu.FixtureCurator({})
            curator = cu.FixtureCurator(json.loads(Path(plan.answer).read_text(encoding="utf-8")))
        response = curator.curate(request)
    except Exception as error:
        failure = error
    kept = keep_run(root, curator, request, response, failure, trace, window, evaluation, run_id)
    if failure is not None:
        raise failure
    return kept


def check_health(spark: SparkSession, feeds_path: str | Path, network: bool = False) -> tuple[DataFrame, str]:
    """(results in their order, the table as Markdown) of one look at each feed of the list."""
    results = health.in_order(health.statuses(fd.probes(spark, str(feeds_path), network))).persist()
    return results, reports.health_table(results)


__all__ = ["Shadow", "check_health", "keep_run", "numbered", "run", "shadow", "traces"]
