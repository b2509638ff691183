"""Feed parity, health, fixtures, shadow runs, delivery and logs."""

import json
import logging
from datetime import date, datetime, timezone
from email.message import Message
from urllib.error import HTTPError, URLError

import pytest

from presswork.operators import validate
from presswork.plans import curator as cu
from presswork.plans import delivery, flows
from presswork.sources import feeds as fd

DAY = date(2026, 3, 4)
ITEM = "<item><title>{0}</title><link>https://x.example/{0}</link><pubDate>Wed, 04 Mar 2026 01:00:00 GMT</pubDate></item>"


def rss(*names, end="</channel></rss>"):
    return ("<rss><channel>" + "".join(map(ITEM.format, names)) + end).encode()


def feed_list(tmp_path, **payloads):
    for name, body in payloads.items():
        if body is not None:
            (tmp_path / f"{name}.xml").write_bytes(body)
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps([{"name": n, "url": f"{n}.xml", "mode": "all", "category": "c"} for n in payloads]))
    return str(path)


def test_a_whole_feed_without_entries_is_no_failure(spark, tmp_path):
    path = feed_list(tmp_path, full=rss("a", "b"), empty=rss(), broken=rss("c", end="<item"), junk=b"no xml", gone=None)
    entries, failures = fd.read_feeds(spark, path)
    assert sorted(r["title"] for r in entries.collect()) == ["a", "b", "c"]
    assert sorted(r["feed_name"] for r in failures.collect()) == ["gone", "junk"]
    results, table = flows.check_health(spark, path)
    assert [(r["name"], r["status"], r["entries_count"]) for r in results.collect()] == [("full", "ok", 2), ("broken", "ok_with_warning", 1), ("empty", "empty", 0), ("gone", "failed", 0), ("junk", "failed", 0)]
    assert table.startswith("Total: 5 | ok: 1 | ok_with_warning: 1 | empty: 1 | failed: 2")


def test_what_cannot_be_read_is_fetched_again():
    answers = [b"no xml", OSError("reset"), rss("a")]

    def get(url, network):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert fd.scan("u", False, 1, get=get)[1] and fd.scan("u", False, 2, get=get)[0][0]["title"] == "a"
    answers[:] = [rss(), rss("late")]
    assert fd.scan("u", False, 2, get=get) == ([], "") and len(answers) == 1
    answers[:] = [b"", OSError("last")]
    assert fd.scan("u", False, 2, get=get) == ([], "last")


def article(i, **more):
    return {"title": f"t{i}", "source": "S", "feed_name": "F", "feed_role": "general", "link": f"https://x.example/{i}?utm_source=q", "published_at": "2026-03-04T01:00:00Z", "summary": "s"} | more


def fixture(tmp_path, articles, **root):
    path = tmp_path / "candidates.json"
    path.write_text(json.dumps({"schema_version": "1.0", "report_date": DAY.isoformat(), "articles": articles} | root))
    return path


def test_candidate_fixture(spark, tmp_path):
    day, rows = validate.candidate_fixture(fixture(tmp_path, [article(1), article(2, published_at=None, language="EN")]))
    assert day == DAY and [r["normalized_link"] for r in rows] == ["https://x.example/1", "https://x.example/2"]
    assert rows[0]["published_at"] == datetime(2026, 3, 4, 1, tzinfo=timezone.utc) and rows[1]["language"] == "en" and rows[0]["article_id"].startswith("art_")
    assert validate.candidate_fixture(fixture(tmp_path, [])) == (DAY, [])
    no_time = article(1)
    del no_time["published_at"]
    wrong = [
        ([], {"schema_version": "2"}, "schema_version"), ([], {"report_date": "x"}, "ISO date"), ({}, {}, "list"), ([1], {}, "object"), ([article(1, API_KEY="k")], {}, "api_key"), ([no_time], {}, "missing_published_at"),
        ([article(1, title=" ")], {}, "missing_title"), ([article(1, published_at="x")], {}, "bad_published_at"), ([article(1, report_date="2026-03-05")], {}, "report_date_mismatch"), ([article(1, link="", published_at=None)], {}, "link_required"),
        ([article(1, normalized_link="https://y.example")], {}, "normalized_link_conflict"), ([article(1, article_id="art_x")], {}, "article_id_conflict"), ([article(1), article(1)], {}, "article 2: duplicate_candidate_key"),
    ]
    for articles, root, message in wrong:
        with pytest.raises(ValueError, match=message):
            validate.candidate_fixture(fixture(tmp_path, articles, **root))
    with pytest.raises(ValueError, match="no candidate fixture"):
        validate.candidate_fixture(tmp_path / "none.json")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="JSON"):
        validate.candidate_fixture(tmp_path / "bad.json")


def answer(rows, **more):
    event = {"event_id": "e1", "canonical_title": "T", "summary": "S", "category": sorted(cu._V["curator.category"])[0], "importance": sorted(cu._V["curator.importance"])[0], "why_important": "W", "evidence_article_ids": [rows[0]["article_id"]], "novelty": sorted(cu._V["curator.novelty"])[0], "confidence": sorted(cu._V["curator.confidence"])[0], "uncertainties": []}
    return {"schema_version": cu.SCHEMA_VERSION, "report_date": DAY.isoformat(), "events": [event], "rejected_article_ids": [], "warnings": []} | more


def http(body, status=200, **more):
    calls = []

    def transport(url, data, headers, timeout):
        calls.append(url)
        envelope = {"choices": [{"finish_reason": "stop", "message": {"content": json.dumps(body)}}]}
        return status, json.dumps(envelope).encode()

    return cu.HttpCurator("https://p.example", "m1", "PRESSWORK_TEST_KEY", transport, "do", "phase4_live", max_attempts=1, provider_id="p", **more), calls


def read(path, name="run.json"):
    return json.loads((path / name).read_text())


def test_shadow_runs(spark, tmp_path, monkeypatch):
    file = fixture(tmp_path, [article(1), article(2)])
    _, rows = validate.candidate_fixture(file)
    said = tmp_path / "answer.json"
    said.write_text(json.dumps(answer(rows)))
    kept = flows.shadow(flows.Shadow(file, said), tmp_path / "runs", run_id="r1")
    run = read(kept)
    assert run["status"] == "succeeded" and run["ai_event_count"] == 1 and run["provider_id"] == "fixture" and len(read(kept, "trace.json")) == 2
    said.write_text("{")
    with pytest.raises(json.JSONDecodeError):
        flows.shadow(flows.Shadow(file, said), tmp_path / "runs", run_id="r2")
    assert read(tmp_path / "runs" / DAY.isoformat() / "r2")["failure_code"] == "invalid_json"
    said.write_text(json.dumps(answer(rows, report_date="2026-01-01")))
    with pytest.raises(cu.ContractError):
        flows.shadow(flows.Shadow(file, said), tmp_path / "runs", run_id="r3")
    failed = read(tmp_path / "runs" / DAY.isoformat() / "r3")
    assert failed["failure_stage"] == "validation" and failed["failure_diagnostic"]["code"] == "report_date_mismatch"
    with pytest.raises(ValueError, match="another day"):
        flows.shadow(flows.Shadow(file, said), tmp_path / "runs", day=date(2026, 1, 1))


def test_shadow_with_a_provider(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PRESSWORK_TEST_KEY", "k")
    file = fixture(tmp_path, [article(1, summary="x" * 900), article(2)])
    _, rows = validate.candidate_fixture(file)
    provider, calls = http(answer(rows))
    figures = flows.shadow(flows.Shadow(file, provider=provider, dry_run=True, mode="phase4_live"), tmp_path / "runs")
    assert figures["transport_calls"] == 0 and not calls and figures["max_events"] == 20 and figures["capped"] == 1 and figures["candidate_count"] == 2
    run = read(flows.shadow(flows.Shadow(file, provider=provider, mode="phase4_live"), tmp_path / "runs", run_id="ok"))
    assert run["status"] == "succeeded" and run["summaries_capped_count"] == 1 and run["summaries_unchanged_count"] == 1 and run["model"] == "m1" and len(calls) == 1
    limited, _ = http(answer(rows), max_candidates=1)
    with pytest.raises(cu.ProviderError):
        flows.shadow(flows.Shadow(file, provider=limited, mode="phase4_live"), tmp_path / "runs", run_id="over")
    over = read(tmp_path / "runs" / DAY.isoformat() / "over")
    assert over["failure_stage"] == "preflight" and over["failure_code"] == "candidate_count_limit" and over["candidate_count"] == 2 and "source_excluded_count" not in over
    down, _ = http(answer(rows), status=500)
    with pytest.raises(cu.ProviderError):
        flows.shadow(flows.Shadow(file, provider=down, mode="phase4_live"), tmp_path / "runs", run_id="down")
    assert read(tmp_path / "runs" / DAY.isoformat() / "down")["failure_code"] == "http_5xx"


def test_shadow_rules():
    provider, _ = http({})
    for wrong in ({}, {"provider": provider, "mode": "phase4_live"}, {"provider": provider, "candidates": "c", "answer": "a", "mode": "phase4_live"}, {"answer": "a", "dry_run": True}, {"answer": "a", "mode": "phase4_live"}, {"provider": provider, "candidates": "c"}, {"answer": "a", "mode": "x"}):
        with pytest.raises(ValueError):
            flows.Shadow(**wrong)
    assert flows.Shadow(answer="a").events == 5 and flows.Shadow(answer="a", max_events=3).events == 3


def test_report_dates():
    assert delivery.report_date("Wed, 04 Mar 2026 01:00:00 GMT") == delivery.report_date("2026-03-04") == DAY
    assert delivery.report_date(None, DAY) == delivery.report_date("", DAY) == DAY
    with pytest.raises(ValueError):
        delivery.report_date("yesterday")


def test_delivery(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# A=0\n\nA = '1 2'\nA=3\nB=\"x=y\"\nC=\"z\nnoise\n")
    assert [delivery.env_value(env, k) for k in "ABCD"] == ["1 2", "x=y", '"z', ""] and delivery.env_value(tmp_path / "none", "A") == ""
    reports, mobile = tmp_path / "reports", tmp_path / "mobile"
    reports.mkdir()
    told, slept = [], []
    assert "no report" in delivery.notify("https://n.example/", reports, "digest", DAY, lambda *x: told.append(x))
    report = reports / delivery.report_file("digest", DAY)
    report.write_text("# x\n Displayed items: 7 of 9 \n" + "line\n" * 30)
    with pytest.raises(FileNotFoundError):
        delivery.mobile_copy(reports, mobile, "digest", DAY)
    mobile.mkdir()
    assert delivery.mobile_copy(reports, mobile, "digest", DAY).read_text() == report.read_text() and len(list(mobile.iterdir())) == 1
    with pytest.raises(ValueError):
        delivery.report_file("list", DAY)
    assert delivery.displayed_items(report) == "7 of 9"
    report.write_text("line\n" * 20 + "Displayed items: 1\n")
    assert delivery.displayed_items(report) == ""
    assert delivery.vault_uri("My Vault", "/notes/daily/", "a b.md") == "obsidian://open?vault=My%20Vault&file=notes%2Fdaily%2Fa%20b.md"
    failures = [HTTPError("u", 503, "busy", Message(), None), URLError("refused"), TimeoutError()]
    assert [delivery.error_text(f) for f in (*failures, OSError("x"))] == ["HTTP 503 busy", "refused", "request timed out", "x"]

    def send(url, body):
        if failures:
            raise failures.pop(0)
        told.append((url, json.loads(body)))

    assert delivery.notify("https://n.example/", reports, "digest", DAY, send, "obsidian://x", sleep=slept.append) == "request timed out" and slept == [10, 20]
    assert delivery.notify("https://n.example/", reports, "digest", DAY, send, "obsidian://x") == ""
    assert told == [("https://n.example", {"title": delivery.REPORTS["digest"][1], "body": f"reports/{report.name}", "url": "obsidian://x"})]


def test_log(tmp_path):
    logger = delivery.log_to(tmp_path / "logs" / "run.log")
    assert delivery.log_to(tmp_path / "logs" / "run.log") is logger
    with delivery.timed("stage"):
        pass
    with pytest.raises(RuntimeError), delivery.timed("bad"):
        raise RuntimeError
    text = (tmp_path / "logs" / "run.log").read_text()
    assert text.count("stage begins") == 1 and "stage took 0.0 s" in text and "bad failed" in text
    for handler in list(logger.handlers):
        logger.removeHandler(handler)
        handler.close()
    logger.setLevel(logging.NOTSET)
