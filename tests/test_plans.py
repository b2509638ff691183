"""Sources, the curator's contract and exchange, artifacts, reports and the stream."""

import io
import json
import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from presswork.config import ReportConfig
from presswork.operators import candidates as cd
from presswork.operators import curation, validate
from presswork.plans import artifacts, flows
from presswork.plans import curator as cu
from presswork.sources import feeds, market
from presswork.streaming import news as stream

DAY, NOW = date(2024, 1, 10), datetime(2024, 1, 10, 12)
RSS = """<rss><channel>{}</channel></rss>"""
ITEM = "<item><title>{}</title><link>{}</link><description>{}</description><pubDate>{}</pubDate></item>"
FRESH, STALE = "Wed, 10 Jan 2024 08:00:00 GMT", "Wed, 01 Jan 2020 08:00:00 GMT"


@pytest.fixture
def listing(tmp_path):
    one = RSS.format("".join([ITEM.format("美联储公布利率决议", "https://x.example/a?utm_source=1#f", "央行 与 利率", FRESH), ITEM.format("again", "https://x.example/a", "", FRESH), ITEM.format("OpenAI 发布新模型", "https://x.example/b", "AI 芯片 订单", FRESH), ITEM.format("no link", "", "", FRESH), ITEM.format("old", "https://x.example/c", "", STALE)]))
    (tmp_path / "one.xml").write_text(one)
    (tmp_path / "bad.xml").write_text("<rss><channel>")
    (tmp_path / "feeds.json").write_text(json.dumps([{"name": "One", "url": "one.xml", "mode": "keyword", "role": "market"}, {"name": "Bad", "url": "bad.xml", "mode": "all"}, {"name": "Net", "url": "https://nowhere.example/x"}]))
    return tmp_path


KEYWORDS = {"财经股票": ["利率", "股票"], "AI方向": ["OpenAI"]}


def test_scan_to_candidates(spark, listing):
    entries, failures = feeds.read_feeds(spark, str(listing / "feeds.json"))
    assert entries.count() == 5 and {r["feed_name"] for r in failures.collect()} == {"Bad", "Net"}
    config = ReportConfig(report_type="digest")
    found = cd.candidates(entries, config, DAY, NOW)
    unique = cd.unique_candidates(found)
    assert sorted(r["title"] for r in unique.collect()) == ["OpenAI 发布新模型", "no link", "美联储公布利率决议"]
    frame = feeds.feed_frame(spark, feeds.normalize_feeds(json.loads((listing / "feeds.json").read_text())))
    chosen = cd.legacy_items(unique, KEYWORDS, frame, 3)
    assert sorted(r["link"] for r in chosen.collect()) == ["https://x.example/a?utm_source=1#f", "https://x.example/b"]
    trace = {r["title"]: r for r in cd.trace(unique, chosen).collect()}
    assert trace["no link"]["legacy_reject_reason"] and trace["OpenAI 发布新模型"]["legacy_selected"] and trace["OpenAI 发布新模型"]["legacy_matched_keywords"] == {"AI方向": ["OpenAI"]}
    assert cd.windows(found).first()["window_end"] is not None


HOLDINGS = {"holdings": [{"code": "601211", "name": "国泰海通", "market": "sh", "sector": "证券", "watch_tags": ["利率"], "notes": ""}]}


def opener(request, timeout):
    rows = [{"f12": "000001", "f14": "上证指数", "f3": 0.8, "f124": 1704850000}, {"f12": "000688", "f14": "科创50", "f3": 3.5}, {"f12": "601211", "f14": "国泰海通", "f3": "-"}]

    class Answer(io.BytesIO):
        def __exit__(self, *a):
            return None

    return Answer(json.dumps({"data": {"diff": rows}}).encode())


@pytest.mark.parametrize("kind", ["list", "digest", "market_brief", "overnight_brief"])
def test_reports(spark, listing, kind):
    entries, failures = feeds.read_feeds(spark, str(listing / "feeds.json"))
    frame = feeds.feed_frame(spark, feeds.normalize_feeds(json.loads((listing / "feeds.json").read_text())))
    (listing / "holdings.json").write_text(json.dumps(HOLDINGS))
    failed = [(r["feed_name"], r["error"]) for r in failures.collect()]
    path = flows.run(spark, entries, frame, KEYWORDS, ReportConfig(report_type=kind), DAY, NOW, listing / "out", listing / "holdings.json", listing / "none.json", failed, opener)
    text = path.read_text()
    assert "2024-01-10" in text and "Bad" in text and text.startswith("# ")
    assert {"list": "OpenAI 发布新模型", "digest": "一句话主线", "market_brief": "科创50", "overnight_brief": "今日值得关注"}[kind] in text
    if kind == "market_brief":
        assert "涨跌幅 数据暂不可用" in text and "+0.80%" in text and "科创50明显强于其他主要指数" in text


def article(i):
    return {"article_id": f"art_{i}", "title": f"t{i}", "summary": "s" * (600 if i == 0 else 5), "source": "S", "feed_name": "S", "feed_role": "market", "published_at": datetime(2024, 1, 9, i, tzinfo=timezone.utc), "link": f"https://x.example/{i}", "normalized_link": f"https://x.example/{i}", "report_date": DAY, "collected_at": datetime(2024, 1, 10, tzinfo=timezone.utc), "author": "", "language": "en"}


def request(n=3):
    return cu.build_request([article(i) for i in range(n)], DAY)


def response(**changes):
    event = {"event_id": "e1", "canonical_title": "利率决议", "summary": "摘要", "category": "financial_markets", "importance": "must_know", "why_important": "重要", "evidence_article_ids": ["art_0"], "novelty": "new_event", "confidence": "high", "uncertainties": []}
    return {"schema_version": cu.SCHEMA_VERSION, "report_date": "2024-01-10", "events": [event | changes.pop("event", {})], "rejected_article_ids": ["art_1"], "warnings": [], **changes}


BREACHES = [
    ({"schema_version": "x"}, "schema_version_mismatch"), ({"report_date": "x"}, "report_date_mismatch"), ({"events": 1}, "events_not_list"), ({"events": [1]}, "event_not_object"), ({"event": {"summary": " "}}, "missing_required_field"),
    ({"event": {"category": "x"}}, "invalid_enum_value"), ({"event": {"evidence_article_ids": []}}, "evidence_required"), ({"event": {"evidence_article_ids": ["art_9"]}}, "unknown_evidence_article_id"),
    ({"event": {"evidence_article_ids": ["art_0", "art_0"]}}, "duplicate_evidence_article_id"), ({"event": {"uncertainties": "x"}}, "uncertainties_not_list"), ({"rejected_article_ids": "x"}, "rejected_article_ids_not_list"),
    ({"rejected_article_ids": [1]}, "rejected_article_invalid_type"), ({"rejected_article_ids": ["art_1", "art_1"]}, "duplicate_rejected_article_id"), ({"rejected_article_ids": [{"article_id": "art_1", "reject_reason": "x"}]}, "invalid_reject_reason"),
    ({"rejected_article_ids": ["art_0"]}, "selected_rejected_overlap"), ({"warnings": "x"}, "warnings_not_list"), ({"rejected_article_ids": ["zz"]}, "unknown_rejected_article_id"),
]


@pytest.mark.parametrize("changes,code", BREACHES)
def test_contract(changes, code):
    with pytest.raises(cu.ContractError) as e:
        cu.validate(response(**dict(changes)), request())
    assert e.value.code == code


def test_contract_holds():
    own = cu.validate(response(), request())
    assert own["rejected_article_ids"] == [{"article_id": "art_1", "reject_reason": "low_significance"}]
    with pytest.raises(cu.ContractError):
        cu.check_policy(cu.validate(response(event={"summary": "建议 买入"}), request()))


def curator(monkeypatch, answers, **options):
    calls = []

    def transport(url, body, headers, timeout):
        calls.append(body)
        a = answers[min(len(calls), len(answers)) - 1]
        if isinstance(a, Exception):
            raise a
        return a if isinstance(a, tuple) else (200, json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": json.dumps(a)}}]}).encode())

    monkeypatch.setenv("TEST_CURATOR_KEY", "k")
    return cu.HttpCurator("https://x.example", "m", "TEST_CURATOR_KEY", transport, "be exact", **options), calls


def test_exchange(monkeypatch):
    c, calls = curator(monkeypatch, [(503, b""), response()])
    assert c.curate(request())["events"][0]["event_id"] == "e1" and len(calls) == 2
    for answers, stage, code, n in [([(400, b"")], "provider", "http_4xx", 1), ([(429, b"")], "provider", "http_429", 2), ([TimeoutError()], "transport", "timeout", 2), ([(200, b"no")], "response_parse", "invalid_json", 1), ([response(warnings="x")], "validation", "invalid_curator_response", 1), ([response(warnings=["you should buy"])], "content_policy", "content_policy_violation", 1)]:
        c, calls = curator(monkeypatch, answers)
        got, failure = cu.curate_or_none(c, request())
        assert got is None and (failure.stage, failure.code, len(calls)) == (stage, code, n)


def test_limits_come_before_any_call(monkeypatch):
    c, calls = curator(monkeypatch, [response()], mode=cu.LIVE, max_candidates=2)
    with pytest.raises(cu.ProviderError, match="candidate_count_limit"):
        c.curate(request())
    c, _ = curator(monkeypatch, [response()], mode=cu.LIVE)
    ready = c.prepare(request())
    assert ready.metrics["capped"] == 1 and ready.metrics["unchanged"] == 2 and len(ready.request.articles[0]["summary"]) == 500
    for most, good in ((len(ready.body), True), (len(ready.body) - 1, False)):
        c, calls = curator(monkeypatch, [response()], mode=cu.LIVE, max_body_bytes=most)
        assert (cu.curate_or_none(c, request())[0] is not None) == good and (len(calls) == 1) == good


def test_live_mode_drops_rejections(monkeypatch):
    c, _ = curator(monkeypatch, [response(event={"evidence_article_ids": ["art_0", "art_0"]}, rejected_article_ids=["nobody"])], mode=cu.LIVE)
    assert c.curate(request())["rejected_article_ids"] == []


def test_artifacts(tmp_path):
    r = request()
    info = {"status": "succeeded", "provider_id": "p", "model": "m", "api_key_env": "K", "attempts": 1, "validation_status": "passed", "original_candidate_count": 3, "source_excluded_count": 0}
    trace = [{"article_id": "art_0", "title": "t0", "legacy_selected": True}, {"trace_type": "fetch_failures", "candidate_failures": [("Bad", "timed out")]}]
    out = artifacts.write_run(tmp_path, info, "2024-01-10", r, response(), trace, "run1")
    assert {p.name for p in out.iterdir()} == {"run.json", "trace.json", "review.md", "request.json", "response.json"}
    assert json.loads((out / "trace.json").read_text())[1]["candidate_failures"] == [{"feed_name": "Bad", "failure_code": "timeout"}]
    with pytest.raises(FileExistsError):
        artifacts.write_run(tmp_path, info, "2024-01-10", r, response(), trace, "run1")
    for bad in ({"original_candidate_count": 9}, {"status": "x"}, {"failure_code": "x"}, {"input_mode": "x"}):
        with pytest.raises(ValueError):
            artifacts.write_run(tmp_path, info | bad, "2024-01-10", r, response(), trace, "run2")
    assert not list((tmp_path / "2024-01-10").glob(".*"))
    failed = artifacts.write_run(tmp_path, {"status": "failed", "failure_stage": "transport", "failure_code": "timeout", "attempts": 2}, "2024-01-10", None, None, [])
    assert {p.name for p in failed.iterdir()} == {"run.json", "trace.json", "review.md"}
    assert "t0" in artifacts.preview(cu.validate(response(), r), r, trace[:1], ("买入",))


def test_overnight_with_curated_events(spark, listing):
    entries, _ = feeds.read_feeds(spark, str(listing / "feeds.json"))
    frame = feeds.feed_frame(spark, feeds.normalize_feeds(json.loads((listing / "feeds.json").read_text())))
    unique = cd.unique_candidates(cd.candidates(entries, ReportConfig(report_type="overnight_brief"), DAY, NOW))
    ids = {r["title"]: r["article_id"] for r in unique.collect()}
    (listing / "holdings.json").write_text(json.dumps(HOLDINGS))
    given = response(event={"evidence_article_ids": [ids["美联储公布利率决议"]], "uncertainties": ["待确认的事"]}, rejected_article_ids=[])
    path = flows.run(spark, entries, frame, KEYWORDS, ReportConfig(report_type="overnight_brief"), DAY, NOW, listing / "out", listing / "holdings.json", listing / "none.json", [], None, True, cu.FixtureCurator(given))
    text = path.read_text()
    assert "### 利率决议" in text and "证据来源" in text and "待确认的事" in text


def test_violations_as_tables(spark):
    schema = "response_id string, pos long, event_id string, canonical_title string, summary string, why_important string, category string, importance string, novelty string, confidence string, evidence_article_ids array<string>, uncertainties array<string>"
    good = ("e", "t", "s", "w", "other", "important", "new_event", "high")
    events = spark.createDataFrame([("a", 0, *good, ["1"], []), ("b", 0, *good, ["9"], []), ("c", 0, *good, ["1"], []), ("c", 1, *good, ["2"], []), ("d", 0, *good, ["1"], [])], schema)
    responses = spark.createDataFrame([(x, "v", "d", "v", "d", 5) for x in "abcd"], "response_id string, schema_version string, report_date string, expected_version string, expected_date string, max_events int")
    known = spark.createDataFrame([(x, i) for x in "abcd" for i in "12"], "response_id string, article_id string")
    rejected = spark.createDataFrame([("d", 0, "1", None)], "response_id string, pos long, article_id string, reject_reason string")
    got = {r["response_id"]: r["code"] for r in curation.first_violation(curation.violations(responses, events, rejected, known)).collect()}
    assert got == {"b": "unknown_evidence_article_id", "c": "duplicate_event_id", "d": "selected_rejected_overlap"}


def test_holdings(spark, tmp_path):
    errors, warnings = validate.holdings_payload({"holdings": [{"code": "", "name": "n", "market": "m", "sector": "s", "watch_tags": "x", "cost": 1, "odd": 2}, 3]})
    assert len(errors) == 5 and len(warnings) == 1
    assert validate.holdings_payload(1)[0] and validate.holdings_payload({"holdings": 1})[0]
    frame, file, example = market.load_holdings(spark, tmp_path / "a", tmp_path / "b")
    assert (frame.count(), file, example) == (0, None, False)
    with pytest.raises(ValueError):
        market.normalize_holdings({"holdings": [{"code": "1"}]})
    assert validate.holding_rows(spark.createDataFrame([(0, "", "n", "m", None)], "ord int, code string, name string, market string, sector string")).count() == 2


def test_candidate_rows(spark):
    schema = "ord int, article_id string, title string, source string, feed_name string, feed_role string, published_at string, link string, normalized_link string, report_date string, expected_date string"
    ok = ("", "t", "s", "f", "r", "2024-01-01T00:00:00Z", "https://x.example/1", "", "d", "d")
    rows = [(0, *ok), (1, *ok), (2, "", " ", *ok[2:]), (3, *ok[:5], "2024-01-01T00:00:00", "https://x.example/3", *ok[7:]), (4, *ok[:5], None, "", *ok[7:]), (5, "art_x", *ok[1:6], "https://x.example/5", *ok[7:])]
    got = {r["ord"]: r["code"] for r in validate.candidate_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "duplicate_candidate_key", 2: "missing_title", 3: "bad_published_at", 4: "link_required", 5: "article_id_conflict"}


def test_gold():
    row = {"reference_id": "r", "tier": "must_include_at_10", "supporting_article_ids": ["1"], "forbidden_article_ids": ["2"], "attribution_required": True, "uncertainty_expected": False}
    own = {"snapshot_id": "s", "snapshot_sha256": "a" * 64, "reference_max_events": 5, "events": [row], "representative_omit_article_ids": []}
    assert validate.gold(own) == own
    for bad in ({"snapshot_sha256": "x"}, {"events": []}, {"events": [row, row]}, {"events": [row | {"forbidden_article_ids": ["1"]}]}, {"reference_max_events": 0}):
        with pytest.raises(ValueError):
            validate.gold(own | bad)


def test_request_json_is_what_the_driver_writes(spark):
    rows = spark.createDataFrame([("art_1", "标题", "s", "S", "S", "market", NOW, "l", "l", DAY, NOW, "a", "en")], "article_id string, title string, summary string, source string, feed_name string, feed_role string, published_at timestamp, link string, normalized_link string, report_date date, collected_at timestamp, author string, language string")
    got = curation.request_json(rows).first()
    one = cu.build_request([{**rows.first().asDict(), "published_at": NOW.replace(tzinfo=timezone.utc), "collected_at": NOW.replace(tzinfo=timezone.utc)}], DAY).articles[0]
    assert got["json"] == cu.canonical_json(one).decode() and got["bytes"] == len(cu.canonical_json(one))


def test_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [("f", f"t{i % 5}", f"https://x.example/{i % 5}/?utm_a={rng.random()}", "s", datetime(2024, 1, 10, 1, i)) for i in range(20)]
    spark.createDataFrame(rows, "feed_name string, title string, link string, summary string, published_ts timestamp").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("feed_name string, title string, link string, summary string, published_ts timestamp").parquet(str(tmp_path / "in"))
    q = stream.candidates(source).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 5
    assert stream.counts(spark.table("once")).agg(F.sum("n")).first()[0] == 5
