"""Feed parsing and ingestion: nested envelopes, broken payloads, dates, failure rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapeworks.plans.ingest import ingest
from tapeworks.sources import feeds

RAW = "payload_id string, ticker string, status int, payload string, fetched_at timestamp"
NOW = dt.datetime(2026, 6, 26, 12)


def as_of():
    return F.lit("2026-06-26 12:00:00").cast("timestamp")


def raw(spark, *payloads):
    return spark.createDataFrame([(f"p{i}", "aapl", 200, p, NOW) for i, p in enumerate(payloads)], RAW)


def item(k, **more):
    return {"title": f"T{k}", "url": f"https://x.com/{k}", "date": "2 hours ago", "description": f"D{k}", **more}


@pytest.mark.parametrize("depth", [0, 1, 3, 4, 7])
@pytest.mark.parametrize("as_text", [True, False])
def test_nested_envelopes_are_found(spark, depth, as_text):
    body = {"news": [item(1)]}
    for level in range(depth):
        body = {["body", "response", "result", "parsed"][level % 4]: json.dumps(body) if as_text else body}
    assert [r.title for r in feeds.parse_search(raw(spark, json.dumps(body)), as_of()).collect()] == ["T1"]


def test_list_text_and_depth_first_order(spark):
    as_list = json.dumps({"body": json.dumps([item(1)])})
    deep_first = json.dumps({"result": {"body": {"items": [item(2)]}}, "parsed": {"items": [item(3)]}})
    empty_first = json.dumps({"result": {"items": []}, "body": {"data": [item(4)]}})
    got = {r.payload_id: r.title for r in feeds.parse_search(raw(spark, as_list, deep_first, empty_first), as_of()).collect()}
    assert got == {"p0": "T1", "p1": "T2", "p2": "T4"}


def test_what_cannot_be_read_is_an_error_row(spark):
    body = {"news": [item(1)]}
    for _ in range(12):
        body = {"body": body}
    bad = feeds.search_errors(raw(spark, "{broken", json.dumps(body), json.dumps({"news": [item(2)]}), "{}")).collect()
    assert {r.payload_id: r.error for r in bad} == {"p0": "payload is not JSON", "p1": "envelopes nested deeper than 8"}
    rss = raw(spark, "<rss><channel><item></rss>", '<rss version="2.0"><channel><title>f</title></channel></rss>')
    assert [r.payload_id for r in feeds.rss_errors(rss).collect()] == ["p0"]


def test_rfc822_without_seconds_and_with_short_years(spark):
    cases = {
        "Fri, 26 Jun 2026 15:52:03 GMT": dt.datetime(2026, 6, 26, 15, 52, 3), "26 Jun 2026 15:52 GMT": dt.datetime(2026, 6, 26, 15, 52),
        "Fri, 26 Jun 26 15:52:03 +0200": dt.datetime(2026, 6, 26, 13, 52, 3), "1 Jan 99 10:00 GMT": dt.datetime(1999, 1, 1, 10), "no date": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", feeds.parse_rfc822(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == cases


def rss(*items):
    return "<rss version='2.0'><channel>" + "".join(f"<item>{i}</item>" for i in items) + "</channel></rss>"


def test_rss_keeps_items_without_title_and_search_drops_them(spark):
    feed = rss("<link>https://x.com/1</link><pubDate>Fri, 26 Jun 2026 10:00:00 GMT</pubDate>", "<title>A</title><link>https://x.com/2</link><pubDate>Fri, 26 Jun 2026 09:00:00 GMT</pubDate>")
    r = raw(spark, feed)
    rows, summary = ingest(r, feeds.parse_rss(r), None, F.lit("2026-06-01").cast("timestamp"), parse_errors=feeds.rss_errors(r))
    assert sorted(x.url for x in rows.collect()) == ["https://x.com/1", "https://x.com/2"]
    s = raw(spark, json.dumps({"news": [{"url": "https://x.com/1", "date": "1 hour ago"}, item(2), {"title": "no link", "date": "1 hour ago"}]}))
    assert [x.title for x in feeds.parse_search(s, as_of()).collect()] == ["T2"]


def test_summary_counts_failures_of_both_kinds_and_cap_binds(spark):
    many = json.dumps({"news": [item(k) for k in range(12)]})
    r = raw(spark, many, "{broken", many).unionByName(spark.createDataFrame([("p9", "msft", 500, many, NOW)], RAW))
    rows, summary = ingest(r, feeds.parse_search(r, as_of()), None, F.lit("2026-06-01").cast("timestamp"), parse_errors=feeds.search_errors(r))
    got = {x.ticker: x for x in summary.collect()}
    assert rows.count() == 8 and got["AAPL"].fetched == 16 and got["AAPL"].duplicates == 8
    assert got["AAPL"].failed_payloads == 1 and got["AAPL"].error == "payload is not JSON"
    assert got["MSFT"].failed_payloads == 1 and got["MSFT"].error == "HTTP 500" and got["MSFT"].fetched == 0


def test_no_session_setting_is_changed(spark):
    before = spark.conf.get("spark.sql.constraintPropagation.enabled")
    feeds.parse_search(raw(spark, "{}"), as_of()).count()
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == before


def test_runs_into_a_log_store_each_key_once(spark, tmp_path):
    from tapeworks.plans.ingest import ingest_into
    from tapeworks.sinks.snapshots import KeyLog

    schema = "payload_id string, ticker string, position int, published_ts timestamp, title string, body string, source string, url string"
    item = lambda k, day: ("p1", "a", k, dt.datetime(2026, 6, day), f"t{k}", "b", "s", f"u{k}")
    raw = spark.createDataFrame([("p1", "a", 200)], "payload_id string, ticker string, status int")
    log, since = KeyLog(spark, str(tmp_path / "log")), F.lit("2026-06-01").cast("timestamp")
    run = lambda name, rows: ingest_into(log, name, raw, spark.createDataFrame(rows, schema), since).first()
    copy = ("p1", "a", 5, *item(1, 11)[3:])  # the same article further down the payload
    first = run("r1", [item(0, 10), item(1, 11), copy])
    assert (first["new"], first["duplicates"]) == (2, 1)
    again = run("r2", [item(0, 10), item(2, 2)])  # a copy of the run before, and a new one older than all
    assert (again["new"], again["duplicates"]) == (1, 1)
    run("r2", [item(3, 12)])  # a run repeated under its name adds nothing
    assert sorted(r.title for r in log.read().collect()) == ["t0", "t1", "t2"]


def test_search_body_skips_blank_entities(spark):
    from pyspark.sql import functions as F

    from tapeworks.sources.feeds import SEARCH_BODY_KEYS, search_body

    names = [*SEARCH_BODY_KEYS, "title", "headline"]
    rows = [
        ("&nbsp;<b>&#160;</b>", None, "<p>R&amp;D up</p>", "later", None, "t", None),
        ("&nbsp;", "", "<br>", None, "&emsp;", " Head ", None),
        ("&lt;", "x", None, None, None, "t", "h"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = [r[0] for r in df.select(search_body({n: F.col(n) for n in names})).collect()]
    assert got == ["R&D up", "Head", "<"]
