"""Requests, fetch log and the whole job."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagequarry import settings as S
from pagequarry.operators import fetchlog as L
from pagequarry.operators import requests as R
from pagequarry.plans.scrape import scrape_batch
from pagequarry.schemas import ATTEMPTS

RICH = "<title>Ferries</title><ul>" + "<li>every hour on the hour</li>" * 12 + "</ul>"
SHELL = "<main data-page=ferries></main><script src=app.js></script>"
FULL = "<title>Rendered</title><p>" + "Filled in. " * 30 + "</p><a href='/n'>n</a>"


def test_request_defaults(spark):
    frame = spark.createDataFrame([("http://a.com", None), ("http://b.com", 5)], "url string, timeout int")
    rows = R.with_defaults(frame, headers={"A": "1"}, tags=["p"]).collect()
    assert [(r.use_browser, r.timeout, r.headers, r.tags) for r in rows] == [
        (False, 30, {"A": "1"}, ["p"]), (False, 5, {"A": "1"}, ["p"])]
    assert R.with_defaults(frame).first().tags == S.CONTENT_TAGS


def test_request_checks_in_order(spark):
    cases = [
        ("", 0, "ScrapeRequest requires a non-empty URL."),
        (None, 1, "ScrapeRequest requires a non-empty URL."),
        ("ftp://x", 0, "Invalid URL 'ftp://x'. Must start with http:// or https://"),
        ("HTTP://x", 1, "Invalid URL 'HTTP://x'. Must start with http:// or https://"),
        (" http://x", 1, "Invalid URL ' http://x'. Must start with http:// or https://"),
        ("http://x", 0, "Timeout must be a positive integer, got 0."),
        ("https://x", -3, "Timeout must be a positive integer, got -3."),
        ("https://x", 1, None),
    ]
    frame = spark.createDataFrame([(u, t) for u, t, _ in cases], "url string, timeout int")
    assert [r.error for r in R.validate(frame).collect()] == [e for *_, e in cases]


def test_request_url_is_stripped_then_cut(spark):
    cases = {" https://x/#a#b ": "https://x/", "https://x/ #a": "https://x/ ", "\x1chttps://x　": "https://x"}
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    got = R.normalize_requests(frame.withColumn("raw", F.col("url"))).collect()
    assert {r.raw: r.url for r in got} == cases


def log(spark, jobs):
    """url -> [(kind, status)], attempts in order"""
    rows = [
        (url, n, kind, status, None, f"detail {n}", False)
        for url, attempts in jobs.items()
        for n, (kind, status) in enumerate(attempts, 1)
    ]
    return spark.createDataFrame(rows, ATTEMPTS)


@pytest.mark.parametrize("partitions", [1, 4])
def test_resolving_attempts(spark, partitions):
    jobs = {
        "good": [("ok", 200)],
        "missing": [("http_error", 404), ("ok", 200)],
        "broken": [("http_error", 500)] * 3,
        "slow": [("timeout", None)] * 3,
        "down": [("connection", None)] * 3,
        "second": [("timeout", None), ("ok", 200)],
        "loop": [("redirect_loop", None), ("ok", 200)],
        "odd": [("other", None), ("http_error", None), ("other", None)],
        "late": [("timeout", None)] * 3 + [("ok", 200)],
        "pending": [("timeout", None), ("http_error", 503)],
    }
    attempts = log(spark, jobs).repartition(partitions)
    got = {r.url: (r.success, r.status_code, r.error, r.attempts) for r in L.resolve(L.classify(attempts)).collect()}
    assert got == {
        "good": (True, 200, None, 1),
        "missing": (False, 404, "HTTP 404 error: detail 1", 1),
        "broken": (False, -1, "Failed after 3 attempts: HTTP 500 error: detail 3", 3),
        "slow": (False, -1, "Failed after 3 attempts: Request timed out after 30s", 3),
        "down": (False, -1, "Failed after 3 attempts: Connection failed — check network or URL", 3),
        "second": (True, 200, None, 2),
        "loop": (False, -1, "Too many redirects — possible redirect loop", 1),
        "odd": (False, -1, "Failed after 3 attempts: Unexpected error: detail 3", 3),
        "late": (False, -1, "Failed after 3 attempts: Request timed out after 30s", 3),
        "pending": (None, None, None, 2),
    }


def test_backoff(spark):
    attempts = log(spark, {"u": [("timeout", None)] * 3, "v": [("ok", 200)]})
    got = L.with_backoff(L.classify(attempts)).collect()
    assert sorted((r.url, r.attempt, r.wait_seconds) for r in got) == [
        ("u", 1, 2), ("u", 2, 4), ("u", 3, None), ("v", 1, None)]


def test_rendered_outcomes(spark):
    rows = [("a", 1, "ok", 404, "<p>", None, True), ("b", 1, "ok", None, "<p>", None, True),
            ("c", 1, "timeout", None, None, None, True), ("d", 1, "other", None, None, "Error: x", True)]
    got = L.rendered_outcome(spark.createDataFrame(rows, ATTEMPTS)).collect()
    assert [(r.success, r.status_code, r.error, r.used_browser) for r in got] == [
        (True, 404, None, True), (True, -1, None, True),
        (False, -1, "Playwright timed out after 30000ms", True),
        (False, -1, "Playwright error: Error: x", True)]


def test_sparse_counts_stripped_characters(spark):
    cases = {" " * 300: True, "é" * 199 + "\n": True, "é" * 200: False, "": True}
    frame = spark.createDataFrame([(h,) for h in cases], "html string")
    assert {r.html: r.s for r in frame.select("html", L.is_sparse(F.col("html")).alias("s")).collect()} == cases


RESPONSE = "id int, url string, use_browser boolean, status_code int, html string, success boolean, error string, used_browser boolean"


def test_rendered_fallback(spark):
    static = spark.createDataFrame(
        [(i, "u", i == 5, 200, html, ok, None, i == 5) for i, html, ok in
         [(1, SHELL, True), (2, SHELL, True), (3, RICH, True), (4, "", False), (5, SHELL, True), (6, SHELL, True)]],
        RESPONSE)
    rendered = spark.createDataFrame(
        [(1, "u", True, 404, FULL, True, None, True), (2, "u", True, -1, "", False, "late", True),
         (3, "u", True, 200, FULL, True, None, True), (4, "u", True, 200, FULL, True, None, True),
         (5, "u", True, 200, FULL, True, None, True)], RESPONSE)
    got = {r.id: (r.status_code, r.html, r.used_browser) for r in L.rendered_fallback(static, rendered, "id").collect()}
    assert got == {
        1: (404, FULL, True), 2: (200, SHELL, False), 3: (200, RICH, False),
        4: (200, "", False), 5: (200, SHELL, True), 6: (200, SHELL, False)}
    assert L.rendered_fallback(static, rendered, "id", auto_browser=False) is static
    again = L.rendered_requests(static, ["id", "url"]).collect()
    assert sorted((r.id, r.use_browser) for r in again) == [(1, True), (2, True), (6, True)]


FETCH = ("request_id int, url string, use_browser boolean, attempt int, kind string, status_code int, html string, "
         "error string, fetched_at timestamp")


def test_scrape_batch(spark):
    noon = datetime(2024, 5, 1, 12)
    requests = spark.createDataFrame(
        [(i, u, b, t) for i, u, b, t in [
            (1, "https://e.com/a#x ", None, None), (2, "https://e.com/b", False, 9), (3, "https://e.com/c", True, 9),
            (4, "https://e.com/d", False, 9), (5, "", False, 9), (6, "https://e.com/f", False, -1),
            (7, "https://e.com/g", False, 9), (8, "https://e.com/h", False, 9), (9, "https://e.com/i", True, 9),
            (10, "https://e.com/j", False, 9), (11, "https://e.com/k", False, 9)]],
        "request_id int, url string, use_browser boolean, timeout int")
    fetches = spark.createDataFrame(
        [(i, f"https://e.com/{chr(96 + i)}", b, n, k, s, h, e, noon) for i, b, n, k, s, h, e in [
            (1, False, 1, "timeout", None, None, None), (1, False, 2, "ok", 200, RICH, None),
            (2, False, 1, "ok", 200, SHELL, None), (2, True, 1, "ok", 404, FULL, None),
            (3, True, 1, "ok", 500, FULL, None), (3, False, 1, "ok", 200, RICH, None),
            (4, False, 1, "ok", 200, SHELL, None), (4, True, 1, "timeout", None, None, None),
            (5, False, 1, "ok", 200, RICH, None), (6, False, 1, "ok", 200, RICH, None),
            (7, False, 1, "connection", None, None, None), (7, False, 2, "http_error", 500, "<p>no", "x"),
            (7, False, 3, "timeout", None, None, None), (7, False, 4, "ok", 200, RICH, None),
            (8, False, 1, "http_error", 404, "<p>gone", "gone"), (8, True, 1, "ok", 200, FULL, None),
            (9, True, 1, "other", None, None, "Crash: y"),
            (10, False, 1, "ok", 200, "", None),
            (11, False, 1, "http_error", 503, None, "busy")]], FETCH)
    got = {r.request_id: r for r in scrape_batch(requests, fetches).collect()}
    facts = {i: (r.url[-1:], r.status_code, r.title, r.success, r.error, r.used_browser) for i, r in got.items()}
    assert facts == {
        1: ("a", 200, "Ferries", True, None, False),
        2: ("b", 404, "Rendered", True, None, True),
        3: ("c", 500, "Rendered", True, None, True),
        4: ("d", 200, "", True, None, False),
        5: ("", -1, "", False, "ScrapeRequest requires a non-empty URL.", False),
        6: ("f", -1, "", False, "Timeout must be a positive integer, got -1.", False),
        7: ("g", -1, "", False, "Failed after 3 attempts: Request timed out after 9s", False),
        8: ("h", 404, "", False, "HTTP 404 error: gone", False),
        9: ("i", -1, "", False, "Playwright error: Crash: y", True),
        10: ("j", 200, "", False, S.ERROR_NO_HTML, False),
        11: ("k", -1, "", None, None, False),
    }
    assert got[1].content.count("every hour") == 12
    assert got[2].links == ["https://e.com/n"] and got[8].links == []
    assert got[7].scraped_at == noon and got[5].scraped_at is None
    static_only = scrape_batch(requests, fetches, auto_browser=False).filter("request_id = 2").first()
    assert (static_only.status_code, static_only.used_browser) == (200, False)




def fetch_rows(spark, url, key=1, html="<p>x</p><a href=b>b</a><a href=/c>c</a>"):
    row = [(key, url, False, 1, "ok", 200, html, None, datetime(2024, 5, 1))]
    return spark.createDataFrame(row, "request_id int, url string, use_browser boolean, attempt int, kind string, "
                                      "status_code int, html string, error string, fetched_at timestamp")


def test_links_are_relative_to_the_request_not_to_the_redirect(spark):
    requests = spark.createDataFrame([(1, "http://a.org/x/")], "request_id int, url string")
    row = scrape_batch(requests, fetch_rows(spark, "https://www.b.org/moved/")).first()
    assert (row.url, row.links) == ("http://a.org/x/", ["http://a.org/x/b", "http://a.org/c"])


def test_jobs_keyed_by_url(spark):
    requests = spark.createDataFrame([("http://a.org/x/#top ",), ("http://z.org",)], "url string")
    rows = {r.url: r for r in scrape_batch(requests, fetch_rows(spark, "http://a.org/x/"), key="url").collect()}
    assert rows["http://a.org/x/"].links == ["http://a.org/x/b", "http://a.org/c"]
    assert rows["http://z.org"].success is None and rows["http://z.org"].links == []
