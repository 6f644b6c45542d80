"""Store operations, files and reports."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.operators import reports as P
from pagequarry.operators import store
from pagequarry.schemas import RESULT_COLUMNS, RESULTS
from pagequarry.session import work_folder
from pagequarry.sources import results as files
from pagequarry.streaming.scrape_stream import arriving_pages, current_results, start_scraping

NOON = datetime(2024, 5, 1, 12)


def results(spark, rows):
    """(url, title, write_seq)"""
    frame = spark.createDataFrame(rows, "url string, title string, write_seq long")
    return frame.select(
        "url", F.lit(200).alias("status_code"), "title", F.lit("").alias("content"),
        F.array().cast("array<string>").alias("links"), F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"), F.lit(NOON).alias("scraped_at"),
        F.lit(False).alias("used_browser"), "write_seq")


def urls(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, url string")


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://docs.example.org/3/", "docs.example.org_3"),
        ("http://docs.example.org/3", "docs.example.org_3"),
        ("https://a.com/?x=1", "a.com_x_1"),
        ("https://a.com/für/x", "a.com_für_x"),
        ("HTTPS://a.com", "HTTPS_a.com"),
        ("https://a.com/" + "b" * 193 + "/c", "a.com_" + "b" * 193),
        ("https://a.com/x__½-y.z²", "a.com_x_½-y.z²"),
        ("", ""),
    ],
)
def test_storage_key(spark, url, key):
    assert urls(spark, url).select(store.storage_key(F.col("url"))).first()[0] == key


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=30), min_size=5))
def test_keys_are_safe_names(spark, texts):
    import re

    got = urls(spark, *texts).select("url", store.storage_key(F.col("url")).alias("k")).collect()
    for row in got:
        bare = re.sub(r"_+", "_", re.sub(r"[^\w\-.]", "_", re.sub(r"^https?://", "", row.url)))
        assert row.k == bare[:200].strip("_")


def test_last_write_wins(spark):
    stored = store.latest(results(spark, [("http://a/x", "old a", 1), ("http://b", "old b", 2)]))
    new = results(spark, [("https://a/x/", "a3", 3), ("http://a/x", "a5", 5), ("http://a/x", "a4", 4), ("http://c", "c6", 6)])
    merged = store.upsert(stored, new).collect()
    assert sorted((r.storage_key, r.title) for r in merged) == [("a_x", "a5"), ("b", "old b"), ("c", "c6")]


def test_lookup_exists_delete(spark):
    stored = store.latest(results(spark, [("http://a/x", "A", 1), ("http://b", "B", 2)]))
    asked = urls(spark, "https://a/x/", "http://a/x", "http://z", "http://a/x")
    found = store.lookup(asked, stored, "id").collect()
    assert sorted((r.id, r.result and r.result.title) for r in found) == [(0, "A"), (1, "A"), (2, None), (3, "A")]
    assert sorted(r.id for r in store.already_scraped(asked, stored, "id").collect()) == [0, 1, 3]
    assert [r.id for r in store.to_scrape(asked, stored, "id").collect()] == [2]
    assert [r.title for r in store.delete(stored, asked).collect()] == ["B"]
    flags = store.deletions(stored, asked, "id").collect()
    assert sorted((r.id, r.deleted) for r in flags) == [(0, True), (1, False), (2, False), (3, False)]


def test_requests_without_url_match_nothing_and_stay(spark):
    stored = store.latest(results(spark, [("http://a/x", "A", 1)]))
    asked = urls(spark, "http://a/x", None, None, "http://z")
    assert sorted(r.id for r in store.to_scrape(asked, stored, "id").collect()) == [1, 2, 3]
    assert [r.id for r in store.already_scraped(asked, stored, "id").collect()] == [0]
    found = {r.id: r.result for r in store.lookup(asked, stored, "id").collect()}
    assert found[0].title == "A" and [found[k] for k in (1, 2, 3)] == [None] * 3


def test_requests_without_url_do_not_meet_in_one_partition(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(4000).select("id", F.lit(None).cast("string").alias("url"))
        stored = store.latest(results(spark, [("http://a/x", "A", 1)]))
        sizes = store.to_scrape(asked, stored, "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2000


def test_save_summary(spark):
    frame = results(spark, [("http://a", "x", 1), ("http://b", None, 2), ("http://c", "y", 3)])
    row = store.save_summary(frame, F.col("title") != "y").first()
    assert (row.saved, row.failed, row.total) == (1, 2, 3)


def full_result(spark):
    rows = [
        ("http://a/ü", 200, "T “x”", "line\nline — é", ["http://b/"], True, None, datetime(2024, 5, 1, 12, 0, 0, 1500), False),
        ("http://b", -1, "", "", [], False, "Err", NOON, True),
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_json_round_trip(spark, tmp_path):
    path = str(tmp_path / "json")
    files.write_json(full_result(spark), path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert all(list(line) == RESULT_COLUMNS for line in lines)
    by_url = {line["url"]: line for line in lines}
    assert by_url["http://a/ü"]["scraped_at"] == "2024-05-01T12:00:00.001500+00:00"
    assert by_url["http://b"]["scraped_at"] == "2024-05-01T12:00:00+00:00"
    assert by_url["http://a/ü"]["error"] is None
    assert any("“x”" in r.value for r in spark.read.text(path).collect())
    back = files.read_json(spark, path)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, full_result(spark).collect()))


def test_parquet_round_trip(spark, tmp_path):
    files.write_parquet(full_result(spark), str(tmp_path / "p"))
    back = files.read_parquet(spark, str(tmp_path / "p"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, full_result(spark).collect()))


def test_one_document_per_file_and_unreadable_ones(spark, tmp_path):
    good = {"url": "http://a", "title": None, "links": ["x"], "scraped_at": "2024-05-01T12:00:00.500000+00:00"}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "b.json").write_text('{"url": "http://b", "title": "cut')
    (tmp_path / "c.json").write_text("[1, 2]")
    (tmp_path / "d.json").write_text('{"scraped_at": "not a time"}')
    (tmp_path / "e.json").write_bytes(b'{"title": "\xff\xfe"}')
    (tmp_path / "f.json").write_text('{"scraped_at": null, "status_code": 404, "other": 1}')
    rows = {r.url: r for r in files.read_json(spark, str(tmp_path), one_per_file=True).collect()}
    assert set(rows) == {"http://a", ""}
    a, f = rows["http://a"], rows[""]
    assert (a.title, a.content, a.links, a.status_code, a.success) == (None, "", ["x"], -1, False)
    assert a.scraped_at == datetime(2024, 5, 1, 12, 0, 0, 500000)
    assert (f.title, f.links, f.status_code, f.error, f.used_browser) == ("", [], 404, None, False)
    assert f.scraped_at > datetime(2025, 1, 1)


def test_no_stored_document_vanishes(spark, tmp_path):
    big = "y" * (20 * 1024 * 1024)
    (tmp_path / "a.json").write_text(json.dumps({"url": "big", "content": big}))
    (tmp_path / "b.json").write_text('{"url": "first", "url": "last", "extra": NaN, "status_code": 7}')
    (tmp_path / "c.json").write_text('{"url": "cut')
    (tmp_path / "d.json").write_bytes(b'{"title": "\xff"}')
    read = {r.url: r for r in files.read_json(spark, str(tmp_path), one_per_file=True).collect()}
    assert set(read) == {"big", "last"}
    assert len(read["big"].content) == len(big) and read["last"].status_code == 7
    refused = files.refused_documents(spark, str(tmp_path), one_per_file=True).collect()
    assert {r.path.rsplit("/", 1)[1]: bool(r.refused) for r in refused} == {"c.json": True, "d.json": True}


TIMES = ["2024", "2024-01", "2024-1-2", "2024-01-02 03:04:05 UTC", "12:30", "T12:30", "20240102", "20240102T030405",
         "2024-W01-1", "2024-01-02T03:04:05Z", "2024-01-02 03:04", "2024-01-02T03:04:05.25+02:00", "tomorrow"]


def test_times_are_read_as_python_reads_them(spark):
    from datetime import timezone

    def expected(text):
        try:
            time = datetime.fromisoformat(text)
        except ValueError:
            return None
        return time.astimezone(timezone.utc).replace(tzinfo=None) if time.tzinfo else time

    rows = [(k, json.dumps({"scraped_at": t})) for k, t in enumerate(TIMES)]
    read = files.read_documents(spark.createDataFrame(rows, "k int, value string"))
    got = {r.k: r.at for r in read.select("k", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()}
    for k, text in enumerate(TIMES):
        time = expected(text)
        assert got[k] == (time and time.strftime("%Y-%m-%d %H:%M:%S.%f")), text


def test_reports(spark):
    frame = full_result(spark)
    lines = [r[0] for r in frame.select(P.summary(frame)).collect()]
    assert lines == [
        "[SUCCESS] http://a/ü | Status: 200 | Title: 'T “x”' | Content: 13 chars | Links: 1",
        "[FAILED] http://b | Status: -1 | Error: Err"]
    shown = P.report(frame).collect()
    assert [(r.title, r.content_chars, r.n_links, r.browser_used, r.scraped_at) for r in shown] == [
        ("T “x”", 13, 1, "No", "2024-05-01 12:00:00 UTC"), ("(none)", 0, 0, "Yes", "2024-05-01 12:00:00 UTC")]
    outcome = P.run_outcome(frame, F.col("url") != "http://a/ü").collect()
    assert [(r.exit_code, r.to_save) for r in outcome] == [(1, True), (1, False)]
    assert [(r.exit_code, r.to_save) for r in P.run_outcome(frame).collect()] == [(0, False), (1, False)]


def test_previews(spark):
    cases = [("", None), ("é" * 500, "é" * 500), ("é" * 501, "é" * 500 + "...")]
    frame = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    assert [r[0] for r in frame.select(P.content_preview(F.col("c"))).collect()] == [e for _, e in cases]
    links = spark.createDataFrame([(list("abcdefg"),), (["a"],), ([],)], "l array<string>")
    got = links.select(P.first_links(F.col("l")).alias("f"), P.further_links(F.col("l")).alias("m")).collect()
    assert [(r.f, r.m) for r in got] == [(list("abcde"), 2), (["a"], 0), ([], 0)]


class _Session:
    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_work_folder_is_below_the_shared_one():
    cluster = _Session(spark_checkpoint_dir="hdfs://shared/", spark_master="yarn")
    first, second = work_folder(cluster), work_folder(cluster)
    assert first != second and first.startswith("hdfs://shared/pagequarry-")
    with pytest.raises(ValueError):
        work_folder(_Session(spark_master="yarn"))
    assert work_folder(_Session(spark_master="local[2]"))


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    pages = str(tmp_path / "pages")
    store_path, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def crawl(rows):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        frame.write.mode("append").parquet(pages)
        query = start_scraping(arriving_pages(spark, pages), store_path, checkpoint, availableNow=True)
        query.awaitTermination(60)
        assert query.exception() is None
        return {r.storage_key: (r.title, r.content) for r in current_results(spark, store_path).collect()}

    assert crawl([(1, "http://a/x", "<title>One</title><p>1"), (2, "http://b", "<title>Two</title><p>2")]) == {
        "a_x": ("One", "1"), "b": ("Two", "2")}
    assert crawl([(3, "https://a/x/", "<title>New</title><p>3")]) == {"a_x": ("New", "3"), "b": ("Two", "2")}
