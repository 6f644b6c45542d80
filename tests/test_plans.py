"""Plans: what is read, what is shuffled, how often pages are read."""

import re

from plantext import shown_plan
from pyspark.sql import functions as F

from pagequarry.operators import extract as X
from pagequarry.operators import fetchlog as L
from pagequarry.operators import requests as R
from pagequarry.operators import store
from pagequarry.plans import catalog
from pagequarry.plans import derived as D
from pagequarry.plans.scrape import scrape_batch, scrape_pages
from pagequarry.sources.pages import read_pages, spread


def exchanges(plan):
    return re.findall(r"Exchange (\w+)", plan)


def exchanged_columns(frame):
    """Names of the columns that go through each exchange."""
    plan = frame._jdf.queryExecution().executedPlan()
    text = frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return plan, re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


def test_extraction_has_no_exchange(spark, data):
    pages = read_pages(spark, f"{data}/pages.parquet")
    for frame in (scrape_pages(pages), X.page_titles(pages), X.page_links(pages), X.page_blocks(pages)):
        assert exchanges(shown_plan(frame)) == []


def test_pages_are_read_once_for_all_outputs(spark, data):
    frame = scrape_pages(read_pages(spark, f"{data}/pages.parquet")).filter("content = '' and title = ''")
    assert len(re.findall(r"MapInArrow read\(", shown_plan(frame))) == 1


def test_filters_and_columns_reach_the_scan(spark, data):
    pages = read_pages(spark, f"{data}/pages.parquet").filter("page_id = 3")
    plan = shown_plan(X.page_titles(pages.select("page_id", "html")))
    assert "EqualTo(page_id,3)" in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_spread_only_where_needed(spark, data, tmp_path):
    pages = read_pages(spark, f"{data}/pages.parquet")
    assert spread(pages).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    pages.repartition(16).write.parquet(str(tmp_path / "pages"))
    many = read_pages(spark, str(tmp_path / "pages"))
    assert spread(many) is many


def test_whole_job_shuffles_results_not_markup(spark, data):
    pages = read_pages(spark, f"{data}/pages.parquet")
    fetches, requests = D.derive(D.FETCHES, pages=pages), D.derive(D.REQUESTS, pages=pages)
    frame = scrape_batch(requests, fetches)
    _, columns = exchanged_columns(frame)
    hashed = [c for c in columns if "request_id" in c]
    assert len(hashed) <= 2
    assert not any("html" in c for c in hashed)


def test_whole_job_settles_all_in_one_aggregation(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = read_pages(spark, f"{data}/pages.parquet")
        fetches = D.derive(D.FETCHES, pages=pages).repartition(4)
        plan = shown_plan(scrape_batch(D.derive(D.REQUESTS, pages=pages), fetches))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = plan.split("MapInArrow apply")[0]
    assert exchanges(top).count("hashpartitioning") == 2  # the log by request, the requests


def test_resolving_combines_before_the_shuffle(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    frame = L.resolve(L.classify(D.derive(D.ATTEMPTS, events=events)), "job")
    plan = shown_plan(frame)
    assert exchanges(plan) == ["hashpartitioning"]
    assert "partial_min_by" in plan and "Window" not in plan


def test_latest_combines_before_the_shuffle(spark, data):
    pages = read_pages(spark, f"{data}/pages.parquet")
    plan = shown_plan(store.latest(D.derive(D.RESULTS, pages=pages)))
    assert exchanges(plan) == ["hashpartitioning"]
    assert "partial_max_by" in plan and "Window" not in plan


def test_full_pages_pass_the_rendered_fallback_unshuffled(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = read_pages(spark, f"{data}/pages.parquet")
        static = pages.select(
            "page_id", "html", F.lit(200).alias("status_code"), F.lit(True).alias("success"),
            F.lit(None).cast("string").alias("error"), F.lit(False).alias("used_browser"),
            F.lit(False).alias("use_browser"))
        plan = shown_plan(L.rendered_fallback(static, static, "page_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    union = plan[plan.index("Union"):]
    passing = union[: union.index("SortMergeJoin")]
    assert "Exchange" not in passing


def test_request_steps_are_projections(spark, data):
    pages = read_pages(spark, f"{data}/pages.parquet")
    frame = R.normalize_requests(R.validate(R.with_defaults(D.derive(D.REQUESTS, pages=pages))))
    assert exchanges(shown_plan(frame)) == [] and "Python" not in shown_plan(frame)


def test_nothing_is_broadcast_unseen(spark, data):
    """With automatic broadcasts off none are left."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("results_upsert", "rendered_fallback", "attempts_resolve", "scrape_batch", "results_load"):
            assert "BroadcastExchange" not in shown_plan(catalog.QUERIES[name](spark, data)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_store_queries_read_each_side_twice_at_most(spark, data):
    pages = read_pages(spark, f"{data}/pages.parquet")
    stored = store.latest(D.derive(D.RESULTS, pages=pages)).select("storage_key", "title")
    events = spark.read.parquet(f"{data}/events.parquet")
    asked = events.select(F.col("event_id").alias("id"), F.col("props").alias("url"))
    for frame in (store.lookup(asked, stored, "id"), store.already_scraped(asked, stored, "id"), store.to_scrape(asked, stored, "id")):
        plan = shown_plan(frame)
        assert plan.count("events.parquet") <= 2 and plan.count("pages.parquet") <= 2


def test_same_domain_needs_no_join(spark, data):
    assert "Join" not in shown_plan(catalog.QUERIES["url_same_domain"](spark, data))
