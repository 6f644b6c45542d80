"""Every operator as a query over the given tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import urls as U
from pagequarry.functions.dom import page_dom
from pagequarry.functions.markup import PageReader
from pagequarry.functions.text import clean_text
from pagequarry.operators import extract as X
from pagequarry.operators import fetchlog as L
from pagequarry.operators import reports as P
from pagequarry.operators import requests as R
from pagequarry.operators import store
from pagequarry.operators import timeline as T
from pagequarry.operators.frontier import crawl_frontier
from pagequarry.plans import derived as D
from pagequarry.plans.scrape import scrape_batch, scrape_pages
from pagequarry.session import tune, work_folder
from pagequarry.sources import pages as pages_source
from pagequarry.sources import results as results_source
from pagequarry.sources.committed import ResultStore

# All anchors of the given pages are inside nav, which the default noise tags remove.
LINK_NOISE = ["script", "style"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
    """Register ``build`` under its name, without the leading underscore."""

    def tuned(spark: SparkSession, folder: str) -> DataFrame:
        return build(tune(spark), folder)

    QUERIES[build.__name__.lstrip("_")] = tuned
    return build


# -- inputs ----------------------------------------------------------------------------


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages_source.read_pages(spark, f"{folder}/pages.parquet")


def _spread_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages_source.spread(_pages(spark, folder))


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    return D.derive(D.ATTEMPTS, events=events)


def _from_pages(select: str, spark: SparkSession, folder: str) -> DataFrame:
    return D.derive(select, pages=_pages(spark, folder))


def _fetches(spark: SparkSession, folder: str) -> DataFrame:
    return D.derive(D.FETCHES, pages=_spread_pages(spark, folder))


def _static(spark: SparkSession, folder: str) -> DataFrame:
    """Static fetches that were answered: one per page, with its markup."""
    answered = _fetches(spark, folder).filter("not use_browser and kind = 'ok'")
    return answered.withColumns({"success": F.lit(True), "used_browser": F.lit(False)})


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The store after a first crawl, which saw the https pages."""
    first = _from_pages(D.RESULTS, spark, folder).filter(F.col("url").startswith("https://"))
    return store.latest(first)


def _recrawl(spark: SparkSession, folder: str) -> DataFrame:
    return _from_pages(D.RECRAWL, spark, folder)


def _lines(column: str) -> Column:
    return F.array_join(column, "\n")


def _joined(column: str) -> Column:
    return F.array_join(F.col(column), "\n").alias(column)


def _big(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# -- scans, sources, sinks -------------------------------------------------------------


@query
def pages_scan(spark, folder):
    return _pages(spark, folder)


@query
def results_serialize(spark, folder):
    flat = results_source.serialize(_from_pages(D.RESULTS, spark, folder))
    return flat.select(
        "url", *_big("status_code"), "title", "content", _joined("links"), "success", "error",
        "scraped_at", "used_browser",
    )


@query
def results_write(spark, folder):
    path = work_folder(spark)
    results_source.write_json(_from_pages(D.RESULTS, spark, folder), path)
    lines = spark.read.text(path)
    document = F.parse_json("value")
    names = F.json_object_keys("value")

    def text(name: str) -> Column:
        return F.variant_get(document, f"$.{name}", "string").alias(name)

    return lines.select(
        text("url"), text("title"), text("content"), text("error"), text("scraped_at"),
        F.array_join(names, ",").alias("fields"),
        F.array_join(F.variant_get(document, "$.links", "array<string>"), "\n").alias("links"),
    )


def _again(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the second crawl."""
    return _recrawl(spark, folder).select(
        "write_seq",
        "url",
        F.lit(200).alias("status_code"),
        F.format_string("Again %s", F.col("write_seq").cast("string")).alias("title"),
        F.lit("").alias("content"),
        F.array().cast("array<string>").alias("links"),
        F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"),
        F.timestamp_seconds(F.col("write_seq")).alias("scraped_at"),
        F.lit(False).alias("used_browser"),
    )


@query
def results_upsert(spark, folder):
    stored, new = _stored(spark, folder), _again(spark, folder)
    return store.upsert(stored, new).select("storage_key", "url", "title", "write_seq")


@query
def results_scan(spark, folder):
    path = work_folder(spark)
    _from_pages(D.DOCUMENTS, spark, folder).select("value").write.text(path)
    return _document_fields(results_source.read_json(spark, path))


@query
def results_defaults(spark, folder):
    documents = _from_pages(D.DOCUMENTS, spark, folder)
    return _document_fields(results_source.parse_documents(documents))


def _document_fields(results: DataFrame) -> DataFrame:
    kept = F.col("scraped_at") < F.lit("2025-01-01").cast("timestamp")
    return results.select(
        "url", *_big("status_code"), "title", "content", _joined("links"), "success", "error",
        F.when(kept, results_source.iso_timestamp(F.col("scraped_at")))
        .otherwise("now").alias("scraped_at"),
        "used_browser",
    )


@query
def results_load(spark, folder):
    found = store.lookup(_recrawl(spark, folder), _stored(spark, folder), "write_seq")
    return found.select(
        F.col("write_seq"),
        "url",
        F.col("result.url").alias("stored_url"),
        F.col("result.title").alias("title"),
        F.col("result.content").alias("content"),
    )


@query
def urls_already_scraped(spark, folder):
    known = store.already_scraped(_recrawl(spark, folder), _stored(spark, folder), "write_seq")
    return known.select("write_seq", "url", "storage_key")


@query
def urls_to_scrape(spark, folder):
    unknown = store.to_scrape(_recrawl(spark, folder), _stored(spark, folder), "write_seq")
    return unknown.select("write_seq", "url", "storage_key")


@query
def results_delete(spark, folder):
    """Both outcomes of a delete: what is left, and which requests removed something."""
    stored = _stored(spark, folder)
    urls = _recrawl(spark, folder).filter(F.col("url").like("%/en/%"))
    left = store.delete(stored, urls).select(
        "url", F.lit("left").alias("outcome"), "write_seq", "storage_key"
    )
    removed = store.deletions(stored, urls, "write_seq").select(
        "url",
        F.when(F.col("deleted"), "deleted").otherwise("not found").alias("outcome"),
        "write_seq",
        "storage_key",
    )
    return left.unionByName(removed)


def _first_crawl(spark: SparkSession, folder: str) -> ResultStore:
    """A store with the first crawl as its version 1."""
    made = ResultStore(spark, work_folder(spark))
    made.commit(_from_pages(D.RESULTS, spark, folder).filter(F.col("url").startswith("https://")))
    return made


@query
def store_commit(spark, folder):
    """What the store holds after a second commit, which is sent twice."""
    made = _first_crawl(spark, folder)
    for _ in range(2):
        made.commit(_again(spark, folder), batch=("recrawl", 1))
    return made.read().select("storage_key", "url", "title", "write_seq")


@query
def store_version(spark, folder):
    """What the store still gives as its first version after a commit and a delete."""
    made = _first_crawl(spark, folder)
    made.commit(_again(spark, folder))
    made.delete(_recrawl(spark, folder).filter(F.col("url").like("%/en/%")))
    return made.read(version=1).select("storage_key", "url", "title", "write_seq")


@query
def store_lookup_pruned(spark, folder):
    """Stored results of some URLs, from the buckets of their keys."""
    some = _recrawl(spark, folder).filter(F.col("write_seq") % 10 == 3)
    return _first_crawl(spark, folder).lookup(some, "write_seq").select(
        "write_seq", "url", F.col("result.url").alias("stored_url"), F.col("result.title").alias("title")
    )


@query
def store_delete(spark, folder):
    """What is left after a committed delete."""
    made = _first_crawl(spark, folder)
    made.delete(_recrawl(spark, folder).filter(F.col("url").like("%/en/%")))
    return made.read().select("storage_key", "url", "write_seq")


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a fetch that took some hours."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    begun = F.col("ts").cast("timestamp")
    hours = F.make_dt_interval(hours=(1 + F.col("event_id") % 24).cast("int"))
    return events.select("event_id", "user_id", begun.alias("begun"), (begun + hours).alias("ended"))


@query
def results_as_of(spark, folder):
    """Each click with the user's last view by then."""
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.filter("event_type = 'view'").drop("event_type")
    clicks = events.filter("event_type = 'click'").drop("event_type", "value")
    found = T.as_of(clicks, views, ["user_id"], "ts", "event_id", 7 * 86400)
    return found.select(
        F.col("event_id").alias("request_id"), "user_id",
        F.col("as_of.event_id").alias("result_id"), F.col("as_of.value").alias("result_value"),
    )


@query
def fetches_overlapping(spark, folder):
    """Pairs of a user's fetches that ran at the same time."""
    return T.overlapping_pairs(_sessions(spark, folder), ["user_id"], "begun", "ended", "event_id", 86400)


@query
def fetches_at_once(spark, folder):
    """How many fetches of a user ran at once, and how many pairs overlapped."""
    return T.concurrency(_sessions(spark, folder), ["user_id"], "begun", "ended", 86400)


@query
def save_summary(spark, folder):
    results = _from_pages(D.RESULTS, spark, folder)
    return store.save_summary(results, F.col("success"))


@query
def storage_key(spark, folder):
    forms = _from_pages(D.URL_FORMS, spark, folder)
    return forms.select("page_id", "form", store.storage_key(F.col("url")).alias("storage_key"))


# -- requests --------------------------------------------------------------------------


@query
def requests_defaults(spark, folder):
    filled = R.with_defaults(
        _from_pages(D.REQUESTS, spark, folder), headers={"Accept-Language": "en-US"}
    )
    return filled.select(
        "request_id", "url", "use_browser", *_big("timeout"),
        F.col("headers")["Accept-Language"].alias("accept_language"),
        F.array_join("tags", ",").alias("tags"),
    )


@query
def requests_headers(spark, folder):
    """Headers as they are sent: the defaults, the URL's own, the request's own."""
    rows = _from_pages(D.REQUESTS, spark, folder)
    custom = F.when(F.col("request_id") % 3 == 0, F.create_map(
        F.lit("Authorization"), F.format_string("Bearer %d", "request_id"), F.lit("Host"), F.lit("own.example.org"),
        F.lit("accept"), F.lit("*/*"),
    ))
    made = R.with_headers(rows.withColumn("headers", custom))
    names = ["Accept-Language", "Accept", "accept", "Origin", "Referer", "Host", "Authorization"]
    return made.select(
        "request_id", F.size("headers").cast("bigint").alias("n_headers"),
        *(F.col("headers")[n].alias(f"{'lower_' if n == 'accept' else ''}{n.lower().replace('-', '_')}") for n in names),
    )


@query
def requests_validate(spark, folder):
    checked = R.validate(R.with_defaults(_from_pages(D.REQUESTS, spark, folder)))
    return checked.select("request_id", "error", F.col("error").isNull().alias("valid"))


@query
def requests_normalize(spark, folder):
    return R.normalize_requests(_from_pages(D.REQUESTS, spark, folder)).select("request_id", "url")


# -- fetch log -------------------------------------------------------------------------


@query
def attempts_classify(spark, folder):
    rows = L.classify(_attempts(spark, folder))
    return rows.select(*_big("job", "attempt", "status_code"), "outcome", "error")


@query
def attempts_resolve(spark, folder):
    jobs = L.resolve(L.classify(_attempts(spark, folder)), "job")
    return jobs.select("job", "success", *_big("status_code", "attempts"), "error")


@query
def attempts_backoff(spark, folder):
    rows = L.with_backoff(L.classify(_attempts(spark, folder)))
    return rows.select(*_big("job", "attempt"), "wait_seconds")


@query
def fetch_route(spark, folder):
    return R.with_route(_attempts(spark, folder)).select(*_big("job", "attempt"), "route")


@query
def rendered_outcome(spark, folder):
    renders = _fetches(spark, folder).filter("use_browser")
    return L.rendered_outcome(renders).select(
        "request_id", "success", *_big("status_code"), "error", "used_browser",
        F.length("html").cast("bigint").alias("html_chars"),
    )


@query
def sparse_pages(spark, folder):
    fetched = _static(spark, folder)
    return fetched.filter(L.is_sparse(F.col("html"))).select("request_id", "url", "html")


@query
def rendered_requests(spark, folder):
    return L.rendered_requests(_static(spark, folder), ["request_id", "url"])


@query
def rendered_fallback(spark, folder):
    columns = ["request_id", "url", "use_browser", "status_code", "html", "success", "error",
               "used_browser"]
    static = _static(spark, folder).filter("attempt <= 3").select(*columns)
    rendered = L.rendered_outcome(_fetches(spark, folder).filter("use_browser")).select(*columns)
    return L.rendered_fallback(static, rendered, "request_id").select(
        "request_id", "url", *_big("status_code"), "html", "success", "used_browser"
    )


@query
def failed_skip_parse(spark, folder):
    """Requests whose fetch failed come out as they came in."""
    results = scrape_batch(_jobs(spark, folder), _fetches(spark, folder))
    return results.filter("not success").select(
        "request_id", *_big("status_code"), "title", "content", "error"
    )


# -- extraction ------------------------------------------------------------------------


@query
def _page_dom(spark, folder):
    read = page_dom(_spread_pages(spark, folder))

    def tags(name: str) -> Column:
        found = F.filter("dom.elements", lambda e: e["tag"] == name)
        return F.size(found).cast("bigint").alias(f"n_{name}")

    return read.select("page_id", *[tags(t) for t in ("a", "article", "b", "br", "h1", "li", "p")])


@query
def noise_removal(spark, folder):
    read = page_dom(_spread_pages(spark, folder))
    return read.select("page_id", X.kept_text().alias("kept_text"))


@query
def noise_count(spark, folder):
    read = page_dom(_spread_pages(spark, folder))
    return read.select("page_id", X.noise_count().cast("bigint").alias("removed"))


@query
def page_title(spark, folder):
    return X.page_titles(_spread_pages(spark, folder)).select("page_id", "title")


@query
def page_blocks(spark, folder):
    blocks = X.page_blocks(_spread_pages(spark, folder))
    return blocks.select("page_id", F.posexplode("blocks").alias("position", "text")).select(
        *_big("page_id", "position"), "text"
    )


@query
def page_content(spark, folder):
    blocks = X.page_blocks(_spread_pages(spark, folder))
    return blocks.select("page_id", _lines("blocks").alias("content"))


@query
def page_links(spark, folder):
    found = X.page_links(_spread_pages(spark, folder), LINK_NOISE)
    return found.select("page_id", _joined("links"), F.size("links").cast("bigint").alias("n_links"))


@query
def page_links_default(spark, folder):
    """With the default noise tags, which take the navigation and all its links."""
    found = X.page_links(_spread_pages(spark, folder))
    return found.select("page_id", F.size("links").cast("bigint").alias("n_links"))


@query
def page_links_exploded(spark, folder):
    found = X.page_links(_spread_pages(spark, folder), LINK_NOISE)
    return found.select("page_id", F.posexplode("links").alias("position", "link")).select(
        *_big("page_id", "position"), "link"
    )


@query
def _clean_text(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = D.derive(D.TEXTS, documents=pages_source.spread(documents, "doc_id"))
    return clean_text(texts, "text", "cleaned").select("doc_id", "cleaned")


def _fetched(pages: DataFrame) -> DataFrame:
    return pages.withColumns(
        {"status_code": F.lit(200), "success": F.lit(True), "error": F.lit(None).cast("string")}
    )


@query
def parse_empty_failure(spark, folder):
    """Some pages are emptied, going by their URL."""
    emptied = _spread_pages(spark, folder).withColumn(
        "html",
        F.when(F.col("url").contains("?"), "")
        .when(F.col("url").contains("#"), F.lit(None).cast("string"))
        .when(F.col("url").endswith("/"), " \n ")
        .otherwise(F.col("html")),
    )
    return X.parse(_fetched(emptied)).select("page_id", "success", "error", "title", "content")


@query
def parse_error_capture(spark, folder):
    def reader(html: str) -> PageReader:
        if "</html>" not in html:
            raise ValueError("page is cut off")
        return PageReader(html)

    parsed = X.parse(_fetched(_spread_pages(spark, folder)), reader=reader)
    return parsed.select("page_id", "success", "error", "title")


@query
def custom_tags(spark, folder):
    blocks = X.page_blocks(_spread_pages(spark, folder), ["li"], LINK_NOISE)
    return blocks.select("page_id", _lines("blocks").alias("content"))


@query
def page_metrics(spark, folder):
    parsed = X.parse(_fetched(_spread_pages(spark, folder)), noise_tags=[*LINK_NOISE, "footer"])
    return parsed.select(
        "page_id",
        *_big("noise_removed", "n_blocks"),
        F.length("content").cast("bigint").alias("content_chars"),
        F.size("links").cast("bigint").alias("n_links"),
    )


@query
def page_metrics_totals(spark, folder):
    """The figures of ``page_metrics`` over all pages, as one row."""
    each = X.parse(_fetched(_spread_pages(spark, folder)), noise_tags=[*LINK_NOISE, "footer"])
    return X.metrics(each)


@query
def empty_content_warning(spark, folder):
    """Asked for paragraphs, of which some pages (going by their URL) have none."""
    without = F.replace(F.replace("html", F.lit("<p>"), F.lit("<div>")), F.lit("</p>"), F.lit("</div>"))
    pages = _spread_pages(spark, folder).withColumn(
        "html", F.when(F.col("url").contains("?"), without).otherwise(F.col("html"))
    )
    parsed = X.parse(_fetched(pages), ["p"])
    return P.without_content(parsed).select("page_id", "url", "title")


# -- URLs ------------------------------------------------------------------------------


def _url_forms(spark, folder):
    return D.derive(D.URL_FORMS, pages=_spread_pages(spark, folder))


@query
def url_is_valid(spark, folder):
    forms = _url_forms(spark, folder)
    return forms.select("page_id", "form", U.url_is_valid(F.col("url")).alias("valid"))


@query
def url_normalize(spark, folder):
    forms = _url_forms(spark, folder)
    return forms.select("page_id", "form", U.url_normalize(F.col("url")).alias("normalized"))


@query
def url_domain(spark, folder):
    forms = _url_forms(spark, folder)
    return forms.select("page_id", "form", U.url_domain(F.col("url")).alias("domain"))


@query
def url_resolve(spark, folder):
    references = D.derive(D.REFERENCES, pages=_spread_pages(spark, folder))
    resolved = U.url_resolve(F.col("base"), F.col("reference"))
    return references.select("page_id", "reference", resolved.alias("resolved"))


@query
def url_same_domain(spark, folder):
    """Each form of a URL against the plain URL of its page."""
    forms = _url_forms(spark, folder)
    same = U.url_same_domain(F.col("url"), F.col("plain"))
    return forms.select("page_id", "form", same.alias("same"))


@query
def links_by_domain(spark, folder):
    """Links of the pages, and links resolved from all kinds of references, some to other sites."""
    own = X.page_links(_spread_pages(spark, folder), LINK_NOISE).select("url", "links")
    references = D.derive(D.REFERENCES, pages=_spread_pages(spark, folder))
    resolved = U.url_resolve(F.col("base"), F.col("reference"))
    others = references.select(
        F.col("base").alias("url"), F.array_compact(F.array(resolved)).alias("links")
    )
    return X.links_by_domain(own.unionByName(others))


# -- reports and the whole job ---------------------------------------------------------


@query
def result_summary(spark, folder):
    results = _from_pages(D.RESULTS, spark, folder)
    return results.select("write_seq", P.summary(results).alias("summary"))


@query
def result_report(spark, folder):
    shown = P.report(_from_pages(D.RESULTS, spark, folder))
    return shown.select(
        "url", *_big("status_code"), "title", *_big("content_chars", "n_links"), "browser_used",
        "scraped_at",
    )


@query
def content_preview(spark, folder):
    results = _from_pages(D.RESULTS, spark, folder)
    return results.select("write_seq", P.content_preview(F.col("content")).alias("preview"))


@query
def first_links(spark, folder):
    results = _from_pages(D.RESULTS, spark, folder)
    return results.select(
        "write_seq",
        F.array_join(P.first_links(F.col("links")), "\n").alias("first_links"),
        P.further_links(F.col("links")).cast("bigint").alias("more"),
    )


@query
def run_outcome(spark, folder):
    results = P.run_outcome(_from_pages(D.RESULTS, spark, folder), F.col("url").isNotNull())
    return results.select("write_seq", *_big("exit_code"), "to_save")


@query
def _crawl_frontier(spark, folder):
    """All links, from a few pages and a URL that nothing links to, six steps far."""
    seeds = _pages(spark, folder).filter("page_id % 100 = 3").select("url")
    alone = _pages(spark, folder).filter("page_id = 3").select(F.concat("url", F.lit("/alone")).alias("url"))
    return crawl_frontier(_from_pages(D.LINK_GRAPH, spark, folder), seeds.unionByName(alone), max_depth=6)


@query
def _crawl_frontier_site(spark, folder):
    """From every tenth page to all that its site leads to."""
    seeds = _pages(spark, folder).filter("page_id % 10 = 0").select("url")
    return crawl_frontier(_from_pages(D.LINK_GRAPH, spark, folder), seeds, same_site=True)


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return _from_pages(D.REQUESTS, spark, folder)


@query
def _scrape_batch(spark, folder):
    """Noise tags that leave the navigation, so that there are links to compare."""
    results = scrape_batch(
        _jobs(spark, folder), _fetches(spark, folder),
        content_tags=["p", "h1"], noise_tags=[*LINK_NOISE, "footer"],
    )
    return results.select(
        "request_id", "url", *_big("status_code"), "title", "content", _joined("links"), "success", "error",
        results_source.iso_timestamp(F.col("scraped_at")).alias("scraped_at"), "used_browser",
    )


@query
def _scrape_pages(spark, folder):
    results = scrape_pages(_spread_pages(spark, folder), ["p", "h1"], [*LINK_NOISE, "footer"])
    return results.select(
        "page_id", "url", *_big("status_code"), "title", "content", _joined("links"), "success", "error",
        "used_browser",
    )
