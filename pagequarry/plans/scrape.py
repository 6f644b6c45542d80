"""The whole job: requests and fetched pages in, results out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import settings as S
from pagequarry.operators import extract as X
from pagequarry.operators import fetchlog as L
from pagequarry.operators import requests as R


def scrape_pages(
    pages: DataFrame,
    content_tags: Sequence[str] | None = None,
    noise_tags: Sequence[str] | None = None,
) -> DataFrame:
    """Results of pages (``url``, ``html``) that were all fetched well. No exchange."""
    fetched = pages.withColumns(
        {
            "status_code": F.lit(200),
            "success": F.lit(True),
            "error": F.lit(None).cast("string"),
            "used_browser": F.lit(False),
        }
    )
    if "scraped_at" not in pages.columns:
        fetched = fetched.withColumn("scraped_at", F.current_timestamp())
    return X.parse(fetched, content_tags, noise_tags)


def scrape_batch(
    requests: DataFrame,
    fetches: DataFrame,
    key: str = "request_id",
    content_tags: Sequence[str] | None = None,
    noise_tags: Sequence[str] | None = None,
    auto_browser: bool = True,
) -> DataFrame:
    """One result per request.

    ``key`` may be ``url``, compared in normal form. Links are relative to the request's URL.
    ``requests`` has ``key``, ``url`` and optional request columns; ``fetches`` has ``key``,
    ``url``, ``use_browser``, ``attempt``, ``kind``, ``status_code``, ``html``, ``error`` and
    ``fetched_at``, for static attempts and renderings alike.

    Pages are read where they lie, before anything is shuffled, so the one exchange of the
    log carries extracted results and no markup. That exchange also brings together a job's
    attempts and its rendering: retries and the rendered fallback are settled by a single
    aggregation, and its output is joined to the requests as it is partitioned.
    """
    checked = R.validate(R.with_defaults(requests)).withColumnRenamed("error", "refused")
    jobs = R.normalize_requests(checked).select(
        _key(key).alias(_KEY), "url", "use_browser", "timeout", "refused"
    )
    responses = _responses(fetches, key, content_tags, noise_tags)
    carried = [c for c in responses.columns if c not in (_KEY, "use_browser", "attempt", "kind")]
    response = F.struct(*carried)
    static = F.when(~F.col("use_browser"), F.col("attempt"))
    settled = responses.groupBy(_KEY).agg(
        F.min_by(response, F.when(F.col("outcome") != L.RETRY, static)).alias("static"),
        F.max_by(F.struct("kind", "error", "fetched_at"), static).alias("last"),
        F.max(static).alias("attempts"),
        F.min_by(response, F.when(F.col("use_browser"), F.col("attempt"))).alias("rendered"),
    )
    results = _results(jobs.join(settled, _KEY, "left"), auto_browser)
    return results.drop(_KEY) if key == "url" else results.withColumnRenamed(_KEY, key)


# the key under a name of its own, as it may be the URL itself
_KEY = "__key"


def _key(key: str) -> Column:
    """Requests and log rows that are matched by URL are matched by its normal form."""
    return R.normal_request_url(F.col("url")) if key == "url" else F.col(key)


def _responses(
    fetches: DataFrame,
    key: str,
    content_tags: Sequence[str] | None,
    noise_tags: Sequence[str] | None,
) -> DataFrame:
    """Log rows that can matter, as responses with their extracted page instead of markup."""
    rendering, kind, status = F.col("use_browser"), F.col("kind"), F.col("status_code")
    loaded = F.when(kind == "ok", L.SUCCESS).otherwise(L.TERMINAL)
    timeout = F.lit(S.REQUEST_TIMEOUT)  # the request's own is put in once they meet
    rows = (
        fetches.filter(rendering | (F.col("attempt") <= S.MAX_ATTEMPTS))
        .select(
            _key(key).alias(_KEY),
            "use_browser",
            "attempt",
            "kind",
            "fetched_at",
            F.when(rendering, loaded).otherwise(L.outcome(kind, status)).alias("outcome"),
            F.when(rendering, L.render_error(kind, F.col("error")))
            .otherwise(L.attempt_error(kind, status, F.col("error"), timeout))
            .alias("error"),
            F.coalesce(F.when(kind.isin("ok", "http_error"), status), F.lit(S.NO_STATUS)).alias(
                "status_code"
            ),
            F.when(kind == "ok", F.coalesce("html", F.lit(""))).alias("html"),
        )
        .withColumn("sparse", L.is_sparse(F.col("html")))
        .withColumn("no_html", F.col("html") == "")
    )
    # links are resolved when the page meets its request: the log's URL may be a redirect's
    parsed = X.extract(rows, content_tags, noise_tags, resolved=False)
    parse_error = F.when(F.col("no_html"), F.lit(S.ERROR_NO_HTML)).otherwise(F.col("parse_error"))
    return parsed.select(
        _KEY,
        "use_browser",
        "attempt",
        "kind",
        "outcome",
        "status_code",
        "title",
        F.array_join("blocks", "\n").alias("content"),
        F.col("links").alias("hrefs"),
        ((F.col("outcome") == L.SUCCESS) & parse_error.isNull()).alias("success"),
        F.coalesce("error", parse_error).alias("error"),
        "sparse",
        "fetched_at",
    )


def _results(jobs: DataFrame, auto_browser: bool) -> DataFrame:
    """The response that counts for each job, as a result row."""
    accepted = F.col("refused").isNull()
    render, static = F.col("rendered"), F.col("static")
    replaced = (
        F.lit(auto_browser)
        & (static["outcome"] == L.SUCCESS)
        & static["sparse"]
        & (render["outcome"] == L.SUCCESS)
    )
    by_browser = F.coalesce(F.col("use_browser") | replaced, F.lit(False))
    chosen = F.when(accepted & by_browser, render).when(accepted, static)
    exhausted = (
        accepted & ~by_browser & static.isNull() & (F.col("attempts") >= S.MAX_ATTEMPTS)
    )
    last_error = F.when(
        F.col("last.kind") == "timeout",
        F.format_string(S.ERROR_TIMEOUT, F.col("timeout").cast("string")),
    ).otherwise(F.col("last.error"))
    picked = jobs.select(
        _KEY,
        "url",
        "refused",
        "last",
        last_error.alias("last_error"),
        chosen.alias("chosen"),
        F.coalesce(exhausted, F.lit(False)).alias("exhausted"),
        (accepted & by_browser).alias("used_browser"),
    )
    failed = F.col("refused").isNotNull() | F.col("exhausted")
    return picked.select(
        _KEY,
        "url",
        F.coalesce("chosen.status_code", F.lit(S.NO_STATUS)).alias("status_code"),
        F.coalesce("chosen.title", F.lit("")).alias("title"),
        F.coalesce("chosen.content", F.lit("")).alias("content"),
        F.expr(X.sql_links("url", "chosen.hrefs")).alias("links"),
        F.when(failed, False).otherwise(F.col("chosen.success")).alias("success"),
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("exhausted"), L.exhausted_error(F.col("last_error")))
        .otherwise(F.col("chosen.error"))
        .alias("error"),
        F.when(F.col("exhausted"), F.col("last.fetched_at"))
        .otherwise(F.col("chosen.fetched_at"))
        .alias("scraped_at"),
        "used_browser",
    )
