"""The request table: defaults, checks, normal form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import settings as S
from pagequarry.functions.text import strip
from pagequarry.functions.urls import url_place


def with_defaults(
    requests: DataFrame,
    use_browser: bool = False,
    timeout: int = S.REQUEST_TIMEOUT,
    headers: Mapping[str, str] | None = None,
    tags: Sequence[str] | None = None,
) -> DataFrame:
    """Fill missing columns and nulls of a request table from job-wide settings."""
    pairs = [F.lit(x) for pair in (headers or {}).items() for x in pair]
    defaults = {
        "use_browser": F.lit(use_browser),
        "timeout": F.lit(timeout),
        "headers": F.create_map(*pairs).cast("map<string,string>"),
        "tags": F.array(*[F.lit(t) for t in tags or S.CONTENT_TAGS]),
    }
    return requests.withColumns(
        {
            name: F.coalesce(F.col(name), value) if name in requests.columns else value
            for name, value in defaults.items()
        }
    )


def merged_headers(base: Column, custom: Column) -> Column:
    """Both maps; where they share a name, as written, the value of ``custom``. Null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    base, custom = F.coalesce(base, none), F.coalesce(custom, none)
    return F.map_concat(F.map_filter(base, lambda name, _: ~F.map_contains_key(custom, name)), custom)


def url_headers(url: Column) -> Column:
    """Origin, Referer and Host of a URL as a map; empty for a URL that cannot be taken apart."""
    place = url_place(url)
    origin = F.concat(place["scheme"], F.lit("://"), place["host"])
    return F.when(
        place.isNotNull(),
        F.create_map(
            F.lit("Origin"), origin, F.lit("Referer"), F.concat(origin, F.lit("/")), F.lit("Host"), place["host"]
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))


def with_headers(requests: DataFrame, base: Mapping[str, str] | None = None) -> DataFrame:
    """``headers`` as they are sent: ``base``, over it the URL's own, over these the request's."""
    pairs = [F.lit(x) for pair in {**S.REQUEST_HEADERS, **(base or {})}.items() for x in pair]
    custom = F.col("headers") if "headers" in requests.columns else F.lit(None).cast("map<string,string>")
    sent = merged_headers(merged_headers(F.create_map(*pairs), url_headers(F.col("url"))), custom)
    return requests.withColumn("headers", sent)


def request_error(url: Column, timeout: Column) -> Column:
    """Why a request is refused, null if it is not. The first failing check counts.

    The URL is checked as given: not yet stripped, its scheme in lower case.
    """
    web = url.startswith("http://") | url.startswith("https://")
    return (
        F.when(F.coalesce(url == "", F.lit(True)), F.lit(S.ERROR_NO_URL))
        .when(~web, F.format_string(S.ERROR_BAD_SCHEME, url))
        .when(timeout <= 0, F.format_string(S.ERROR_BAD_TIMEOUT, timeout.cast("string")))
    )


def validate(requests: DataFrame) -> DataFrame:
    """``requests`` plus ``error``. Refused rows stay, so a batch is never cut short."""
    return requests.withColumn("error", request_error(F.col("url"), F.col("timeout")))


def normal_request_url(url: Column) -> Column:
    """Stripped, then cut at the first ``#``."""
    return F.substring_index(strip(url), "#", 1)


def normalize_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("url", normal_request_url(F.col("url")))


def with_route(requests: DataFrame) -> DataFrame:
    """``route``: which kind of fetch a request asks for."""
    return requests.withColumn(
        "route", F.when(F.col("use_browser"), "rendered").otherwise("static")
    )
