"""Report projections over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import settings as S


def utc_text(ts: Column, pattern: str) -> Column:
    """Timestamp as text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)


def summary(results: DataFrame) -> Column:
    """One line per result. Failures name their error."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("url", "error", "title")}
    status = F.col("status_code").cast("string")
    done = F.format_string(
        "[SUCCESS] %s | Status: %s | Title: '%s' | Content: %s chars | Links: %s",
        text["url"],
        status,
        text["title"],
        F.length("content").cast("string"),
        F.size("links").cast("string"),
    )
    failed = F.format_string("[FAILED] %s | Status: %s | Error: %s", text["url"], status, text["error"])
    return F.when(F.col("success"), done).otherwise(failed)


def report(results: DataFrame) -> DataFrame:
    """The fields shown for a result."""
    return results.select(
        "url",
        "status_code",
        F.when(F.col("title") == "", "(none)").otherwise(F.col("title")).alias("title"),
        F.length("content").alias("content_chars"),
        F.size("links").alias("n_links"),
        F.when(F.col("used_browser"), "Yes").otherwise("No").alias("browser_used"),
        utc_text(F.col("scraped_at"), "yyyy-MM-dd HH:mm:ss 'UTC'").alias("scraped_at"),
    )


def content_preview(content: Column) -> Column:
    """Start of the content, marked when it goes on; null when there is none."""
    start = F.substring(content, 1, S.PREVIEW_CHARS)
    cut = F.length(content) > S.PREVIEW_CHARS
    return F.when(content != "", F.when(cut, F.concat(start, F.lit("..."))).otherwise(start))


def first_links(links: Column) -> Column:
    return F.slice(links, 1, S.PREVIEW_LINKS)


def further_links(links: Column) -> Column:
    """How many links the preview leaves out."""
    return F.greatest(F.size(links) - S.PREVIEW_LINKS, F.lit(0))


def run_outcome(results: DataFrame, saved: Column | None = None) -> DataFrame:
    """``exit_code`` (0 or 1) and ``to_save`` per result.

    Failed scrapes are not saved; a failed save (``saved`` false) is a failure too. Leave
    ``saved`` out when nothing is to be saved.
    """
    scraped = F.coalesce(F.col("success"), F.lit(False))
    fine = scraped if saved is None else scraped & F.coalesce(saved, F.lit(False))
    return results.withColumns(
        {
            "exit_code": F.when(fine, 0).otherwise(1),
            "to_save": scraped if saved is not None else F.lit(False),
        }
    )


def without_content(results: DataFrame) -> DataFrame:
    """Successes with nothing in them: the content tags may not fit the page."""
    return results.filter(F.col("success") & (F.col("content") == ""))
