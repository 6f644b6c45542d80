"""The fetch log: one row per attempt in, one outcome per job out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import settings as S
from pagequarry.functions.text import strip

SUCCESS, TERMINAL, RETRY = "success", "terminal", "retry"


def outcome(kind: Column, status_code: Column) -> Column:
    """What a static attempt means for its job: success, terminal failure, or try again.

    A client error (4xx) and a redirect loop will not get better; anything else may.
    """
    client_error = (kind == "http_error") & status_code.between(400, 499)
    return (
        F.when(kind == "ok", SUCCESS)
        .when(client_error | (kind == "redirect_loop"), TERMINAL)
        .otherwise(RETRY)
    )


def attempt_error(kind: Column, status_code: Column, detail: Column, timeout: Column) -> Column:
    """Error text of a static attempt; null for a success. ``detail`` is the logged message."""
    known = F.coalesce(status_code, F.lit(S.NO_STATUS)).cast("string")
    message = F.coalesce(detail, F.lit(""))
    return (
        F.when(kind == "ok", F.lit(None).cast("string"))
        .when(kind == "http_error", F.format_string(S.ERROR_HTTP, known, message))
        .when(kind == "timeout", F.format_string(S.ERROR_TIMEOUT, timeout.cast("string")))
        .when(kind == "redirect_loop", F.lit(S.ERROR_REDIRECTS))
        .when(kind == "connection", F.lit(S.ERROR_CONNECTION))
        .otherwise(F.format_string(S.ERROR_OTHER, message))
    )


def backoff_seconds(attempt: Column) -> Column:
    """Seconds to wait after a retryable attempt: doubling, and none after the last."""
    wait = F.lit(S.RETRY_DELAY) * F.pow(F.lit(2), attempt - 1)
    return F.when(attempt < S.MAX_ATTEMPTS, wait.cast("bigint"))


def classify(attempts: DataFrame) -> DataFrame:
    """``attempts`` plus ``outcome``; ``status_code`` and ``error`` as a response has them."""
    timeout = F.col("timeout") if "timeout" in attempts.columns else F.lit(S.REQUEST_TIMEOUT)
    answered = F.col("kind").isin("ok", "http_error")
    return attempts.withColumns(
        {
            "outcome": outcome(F.col("kind"), F.col("status_code")),
            "error": attempt_error(
                F.col("kind"), F.col("status_code"), F.col("error"), timeout
            ),
            "status_code": F.coalesce(
                F.when(answered, F.col("status_code")), F.lit(S.NO_STATUS)
            ),
        }
    )


def with_backoff(classified: DataFrame) -> DataFrame:
    """``wait_seconds`` before the next attempt, null where there is none."""
    return classified.withColumn(
        "wait_seconds", F.when(F.col("outcome") == RETRY, backoff_seconds(F.col("attempt")))
    )


def resolve(classified: DataFrame, key: str | Sequence[str] = "url") -> DataFrame:
    """Outcome of each job: its first deciding attempt, or failure once all are used up.

    Jobs with attempts left have ``success`` null: they are pending. Attempts beyond the last
    allowed one do not count. One aggregation with partial results on the map side, so a job
    (or key) with very many log rows costs no more than its distinct map tasks; markup is not
    carried.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counted = classified.filter(F.col("attempt") <= S.MAX_ATTEMPTS)
    decides = F.when(F.col("outcome") != RETRY, F.col("attempt"))
    decision = F.struct("outcome", "status_code", "error", "attempt")
    jobs = counted.groupBy(*keys).agg(
        F.min_by(decision, decides).alias("decided"),
        F.max_by(F.col("error"), F.col("attempt")).alias("last_error"),
        F.max("attempt").alias("attempts"),
    )
    exhausted = F.col("decided").isNull() & (F.col("attempts") >= S.MAX_ATTEMPTS)
    return jobs.select(
        *keys,
        F.when(F.col("decided").isNotNull(), F.col("decided.outcome") == SUCCESS)
        .when(exhausted, F.lit(False))
        .alias("success"),
        F.when(F.col("decided").isNotNull(), F.col("decided.status_code"))
        .when(exhausted, F.lit(S.NO_STATUS))
        .alias("status_code"),
        F.when(F.col("decided").isNotNull(), F.col("decided.error"))
        .when(exhausted, exhausted_error(F.col("last_error")))
        .alias("error"),
        F.coalesce("decided.attempt", "attempts").alias("attempts"),
    )


def exhausted_error(last_error: Column) -> Column:
    return F.format_string(
        S.ERROR_EXHAUSTED, F.lit(str(S.MAX_ATTEMPTS)), F.coalesce(last_error, F.lit("None"))
    )


def render_error(kind: Column, detail: Column) -> Column:
    """Error text of a rendered fetch; null for a success."""
    return (
        F.when(kind == "ok", F.lit(None).cast("string"))
        .when(kind == "timeout", S.ERROR_RENDER_TIMEOUT % S.RENDER_TIMEOUT_MS)
        .otherwise(F.format_string(S.ERROR_RENDER_OTHER, F.coalesce(detail, F.lit(""))))
    )


def rendered_outcome(renders: DataFrame) -> DataFrame:
    """Responses of rendered fetches: any page that loaded is a success, whatever its status."""
    loaded = F.col("kind") == "ok"
    return renders.withColumns(
        {
            "success": loaded,
            "error": render_error(F.col("kind"), F.col("error")),
            "status_code": F.coalesce(
                F.when(loaded, F.col("status_code")), F.lit(S.NO_STATUS)
            ),
            "used_browser": F.lit(True),
        }
    )


def is_sparse(html: Column) -> Column:
    """Is the markup so short that the page is likely filled in by scripts?"""
    return F.length(strip(html)) < S.MIN_HTML_LENGTH


def needs_rendering(static: DataFrame) -> Column:
    """Static successes that look like script shells and were not rendered already."""
    return F.coalesce(
        F.col("success") & ~F.col("use_browser") & is_sparse(F.col("html")), F.lit(False)
    )


def rendered_requests(fetched: DataFrame, request_columns: Sequence[str]) -> DataFrame:
    """Requests to render: those of sparse static pages, unchanged but for ``use_browser``."""
    return (
        fetched.filter(needs_rendering(fetched))
        .select(*request_columns)
        .withColumn("use_browser", F.lit(True))
    )


def rendered_fallback(
    static: DataFrame, rendered: DataFrame, key: str, auto_browser: bool = True
) -> DataFrame:
    """``static`` with sparse pages replaced by their rendering where that succeeded.

    Only sparse rows, short by definition, take part in the join; full pages pass by without
    a shuffle. ``key`` identifies a request in both tables.
    """
    if not auto_browser:
        return static
    replaced = [c for c in ("status_code", "html", "success", "error", "used_browser")]
    sparse = needs_rendering(static)
    better = rendered.filter("success").select(key, F.struct(*replaced).alias("better"))
    retried = static.filter(sparse).join(better, key, "left")
    chosen = {
        c: F.when(F.col("better").isNotNull(), F.col(f"better.{c}")).otherwise(F.col(c))
        for c in replaced
    }
    return static.filter(~sparse).unionByName(
        retried.withColumns(chosen).select(*static.columns)
    )
