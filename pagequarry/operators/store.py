"""The result store: results keyed by a name made from their URL.

The key is not unique per URL: ``http``/``https`` and slash variants share one, and the last
write wins. A store table has one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import settings as S


def storage_key(url: Column) -> Column:
    """URL without scheme, unsafe characters as underscores, cut to length, ends trimmed."""
    bare = F.regexp_replace(url, "^https?://", "")
    safe = F.regexp_replace(bare, r"[^\p{L}\p{N}_\-.]", "_")
    return F.btrim(
        F.substring(F.regexp_replace(safe, "_+", "_"), 1, S.MAX_KEY_LENGTH), F.lit("_")
    )


def with_key(table: DataFrame, url: str = "url") -> DataFrame:
    return table.withColumn("storage_key", storage_key(F.col(url)))


def latest(results: DataFrame, order: str = "write_seq") -> DataFrame:
    """The last written row of each key. ``order`` must order the writes of a key.

    One aggregation: a key written very often is reduced to one row per map task before
    anything is shuffled.
    """
    keyed = with_key(results)
    last = F.max_by(F.struct(*results.columns), F.struct(order, "url"))
    return keyed.groupBy("storage_key").agg(last.alias("row")).select("storage_key", "row.*")


def upsert(stored: DataFrame, new: DataFrame, order: str = "write_seq") -> DataFrame:
    """Store table after writing ``new`` into ``stored``.

    ``stored`` has one row per key already, so it is only filtered, not sorted out again; for
    a small batch Spark broadcasts the batch's keys and leaves the store unshuffled. ``new``
    is read twice: pass a written table, not a running extraction.
    """
    incoming = latest(new, order)
    written = with_key(new).select("storage_key").distinct()
    untouched = stored.join(written, "storage_key", "left_anti")
    return untouched.unionByName(incoming.select(*untouched.columns))


def asked_for(stored: DataFrame, keyed: DataFrame) -> DataFrame:
    """Stored rows with a key in ``keyed``.

    The keys are brought down to one row each first. A small set is broadcast (Spark checks
    its size), so looking up a few URLs does not shuffle the store.
    """
    return stored.join(keyed.select("storage_key").distinct(), "storage_key", "left_semi")


def _matched(keyed: DataFrame, right: DataFrame, how: str, spread_by: str) -> DataFrame:
    """``keyed`` joined to ``right``, which has one row per storage key.

    Keys asked for very often are split by Spark's skew join at run time. Requests without
    a key match nothing; they are dealt out by their id instead of meeting in one partition
    (no storage key has a line break).
    """
    spread = F.format_string("\n%d", F.pmod(F.xxhash64(spread_by), F.lit(1024)))
    by = keyed.withColumn("__by", F.coalesce("storage_key", spread))
    return by.join(right.withColumnRenamed("storage_key", "__by"), "__by", how).drop("__by")


def lookup(
    requests: DataFrame, stored: DataFrame, request_id: str, selective: bool = True
) -> DataFrame:
    """Each request with its stored result in ``result`` (null when there is none).

    Set ``selective`` to false when the requests cover much of the store: narrowing it down
    first then costs a shuffle more than it saves.
    """
    keyed = with_key(requests)
    rows = asked_for(stored, keyed) if selective else stored
    found = rows.select("storage_key", F.struct(*stored.columns).alias("result"))
    return _matched(keyed, found, "left", request_id)


def already_scraped(requests: DataFrame, stored: DataFrame, request_id: str) -> DataFrame:
    """Requests with a stored result."""
    keyed = with_key(requests)
    return _matched(keyed, stored.select("storage_key"), "left_semi", request_id)


def to_scrape(requests: DataFrame, stored: DataFrame, request_id: str) -> DataFrame:
    """Requests without a stored result."""
    keyed = with_key(requests)
    return _matched(keyed, stored.select("storage_key"), "left_anti", request_id)


def delete(stored: DataFrame, urls: DataFrame) -> DataFrame:
    """Store table without the results of ``urls``."""
    return stored.join(with_key(urls).select("storage_key").distinct(), "storage_key", "left_anti")


def deletions(stored: DataFrame, urls: DataFrame, request_id: str) -> DataFrame:
    """``urls`` plus ``deleted``: did this request, in ``request_id`` order, remove a result?

    Of several requests for one key only the first finds something to remove.
    """
    keyed = with_key(urls)
    first = keyed.groupBy("storage_key").agg(F.min(request_id).alias("first"))
    hits = stored.select("storage_key").join(first, "storage_key")
    marked = _matched(keyed, hits, "left", request_id)
    return marked.withColumn(
        "deleted", F.coalesce(F.col(request_id) == F.col("first"), F.lit(False))
    ).drop("first")


def save_summary(results: DataFrame, saved: Column) -> DataFrame:
    """One row: how many results were saved, how many not, how many there were."""
    ok = F.coalesce(saved, F.lit(False))
    return results.agg(
        F.count_if(ok).alias("saved"), F.count_if(~ok).alias("failed"), F.count("*").alias("total")
    )
