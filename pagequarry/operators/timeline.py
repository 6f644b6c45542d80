"""Tables in time: the last state as of a time, intervals that overlap, how many at once.

All of these cut time into slices of a given width, so that a key with very many rows is
worked on slice by slice: a slice's rows are sorted together, and what was before it comes
from one row per key and slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _slice(micros: Column, seconds: int) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000))


def _key(by: Sequence[str]) -> Column:
    return F.struct(*by)


def _given(*columns: str) -> Column:
    """All of them given."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known


def as_of(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    time: str,
    tie: str,
    slice_seconds: int,
    out: str = "as_of",
) -> DataFrame:
    """``left`` with the last row of ``right`` for the same key at or before its time, in ``out``.

    Of right rows with one time the largest ``tie`` counts. Left rows without key or time, and
    those before all right rows, get null; right rows without key or time count for nothing.
    Both tables are sorted together once, a slice at a time; no row meets another.
    """
    needed = _given(*by, time)
    row, other = F.struct(*left.columns), F.struct(*right.columns)
    lefts = left.filter(needed).select(
        _key(by).alias("k"), _micros(time).alias("t"), F.lit(1).alias("side"),
        row.alias("l"), F.lit(None).cast(right.select(other).schema[0].dataType).alias("r"),
    )
    rights = right.filter(needed).select(
        _key(by).alias("k"), _micros(time).alias("t"), F.lit(0).alias("side"),
        F.lit(None).cast(left.select(row).schema[0].dataType).alias("l"), other.alias("r"),
    )
    rows = lefts.unionByName(rights).withColumn("slice", _slice(F.col("t"), slice_seconds))
    # one row per key and slice: its last right row, carried over to the slices after it
    last = F.max_by("r", F.when(F.col("side") == 0, F.struct("t", F.col(f"r.{tie}"))))
    ends = rows.groupBy("k", "slice").agg(last.alias("r"))
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select("k", "slice", F.last("r", True).over(before).alias("r")).filter("r IS NOT NULL")
    heads = heads.select("k", "slice", F.lit(None).cast("bigint").alias("t"), F.lit(-1).alias("side"), "r")
    here = Window.partitionBy("k", "slice").orderBy(F.asc_nulls_first("t"), "side", F.col(f"r.{tie}"))
    found = rows.unionByName(heads, allowMissingColumns=True).withColumn(
        "found", F.last("r", True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    )
    matched = found.filter("side = 1").select("l.*", F.col("found").alias(out))
    rest = left.filter(~needed).withColumn(out, F.lit(None).cast(matched.schema[out].dataType))
    return matched.unionByName(rest)


def overlapping_pairs(
    intervals: DataFrame, by: Sequence[str], start: str, end: str, id_: str, slice_seconds: int
) -> DataFrame:
    """Pairs ``a`` < ``b`` of ids of one key whose intervals [start, end) share a moment.

    An interval lies in every slice it covers, and a pair is given by the first slice that both
    cover, so no pair comes twice. Intervals without key, ends or length overlap nothing. Where the
    pairs themselves are too many, ``concurrency`` counts them without listing them.
    """
    known = intervals.filter(_given(*by, start, end, id_)).select(
        *by, F.col(id_).alias("id"), _micros(start).alias("s"), _micros(end).alias("e")
    )
    first = _slice(F.col("s"), slice_seconds)
    cells = (
        known.filter("s < e")
        .withColumn("first", first)
        .withColumn("slice", F.explode(F.sequence("first", _slice(F.col("e") - 1, slice_seconds))))
    )
    key = [*by, "slice"]
    left = cells.select(*key, *(F.col(c).alias(f"{c}_a") for c in ("id", "s", "e", "first")))
    right = cells.select(*key, *(F.col(c).alias(f"{c}_b") for c in ("id", "s", "e", "first")))
    meet = (
        (F.col("id_a") < F.col("id_b")) & (F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a"))
        & (F.col("slice") == F.greatest("first_a", "first_b"))
    )
    return left.join(right, key).filter(meet).select(*by, F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def concurrency(
    intervals: DataFrame, by: Sequence[str], start: str, end: str, slice_seconds: int
) -> DataFrame:
    """Per key: ``n`` intervals, the ``peak`` at one moment, and how many ``pairs`` overlap.

    A sweep over starts and ends: an interval that begins overlaps all that are open. Each slice
    of a key begins with the number open at its start, which one row per key and slice gives.
    """
    known = intervals.filter(_given(*by, start, end)).select(
        *by, _micros(start).alias("s"), _micros(end).alias("e")
    )
    points = (
        known.filter("s < e")
        .select(*by, F.explode(F.array(
            F.struct(F.col("s").alias("t"), F.lit(1).alias("step")),
            F.struct(F.col("e").alias("t"), F.lit(-1).alias("step")),
        )).alias("p"))
        .select(*by, "p.t", "p.step")
        .withColumn("slice", _slice(F.col("t"), slice_seconds))
    )
    # equal moments are one step: ends count before starts, and starts of one moment are ranked by a row number
    moments = points.groupBy(*by, "slice", "t").agg(
        F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).alias("begun"),
        F.sum(F.when(F.col("step") == -1, 1).otherwise(0)).alias("ended"),
    )
    change = F.col("begun") - F.col("ended")
    ends = moments.groupBy(*by, "slice").agg(F.sum(change).alias("change"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(*by, "slice", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("open"))
    within = Window.partitionBy(*by, "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    after = moments.withColumn("moved", F.sum(change).over(within)).join(heads, [*by, "slice"])
    now = F.col("open") + F.col("moved")
    already = now - F.col("begun")
    pairs = F.col("begun") * already + F.floor(F.col("begun") * (F.col("begun") - 1) / 2)
    return after.groupBy(*by).agg(
        F.sum("begun").alias("n"), F.max(now).alias("peak"), F.sum(pairs).cast("bigint").alias("pairs")
    )
