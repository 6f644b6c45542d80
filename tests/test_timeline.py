"""As-of joins, overlaps and concurrency against brute force: ties, hot keys, slices, missing values."""

import datetime as dt
import random

import pytest
from plantext import shown_plan
from pyspark.sql import functions as F

from pagequarry.operators import timeline as T
from pagequarry.operators.requests import merged_headers, url_headers

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "only", None])
    left = [(k, key(), rng.choice([None, *range(0, 3000, 7)])) for k in range(300)]
    right = [(k, rng.choice(["hot", "a", "b", None]), rng.choice([None, *range(500, 2500, 7)])) for k in range(300)]
    return left, right


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**9])
def test_as_of_equals_brute_force(spark, rows, slice_seconds):
    left, right = rows
    schema = "id long, k string, ts timestamp"
    made = T.as_of(
        spark.createDataFrame([(i, k, at(m)) for i, k, m in left], schema),
        spark.createDataFrame([(i, k, at(m)) for i, k, m in right], schema).withColumn("v", F.col("id") * 2),
        ["k"], "ts", "id", slice_seconds,
    )
    expected = {}
    for i, k, m in left:
        known = [(n, j) for j, q, n in right if k is not None and m is not None and q == k and n is not None and n <= m]
        expected[i] = max(known)[1] if known else None
    got = {r.id: r.as_of for r in made.collect()}
    assert {i: a and a.id for i, a in got.items()} == expected and len(got) == len(left)
    assert all(a is None or a.v == 2 * a.id for a in got.values())
    assert sum(a is not None for a in got.values()) > 50


def test_as_of_meets_no_rows_and_sorts_slices(spark, rows):
    frame = spark.createDataFrame([(i, k, at(m)) for i, k, m in rows[0]], "id long, k string, ts timestamp")
    plan = shown_plan(T.as_of(frame, frame, ["k"], "ts", "id", 3600))
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert T.as_of(frame, frame.limit(0), ["k"], "ts", "id", 3600).filter("as_of IS NULL").count() == len(rows[0])
    assert T.as_of(frame.limit(0), frame, ["k"], "ts", "id", 3600).count() == 0


@pytest.fixture(scope="module")
def intervals():
    rng = random.Random(2)
    made = []
    for k in range(250):
        begun = rng.choice([None, *range(0, 2000, 5)])
        ended = None if begun is None or rng.random() < 0.05 else begun + rng.choice([-5, 0, 5, 30, 400])
        made.append((k, rng.choice(["hot", "hot", "a", "b", None]), begun, ended))
    return made


def good(intervals):
    return [x for x in intervals if None not in x and x[2] < x[3]]


@pytest.mark.parametrize("slice_seconds", [300, 7200, 10**9])
def test_overlaps_and_concurrency_equal_brute_force(spark, intervals, slice_seconds):
    frame = spark.createDataFrame(
        [(i, k, at(s), at(e)) for i, k, s, e in intervals], "id long, k string, s timestamp, e timestamp"
    )
    known = good(intervals)
    pairs = {(a[1], a[0], b[0]) for a in known for b in known if a[1] == b[1] and a[0] < b[0] and a[2] < b[3] and b[2] < a[3]}
    got = [tuple(r) for r in T.overlapping_pairs(frame, ["k"], "s", "e", "id", slice_seconds).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    expected = {}
    for key in {x[1] for x in known}:
        of = [x for x in known if x[1] == key]
        peak = max(sum(y[2] <= x[2] < y[3] for y in of) for x in of)
        expected[key] = (len(of), peak, sum(p[0] == key for p in pairs))
    counted = {r.k: (r.n, r.peak, r.pairs) for r in T.concurrency(frame, ["k"], "s", "e", slice_seconds).collect()}
    assert counted == expected


def test_a_hot_key_is_counted_without_its_pairs(spark):
    """5,000 fetches open at once have 12 million pairs; the sweep makes two points of each."""
    frame = spark.range(5000).select(
        F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id")).alias("s"), F.timestamp_seconds(F.lit(10_000)).alias("e")
    )
    made = T.concurrency(frame, ["k"], "s", "e", 600).first()
    assert (made.n, made.peak, made.pairs) == (5000, 5000, 5000 * 4999 // 2)


def test_header_maps(spark):
    rows = [("https://User@E.com:81/a?b", {"Host": "x", "host": "y"}), ("http://[bad", {"A": "1"}), (None, None), ("HTTP://e.com", {})]
    frame = spark.createDataFrame(rows, "url string, custom map<string,string>")
    made = frame.select(url_headers(F.col("url")).alias("own"), merged_headers(url_headers(F.col("url")), F.col("custom")).alias("all")).collect()
    assert made[0].own == {"Origin": "https://User@E.com:81", "Referer": "https://User@E.com:81/", "Host": "User@E.com:81"}
    assert made[0].all == {**made[0].own, "Host": "x", "host": "y"}
    assert made[1].own == {} and made[1].all == {"A": "1"}
    assert made[2].own == {} and made[2].all == {}
    assert made[3].all == {"Origin": "http://e.com", "Referer": "http://e.com/", "Host": "e.com"}
