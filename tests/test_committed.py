"""The committed store: versions, what is read, what is rewritten, writers that die or meet."""

import re

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import store
from pagequarry.sources.committed import CommitConflict, ResultStore


def results(spark, rows):
    return spark.createDataFrame([(f"https://e.com/{k}", t, s) for k, t, s in rows], "url string, title string, write_seq long")


def titles(frame):
    return {r.url.rsplit("/", 1)[1]: r.title for r in frame.collect()}


@pytest.fixture
def empty(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "store"), buckets=8)


@pytest.fixture
def filled(spark, empty):
    empty.commit(results(spark, [(k, f"t{k}", k) for k in range(200)]))
    return empty


def buckets_read(frame):
    return {int(re.search(r"bucket=(\d+)", f).group(1)) for f in frame.inputFiles()}


def test_begins_empty(spark, empty):
    assert empty.current() == 0 and empty.versions() == []
    with pytest.raises(ValueError, match="nothing"):
        empty.read()
    assert empty.delete(results(spark, [(1, "x", 1)])) == 0


def test_last_write_wins_within_and_between_commits(spark, filled):
    assert filled.commit(results(spark, [(3, "late", 9), (3, "early", 8), (999, "new", 1)])) == 2
    got = titles(filled.read())
    assert got["3"] == "late" and got["999"] == "new" and got["4"] == "t4" and len(got) == 201


def test_versions_stay_as_they_were(spark, filled):
    first = titles(filled.read())
    filled.commit(results(spark, [(k, "again", k) for k in range(50)]))
    filled.delete(results(spark, [(k, "", 0) for k in range(100)]))
    assert filled.versions() == [1, 2, 3] and filled.current() == 3
    assert titles(filled.read(version=1)) == first
    assert sum(t == "again" for t in titles(filled.read(version=2)).values()) == 50
    assert set(titles(filled.read())) == {str(k) for k in range(100, 200)}
    with pytest.raises(ValueError, match="no version 7"):
        filled.read(version=7)


def test_equals_the_table_operators(spark, filled):
    stored = filled.read()
    new = results(spark, [(k, "again", k) for k in range(150, 260)])
    expected = store.upsert(stored, new)
    filled.commit(new)
    assert sorted(filled.read().select(expected.columns).collect()) == sorted(expected.collect())


def test_a_lookup_reads_the_buckets_of_its_keys(spark, filled):
    one = results(spark, [(5, "", 1)]).select("url", F.lit(1).alias("request_id"))
    found = filled.lookup(one, "request_id")
    bucket = store.with_key(one).select(filled._bucket(8).alias("b")).first().b
    assert found.first().result.title == "t5"
    assert buckets_read(filled._rows(filled._version(None), [bucket])) == {bucket}
    assert len(buckets_read(filled.read())) == 8
    scanned = [f for f in found.inputFiles() if "bucket=" in f]
    assert {int(re.search(r"bucket=(\d+)", f).group(1)) for f in scanned} == {bucket}


def test_a_write_leaves_other_buckets_alone(spark, filled):
    before = filled._version(1)["buckets"]
    filled.commit(results(spark, [(5, "again", 1)]))
    after = filled._version(2)["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_a_batch_sent_again_is_not_written_again(spark, filled):
    new = results(spark, [(1, "first", 1)])
    assert filled.commit(new, batch=("stream", 4)) == 2
    filled.commit(results(spark, [(1, "second", 1)]))
    assert filled.commit(new, batch=("stream", 4)) == 3
    assert filled.commit(new, batch=("stream", 3)) == 3
    assert titles(filled.read())["1"] == "second"


def test_a_writer_that_dies_leaves_the_version_before(spark, filled, monkeypatch):
    def dies(document):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(filled, "_create", dies)
        with pytest.raises(KeyboardInterrupt):
            filled.commit(results(spark, [(1, "lost", 1)]))
    # and one that dies while it writes the version's document
    with open(f"{filled.path}/versions/0000000002.json", "w") as f:
        f.write('{"version": 2, "buck')
    assert filled.current() == 1 and filled.versions() == [1] and titles(filled.read())["1"] == "t1"
    assert filled.commit(results(spark, [(1, "next", 1)])) == 3
    assert titles(filled.read())["1"] == "next" and filled.versions() == [1, 3]


def test_of_two_writers_the_later_is_refused(spark, filled):
    begun = filled._version(None)
    filled.commit(results(spark, [(1, "first", 1)]))
    with pytest.raises(CommitConflict):
        filled._next(begun, begun["buckets"], begun["schema"], None)
    assert titles(filled.read())["1"] == "first"


def test_empty_batches_missing_urls_and_emptied_buckets(spark, filled):
    filled.commit(results(spark, [(1, "x", 1)]).limit(0))
    assert filled.read().count() == 200
    filled.commit(spark.createDataFrame([(None, "none", 1)], "url string, title string, write_seq long"))
    assert filled.read().filter("url IS NULL").count() == 1
    filled.delete(filled.read())
    assert filled.read().filter("url IS NOT NULL").count() == 0
