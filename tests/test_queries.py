"""Every registered query against its SQL check, over the whole test tables."""

import pytest
from oracle import connect, differences

import __spark_entry__ as spark_entry
from pagequarry.plans import catalog

# the training-data queries have tests of their own
QUERIES = {n: q for n, q in spark_entry.queries().items() if n in catalog.QUERIES}
ORACLES = {n: q for n, q in spark_entry.oracle_sql().items() if n in catalog.QUERIES}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, duck, name):
    assert differences(QUERIES[name](spark, data), duck, ORACLES[name]) == []


@pytest.mark.parametrize("name", list(QUERIES))
def test_check_has_rows(duck, name):
    """No check compares two empty tables."""
    assert duck.sql(f"SELECT count(*) FROM ({ORACLES[name]})").fetchall()[0][0] > 0


@pytest.mark.parametrize(
    "name, column",
    [("links_by_domain", "internal"), ("scrape_batch", "links"), ("scrape_pages", "links"), ("attempts_resolve", "success"),
     ("results_scan", "scraped_at"), ("url_same_domain", "same"), ("failed_skip_parse", "error"), ("parse_empty_failure", "success")],
)
def test_checked_columns_vary(duck, name, column):
    assert duck.sql(f"SELECT count(DISTINCT {column}) FROM ({ORACLES[name]})").fetchall()[0][0] > 1


def test_pending_jobs_are_among_the_attempts(duck):
    assert duck.sql(f"SELECT count(*) FROM ({ORACLES['attempts_resolve']}) WHERE success IS NULL").fetchall()[0][0] > 0


def test_entry(spark):
    frame = spark_entry.entry(spark)
    assert frame.count() > 0 and "title" in frame.columns
