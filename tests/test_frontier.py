"""The crawl frontier on small graphs, against a walk in Python."""

import random
import re

import pytest
from plantext import shown_plan

from pagequarry.operators.frontier import LinkTable, crawl_frontier


def walk(links, seeds, max_depth=None):
    depth, referrer = {s: 0 for s in seeds}, {s: None for s in seeds}
    edge, k = set(seeds), 0
    while edge and (max_depth is None or k < max_depth):
        k += 1
        found = {}
        for url, link in links:
            if url in edge and link is not None and link not in depth:
                found[link] = min(url, found.get(link, url))
        depth.update(dict.fromkeys(found, k))
        referrer.update(found)
        edge = set(found)
    return {(u, depth[u], referrer[u]) for u in depth}


def frames(spark, links, seeds):
    rows = [(*pair, "extra") for pair in links]
    return (
        spark.createDataFrame(rows, "url string, link string, depth string"),
        spark.createDataFrame([(s, 7) for s in seeds], "url string, referrer int"),
    )


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


U = [f"https://site{k % 2}.example.com/{k}" for k in range(40)]
RING = [(U[k], U[(k + 1) % 8]) for k in range(8)]
HUB = [(U[0], u) for u in U[1:]] + [(u, U[0]) for u in U[1:]]


@pytest.mark.parametrize(
    "links, seeds, max_depth",
    [
        (RING, U[:1], None), (RING, U[:1], 3), (RING, U[:1], 0), (HUB, U[5:6], None), (HUB + RING, U[2:4], None),
        ([], U[:2], None), (RING, [], None), ([], [], None), (RING, U[20:21], None),
        ([(U[0], U[0]), (U[0], U[1]), (U[0], U[1]), (U[2], U[1]), (U[1], U[3])], [U[0], U[2], U[0]], None),
    ],
)
def test_against_a_walk(spark, links, seeds, max_depth):
    result = crawl_frontier(*frames(spark, links, seeds), max_depth=max_depth, heavy=3)
    assert found(result) == walk(links, seeds, max_depth)
    assert result.columns == ["url", "depth", "referrer"]


def test_random_graph(spark):
    r = random.Random(5)
    links = [(r.choice(U[:30]), r.choice(U)) for _ in range(60)]
    assert found(crawl_frontier(*frames(spark, links, U[:2]), heavy=2)) == walk(links, U[:2])


def test_rows_without_url_count_for_nothing(spark):
    links = [(None, U[1]), (U[0], None), (U[0], U[2]), (None, None)]
    assert found(crawl_frontier(*frames(spark, links, [U[0], None]))) == {(U[0], 0, None), (U[2], 1, U[0])}


def test_stays_within_a_site(spark):
    links = [(U[0], U[1]), (U[1], U[4]), (U[0], U[2]), (U[2], U[6]), (U[2], "no url")]
    result = found(crawl_frontier(*frames(spark, links, U[:1]), same_site=True))
    assert result == {(U[0], 0, None), (U[2], 1, U[0]), (U[6], 2, U[2])}


def test_links_stay_in_their_buckets(spark):
    """A round moves the URLs found, not the links; a hub's links lie in several buckets."""
    links, seeds = frames(spark, HUB, U)
    table = LinkTable(spark, links, heavy=4, buckets=4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = shown_plan(table.from_pages(seeds.select("url").distinct()))
        hub = spark.table(table.name).filter(f"url = '{U[0]}'")
        assert hub.select("part").distinct().count() > 3 and hub.count() == 39
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        table.close()
    moved = re.findall(r"Exchange hashpartitioning\(url#\d+, part#\d+", plan)
    assert len(moved) == 1 and "Bucketed: true" in plan  # the links' side has none
    assert not spark.catalog.tableExists(table.name)
