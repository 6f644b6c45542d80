"""URL functions against the table of edge cases and against Python's own URL library."""

import random
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.functions import urls as U


# What the functions have to give, in terms of the standard library.
def valid(url):
    try:
        parts = urlparse((url or "").strip())
        return parts.scheme in ("http", "https") and parts.netloc != ""
    except ValueError:
        return False


def normal(url):
    if not valid(url):
        return None
    p = urlparse(url.strip())
    query = urlencode(sorted(parse_qsl(p.query)))
    return urlunparse((p.scheme, p.netloc.lower(), p.path or "/", p.params, query, ""))


def domain(url):
    return urlparse(url).netloc.lower() if valid(url) else None


def resolved(base, reference):
    if not base or not reference:
        return None
    try:
        return normal(urljoin(base, reference.strip()))
    except ValueError:
        return None


def check(spark, pairs):
    frame = spark.createDataFrame(pairs, "b string, r string").repartition(4)
    b, r = F.col("b"), F.col("r")
    rows = frame.select(
        "b", "r",
        U.url_is_valid(r).alias("valid"), U.url_normalize(r).alias("normal"),
        U.url_domain(r).alias("domain"), U.url_resolve(b, r).alias("resolved"),
        U.url_same_domain(b, r).alias("same"),
        U.url_resolve_all(b, F.array(r)).alias("all"),
    ).collect()
    for row in rows:
        same = bool(domain(row.b)) and domain(row.b) == domain(row.r)
        expected = (valid(row.r), normal(row.r), domain(row.r), same)
        assert (row.valid, row.normal, row.domain, row.same) == expected, row
        assert row.all == [row.resolved]
        if not row.b or valid(row.b):
            assert row.resolved == resolved(row.b, row.r), row
    return len(rows)


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Docs.Python.ORG/3/#i", "https://docs.python.org/3/"),
        ("http:///x", None), ("//a.com/x", None), ("not-a-url", None), ("http://[bad/", None),
        ("http://a.com?b=2&a=1&c=&d", "http://a.com/?a=1&b=2"),
        ("http://a.com/?q=a%20b&z=é&s=a/b:~*", "http://a.com/?q=a+b&s=a%2Fb%3A~%2A&z=%C3%A9"),
        ("http://a.com/P;x;y=1/Z;v=2;", "http://a.com/P;x;y=1/Z;v=2;"),
        ("http://a.com/a;", "http://a.com/a"),
        ("http://a.com/a b", "http://a.com/a b"),
        ("http://a.com/?a=%zz&b=%", "http://a.com/?a=%25zz&b=%25"),
        ("ftp://a.com/", None), ("", None), (None, None),
    ],
)
def test_normalize(spark, url, expected):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(U.url_normalize(F.col("u"))).first()[0] == expected


@pytest.mark.parametrize(
    "reference, expected",
    [
        ("/a/../b", "https://e.com/b"), ("../g", "https://e.com/g"),
        ("?p=2", "https://e.com/3/x?p=2"), ("//o.com/3/", "https://o.com/3/"),
        ("./", "https://e.com/3/"), (";x", "https://e.com/3/;x"),
        ("https://e.com/a/../b", "https://e.com/a/../b"), ("https:foo", "https://e.com/3/foo"),
        ("http:foo", None), ("", None), (" ", "https://e.com/3/x?q=1"), (None, None),
        ("/.", "https://e.com/"), ("/a/./b", "https://e.com/a/b"), ("/.a", "https://e.com/.a"),
    ],
)
def test_resolve(spark, reference, expected):
    frame = spark.createDataFrame([("https://e.com/3/x?q=1", reference)], "b string, r string")
    assert frame.select(U.url_resolve(F.col("b"), F.col("r"))).first()[0] == expected


def test_domain_keeps_blanks_after_the_host(spark):
    frame = spark.createDataFrame([(" http://a.com ",)], "u string")
    assert frame.select(U.url_domain(F.col("u"))).first()[0] == "a.com "


PIECES = (
    "http: https: HTTP: ftp: // / a.com E.Com .. . /../ /./ ? & = a=1 b=%zz c=%20x %C3%A9 + # #f ; ;x x é É "
    "[ ] [::1] [1:2:3:4:5:6:7::] [::1.2.3.4] [1.2.3.4] [v1.x] [::ffff:1.2.3.4%e] :80 u:p@ * ~ %7E %2A ℀ ① "
    "mailto: q=a/b:~* İ %ff % %4 == && 1: 𝒳 http://a.com/x https://e.com/y/z /a/b /.x /x/.. \" -"
).split() + [" ", "\t", "\n", "\r", "\xa0", "　", "\x1f", "\x00", "\x7f", ""]
BASES = [
    "https://e.com/3/x?q=1", "http://e.com", "https://e.com/3/", "https://e.com//a//b;p?z=1#t",
    "http://E.com:80/a/b/c?x=1&y=", "https://e.com/;p", " https://e.com/x ",
]


def test_like_the_standard_library(spark):
    rnd = random.Random(20)

    def url():
        start = rnd.choice(["", "", "http://", "https://", "HTTPS://", "https://e.com/", "/"])
        return start + "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 8)))

    pairs = [(rnd.choice([*BASES, url()]), url()) for _ in range(8000)]
    assert check(spark, pairs) == 8000


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from("ab/.:?#&=;%[]@é \t"), max_size=20), min_size=50, max_size=200))
def test_any_text(spark, texts):
    pairs = [(base, prefix + t) for t in texts for base, prefix in ((BASES[0], ""), (BASES[2], "http://h"))]
    check(spark, pairs)


def test_very_long_urls(spark):
    long = ["/" + "a/" * 50_000, "http://a.com/" + "é" * 100_000, "?" + "a=1&" * 20_000, "x/" * 20_000 + "y",
            "../" * 1000 + "z", "/a" + "/./b" * 500, "http://" + "h" * 50_000, ";" * 50_000, "#" * 50_000, "%" * 20_000]
    assert check(spark, [(BASES[0], url) for url in long]) == len(long)


def test_normalizing_twice_changes_nothing(spark):
    rnd = random.Random(7)
    urls = [("http://h" + "".join(rnd.choice(PIECES) for _ in range(6)),) for _ in range(2000)]
    frame = spark.createDataFrame(urls, "u string").select(U.url_normalize(F.col("u")).alias("n"))
    again = frame.filter("n is not null").select("n", U.url_normalize(F.col("n")).alias("m"))
    for row in again.collect():
        assert row.m == normal(row.n)
