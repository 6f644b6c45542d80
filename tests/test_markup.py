"""The page reader: tokens and tree repair."""

import time

import pyarrow as pa
import pytest

from pagequarry.functions import dom
from pagequarry.functions.markup import PageReader


def elements(html):
    """(tag, text runs below it) of each element"""
    page = PageReader(html)
    return [(t, page.texts[a:b]) for t, a, b in zip(page.tags, page.firsts, page.lasts)]


def texts(html, tag):
    return [runs for t, runs in elements(html) if t == tag]


@pytest.mark.parametrize(
    "html, tag, expected",
    [
        ("<p>one<p>two", "p", [["one"], ["two"]]),
        ("<p><b>one<br><p>two", "p", [["one"], ["two"]]),
        ("<p>before<blockquote>within</p>after</blockquote>", "p", [["before"]]),
        ("<p>a<section>b</section>", "p", [["a"]]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", "li", [["1"], ["2", "3"], ["3"], ["4"]]),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dd", [["b"]]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "td", [["a"], ["b"], ["c"]]),
        ("<table><tr><td><p>a</td><td>b</table>", "p", [["a"]]),
        ("<button><p>x</button>y", "button", [["x"]]),
        ("<a href=x>1<a href=y>2</a>", "a", [["1"], ["2"]]),
        ("<h1>a<h2>b</h2>", "h1", [["a"]]),
        ("<p>a</b>b</i>c", "p", [["abc"]]),
        ("<p>a<!-- x -->b", "p", [["a", "b"]]),
        ("<p>a<!-->b", "p", [["a", "b"]]),
        ("<p>a<!-- x --!>b", "p", [["a", "b"]]),
        ("<p>a<!-- never closed <p>b", "p", [["a"]]),
        ("<p>a<?php x ?>b</>c", "p", [["a", "b", "c"]]),
        ("<p>1 < 2 <3 &lt; 4", "p", [["1 < 2 <3 < 4"]]),
        ("<p>x &amp y &copy; &#65;&#x42; &nosuch;", "p", [["x & y © AB &nosuch;"]]),
        ("<script>if (a</p>b) '<p>'</script><p>x", "p", [["x"]]),
        ("<SCRIPT>a</script ><p>x", "p", [["x"]]),
        ("<style>p{}<p>x", "p", []),
        ("<title>a <b>c</b> &amp; d</title>", "title", [["a <b>c</b> & d"]]),
        ("<textarea><p>a</textarea><p>b", "p", [["b"]]),
        ("<p/>a<p>b", "p", [[], ["b"]]),
        ("<p class='a>b' id=\"c>d\">x", "p", [["x"]]),
        ("<p title=it's>x</p>", "p", [["x"]]),
        ("<p>x<a href=\"never closed>y", "p", [["x", "y"]]),
        ("<p>x<a href='cut off", "p", [["x"]]),
        ("</body></html><p>late", "p", [["late"]]),
        ("plain text only", "p", [["plain text only"]]),
        ("<html> bare <b>text</b><div>x</div>tail", "p", [[" bare ", "text"]]),
        ("<div>x</div>tail", "p", []),
        ("  \n ", "p", []),
        ("", "p", []),
    ],
)
def test_repair(html, tag, expected):
    assert texts(html, tag) == expected


@pytest.mark.parametrize(
    "tag, expected",
    [
        ("<a href='/x'>", "/x"),
        ("<a href=/x/>", "/x/"),
        ("<a HREF = \"/x y\" href=/z>", "/x y"),
        ("<a data-href=/n>", None),
        ("<a href>", ""),
        ("<a href=''>", ""),
        ("<a href='?a=1&copy=2&amp;b=&lt;&#65;&copy;'>", "?a=1&copy=2&b=<A©"),
        ("<a title='x' / href=/y >", "/y"),
    ],
)
def test_href(tag, expected):
    page = PageReader(tag)
    assert page.hrefs[page.tags.index("a")] == expected


def test_scopes_hold_the_open_tags():
    page = PageReader("<nav><ul><li>a</ul></nav><div><nav>b</nav></div>", ["body", "nav", "ul", "li", "div"])
    for text, around in (("a", {"body", "nav", "ul", "li"}), ("b", {"body", "div", "nav"})):
        assert set(page.scopes[page.text_scopes[page.texts.index(text)]]) == around
    assert len(page.scopes) == len({tuple(s) for s in page.scopes})


def test_text_kinds_follow_the_nearest_container():
    page = PageReader("<template>a<ruby>b<rt>c<template>d</template></rt></ruby></template><p>e")
    kinds = {t: page.scope_kinds[s] for t, s in zip(page.texts, page.text_scopes)}
    assert kinds == {"a": "template", "b": "template", "c": "rt", "d": "template", "e": None}


def test_scopes_know_the_tags_asked_for():
    page = PageReader("<nav><ul><li>a</ul></nav><div>b</div>", ["nav", "li"])
    around = {t: page.scopes[s] for t, s in zip(page.texts, page.text_scopes)}
    assert around == {"a": ["nav", "li"], "b": []}


def test_end_tags_find_deep_elements_and_barriers():
    deep = "<i>" * 200
    assert texts(f"<p>x<b>{deep}y</b>z</p>", "b") == [["x", "y", "z"][1:2]]
    assert texts(f"<a><div>{deep}</a>y", "a") == [["y"]]  # the div stops the end tag


def test_hostile_nesting_takes_linear_time_and_memory():
    started = time.time()
    n = 200_000 // 7
    PageReader("<a><div>" + "<i>" * n + "</a>" * n)
    page = PageReader("".join(f"<t{k}>" for k in range(200_000 // 7)) + "x")
    assert time.time() - started < 5
    assert sum(map(len, page.scopes)) < 100


@pytest.mark.parametrize(
    "piece", ["<", "<a ", "</b>x", "<p><div>", "<!--", "<a href=\"", "<li>", "&amp", "<b><i>", "<a x='"]
)
def test_time_grows_with_size_only(piece):
    started = time.time()
    PageReader(piece * (200_000 // len(piece)))
    assert time.time() - started < 5


def test_pages_read_together_are_bounded():
    """However many rows a batch has, and however long its pages are."""
    long = "<p>" + "x" * dom.BYTES_TOGETHER
    html = [None, "<p>a", *["<p>b" * 3000] * 1000, long, "<p>c", *["<p>d"] * 2000, long]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(html))), pa.array(html)], ["page_id", "html"])
    parts = list(dom._parts([batch, batch.slice(0, 0), batch.slice(5, 3)], "html"))
    assert pa.Table.from_batches(parts).column("page_id").to_pylist() == [*range(len(html)), 5, 6, 7]
    for part in parts:
        assert 0 < part.num_rows <= dom.PAGES_TOGETHER
        size = sum(len(x or "") for x in part.column("html").to_pylist())
        assert size <= dom.BYTES_TOGETHER or part.num_rows == 1
    assert max(part.num_rows for part in dom._parts([batch])) == dom.PAGES_TOGETHER
