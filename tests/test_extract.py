"""Extraction cases as literal pages."""

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.dom import page_dom
from pagequarry.functions.markup import PageReader
from pagequarry.functions.text import clean_text, strip
from pagequarry.operators import extract as X
from pagequarry.operators.reports import without_content
from pagequarry import settings as S

BASE = "https://docs.example.org/3/"

# the parts of a page that count, between all kinds that do not
WHOLE = (
    "<!doctype html><title>Tide tables</title><style>h1 { color: teal }</style>"
    "<aside><h1>Weather</h1><p>Rain later</p></aside>"
    "<main><h1>Harbour</h1><section><p>High water at six.</p><p>Low water at noon.</p></section></main>"
    "<form><p>Name</p></form><script>track('<p>none</p>')</script>"
)
# one anchor for every rule about targets, in the order of the links expected below
LINKS = "<title>Targets</title><ol>" + "".join(
    f"<li><a {href}>{n}</a></li>"
    for n, href in enumerate([
        "href='./pilots/'", "href='/3/charts'", "href='../3/charts'", "href='#top'", "href=' \t '", "href",
        "name='anchor'", "href='tel:0042'", "href='mailto:harbour@example.org'", "href='javascript:open()'",
        "href='JAVASCRIPT:open()'", "href='data:,x'", "href='\n buoys?z=2&amp;y=1#north '",
        "href='pilots/#crew'", "href='HTTPS://DOCS.example.org'", "href='//tides.example.net'",
    ])
) + "</ol>"

# html -> (title, content)
CASES = {
    "whole": (WHOLE, "Tide tables", "Harbour\nHigh water at six.\nLow water at noon."),
    "h1": ("<h1>Main <i>Head</i>ing</h1><p>Text.</p>", "Main Heading", "Main Head ing\nText."),
    "h2": ("<body><h2>Second</h2><p>Text.</p>", "Second", "Second\nText."),
    "no title": ("<p>Only a paragraph</p>", "", "Only a paragraph"),
    "blank title": ("<title> \n </title><h1>Head</h1>", "Head", "Head"),
    "first h1 only": ("<h1> </h1><h1>Two</h1><h2>Sub</h2>", "Sub", "Two\nSub"),
    "title in noise": ("<header><h1>Site</h1></header><h2>Page</h2>", "Page", "Page"),
    "unicode": (
        "<title>ﬂ</title><p>Zürich\xa0\xa0Süd</p><p>№ 7\u2003½ ’q’</p>",
        "fl", "Zürich Süd\nNo 7 1⁄2 ’q’"),
    "accent over runs": ("<h1>e<b>́</b></h1>", "é", "e ́"),
    "headings": ("<h1>One</h1><h2>Two</h2><h6>Six</h6><p>P</p>", "One", "One\nTwo\nSix\nP"),
    "malformed": ("<ul><li>left open<p>inner</ul></section><h2>after</p>", "after", "left open inner\ninner\nafter"),
    "nested repeats": ("<ul><li><p>x</p></li></ul><pre><code>y</code></pre>", "", "x\nx\ny\ny"),
    "runs": ("<p> a <b> b </b>\t<i></i> c\n\n d</p>", "", "a b c\n d"),
    "newline rule": ("<p>a\n \n\n\nb</p>", "", "a\n \nb"),
    "carriage return": ("<p>a\r\nb</p>", "", "a\r\nb"),
    "empty blocks": ("<p> </p><p>\xa0</p><li></li><p>x</p>", "", "x"),
    "comment": ("<p>a<!-- hidden -->b</p>", "", "a b"),
    "template": ("<template><p>t</p></template><p>a<ruby>b<rt>c</rt></ruby></p>", "", "a b"),
    "noise inside": ("<p>a<script>x</script>b</p><form><p>f</p></form>", "", "a b"),
    "plain": ("only text", "", "only text"),
    "blank": ("  \n", "", ""),
    "entities": ("<title>a &amp; b &lt;</title><p>&copy;&nbsp;&#169;", "a & b <", "© ©"),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(name, BASE, html) for name, (html, _, _) in CASES.items()]
    return spark.createDataFrame(rows, "name string, url string, html string")


def fetched(frame):
    return frame.withColumns(
        {"status_code": F.lit(200), "success": F.lit(True), "error": F.lit(None).cast("string")}
    )


def one(spark, html, **options):
    frame = spark.createDataFrame([(BASE, html)], "url string, html string")
    return X.parse(fetched(frame), **options).first()


def test_titles_and_contents(pages):
    got = {r.name: (r.title, r.content) for r in X.parse(fetched(pages)).collect()}
    assert got == {name: (title, content) for name, (_, title, content) in CASES.items()}


def test_single_outputs_agree_with_parse(pages):
    titles = {r.name: r.title for r in X.page_titles(pages).collect()}
    blocks = {r.name: "\n".join(r.blocks) for r in X.page_blocks(pages).collect()}
    assert titles == {n: c[1] for n, c in CASES.items()}
    assert blocks == {n: c[2] for n, c in CASES.items()}


def test_links(spark):
    assert one(spark, LINKS).links == [
        "https://docs.example.org/3/pilots/",
        "https://docs.example.org/3/charts",
        "https://docs.example.org/3/buoys?y=1&z=2",
        "https://docs.example.org/",
        "https://tides.example.net/",
    ]


def test_links_in_noise_are_lost_unless_asked_for(spark):
    html = "<nav><a href=/a>a</a></nav><p><a href=/b>b</a>"
    assert one(spark, html).links == ["https://docs.example.org/b"]
    kept = one(spark, html, noise_tags=["script"])
    assert kept.links == ["https://docs.example.org/a", "https://docs.example.org/b"]


def test_links_by_domain(spark):
    html = "<a href=/a>1</a><a href=http://Docs.example.org:80/x?y=1>2</a><a href=//o.net>3</a><a href=/b;>4</a>"
    frame = spark.createDataFrame([(BASE, html), ("http://o.net", "<a href=c>5</a>")], "url string, html string")
    got = {(r.domain, r.internal): r.n_links for r in X.links_by_domain(X.page_links(frame)).collect()}
    assert got == {
        ("docs.example.org", True): 2, ("docs.example.org:80", False): 1,
        ("o.net", False): 1, ("o.net", True): 1}


def test_custom_and_empty_tag_lists(spark):
    html = "<blockquote>quoted</blockquote><p>said</p><script>s</script>"
    assert one(spark, html, content_tags=["blockquote"]).content == "quoted"
    assert one(spark, html, content_tags=[], noise_tags=[]).content == "said"
    assert one(spark, html, content_tags=["script"], noise_tags=["none"]).content == "s"


def test_noise_count(spark):
    def count(html, tags=None):
        frame = spark.createDataFrame([(html,)], "html string")
        return page_dom(frame, scope_tags=tags).select(X.noise_count(tags)).first()[0]

    assert count(WHOLE) == 4
    assert count("<nav><nav></nav></nav>") == 2
    # the style goes with the script's turn first, the footer with its nav
    assert count("<nav><footer></footer><style></style></nav>") == 2
    assert count("<footer><nav></nav></footer>") == 2
    assert count("<div><p></p></div>", ["p", "div"]) == 2
    assert count("<div><p></p></div>", ["div", "p", "div"]) == 1


def test_page_without_markup_fails(spark):
    for html in ("", None):
        row = one(spark, html)
        assert (row.success, row.error) == (False, S.ERROR_NO_HTML)
        assert (row.title, row.content, row.links) == ("", "", [])
    assert one(spark, " ").success


def test_failing_page_is_kept_and_others_go_on(spark, pages):
    def reader(html):
        if "Second" in html:
            raise KeyError("bad page")
        return PageReader(html)

    rows = {r.name: r for r in X.parse(fetched(pages), reader=reader).collect()}
    assert len(rows) == len(CASES)
    failed = rows["h2"]
    assert (failed.success, failed.error) == (False, "Parsing failed: KeyError: 'bad page'")
    assert (failed.title, failed.content, failed.links) == ("", "", [])
    assert rows["h1"].success and rows["h1"].title == "Main Heading"


def test_parse_keeps_the_fetch_flag(spark):
    frame = spark.createDataFrame(
        [(BASE, "<p>x", False, "later")], "url string, html string, success boolean, error string"
    )
    row = X.parse(frame).first()
    assert (row.success, row.error, row.content) == (False, "later", "x")


def test_metrics_and_empty_content(spark, pages):
    parsed = X.parse(fetched(pages))
    blank = {r.name for r in without_content(parsed).collect()}
    assert blank == {"blank"}
    row = parsed.filter("name = 'whole'").first()
    assert (row.n_blocks, row.noise_removed) == (3, 4)


def test_clean_text(spark):
    cases = {
        None: "", "": "", "  a \t b  ": "a b", "a\n\n\nb\n c": "a\nb\n c", "¨x": "̈x",
        "ﬁ…™": "fi...TM", "\x1c x 　": "x", "é": "é",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r.text: r.cleaned for r in clean_text(frame, "text", "cleaned").collect()}
    assert got == cases


def test_strip_is_pythons(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["​", "x", "\x00"]
    frame = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in blanks], "t string")
    for row in frame.select("t", strip(F.col("t")).alias("s")).collect():
        assert row.s == row.t.strip()


def test_totals_of_metrics(spark, pages):
    parsed = X.parse(fetched(pages)).cache()
    total, rows = X.metrics(parsed).first(), parsed.collect()
    assert total.pages == total.parsed == len(rows)
    assert total.blocks == sum(r.n_blocks for r in rows)
    assert total.content_chars == sum(len(r.content) for r in rows)
    assert total.noise_removed == sum(r.noise_removed for r in rows)
    parsed.unpersist()
