"""Main texts of pages, byte-level BPE, the pipeline."""

import hashlib
import html as html_
import re
import struct
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from plantext import shown_plan
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import blocks, bpe, decontaminate, neardup
from pagequarry.llm.queries import QUERIES, public_vocabulary


def read(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


def article(page):
    """Main text of the given tables' pages, by regular expressions."""
    inner = page.split("<article>", 1)[1].split("</article>")[0] if "<article>" in page else ""
    inner = re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", inner).replace("<br>", " ")
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html_.unescape(re.sub("<[^>]+>", "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_main_texts_of_all_pages(spark, data):
    rows = QUERIES["op8_main_text"](spark, data).collect()
    pages = {r.page_id: r for r in read(spark, data, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
    assert np.mean([r.text == article(pages[r.page_id].html) for r in rows]) > 0.99


@pytest.fixture(scope="module")
def model(spark, data):
    return blocks.learn(read(spark, data, "pages"))


LONG = "This paragraph tells of the harbour, its ships and the people who work there."


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<header><p>{LONG}</p></header><main><h1>Head</h1><p>{LONG}</p><p>Short.</p></main><aside>{LONG}</aside>", ["Head", LONG, "Short."]),
        (f"<article><h1>Head</h1><p>{LONG} &amp; more</p></article><div class='comments'><p>{LONG}</p></div>", ["Head", f"{LONG} & more"]),
        (f"<nav><a href=/a>A</a></nav><article><p>{LONG}</p></article><form><p>{LONG}</p></form><script>var x</script>", [LONG]),
        ("", []), (None, []), ("<p>", []), ("   ", []),
        (f"<article><p>{LONG}</p></article><div class='col-md-4 col-lg-3 d-none px-2 m-1 row sidebar'><p>{LONG}</p></div>", [LONG]),
        (f"<article><p>{LONG}</p></article><div class='commentThread'><p>{LONG}</p></div>", [LONG]),
        (f"<article><p>{LONG}</p></article><div id='disqus_thread'><p>{LONG}</p></div>", [LONG]),
        (f"<main class='content has-sidebar'><h1>Head</h1><p>{LONG}</p></main><aside>{LONG}</aside>", ["Head", LONG]),
        (f"<body class='page-header-fixed modal-open'><nav>Home</nav><article><p>{LONG}</p></article></body>", [LONG]),
        (f"{'<div>' * 300}<article><p>{LONG}</p></article><script>var x=1;</script><div class='cookieNotice'>{LONG}</div>", [LONG]),
    ],
)
def test_kinds_of_pages(model, page, expected):
    assert blocks.main_texts([page], model, blocks.Vectors()) == ["\n".join(expected)]


def test_blocks_of_broken_markup():
    texts = lambda h: [t for _, t, _ in blocks.read_blocks(h)]
    assert texts("<p>one<p>two<br>three<div>four") == ["one", "two three", "four"]
    assert texts("<ul><li>a<li>b</ul>c &lt;&am") == ["a", "b", "c <&am"]
    assert texts("<p>x</p><script>if (a<b) '<p>y'</script><p>z <b") == ["x", "z"]
    assert len(texts("<div>" * 5000 + "deep")) == 1
    assert texts("<div>" * 300 + "<script>var x=1;</script>deep") == ["deep"]
    assert texts("<table><tr><td>a<td>b<tr><th>c<td><table><td>d</table>e</table>f") == ["a", "b", "c", "d", "e", "f"]
    assert texts("<dl><dt>a<dd>b<p>c<dt>d</dl>e</i>f</p>g") == ["a", "b", "c", "d", "ef", "g"]


def test_paths_of_blocks():
    path = lambda h: blocks.read_blocks(h)[-1][0]
    tags = lambda h: [tag for tag, _ in path(h)]
    assert tags("<table><tr><td>a<td>b<tr><td>c") == ["table", "tr", "td"]
    assert tags("<ul><li>a<ul><li>b</ul><li>c<p>d") == ["ul", "li", "p"]
    assert tags("<div><nav><div>" + "<div>" * 50 + "x") == ["div", "nav", "div"]
    assert tags("<dl><dt>a<dd>b") == ["dl", "dd"] and tags("<p>a<div>b</div><b>c") == ["b"]
    many = " ".join(f"{c}-box" for c in "abcdefghij") + " sidebarLeft"
    assert path(f"<div class='{many}'>x")[0][1][-1] == "sidebar-left"


@pytest.mark.parametrize(
    "part, expected",
    [
        (("div", "commentThread"), (True, False)), (("div", "disqus_thread"), (True, False)),
        (("main", "content has-sidebar"), (False, True)), (("body", "page-header-fixed modal-open post"), (False, False)),
        (("div", "no-sidebar"), (False, False)), (("div", "fixed-header"), (True, False)),
        (("div", "entry-content"), (False, True)), (("article", "comment"), (True, True)), (("div", "é 1"), (False, False)),
    ],
)
def test_names_tell_of_containers(part, expected):
    assert blocks.evidence((part[0], blocks.names_of(part[1]))) == expected


def test_long_pages_in_parts(model):
    vectors = blocks.Vectors()
    page = blocks.read_blocks(f"<nav>Home</nav><article>{f'<p>{LONG}</p><h2>Head</h2>' * 60}</article><footer>End</footer>")
    whole = model.probabilities(*blocks.padded([vectors(page)]))[0]
    for size in (1, 7, 1000):
        assert np.allclose(whole, model.long_page(lambda a, b: vectors(page, a, b), len(page), size))


def test_memory_of_a_very_long_page():
    code = """
import resource
from pagequarry.llm import blocks
html = "<article><table>" + "<tr><td>one cell of it<td>another" * 50_000 + "</table></article>"
small = ["<article><p>some words of a page</p></article>"] * 31
model, vectors = blocks.Labeller(), blocks.Vectors()
model.w["o"][-1] = 99  # everything is main text
texts = blocks.main_texts([html, *small], model, vectors)
assert texts[0].count(chr(10)) == 99_999 and texts[31] == "some words of a page"
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout.split()[-1]) < 600


def test_labeller_gradients():
    r = np.random.default_rng(1)
    model = blocks.Labeller()
    x, mask = blocks.padded([r.standard_normal((n, blocks.INPUT)) for n in (3, 5)])
    y = r.integers(0, 2, mask.shape).astype(float)
    grads = model.gradients(x, mask, y)

    def loss():
        p = model.probabilities(x, mask)
        return -np.mean(np.log(np.where(y == 1, p, 1 - p))[mask])

    for name in ("wf", "wb", "cf", "o"):
        flat = model.w[name].reshape(-1)
        for k in r.choice(flat.size, 5, replace=False):
            before, eps = flat[k], 1e-5
            flat[k] = before + eps
            up = loss()
            flat[k] = before - eps
            down = loss()
            flat[k] = before
            assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[k]) < 1e-5


def test_padding_changes_no_label(model):
    r = np.random.default_rng(2)
    a, b = r.standard_normal((4, blocks.INPUT)), r.standard_normal((9, blocks.INPUT))
    together = model.probabilities(*blocks.padded([a, b]))
    assert np.allclose(together[0, :4], model.probabilities(*blocks.padded([a]))[0])


def test_pages_edge_cases(spark):
    rows = [(1, "u", None), (None, None, "<p>x"), (2, "u", "<article><p>" + "long text here. " * 20_000), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert blocks.extracted(pages).count() == 4
    assert blocks.extracted(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def reference():
    v = public_vocabulary()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def digests(text, encoding):
    ids = encoding.encode_ordinary(text or "")
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("native", [False, True])
def test_tokens_against_the_library(spark, reference, native, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)  # tasks begin anew many times
    r = np.random.default_rng(4)
    odd = ["", None, " ", "\x00b\x1c\x1dc", "don't I'll we've  \n\n x", "a" * 3000, "ab" * 900, " " * 900 + "x",
           "日本語 混ぜ 🎉🎉", "  x\u0085y z", "<|endoftext|>", "x\r\n\ty  ", "е́ё 123456 ½ Ⅷ ²",
           "".join(r.choice(list("abcdefgh"), 2500))]
    odd += ["\U0001c89d\U0001c8a0a \u0c5c", "漢" * 500 + " \ua7cb"]  # letters of late Unicode versions
    odd += ["".join(r.choice(list("abc  .,\n'sé漢🎉0 1Z\t"), int(r.integers(0, 120)))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = bpe.token_digests(docs, public_vocabulary(), native).collect()
    assert len(rows) == len(odd)
    for x in rows:
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == digests(odd[x.doc_id], reference), odd[x.doc_id]


def test_tokens_of_documents(spark, data, reference, tmp_path):
    docs = read(spark, data, "documents").limit(60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for x in QUERIES["op10_byte_bpe"](spark, str(tmp_path)).collect():
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == digests(texts[x.doc_id], reference)


def test_merges_are_folded_by_default(spark, data, reference, monkeypatch):
    """Queries that name no form of the merges take the fold, also when tasks begin anew."""
    def heap(*_):
        raise AssertionError("merged by the heap")

    monkeypatch.setattr(bpe, "_merged", heap)
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    monkeypatch.setattr(bpe, "PIECES", 20)
    docs = read(spark, data, "documents").limit(40)
    encoder = bpe.Encoder(spark, public_vocabulary())
    plan = shown_plan(bpe.encoded(docs, encoder, ["doc_id"]))
    assert "aggregate(" in plan
    texts = {r.doc_id: r.text for r in docs.collect()}
    for x in bpe.token_digests(docs, public_vocabulary()).collect():
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == digests(texts[x.doc_id], reference)
    rows = corpus_pipeline.encode(spark, docs, data).collect()
    assert len(rows) == 40 and all(r.decodes and r.ids == reference.encode_ordinary(texts[r.doc_id] or "") for r in rows)


@pytest.mark.parametrize("short", [0, 6, 2000])
def test_fold_cuts_or_goes_over_all_tokens(spark, reference, short, monkeypatch):
    monkeypatch.setattr(bpe, "SHORT", short)
    r = np.random.default_rng(6)
    odd = ["".join(r.choice(list("abcdeté漢ñ"), int(r.integers(2, 40)))) for _ in range(60)] + ["", "aaaa" * 9, "x"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for x in bpe.token_digests(docs, public_vocabulary()).collect():
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == digests(odd[x.doc_id], reference), odd[x.doc_id]


def test_encoding_holds_little_at_once(spark, reference):
    """Batches of texts are bounded, and pairs are made only for words that the heap merges."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.createDataFrame([(1, "some wrds")], "doc_id long, text string")
        bpe.encoded(docs, bpe.Encoder(spark, public_vocabulary()), ["doc_id"])
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
    numberer = bpe.Numberer(public_vocabulary(), bpe.LONG)
    numberer("some wrds onleon")
    assert numberer.new and "pairs" not in vars(numberer)
    numberer("a" * 2000)
    assert "pairs" in vars(numberer)


def test_large_vocabularies_take_the_heap(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "foldable", False)
    docs = spark.createDataFrame([(1, "onleon thndanwh")], "doc_id long, text string")
    (x,) = bpe.token_digests(docs, public_vocabulary()).collect()
    assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == digests("onleon thndanwh", reference)


def test_tokens_of_no_rows(no_docs):
    assert bpe.token_digests(no_docs, public_vocabulary()).count() == 0
    assert bpe.token_digests(no_docs, public_vocabulary(), native=True).count() == 0


def test_long_words_by_heap(reference):
    v, r = public_vocabulary(), np.random.default_rng(5)
    pairs = v.pairs()
    for _ in range(200):
        word = "".join(r.choice(list("abcdeté漢"), int(r.integers(1, 60))))
        ids = bpe.encode_word(word.encode(), v.ranks, pairs)
        assert ids == reference._encode_single_piece(word.encode())


def test_pipeline(spark, data, reference, tmp_path):
    """Every stage on its own input; the last against the library."""
    small = read(spark, data, "documents").filter("n_chars < 4000")
    small.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        read(spark, data, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) < before, name
        if name == "near_duplicates":
            assert all(r.doc_id == r.class_id for r in neardup.near_duplicates(docs).collect())
        if name == "decontamination":
            items = read(spark, data, "benchmark")
            assert decontaminate.contaminated(docs, items).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.decodes and r.ids == reference.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_pipeline_stages_of_odd_rows(spark, odd_docs, no_docs, no_labels, odd_labels, tmp_path):
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
        made = stage(spark, odd_docs, str(tmp_path))
        assert made.columns == odd_docs.columns and made.count() > 0, name
    last = corpus_pipeline.STAGES[4][1](spark, odd_docs, str(tmp_path)).collect()
    assert len(last) == odd_docs.count() and all(r.decodes for r in last)
