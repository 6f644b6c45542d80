"""Collocations and spelling variants against brute force and SQL, odd rows, skew."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from pagequarry.llm import collocations as C
from pagequarry.llm import variants as V
from pagequarry.llm.queries import ORACLES, QUERIES


def test_collocations_equal_sql(spark, data):
    assert differences(QUERIES["op11_collocations"](spark, data), connect(data), ORACLES["op11_collocations"]) == []


def brute_force(rows, support, kept):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    made = []
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if " " in p and a >= support}
        best = []
        for p, a in phrases.items():
            if any(f" {p} " in f" {q} " and q != p and b >= a for q, b in phrases.items()):
                continue
            words = p.split(" ")
            cuts = []
            for k in range(1, len(words)):
                left, right = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            best.append((-score, -a, p.encode(), p, a, left, right, totals[lang], score))
        made += [(lang, n, *b[3:]) for n, b in enumerate(sorted(best)[:kept], 1)]
    return sorted(made)


def run(docs, **options):
    return sorted(tuple(r) for r in C.collocations(docs, **options).collect())


@pytest.fixture(scope="module")
def made_rows():
    rng = random.Random(5)
    words = "red Red blue green ß é cat dog sat on the mat a b".split(" ")
    rows = [(k, rng.choice(["en", "en", "de", None]),
             "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 60))))
            for k in range(400)]
    return rows + [(1000 + k, "en", "on the mat the cat sat") for k in range(50)] + [(None, None, None), (None, "und", "a b a b")]


@pytest.mark.parametrize("shard_bytes, at_once", [(1 << 20, 10_000), (900, 10_000), (4000, 40), (200, 7)])
def test_collocations_equal_brute_force(spark, made_rows, shard_bytes, at_once):
    """One shard and many, fewer and more shards than the support, one pass and several."""
    docs = spark.createDataFrame(made_rows, "doc_id long, lang string, text string")
    got = run(docs, support=20, kept=30, shard_bytes=shard_bytes, at_once=at_once)
    assert got == brute_force([r[1:] for r in made_rows], 20, 30) and len(got) > 30


def test_local_support_keeps_no_phrase_back(spark, made_rows):
    """What shards may keep back together stays below the support, and some phrases are left out."""
    docs = spark.createDataFrame(made_rows, "doc_id long, lang string, text string")
    local = C.local_phrases(docs, 20, 4000).cache()
    back = local.filter("phrase IS NULL").groupBy("lang").agg(F.sum("over").alias("s")).collect()
    assert max(r.s for r in back) < 20 and min(r.s for r in back) > 0
    assert local.filter("phrase IS NOT NULL").select("lang", "phrase").distinct().count() < 2000
    assert local.filter("phrase LIKE '% %'").count() == local.filter("phrase IS NOT NULL").count() > 0


def test_large_products(spark):
    """Scores whose products pass 64 bits."""
    frame = spark.createDataFrame([(7 * 10**11, 3 * 10**13, 9 * 10**11, 8 * 10**11)], "a long, n long, l long, r long")
    wide = "decimal(19,0)"
    made = frame.selectExpr(f"(cast(1000 * a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide})) AS s")
    assert made.first().s == 1000 * 7 * 10**11 * 3 * 10**13 // (9 * 10**11 * 8 * 10**11)


def test_collocations_of_odd_rows(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert run(odd_docs, support=3) == brute_force(rows, 3, 2000)
    assert run(no_docs) == []


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    by_gap, by_loss, near = defaultdict(set), defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i], w[i + 1 :]].add(w)
            by_loss[w[:i] + w[i + 1 :]].add(w)
    for group in by_gap.values():
        for a in group:
            near[a] |= group - {a}
    for short, longer in by_loss.items():
        if short in words:
            near[short] |= longer
            for w in longer:
                near[w].add(short)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    made = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        made.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(made)


def variants(docs):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r[c] for c in columns) for r in V.spelling_variants(docs).collect())


def test_variants_of_all_words(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    expected = brute_variants(brute_words(rows))
    got = QUERIES["op13_spelling_variants"](spark, data)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert sum(r[1] is not None for r in expected) > 50


def test_variants_in_few_and_large_buckets(spark, monkeypatch):
    """Edits at every place, words that share a half, buckets of one and of all words, chains of forms."""
    rng = random.Random(3)
    words = {"abcde", "abcdeé", "ùbcde", "aaaaa", "aaaaaa", "aaaaaaa", "aaaab"} | {"x" * 70, "x" * 69 + "y"}
    for _ in range(150):
        words.add("".join(rng.choice("abé") for _ in range(rng.randint(5, 9))))
    rows = [(k, " ".join([w] * rng.choice([3, 4, 7, 15, 40]))) for k, w in enumerate(sorted(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_variants(brute_words(rows))
    assert max(r[4] for r in expected) > 3 and any(r[2] != r[1] and r[1] for r in expected)
    for bucket, bits in [(1, 64), (10_000, 1 << 23)]:
        monkeypatch.setattr(V, "BUCKET", bucket)
        monkeypatch.setattr(V, "BITS", bits)
        assert variants(docs) == expected


def test_variants_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert variants(odd_docs) == brute_variants(brute_words(rows))
    assert variants(no_docs) == []
