"""Toxicity, quality, licenses and language model scores."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pagequarry.llm import brown, licenses, quality, toxicity
from pagequarry.llm.queries import QUERIES


def read(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_what_the_distance_says():
    lexicon, r = toxicity.Lexicon(list(toxicity.TERMS)), np.random.default_rng(1)
    words = set(toxicity.TERMS)
    for term in toxicity.TERMS:
        for _ in range(30):
            w = list(term)
            for _ in range(int(r.integers(1, 4))):
                k, c = int(r.integers(0, len(w) + 1)), "aeiorst"[r.integers(7)]
                w[k : k + int(r.integers(0, 2))] = [c] if r.random() < 0.7 else []
            words.add("".join(w))
    for word in words:
        near = [
            distance(word, t) for t in toxicity.TERMS
            if word[:1] == t[:1] and distance(word[1:], t[1:]) <= toxicity.edits_allowed(t)
        ]
        found = lexicon.match(word)
        assert (found is None) == (not near), word
        if found:
            assert distance(word[1:], found[0][1:]) == found[1]


def test_quotation_is_told_from_abuse():
    scorer = toxicity.Scorer(toxicity.Model())
    contexts = lambda text: [m[4] for m in scorer.matches(text)[1]]
    assert contexts("you idiot") == ["aimed"] and contexts("an idiot") == ["plain"]
    assert contexts('the word "idiot" is old') == ["quoted"] and contexts("“idiot” he said") == ["quoted"]
    assert contexts('"open\nidiot') == ["plain"]  # a quotation ends with its line
    score = lambda text: scorer.score(*scorer.matches(text))
    assert score("you idiot") > score("it was the insult idiot that he wrote") > score("a fine day") - 1e-9


def test_toxicity_learns_and_holds_out(spark, data):
    rows = QUERIES["op6_toxicity"](spark, data).collect()
    assert len(rows) == read(spark, data, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    truth = {r.doc_id: r.toxic for r in read(spark, data, "labels").collect()}
    got = {r.doc_id: r.predicted for r in rows}
    english = {r.doc_id for r in read(spark, data, "documents").filter("lang = 'en'").collect()}
    hits = [got[d] == t for d, t in truth.items() if d in english and t is not None]
    assert np.mean(hits) > 0.9


def test_held_out_labels_are_never_read(spark, data):
    docs, labels = read(spark, data, "documents"), read(spark, data, "labels")
    flipped = labels.selectExpr("doc_id", "quality",
        "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert a == b


def test_toxicity_of_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
        assert toxicity.toxicity(no_docs, labels).count() == 0
    kept = toxicity.without_toxic(odd_docs, no_labels)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 8 not in ids and 9 in ids and ids.count(1) == 2 and ids.count(None) == 2


def test_ordinal_regression_recovers_order():
    r = np.random.default_rng(3)
    x = r.random((600, 2))
    latent = 6 * x[:, 0] - 6 * x[:, 1] + r.logistic(size=600) * 0.3
    grades = np.digitize(latent, [-1.5, 1.5])
    model = quality.fit([(np.array([0, 1]), v) for v in x], grades)
    assert model.thresholds == sorted(model.thresholds)
    w = np.array(model.weights)
    tails = np.array([model.tails(np.array([0, 1]), v, w) for v in x])
    assert np.all(tails[:, 0] >= tails[:, 1])
    assert np.mean(tails.sum(axis=1).round() == grades) > 0.85


def test_quality_keeps_good_documents(spark, data):
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, data).collect()}
    truth = {r.doc_id: r.quality for r in read(spark, data, "labels").collect()}
    kept = [got[d].selected for d, q in truth.items() if q == 1]
    dropped = [not got[d].selected for d, q in truth.items() if q == 0]
    assert np.mean(kept) > 0.97 and np.mean(dropped) > 0.7
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_select <= 1 for r in got.values())


def test_quality_of_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        assert quality.quality(odd_docs, labels).count() == odd_docs.count()
        assert quality.quality(no_docs, labels).count() == 0
    assert quality.selected(odd_docs, no_labels).count() == odd_docs.count()
    assert quality.selected(odd_docs, odd_labels).columns == odd_docs.columns


def test_shapes():
    classes = quality._Classes()
    cases = {"word": "a", "Word": "Aa", "WORD%%%": "A%", "a1B": "a0A", "über": "a", "|": "|"}
    assert {w: quality.shape(w, classes) for w in cases} == cases


def places(text, phrase):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = len(phrase)
    return words, [k for k in range(len(words) - n + 1) if words[k : k + n] == phrase]


def test_base_phrases_against_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in read(spark, data, "documents").collect()}
    for r in QUERIES["op5_licenses"](spark, data).collect():
        found, labels = [], set()
        for phrase, label in licenses.BASE.items():
            words, at = places(texts[r.doc_id], phrase.split())
            found += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found), max(found)) if found else (None, None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))


@pytest.mark.parametrize("label, notice", licenses.NOTICES)
def test_every_notice_is_found_with_the_allowed_edits(label, notice):
    r, scan = np.random.default_rng(len(notice)), licenses.Scanner()
    for k in range(licenses.edits(notice) + 1):
        text = list(notice)
        for at in r.choice(len(text), k, replace=False):
            text[at] = "§"
        before = "some text before the line; "
        found = scan.notices_in(before + "".join(text) + " and after")
        assert any(l == label and e <= k for l, _, _, e in found)
        exact = regex.search(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={licenses.edits(notice)}}}",
                             before + "".join(text) + " and after")
        assert exact and any(s < exact.end() and t > exact.start() for _, s, t, _ in found)


def test_pieces_make_up_the_notice():
    for _, notice in licenses.NOTICES:
        parts = licenses.pieces(notice)
        assert "".join(p for _, p in parts) == notice and len(parts) == licenses.edits(notice) + 1
        assert all(notice.startswith(p, k) for k, p in parts)


def test_every_copy_of_a_notice_is_found():
    scan = licenses.Scanner()
    one, none = "released under the mit licence", "released under the mit license"
    for text in (f"{one} {one} {none}", f"{none} {one} {one}", f"{one} {none} {one}", f"{one}{one}{none}{one}"):
        at = [m.start() for m in re.finditer("released", text)]
        want = [("mit", k, k + 30, int(text[k : k + 30] == one)) for k in at]
        assert scan.notices_in(text) == want
    many = " ".join([one, none] * 200)
    assert len(scan.notices_in(many)) == 400


def test_only_what_overlaps_a_better_notice_is_left_out():
    """The third overlaps the second alone, which the first one puts out."""
    scan = licenses.Scanner([("a", "abcdefghijklmnopqrstuvwxyz"), ("b", "stuvwxyz0123456789abcdefgh"), ("c", "abcdefgh!?.,;:-_()[]{}&%$#")])
    text = "abcdefghijklmnopqrstuvwxyz0123456xx9abcdefgh!?.,;:_-()[]{}&%$#"
    found = scan.notices_in(text)
    assert [n[0] for n in found] == ["a", "c"], found


def test_licenses_of_odd_rows(odd_docs, no_docs):
    rows = licenses.licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and licenses.licenses(no_docs).count() == 0
    assert all(r.labels == "" and r.score == 0 and r.n_base == 0 for r in rows)
    words = Counter(r.n_words for r in rows)
    assert words[0] == 4 and words[40_000] == 1


def test_gains_of_many_units_are_those_of_each():
    r = np.random.default_rng(4)
    k, n = 6, 40
    counts = r.integers(0, 4, (n, n)) * (r.random((n, n)) < 0.3).astype(int)
    cls = np.concatenate([[0], r.integers(1, k, n - 1)])
    one = np.eye(k)[cls]
    table, loop = one.T @ counts @ one, np.diag(counts).astype(float)
    o, i = counts @ one, counts.T @ one
    o[np.arange(n), cls] -= loop
    i[np.arange(n), cls] -= loop
    many = brown.many_gains(table, o, i, loop, cls)
    for u in range(1, n):
        assert np.allclose(many[u], brown.gains(table, o[u], i[u], loop[u], cls[u])[1], atol=1e-6)


def test_brown_against_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 500)  # most words take the join
    texts = {r.doc_id: r.text for r in read(spark, data, "documents").collect()}
    rows = QUERIES["op9_brown"](spark, data).collect()
    counts = Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(brown.tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    held = np.zeros(2)
    assert len(rows) == len(texts)
    for r in rows:
        tokens = brown.tokens_of(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        held += (r.score, r.base_score) if r.held_out else (0, 0)
    assert held[0] > held[1]  # classes tell more than counts do


def test_words_of_the_model():
    assert brown.tokens_of("A\x0bÀB\xa0c\x1cd  e") == ["a".encode(), "Àb\xa0c\x1cd".encode(), b"e", brown.END]
    assert brown.tokens_of(None) == brown.tokens_of("") == [brown.END]


def test_class_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    table = r.integers(0, 50, (12, 12)).astype(float)
    cls = brown.exchange(table, 5)
    assert cls[0] == 0 and np.sum(cls == 0) == 1 and cls.max() < 5
    one = np.eye(cls.max() + 1)[cls]
    assert np.allclose((10 ** brown.transitions(one.T @ table @ one)).sum(axis=1), 1)


def test_exchange_finds_alternating_classes():
    """Words of one kind always follow words of the other."""
    n = 21
    table = np.zeros((n, n))
    for a in range(1, n):
        for b in range(1, n):
            table[a, b] = 5.0 if (a % 2) != (b % 2) else 0.0
    table[0, 1:] = table[1:, 0] = 1.0
    cls = brown.exchange(table, 3)
    assert len({cls[k] for k in range(1, n, 2)}) == 1 and len({cls[k] for k in range(2, n, 2)}) == 1


def test_words_beyond_the_commonest_get_classes_by_their_neighbours(spark, monkeypatch):
    """Words of one kind follow words of the other; nearly all of them share their ending."""
    monkeypatch.setattr(brown, "UNITS", 60)
    r = np.random.default_rng(3)
    p = 1 / np.arange(3, 303)
    kinds = [r.permutation([f"{k}{i:03}xx" for i in range(300)]) for k in "ab"]
    texts = []
    for _ in range(600):
        words = [kinds[i % 2][r.choice(300, p=p / p.sum())] for i in range(30)]
        texts.append(" ".join(words))
    pairs = [r.choice(300, 4, replace=False) for _ in range(100)]
    tests = [[kinds[0][q[0]], kinds[1][q[1]], kinds[0][q[2]], kinds[1][q[3]]] for q in pairs]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(1000 + k, " ".join(t)) for k, t in enumerate(tests)]
    rows += [(2000 + k, " ".join([t[0], t[2], t[1], t[3]])) for k, t in enumerate(tests)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {x.doc_id: x.score for x in brown.scores(docs, F.col("doc_id") < 1000).collect()}
    better = [score[1000 + k] > score[2000 + k] + 1 for k in range(len(tests))]
    assert np.mean(better) > 0.95


def test_scores_of_odd_rows(odd_docs, no_docs):
    rows = brown.lm_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1]
    assert brown.lm_scores(no_docs).count() == 0


def test_units_of_many_words_are_those_of_each():
    words = [f"w{k % 700}".encode() for k in range(2000)] + [brown.END, b"x", "漢字".encode()]
    for keys in ([], sorted(brown._key(w) for w in words[:300:3])):
        numbers = brown.Numbers(np.array(keys, np.int64), [brown.ending(b"w1"), brown.ending(b"x")])
        memo = brown._Memo(numbers)
        for part in (words[:500], words, []):
            assert memo.many(part).tolist() == [numbers(w) for w in part]


def test_first_bigrams_from_neighbours(spark):
    """The table of neighbours, made of whole slices, gives the first units' bigrams without another pass."""
    r = np.random.default_rng(8)
    texts = [" ".join(r.choice(["aa", "ba", "ca", "da", "xe", "ye"], int(r.integers(0, 30)))) for _ in range(300)] + [None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    words = [b"aa", b"ba", b"ca", b"da"]
    endings = [brown.ending(b"xe")]
    units = brown.Units(words[:2], [brown.ending(b"ca"), *endings])
    keys, of = zip(*sorted((brown._key(w), units(w)) for w in words))
    shared = spark.sparkContext.broadcast((np.array(keys, np.int64), endings))
    blocks = brown.neighbours(docs, shared, len(keys) + 3, 5000).cache()
    found = brown.coarse_bigrams(blocks, np.array([0, *of, units(b"xe"), units.size - 1]), units.size)
    wanted = np.zeros((units.size, units.size))
    for x in brown.unit_bigrams(docs, units).collect():
        wanted[x.a, x.b] = x.n
    assert (found == wanted).all() and found.sum() == sum(len(brown.tokens_of(t)) for t in texts)
