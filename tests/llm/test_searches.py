"""Benchmark search, nearest neighbours, near duplicates, token counts."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import decontaminate, forest, neardup, tokencounts
from pagequarry.llm.common import shared_folder
from pagequarry.llm.components import Workspace, components
from pagequarry.llm.queries import QUERIES


def read(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


@pytest.fixture(scope="module")
def index(spark, data):
    return decontaminate.Index(*next(decontaminate.index_parts(read(spark, data, "benchmark"))))


def passages(words):
    stride, last = decontaminate.STRIDE, max(0, (len(words) - 1) // decontaminate.STRIDE - 1)
    for k in range(last + 1):
        yield k * stride, words[k * stride : k * stride + decontaminate.WINDOW if k < last else None]


def test_wand_and_bound_lose_nothing(spark, data, index):
    least = decontaminate.LEAST_SCORE - 1e-9
    for row in read(spark, data, "documents").collect():
        words = decontaminate.words_of(row.text)
        tried = {start for start, _ in index.passages(words)}
        for start, part in passages(words):
            terms = sorted({index.terms[w] for w in part if w in index.terms})
            scores = Counter()
            for t in terms:
                for item, x in zip(index.at[t], index.impact[t]):
                    scores[item] += x
            want = {i: round(s, 9) for i, s in scores.items() if s >= least}
            assert {i: round(s, 9) for i, s in index.retrieve(terms, least)} == want
            assert not want or start in tried


def test_contained_items_are_found(spark, data):
    docs, items = read(spark, data, "documents"), read(spark, data, "benchmark")
    found = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, data).collect()}
    plain = {r.item_id: " ".join(decontaminate.words_of(r.text)) for r in items.collect()}
    inside = {
        (r.doc_id, i) for r in docs.collect() for i, t in plain.items() if t in " ".join(decontaminate.words_of(r.text))
    }
    assert inside and inside <= found
    left = {r.doc_id for r in decontaminate.without_benchmark(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_shards_find_what_one_index_finds(spark, data, monkeypatch):
    docs, items = read(spark, data, "documents"), read(spark, data, "benchmark")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 9)
    assert len(list(decontaminate.index_parts(items))) > 1
    parts = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert [p[:2] for p in parts] == [p[:2] for p in whole]
    assert np.allclose([p[2] for p in parts], [p[2] for p in whole])


def test_benchmark_edge_cases(spark, odd_docs, no_docs):
    rows = [(1, None), (None, ""), (2, "one"), (3, "The quick brown fox jumps over the lazy dog near the river bank today."),
            (3, "The quick brown fox jumps over the lazy dog near the river bank today."), (None, "Nothing like it anywhere here.")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("score", F.lit(1))
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs, items).collect())
    assert found == {(1, 3): 2, (2, 3): 1, (None, 3): 1}
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0
    kept = decontaminate.without_benchmark(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4


def test_long_items_are_found_wherever_they_stand(spark):
    """Items of 65 to 1,000 words held verbatim at any place; half an item is not the item."""
    r = np.random.default_rng(4)

    def text(n):
        return " ".join(f"w{k}" + "." * (i % 12 == 11) for i, k in enumerate(r.integers(0, 3000, n)))

    sizes = [30, 65, 128, 180, 220, 260, 300, 400, 600, 1000]
    items = [(k, text(n)) for k, n in enumerate(sizes)]
    docs = [(k * 10 + j, " ".join([text(500 + 13 * j), t, text(400)])) for k, t in items for j in range(5)]
    docs += [(1000 + k, " ".join([text(70), t[: len(t) // 2], text(400)])) for k, t in items]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = Counter((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, items).collect())
    assert found == {(k * 10 + j, k): 1 for k in range(len(sizes)) for j in range(5)}
    assert {x.doc_id for x in decontaminate.without_benchmark(docs, items).collect()} == {1000 + k for k in range(len(sizes))}


def test_nearest_neighbours_recall(spark, data):
    rows = QUERIES["op2_hash_forest"](spark, data).collect()
    table = read(spark, data, "embeddings").toPandas()
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.query_id].append(r)
    hits = wanted = 0
    for k in np.flatnonzero(ids % 20 == 0):
        scores = np.einsum("ij,j->i", x, x[k])
        best = [i for i in np.lexsort((ids, -scores)) if i != k][:20]
        hits += len({ids[i] for i in best} & {r.vec_id for r in got[ids[k]]})
        wanted += len(best)
        exact = dict(zip(ids, scores))
        assert all(np.isclose(r.score, exact[r.vec_id], rtol=0, atol=1e-12) for r in got[ids[k]])
        assert [r["rank"] for r in got[ids[k]]] == list(range(1, len(best) + 1))
    assert set(got) == set(ids[ids % 20 == 0]) and hits / wanted >= 0.9


def test_nearest_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (20, [2.0, 0.0]),
            (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in forest.nearest_of_queries(table).collect()}
    assert got == {
        (0, 1): (20, 2.0), (0, 2): (1, 1.0), (0, 3): (2, 1.0), (0, 4): (3, 0.0),
        (20, 1): (0, 2.0), (20, 2): (1, 2.0), (20, 3): (2, 2.0), (20, 4): (3, 0.0),
    }
    assert forest.nearest_of_queries(table.limit(0)).count() == 0


def test_many_equal_vectors_and_shards(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARD", 64)
    r = np.random.default_rng(1)
    rows = [(k, [1.0, 1.0, 0.0]) for k in range(500)] + [(500 + k, r.standard_normal(3).tolist()) for k in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): x.vec_id for x in forest.nearest_of_queries(table).collect()}
    vectors = np.array([v for _, v in rows])
    for q in (0, 480, 520):
        s = np.einsum("ij,j->i", vectors, vectors[q])
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        if q < 500:  # ties among equal vectors go to the smallest ids
            assert [got[q, k + 1] for k in range(20)] == best
        assert len({got[q, k + 1] for k in range(20)} & set(best)) >= 18


def test_darts_estimate_weighted_similarity():
    r, error = np.random.default_rng(5), []
    for same in (0.3, 0.6, 0.9):
        for n in (3, 60, 700):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            w = r.integers(1, 9, n).astype(float)
            other = w.copy()
            change = r.random(n) > same
            other[change] = r.integers(1, 9, change.sum())
            x = neardup.signatures(np.concatenate([a, a]), np.concatenate([w, other]), np.repeat([0, 1], n), 2)
            error.append(np.mean(x[0] == x[1]) - np.minimum(w, other).sum() / np.maximum(w, other).sum())
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.06


def test_signatures_do_not_depend_on_the_batch():
    r = np.random.default_rng(6)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 5, 300, 2000)]
    of = np.repeat(np.arange(4), [len(s) for s in sets])
    together = neardup.signatures(np.concatenate(sets), np.ones(len(of)), of, 4)
    for k, s in enumerate(sets):
        alone = neardup.signatures(s, np.ones(len(s)), np.zeros(len(s), np.int64), 1)
        assert np.array_equal(alone[0], together[k])


def brute_classes(texts):
    shingler, sets, parent = neardup.Shingler(), {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for d in sorted(texts):
        parent[d] = d
        t = texts[d] or ""
        if t in first:
            parent[d] = first[t]
        else:
            first[t] = d
            sets[d] = set(shingler(t).tolist())
    keys = [d for d in sets if sets[d]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def test_classes_against_all_pairs(spark, data):
    texts = {r.doc_id: r.text for r in read(spark, data, "documents").collect()}
    got = {r.doc_id: r.class_id for r in QUERIES["op7_near_duplicates"](spark, data).collect()}
    assert got == brute_classes(texts)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """More members than a leader can settle, in buckets that are dealt over several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    texts = {}
    for group in range(3):
        base = [words[k] for k in r.integers(0, 400, 120)]
        for k in range(40):
            copy = list(base)
            for at in r.choice(120, int(r.integers(0, 4)), replace=False):
                copy[at] = f"new{r.integers(10**6)}"
            texts[group * 100 + k] = " ".join(copy)
    texts |= {500: texts[0], 501: texts[0], 502: ""}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)


def test_a_bucket_gives_no_more_links_than_it_has_classes():
    """A chain of texts: each is similar to the next ones only, all share a band."""
    words = [f"w{k}" for k in range(1000)]
    shingler = neardup.Shingler()
    rows = []
    for k in range(30):
        e = np.unique(shingler(" ".join(words[k * 6 : k * 6 + 130])))
        sketch = neardup.signatures(e, np.ones(len(e)), np.zeros(len(e), np.int64), 1).astype(np.uint8)
        rows.append({"key": 7, "i": 0, "j": 0, "mine": 0, "node": k, "class": k // 2 * 2, "bands": [7, 100 + k],
                     "sketch": sketch.tobytes(), "shingles": np.unique((e >> np.uint64(32)).astype(np.uint32)).tobytes()})
    sets = [set(np.frombuffer(r["shingles"], np.uint32).tolist()) for r in rows]
    similar = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets, sets[1:])]
    made = neardup._joining_links(0.8, pa.Table.from_pylist(rows)).to_pylist()
    assert all(similar) and len(made) == 14  # fifteen classes become one
    joined = {frozenset((m["a"] // 2, m["b"] // 2)) for m in made}
    assert all(max(p) - min(p) <= 2 for p in joined) and set().union(*joined) == set(range(15))
    assert neardup._joining_links(0.8, pa.Table.from_pylist(rows[:2])).num_rows == 0


def test_weighted_sets_are_another_similarity(spark):
    docs = spark.createDataFrame([(1, "a b c d e " * 30), (2, "a b c d e " * 10)], "doc_id long, text string")
    plain = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    counted = {r.doc_id: r.class_id for r in neardup.classes(docs, counted=True).collect()}
    assert plain == {1: 1, 2: 1} and counted == {1: 1, 2: 2}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(odd_docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10}
    kept = neardup.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        *((False, k) for k in (1, 3, 5, 6, 7, 8, 9, 10)), (True, 0), (True, 0)]
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.without_copies(no_docs).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (20, 4), (30, 31), (31, 32), (32, 33), (33, 34)]
    space = Workspace(spark, "test")
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "a long, b long"), space).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 20: 1, 9: 8, 31: 30, 32: 30, 33: 30, 34: 30}
    assert components(spark.createDataFrame([], "a long, b long"), space).count() == 0


def changes(spark, rows):
    side = "struct<source:string,lang:string,tokens:bigint,chars:bigint>"
    return spark.createDataFrame(rows, f"change_id string, tokenizer string, before {side}, after {side}")


def test_batches_count_once(spark):
    store = tokencounts.Store(spark, Workspace(spark, "test").folder)
    a, b = ("web", "en", 10, 50), ("web", None, 7, 30)
    first = changes(spark, [("1", "t", None, a), ("1", "t", None, a), ("2", "t", None, b), ("3", "t", None, None)])
    assert store.commit("1", first) and not store.commit("1", first)
    totals = lambda s: {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens, r.chars) for r in s.totals().collect()}
    assert totals(store) == {("web", "en", "t"): (1, 10, 50), ("web", None, "t"): (1, 7, 30)}
    moved = changes(spark, [("4", "t", a, ("book", "en", 12, 50)), ("5", "t", b, None)])
    assert store.commit("2", moved)
    assert totals(store) == {("book", "en", "t"): (1, 12, 50)}
    compact = store.compact(Workspace(spark, "test").folder)
    assert totals(compact) == totals(store)
    assert not compact.commit("2", moved) and totals(compact) == totals(store)
    again = compact.compact(Workspace(spark, "test").folder)
    assert not again.commit("2", moved) and totals(again) == totals(store)
    extra = changes(spark, [("6", "t", None, ("book", "en", 1, 2))])
    assert again.commit("3", extra) and totals(again) == {("book", "en", "t"): (2, 13, 52)}


def test_a_batch_that_failed_half_way_is_done_again(spark):
    folder = Workspace(spark, "test").folder
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch-1/_temporary/0/left")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    store = tokencounts.Store(spark, folder)
    assert store.totals().count() == 0
    assert store.commit("1", changes(spark, [("1", "t", None, ("s", "l", 3, 4))]))
    assert [r.tokens for r in store.totals().collect()] == [3]


def test_token_counts_of_odd_rows(spark, odd_docs, no_docs):
    once = odd_docs.filter("doc_id IS NOT NULL")
    history = tokencounts.document_changes(once)
    store = tokencounts.Store(spark, Workspace(spark, "test").folder)
    for batch in (1, 2, 3):
        store.commit(str(batch), history.filter(F.col("batch") == batch))
    rows = store.totals().collect()
    assert sum(r.documents for r in rows) == 9  # ten ids, one deleted
    assert {r.tokenizer for r in rows} == {"words-1", "words-2"}
    assert tokencounts.amounts(tokencounts.document_changes(no_docs)).count() == 0


def committed(spark, docs):
    store = tokencounts.Store(spark, Workspace(spark, "test").folder)
    history = tokencounts.document_changes(docs)
    for batch in (1, 2, 2, 3):
        store.commit(str(batch), history.filter(F.col("batch") == batch))
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens, r.chars) for r in store.totals().collect()}


def test_rows_without_id_and_of_one_id_all_count(spark, odd_docs):
    got = committed(spark, odd_docs)
    assert sum(n for n, _, _ in got.values()) == 11  # nine with an id, two without
    assert got["b", "de", "words-1"][0] == 1 and got[None, None, "words-1"] == (2, 0, 0)
    rows = [(None, "a b", "s", "en"), (None, "a b", "s", "en"), (None, "c", None, "en"), (-1, "d", "s", "en"),
            (5, "e f", "s", "en"), (5, "e f", "s", "en"), (5, "g h i", "s", "en"), (5, "e f", "t", "en"), (5, "e f", "en", "t"),
            (10, "k", "s", "en"), (10, "k l m", "s", "en"), (3, "x-y", "s", "en"), (3, "x", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    assert committed(spark, docs) == {
        ("s", "en", "words-1"): (5, 10, 15), (None, "en", "words-1"): (1, 1, 1), ("t", "en", "words-1"): (1, 2, 3),
        ("en", "t", "words-1"): (1, 2, 3), ("s", "en", "words-2"): (2, 4, 4),
    }


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_near_duplicates_of_one_id_with_several_texts(spark):
    """Rows of one id that differ are different documents: none is lost for another's copy."""
    a = "the quick brown fox jumps over the lazy dog near the river bank today " * 4
    b = "completely other words stand here and nobody wrote them anywhere before this test " * 4
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b), (7, "short text"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    found = sorted(tuple(r) for r in neardup.near_duplicates(docs).select("doc_id", "class_id", "is_kept").collect())
    assert found == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (7, 7, True)]
    left = sorted(((r.doc_id or 0), r.text) for r in neardup.without_copies(docs).collect())
    assert left == sorted([(0, a), (3, a), (5, b), (7, "short text")])
