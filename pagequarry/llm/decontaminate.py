"""Benchmark decontamination: BM25 over an index of the test items, block-max WAND, overlap.

Test items are indexed; every passage of every document (``WINDOW`` words, a new one each
``STRIDE``) is a query. Scores are BM25 with the item's score against itself as 1, so one
threshold serves items of every length, and all items at or above it are retrieved. As no
passage can hold an item much longer than itself, items of over ``SEGMENT`` words are also
indexed by overlapping segments of so many words, each scored against itself: a segment that
a document holds lies within one of its passages. A block bound decides which passages run the search at all: what the rare terms of passage and item
add up to, and the most that the passage's frequent terms can add in the item's block. It is
never below the score, so it loses nothing. An item that is retrieved counts as found if the text around the passage
holds enough of the word sequences of its question and of its answer (its last sentence),
both of the whole item.

The index holds at most ``SHARD_ITEMS`` items and ``SHARD_CHARS`` characters, those of
segments included. Larger
benchmarks are searched in several such shards, with word statistics of the whole benchmark.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import WORD, flat_map_rows, map_rows, unused

WINDOW, STRIDE = 128, 64
#: Words of a segment of a longer item, and from one segment's start to the next one's. Wherever
#: SEGMENT words stand, a passage holds them all, as SEGMENT + STRIDE is at most WINDOW.
SEGMENT, SEGMENT_STRIDE = 64, 32
K1, B = 1.2, 0.75
#: Least share of an item's own score, and least overlap of its question and its answer.
LEAST_SCORE, LEAST_OVERLAP = 0.6, 0.6
SHINGLE = 5
#: Postings in a block of the index; items in a block of the bound.
BLOCK, BOUND_BLOCK = 8, 2
SHARD_ITEMS, SHARD_CHARS = 4_000, 10_000_000
#: Parts of so many strides bound the memory that a long text takes.
CELLS = 64
#: Terms in more than this share of the items only count towards the bound.
FREQUENT = 0.05

_WORD = re.compile(WORD)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of a shorter text, the whole."""
    n = min(SHINGLE, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def stretches(words: list[str]) -> list[list[str]]:
    """What an item is indexed by: all its words and, if they are many, its segments."""
    if len(words) <= SEGMENT:
        return [words]
    starts = [*range(0, len(words) - SEGMENT, SEGMENT_STRIDE), len(words) - SEGMENT]
    return [words, *(words[k : k + SEGMENT] for k in starts)]


@dataclass
class Item:
    item_id: int | None
    words: int
    question: set = field(default_factory=set)
    answer: set = field(default_factory=set)

    @classmethod
    def read(cls, item_id: int | None, text: str) -> Item:
        parts = [p for p in _SENTENCE.split(text) if words_of(p)]
        answer = words_of(parts[-1]) if len(parts) > 1 else []
        question = words_of(" ".join(parts[:-1] if len(parts) > 1 else parts))
        return cls(item_id, len(words_of(text)), shingles(question), shingles(answer))

    def overlaps(self, words: list[str]) -> tuple[float, float]:
        """Shares of the question's and of the answer's runs that ``words`` hold."""

        def share(runs: set) -> float:
            if not runs:
                return 1.0
            n = len(next(iter(runs)))
            there = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            return len(runs & there) / len(runs)

        return share(self.question), share(self.answer)


class Index:
    """Inverted index of items: by term, postings in blocks with their largest impact.

    An item has an entry, or several, for its stretches; ``items`` has the item of each entry.
    """

    def __init__(self, items: list[tuple], frequency: dict[str, int], n: int, length: float) -> None:
        self.items: list[Item] = []
        self.terms = {w: k for k, w in enumerate(sorted(frequency))}
        idf = [math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in sorted(frequency)]
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item_id, text in items:
            item = Item.read(item_id, text)
            for stretch in stretches(words_of(text)):
                at, counts = len(self.items), Counter(stretch)
                self.items.append(item)
                norm = K1 * (1 - B + B * len(stretch) / length)
                impact = {w: idf[self.terms[w]] * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
                own = sum(impact.values())
                for w, x in impact.items():
                    postings[self.terms[w]].append((at, x / own))
        entries = len(self.items)
        self.at = [[a for a, _ in p] for p in postings]
        self.impact = [[x for _, x in p] for p in postings]
        self.top = np.array([max(x, default=0.0) for x in self.impact])
        self.block_top = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impact]
        # for the bound: rare terms' postings as flat arrays, frequent terms' maxima by block
        limit = max(2, FREQUENT * entries)
        rare = [len(a) <= limit for a in self.at]
        self.rare = np.array([*rare, False], bool)  # term -1 is none
        self.starts = np.cumsum([0, *(len(a) for a in self.at)])
        self.flat_at = np.array([a for p in self.at for a in p], np.int64)
        self.flat_impact = np.array([x for p in self.impact for x in p])
        self.frequent = {t: k for k, t in enumerate(k for k, r in enumerate(rare) if not r)}
        self.block_bound = np.zeros((len(self.frequent), entries // BOUND_BLOCK + 1))
        for t, k in self.frequent.items():
            np.maximum.at(self.block_bound[k], np.array(self.at[t]) // BOUND_BLOCK, self.impact[t])
        self.most = self.block_bound.sum(axis=0)
        self.counts = np.diff(self.starts)
        # what rare terms must add up to, by entry
        self.rest = LEAST_SCORE - 1e-9 - self.most[np.arange(entries) // BOUND_BLOCK]

    def retrieve(self, terms: list[int], least: float) -> Iterator[tuple[int, float]]:
        """Entries (by place in ``items``) that reach ``least``, by block-max WAND."""
        cursors = [[self.at[t][0], 0, t] for t in terms]

        def advance(cursor: list[int], to: int) -> None:
            cursor[1] = bisect_left(self.at[cursor[2]], to, cursor[1])
            ended = cursor[1] >= len(self.at[cursor[2]])
            cursor[0] = len(self.items) if ended else self.at[cursor[2]][cursor[1]]

        while True:
            cursors.sort()
            while cursors and cursors[-1][0] >= len(self.items):
                cursors.pop()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.top[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            bound, end = 0.0, len(self.items)
            for _, i, t in ahead:  # the blocks that may hold the item
                at = self.at[t]
                k = bisect_left(at, item, i) // BLOCK
                if k < len(self.block_top[t]):
                    bound += self.block_top[t][k]
                    end = min(end, at[min(k * BLOCK + BLOCK, len(at)) - 1])
            if bound < least:
                if pivot + 1 < len(cursors):
                    end = min(end, cursors[pivot + 1][0] - 1)
                for c in ahead:
                    if c[0] <= max(end, item):
                        advance(c, max(end, item) + 1)
            elif ahead[0][0] == item:
                score = sum(self.impact[t][i] for _, i, t in ahead)
                if score >= least:
                    yield item, score
                for c in ahead:
                    advance(c, item + 1)
            else:
                for c in ahead:
                    if c[0] < item:
                        advance(c, item)

    def passages(self, words: list[str], least: float = LEAST_SCORE - 1e-9) -> Iterator[tuple[int, list[int]]]:
        """Passages that some entry may reach: first word, distinct indexed terms."""
        get = self.terms.get
        term = np.array([get(w, -1) for w in words], np.int64)
        cells = (len(words) - 1) // STRIDE + 1 if words else 0
        last, n = max(0, cells - 2), len(self.items)  # the last passage reaches the end
        at = np.flatnonzero(self.rare[term])
        for begin in range(0, last + 1 if cells else 0, CELLS):  # long texts in parts
            end = min(begin + CELLS + 1, cells)
            part = at[np.searchsorted(at, begin * STRIDE) : np.searchsorted(at, end * STRIDE)]
            t = term[part]
            counts = self.counts[t]
            ends = np.cumsum(counts)
            if len(ends):
                which = np.arange(ends[-1]) + np.repeat(self.starts[t] - ends + counts, counts)
                key = np.repeat((part // STRIDE - begin) * n, counts) + self.flat_at[which]
                sums = np.bincount(key, self.flat_impact[which], (end - begin) * n).reshape(-1, n)
            else:
                sums = np.zeros((end - begin, n))
            if len(sums) > 1:
                sums = sums[:-1] + sums[1:]
            rows, items = np.nonzero(sums >= self.rest)
            found: dict[int, list[tuple]] = {}
            for r, i in zip(rows.tolist(), items.tolist()):
                found.setdefault(r, []).append((sums[r, i], i // BOUND_BLOCK))
            for r, candidates in found.items():
                k = begin + r
                there = term[k * STRIDE : k * STRIDE + WINDOW if k < last else None]
                distinct = np.unique(there[there >= 0]).tolist()
                bound = self.block_bound[[self.frequent[t] for t in distinct if t in self.frequent]].sum(axis=0)
                if any(x + bound[b] >= least for x, b in candidates):
                    yield k * STRIDE, distinct

    def search(self, text: str | None) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap, first word), the best per item.

        The score is that of the item or of its best segment.
        """
        words = words_of(text)
        best: dict[int, tuple] = {}
        for start, terms in self.passages(words):
            reached: dict[int, tuple[Item, float]] = {}
            for k, score in self.retrieve(terms, LEAST_SCORE - 1e-9):
                item = self.items[k]
                if id(item) not in reached or reached[id(item)][1] < score:
                    reached[id(item)] = (item, score)
            for k, (item, score) in reached.items():
                # sums of a segment's shares that differ in the last digits are equal
                if k in best and best[k][1] >= score - (1e-9 if item.words > SEGMENT else 0):
                    continue
                around = words[max(0, start - item.words) : start + WINDOW + item.words]
                asked, answered = item.overlaps(around)
                if asked >= LEAST_OVERLAP and answered >= LEAST_OVERLAP:
                    best[k] = (item.item_id, float(score), asked, answered, start)
        return list(best.values())


def _spark_words():
    return F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))


def index_parts(items: DataFrame) -> Iterator[tuple]:
    """What the index, or that of each shard, is made of. Items without words are left out."""
    items = (
        items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("words", _spark_words())
        .filter(F.size("words") > 0)
    )
    # segments overlap by half, so a long item is indexed about three times
    times = F.when(F.size("words") > SEGMENT, 1 + SEGMENT // SEGMENT_STRIDE).otherwise(1)
    total = items.agg(
        F.count("*").alias("n"), F.sum(F.length("text") * times).alias("chars"), F.avg(F.size("words")).alias("length")
    ).first()
    if not total.n:
        return
    shards = max(math.ceil(total.n / SHARD_ITEMS), math.ceil(total.chars / SHARD_CHARS))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    frequency = items.select(shard.alias("shard"), F.explode(F.array_distinct("words")).alias("word"))
    counted = frequency.groupBy("word").agg(F.count("*").alias("n"))
    for k in range(shards):
        rows = items.filter(shard == k).select("item_id", "text").orderBy("item_id", "text").collect()
        if not rows:
            continue
        own = frequency.filter(F.col("shard") == k).select("word").distinct()
        known = {r.word: r.n for r in counted.join(own, "word").collect()}
        # words as Python reads them, in case the two differ
        for r in rows:
            for w in words_of(r.text):
                known.setdefault(w, 1)
        yield [(r.item_id, r.text) for r in rows], known, total.n, total.length


FOUND = [
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()),
    T.StructField("answer_overlap", T.DoubleType()), T.StructField("first_word", T.LongType()),
]


def _finder(shared):
    index = Index(*shared.value)
    return lambda doc_id, text: [(doc_id, *f) for f in index.search(text)]


def _tester(shared):
    index = Index(*shared.value)
    return lambda text: (bool(index.search(text)),)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document and item found in it: doc_id, item_id, score, overlaps, first_word.

    Null and empty texts hold no item; repeated rows are found repeatedly; without items or
    documents the result is empty.
    """
    sc = docs.sparkSession.sparkContext
    found = None
    for parts in index_parts(items):
        shared = sc.broadcast(parts)  # at most SHARD_ITEMS items
        rows = flat_map_rows(
            docs,
            ["doc_id", "text"],
            partial(_finder, shared),
            [T.StructField("doc_id", T.LongType()), *FOUND],
        )
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), *FOUND])
        found = docs.sparkSession.createDataFrame([], schema)
    return found


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns."""
    sc, columns = docs.sparkSession.sparkContext, docs.columns
    found = unused(docs, "found")
    for parts in index_parts(items):
        shared = sc.broadcast(parts)
        rows = map_rows(
            docs,
            ["text"],
            partial(_tester, shared),
            [T.StructField(found, T.BooleanType())],
            columns,
        )
        docs = rows.filter(~F.col(found)).select(*columns)
    return docs
