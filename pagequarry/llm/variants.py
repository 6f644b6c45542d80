"""Spelling variants: words one edit apart, found by bit-sliced indexes over the vocabulary.

For every (position, letter) an index holds a bitset of the words with that letter there, one
index for each word length. A query word runs over its letters and keeps, for all words of a
length at once, the set that has matched without an error and the set with one error: a word of
its own length has one letter replaced, a longer one an inserted letter, so that from then on
letters are looked up one position later. The sets of all query words of a bucket advance
together, 64 words at a time.

Which words meet is decided by a split in halves. Of two words within one edit, of lengths L
and L or L + 1, either the first L div 2 letters are equal or the last L div 2 are. Words are
dealt by L and a hash of either half into buckets of some ``BUCKET`` words, as many as the
vocabulary needs; two words that meet by their first halves are left out by their last. No
bucket is cut, and a bucket of m words needs memory for m words and time for m * m / 64 steps.
A half that very many words share makes one large bucket; that of a vocabulary of words is
bounded, as there are only so many words of a length that share a half.

Runs are counted over all texts. A null text holds none, and a null id is an empty string in the
hash. An empty table has no words. Extra columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.components import Workspace

#: Letters of the words (fixed value).
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: A-Z to a-z in UTF-8 bytes and nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: One run in so many loses a letter (fixed value).
DROP = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words a bucket holds on average, counts a task holds before it passes them on, and the bits
#: of the sets (query words times words) that advance together.
BUCKET, HELD, BITS = 2048, 1 << 18, 1 << 23


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: all words of at least ``LEAST_LENGTH`` letters after the planted losses, and their places."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def emit() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= LEAST_LENGTH]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                here = Counter(RUNS.findall(text.encode().translate(LOWER).decode()))
                begun = zlib.crc32(f"{doc}:".encode())
                for w, n in here.items():
                    h = zlib.crc32(w.encode(), begun)
                    if h % DROP == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    held[w] += n
                if len(held) >= HELD:
                    yield emit()
                    held.clear()
        yield emit()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    return counted_words(docs).filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


class Index:
    """Bitsets by position and letter over words of one length; equal letters share a row."""

    def __init__(self, words: list[str]) -> None:
        self.codes = _codes(words)
        self.size, self.length = self.codes.shape
        self.letters = np.unique(self.codes)
        self.width = -(-self.size // 64)
        # the row after the letters is for those the index does not have: no word
        self.sets = np.zeros((self.length, len(self.letters) + 1, self.width), np.uint64)
        for p in range(self.length):
            bits = self.codes[:, p][None, :] == self.letters[:, None]
            packed = np.packbits(bits, axis=1, bitorder="little")
            rows = np.zeros((len(self.letters), 8 * self.width), np.uint8)
            rows[:, : packed.shape[1]] = packed
            self.sets[p, :-1] = rows.view(np.uint64)
        every = np.zeros(8 * self.width, np.uint8)
        ones = np.packbits(np.ones(self.size, bool), bitorder="little")
        every[: len(ones)] = ones
        self.every = every.view(np.uint64)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, len(self.letters))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _pairs(found: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and word numbers of the bits set."""
    return np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, count=size, bitorder="little"))


def one_replaced(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) with a < b of the index's words that differ in one letter."""
    rows = index.rows(index.codes)
    left, right = [], []
    for start, part in _blocks(rows, index.width):
        none = np.broadcast_to(index.every, (len(part), index.width))
        one = np.zeros_like(none)
        for p in range(index.length):
            same = index.sets[p][part[:, p]]
            one = (one & same) | (none & ~same)
            none = none & same
        a, b = _pairs(np.ascontiguousarray(one), index.size)
        left.append(a + start)
        right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a < b], b[a < b]


def one_inserted(short: Index, long: Index) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) such that one letter inserted into word a of ``short`` gives word b of ``long``."""
    rows = long.rows(short.codes)
    left, right = [], []
    for start, part in _blocks(rows, long.width):
        none = np.broadcast_to(long.every, (len(part), long.width))
        one = np.zeros_like(none)
        for p in range(short.length):
            one = (one | none) & long.sets[p + 1][part[:, p]]
            none = none & long.sets[p][part[:, p]]
        a, b = _pairs(np.ascontiguousarray(one | none), long.size)
        left.append(a + start)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _blocks(rows: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    size = max(1, BITS // (64 * width))
    return ((k, rows[k : k + size]) for k in range(0, len(rows), size))


def near_pairs(words: list[str], length: int, side: str) -> tuple[list[str], list[str]]:
    """Pairs within one edit of words of ``length`` letters, or of one of these and a longer one.

    They share the half of ``side``; by the last half, those that share the first are left out.
    """
    short = [w for w in words if len(w) == length]
    long = [w for w in words if len(w) == length + 1]
    half = length // 2
    first, second = [], []
    if short:
        index = Index(short)
        found = [(one_replaced(index), short)]
        if long:
            found.append((one_inserted(index, Index(long)), long))
        for (left, right), others in found:
            for a, b in zip(left.tolist(), right.tolist()):
                a, b = short[a], others[b]
                by_first = a[:half] == b[:half]
                if by_first if side == "first" else not by_first and a[-half:] == b[-half:]:
                    first.append(a)
                    second.append(b)
    return first, second


def links(words: DataFrame) -> DataFrame:
    """a, b: every two words one edit apart once, the shorter first."""
    size = F.length("word")
    halves = [
        F.struct(
            (size - less).alias("length"),
            F.lit(side).alias("side"),
            F.xxhash64(take((size - less).cast("int"))).alias("half"),
        )
        for less in (0, 1)
        for side, take in (
            ("first", lambda n: F.substring("word", F.lit(1), F.floor(n / 2).cast("int"))),
            ("last", lambda n: F.right("word", F.floor(n / 2).cast("int"))),
        )
    ]
    # one row per length: how many buckets its words and those one longer need
    sizes = words.groupBy(size.alias("length")).agg(F.count("*").alias("n"))
    longer = sizes.select((F.col("length") - 1).alias("length"), "n")
    buckets = (
        sizes.unionByName(longer).groupBy("length").agg(F.ceil(F.sum("n") / BUCKET).cast("long").alias("buckets"))
    )
    dealt = (
        words.select("word", F.explode(F.array(*halves)).alias("h"))
        .select("word", "h.*")
        .join(F.broadcast(buckets), "length")
        .select("word", "length", "side", F.pmod("half", "buckets").alias("bucket"))
    )

    def run(group: pa.Table) -> pa.Table:
        one = group.slice(0, 1).to_pylist()[0]
        first, second = near_pairs(group["word"].to_pylist(), one["length"], one["side"])
        return pa.table({"a": pa.array(first, pa.string()), "b": pa.array(second, pa.string())})

    return dealt.groupBy("length", "side", "bucket").applyInArrow(run, "a string, b string")


def _roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """word, root of the words with a form: each round doubles the steps followed.

    A form has at least twice its word's count, so a chain has as many steps as a long has bits at most.
    """
    work = space.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = work.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = work.join(further, "root", "left")
        work = space.keep(
            stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"
        )
        if work.filter("moved").isEmpty():
            return work.select("word", "root")
        work = work.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    space = Workspace(docs.sparkSession, "variants")
    words = space.keep(vocabulary(docs), "words")
    pairs = space.keep(links(words), "links")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"))
    )
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        both.join(counts, "near")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    )
    found = words.join(best, "word", "left").withColumn("strong", -F.col("best.m") >= 2 * F.col("n"))
    grouped = space.keep(
        found.select(
            "word", F.when(F.col("strong"), F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("strong"), -F.col("best.m")).alias("form_n"),
        ),
        "grouped",
    )
    roots = _roots(grouped.filter("form IS NOT NULL"), space)
    return grouped.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
