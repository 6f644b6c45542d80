"""Text scores by a class-based bigram model in the manner of Brown.

Words belong to classes; a token's probability is that of its class after the class before
it, times that of the word within its class. Classes are found by exchange clustering: units
move to the class that raises the likelihood of the unit bigrams most. Every training word
that occurs ``LEAST`` times is a unit; each of the other words stands with the unit of its
ending, so that every word has a class. Bigrams and word counts come from all training
documents.

The driver clusters the ``UNITS`` commonest words and the endings of all others one at a time
until none moves. That gives each word a first class. Then all units are moved in ``STEPS``
steps, half of them in each. For that the units beside each unit are counted and written once;
a step passes over them where they lie, sums a unit's counts by the class before and after
it and chooses its best class by the table of class bigrams. As units move at once, the moves of
a step count only as far as they raise the likelihood. Tasks know units by a hash of the word:
8 bytes and a class for each; the units beside one unit, at most all, are in one row. There
may be 2**31 units.

Word counts of frequent words (at most ``FREQUENT``) travel to the tasks; counts of other
words are joined by word. Both the base score and the class model need the sum of
log10(count + 0.5) over a text's tokens and otherwise only classes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import flat_map_rows, map_rows, remainder
from pagequarry.llm.components import Workspace

#: The token that ends a text. Words hold no white space, so it is none of them.
END = b" "
UNITS, ENDINGS, CLASSES = 640, 383, 48
FREQUENT = 1 << 18
PASSES = 12
#: Least count of a word that is a unit of its own; steps that move all units.
LEAST, STEPS = 5, 6
#: Counts held by a task before equal ones are added up and handed on; those a task gathers.
HELD, GATHERED = 500_000, 1_000_000
#: Counts in one row of the table of units and the units beside them, and those looked at together.
BLOCK, LOOKED = 100_000, 10_000
#: Such rows that a task takes in at once.
ROWS = 16
#: Texts that a task takes in at once, and tokens of texts that it looks up together.
TEXTS, TOKENS = 512, 50_000
#: Words counted before a task hands its counts on.
COUNTED = 400_000


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, then the end."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list]:
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            yield batch.slice(k, TEXTS).column(column).to_pylist()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            for k in range(0, len(words), 50_000):
                part = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[part], pa.binary()), pa.array(counts[part], pa.int64())], ["word", "c"]
                )
            held.clear()

        for values in _batches(batches, "text"):
            for text in values:
                held.update(tokens_of(text))
                if len(held) >= COUNTED:
                    yield from emit()
        yield from emit()

    counted = texts.select("text").mapInArrow(run, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def ending(word: bytes) -> bytes:
    """What stands for a word that is no unit of its own: its last two bytes, and a mark."""
    return b"\n" + word[-2:]


class Units:
    """Number of a word's unit. Unit 0 is the end, the last one all other endings."""

    def __init__(self, words: list[bytes], endings: list[bytes]) -> None:
        names = [END, *(w for w in words if w != END), *endings]
        self.size = len(names) + 1
        self.known = {w: k for k, w in enumerate(names)}

    def __call__(self, word: bytes) -> int:
        k = self.known.get(word)
        return self.known.get(ending(word), self.size - 1) if k is None else k


class _Memo(dict):
    """Units of words, remembered up to a bounded number."""

    def __init__(self, units: Callable[[bytes], int]) -> None:
        self.units = units

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        made = self[word] = self.units(word)
        return made

    def many(self, words: list[bytes]) -> np.ndarray:
        """Units of words in order; those not remembered are looked up together."""
        found = list(map(self.get, words))
        if None in found:
            new = list({w for w, x in zip(words, found) if x is None})
            made = dict(zip(new, self.units.many(new)))
            if len(self) + len(made) > 300_000:
                self.clear()
            self.update(made)
            found = [made[w] if x is None else x for w, x in zip(words, found)]
        return np.array(found, np.int64)


def unit_bigrams(texts: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a; a text's first word follows the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, size = _Memo(units), units.size
        table = np.zeros(size * size, np.int64)
        for values in _batches(batches, "text"):
            for text in values:
                words = tokens_of(text)
                u = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                pairs = np.concatenate([[u[0]], u[:-1] * size + u[1:]])
                if len(pairs) > 5000:
                    table += np.bincount(pairs, minlength=size * size)
                else:
                    np.add.at(table, pairs, 1)
        at = np.flatnonzero(table)
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part // size, pa.int32()), pa.array(part % size, pa.int32()), pa.array(table[part], pa.int64())],
                ["a", "b", "n"],
            )

    counted = texts.select("text").mapInArrow(run, "a int, b int, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def gains(table: np.ndarray, o: np.ndarray, i: np.ndarray, loop: float, old: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams without a unit of class ``old``, and the gain of its joining each class.

    ``o`` and ``i`` are its counts to and from each class without ``loop``, those to itself.
    """
    base = table.copy()
    base[old, :] -= o
    base[:, old] -= i
    base[old, old] -= loop
    # its class's row gets o, its column i, and where they cross all three
    after, before = np.flatnonzero(o), np.flatnonzero(i)
    rows = _xlogx(base[:, after] + o[after]) - _xlogx(base[:, after])
    columns = _xlogx(base[before, :] + i[before][:, None]) - _xlogx(base[before, :])
    gain = rows.sum(axis=1) + columns.sum(axis=0)
    gain[after] -= rows[after, np.arange(len(after))]
    gain[before] -= columns[np.arange(len(before)), before]
    d = np.diag(base)
    gain += _xlogx(d + o + i + loop) - _xlogx(d)
    left, right = base.sum(axis=1), base.sum(axis=0)
    gain -= _xlogx(left + o.sum() + loop) - _xlogx(left)
    gain -= _xlogx(right + i.sum() + loop) - _xlogx(right)
    # tokens that precede or follow the unit keep their classes, so only its own move
    gain[0] = -np.inf
    return base, gain


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit by exchange clustering on a unit bigram table.

    Maximises the sum of n log n over class bigrams minus that over class counts on either
    side. The end unit stays alone in class 0; others start by frequency, round robin.
    """
    n = len(bigrams)
    classes = min(classes, n)
    order = [int(u) for u in np.argsort(-bigrams.sum(axis=1), kind="stable") if u]
    cls = np.zeros(n, np.int64)
    for k, u in enumerate(order):
        cls[u] = 1 + k % max(1, classes - 1) if classes > 1 else 0
    if classes < 3:
        return cls
    one = np.eye(classes)[cls]
    table = one.T @ bigrams @ one
    out_of, into = bigrams @ one, bigrams.T @ one  # by unit: counts to and from each class
    for _ in range(passes):
        moved = 0
        for u in order:
            old = cls[u]
            o, i, loop = out_of[u].copy(), into[u].copy(), bigrams[u, u]
            o[old] -= loop
            i[old] -= loop
            base, gain = gains(table, o, i, loop, old)
            new = int(np.argmax(gain))
            if new != old and gain[new] > gain[old] + 1e-9:
                cls[u] = new
                moved += 1
                table = base
                table[new, :] += o
                table[:, new] += i
                table[new, new] += loop
                out_of[:, old] -= bigrams[:, u]
                out_of[:, new] += bigrams[:, u]
                into[:, old] -= bigrams[u, :]
                into[:, new] += bigrams[u, :]
        if not moved:
            break
    return cls


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, up to what depends on the words alone."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def _key(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)


class Numbers:
    """Number of a word's unit: 0 is the end, then words by hash, endings, all other endings."""

    def __init__(self, keys: np.ndarray, endings: list[bytes]) -> None:
        self.keys, self.size = keys, len(keys) + len(endings) + 2
        self.endings = {e: len(keys) + 1 + k for k, e in enumerate(endings)}

    def __call__(self, word: bytes) -> int:
        if word == END:
            return 0
        key = _key(word)
        k = int(self.keys.searchsorted(key))
        if k < len(self.keys) and self.keys[k] == key:
            return k + 1
        return self.endings.get(ending(word), self.size - 1)

    def many(self, words: list[bytes]) -> list[int]:
        """Numbers of the units of many words, found in one search."""
        keys = np.array([_key(w) for w in words], np.int64)
        at = self.keys.searchsorted(keys)
        held = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        held[inside] = self.keys[at[inside]] == keys[inside]
        get, rest = self.endings.get, self.size - 1
        return [0 if w == END else k if h else get(ending(w), rest)
                for w, h, k in zip(words, held.tolist(), (at + 1).tolist())]


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, n = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(n, starts)


def neighbours(texts: DataFrame, shared, size: int, tokens: int) -> DataFrame:
    """Units with the units beside them and how often, some units in one row.

    ``half`` is the units' parity. The others are arrays as bytes: the units, how many
    counts each has, and of the counts the unit beside times two (one more if it comes before)
    and the number. Texts end with unit 0, which also precedes the first word.
    """

    parts = max(1, math.ceil(2 * tokens / GATHERED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(Numbers(*shared.value))
        keys, held = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
            a, b = key // size, key % size
            unit, beside, n = np.concatenate([a, b]), np.concatenate([2 * b, 2 * a + 1]), np.concatenate([n, n])
            part = unit % parts  # units are numbered by hash
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for k in range(parts):
                rows = order[edges[k] : edges[k + 1]]
                if len(rows):
                    arrays = unit[rows].astype(np.int32), beside[rows].astype(np.uint32), n[rows].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)],
                        ["part", "unit", "beside", "n"],
                    )

        def take(words: list[bytes]) -> int:
            """Of whole texts: each ends with unit 0, which precedes the next one's first word, too."""
            b = memo.many(words)
            keys.append(np.concatenate([[0], b[:-1]]) * size + b)
            return len(b)

        for values in _batches(batches, "text"):
            words: list[bytes] = []
            for text in values:
                words += tokens_of(text)
                if len(words) >= TOKENS:
                    held += take(words)
                    words = []
                    if held > HELD:
                        yield from emit()
                        keys, held = [], 0
            if words:
                held += take(words)
            if held > HELD:
                yield from emit()
                keys, held = [], 0
        yield from emit()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("unit", "beside", "n"))):
                unit, beside, n = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int32, np.uint32, np.int32)))
                keys.append(unit.astype(np.int64) * (2 * size) + beside)
                counts.append(n.astype(np.int64))
                held += len(n)
            if held > 2 * GATHERED:  # equal ones of a frequent unit
                key, n = _added(keys, counts)
                keys, counts, held = [key], [n], len(key) // 2
        all_, n_all = _added(keys, counts)
        for half in (0, 1):
            mine = all_ // (2 * size) % 2 == half
            key, n = all_[mine], n_all[mine]
            units, starts = np.unique(key // (2 * size), return_index=True)
            ends = np.concatenate([starts[1:], [len(key)]]).astype(np.int64)
            at = 0
            while at < len(units):
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
                part = slice(starts[at], ends[to - 1])
                beside = (key[part] % (2 * size)).astype(np.uint32)
                arrays = units[at:to], ends[at:to] - starts[at:to], beside, n[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([half], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)],
                    ["half", "units", "sizes", "beside", "n"],
                )
                at = to

    # few rows of many counts, so the exchange costs little
    counted = texts.select("text").mapInArrow(count, "part int, unit binary, beside binary, n binary")
    return counted.repartition(parts, "part").mapInArrow(gather, "half int, units binary, sizes binary, beside binary, n binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("units", "sizes", "beside", "n"))):
            units, sizes, beside, n = (x.as_buffer() for x in row)
            yield (np.frombuffer(units, np.int64), np.frombuffer(sizes, np.int64),
                   np.frombuffer(beside, np.uint32).astype(np.int64), np.frombuffer(n, np.int64))


@contextmanager
def _small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """While this holds, tasks are handed so many rows at a time: texts are large, rows of blocks more so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def class_table(blocks: DataFrame, cls: np.ndarray, k: int) -> np.ndarray:
    """How often a class follows another."""
    shared = blocks.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = shared.value, np.zeros(k * k, np.int64)
        for units, sizes, beside, n in _rows(batches):
            after = beside % 2 == 0
            at = np.repeat(of[units].astype(np.int64) * k, sizes)[after] + of[beside[after] // 2]
            table += np.bincount(at, n[after], k * k).astype(np.int64)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["at", "n"])

    with _small_batches(blocks.sparkSession):
        cells = blocks.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = np.zeros(k * k)
    out[cells["at"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(k, k)


def coarse_bigrams(blocks: DataFrame, unit_of: np.ndarray, size: int) -> np.ndarray:
    """How often a unit of a coarser kind follows another; ``unit_of`` gives that of each unit."""
    shared = blocks.sparkSession.sparkContext.broadcast(unit_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = shared.value, np.zeros(size * size, np.int64)
        for units, sizes, beside, n in _rows(batches):
            after = beside % 2 == 0
            at = np.repeat(of[units] * size, sizes)[after] + of[beside[after] // 2]
            np.add.at(table, at, n[after])
        at = np.flatnonzero(table)
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(table[part], pa.int64())], ["at", "n"])

    with _small_batches(blocks.sparkSession):
        cells = blocks.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = np.zeros(size * size)
    out[cells["at"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(size, size)


def many_gains(table: np.ndarray, o: np.ndarray, i: np.ndarray, loop: np.ndarray, old: np.ndarray) -> np.ndarray:
    """What ``gains`` gives, for many units at once: a row for each."""
    units = np.arange(len(old))
    total_o, total_i = o.sum(axis=1), i.sum(axis=1)

    def without(grid: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The part of the cells [class, j] for each j that a unit has ``mine`` counts to."""
        u, j = np.nonzero(mine)
        n, was = mine[u, j], old[u]
        base, before = grid.T[j], _xlogx(grid).T[j]
        base[np.arange(len(u)), was] -= n
        at_old = np.flatnonzero(j == was)
        base[at_old] -= other[u[at_old]]
        base[at_old, j[at_old]] -= loop[u[at_old]]
        before[np.arange(len(u)), was] = _xlogx(base[np.arange(len(u)), was])
        before[at_old] = _xlogx(base[at_old])
        more = _xlogx(base + n[:, None]) - before
        more[np.arange(len(u)), j] = 0  # the crossing cell is counted by itself
        out = np.zeros(mine.shape)
        if len(u):
            starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            out[u[starts]] = np.add.reduceat(more, starts, axis=0)
        return out

    gain = without(table, o, i) + without(table.T, i, o)
    cross = np.tile(np.diag(table), (len(old), 1))
    cross[units, old] -= o[units, old] + i[units, old] + loop
    gain += _xlogx(cross + o + i + loop[:, None]) - _xlogx(cross)
    left, right = table.sum(axis=1) - i, table.sum(axis=0) - o
    left[units, old] -= total_o + loop
    right[units, old] -= total_i + loop
    gain -= _xlogx(left + (total_o + loop)[:, None]) - _xlogx(left)
    gain -= _xlogx(right + (total_i + loop)[:, None]) - _xlogx(right)
    gain[:, 0] = -np.inf
    return gain


def moves(blocks: DataFrame, cls: np.ndarray, table: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of one half that gain by another class: numbers, classes, gains."""
    k, shared = len(table), blocks.sparkSession.sparkContext.broadcast((cls, table))
    width = 2 * k + 1  # by unit: counts to each class, from each class, to itself

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, grid = shared.value
        of = of.astype(np.int64)
        made = []
        for units, sizes, beside, n in _rows(batches):
            at, other, before = np.repeat(np.arange(len(units)), sizes), beside // 2, beside % 2
            loop = (before == 1) & (other == units[at])
            slot = np.concatenate([at * width + before * k + of[other], at[loop] * width + 2 * k])
            rows = np.bincount(slot, np.concatenate([n, n[loop]]), len(units) * width).reshape(-1, width)
            o, i, loops, old = rows[:, :k], rows[:, k:-1], rows[:, -1], of[units]
            o[np.arange(len(old)), old] -= loops
            i[np.arange(len(old)), old] -= loops
            step = max(1, LOOKED // width)
            for start in range(0, len(units), step):
                part = slice(start, start + step)
                gain = many_gains(grid, o[part], i[part], loops[part], old[part])
                here, new = np.arange(len(gain)), gain.argmax(axis=1)
                more = gain[here, new] - gain[here, old[part]]
                good = (new != old[part]) & (more > 1e-9) & (units[part] > 0)
                made.append((units[part][good], new[good], more[good]))
        columns = [np.concatenate(c) for c in zip(*made)] or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], ["unit", "cls", "gain"]
        )

    with _small_batches(blocks.sparkSession):
        rows = blocks.filter(F.col("half") == half).mapInArrow(choose, "unit int, cls int, gain double").toArrow()
    shared.unpersist()
    return tuple(rows[c].to_numpy() for c in ("unit", "cls", "gain"))


def refined(blocks: DataFrame, cls: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units after so many steps, and the class bigrams."""
    k = int(cls.max()) + 1
    table = class_table(blocks, cls, k)
    idle = 0
    for step in range(steps if k > 2 else 0):
        unit, new, gain = moves(blocks, cls, table, step % 2)
        order = np.lexsort((unit, -gain))
        idle += 1
        while len(order):  # all moves, or the half of them that gain most, and so on
            tried = cls.copy()
            tried[unit[order]] = new[order]
            made = class_table(blocks, tried, k)
            if likelihood(made) > likelihood(table):
                cls, table, idle = tried, made, 0
                break
            order = order[: len(order) // 2]
        if idle > 1:  # neither half moves
            break
    return cls, table


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class | class before): class bigrams backed off to class frequencies."""
    k = len(table)
    total = table.sum(axis=0) + 0.5
    unigram = total / total.sum()
    before = table.sum(axis=1, keepdims=True)
    return np.log10((table + 20.0 * unigram[None, :]) / (before + 20.0)) if k else np.zeros((0, 0))


def _scorer(shared):
    """Per text: tokens, known tokens and log counts of frequent words, class part, the rest."""
    words, counts, keys, endings, cls, trans, within = shared.value
    memo = _Memo(Numbers(keys, endings))
    # a frequent word has its place in the list, from which its log count and class follow; others a class alone
    place = dict(zip(words, range(len(words))))
    logs, cls_of = np.log10(np.array(counts, float) + 0.5), np.zeros(len(words), np.int64)
    for k in range(0, len(words), TOKENS):
        cls_of[k : k + TOKENS] = cls[memo.units.many(words[k : k + TOKENS])]
    trans, within = np.array(trans), np.array(within)

    def step(text: str | None) -> tuple:
        tokens = tokens_of(text)
        at = list(map(place.get, tokens))
        rest = [w for w, x in zip(tokens, at) if x is None] if None in at else []
        if rest:
            places = np.array([-1 if x is None else x for x in at], np.int64)
            held = places >= 0
            c = np.zeros(len(tokens), np.int64)
            c[~held] = cls[memo.many(rest)]
            places = places[held]
            c[held] = cls_of[places]
        else:
            places = np.array(at, np.int64)
            c = cls_of[places]
        by_class = trans[np.concatenate([[0], c[:-1]]), c].sum() - within[c].sum()
        rare = Counter(rest)
        known = logs[places].tolist()
        return len(tokens), len(known), math.fsum(known), float(by_class), list(rare), list(rare.values())

    return step


def scores(docs: DataFrame, learn: F.Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``learn`` says which documents are learned from (all, if None). A null text counts as
    empty and has the end as its only token. Rows that repeat a doc_id are scored each by
    itself. Without training documents every count is 0.
    """
    sc = docs.sparkSession.sparkContext
    space = Workspace(docs.sparkSession, "brown")
    train = docs if learn is None else docs.filter(learn)
    with _small_batches(docs.sparkSession, TEXTS):
        vocabulary = space.keep(word_counts(train), "words")
    total = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total.n or 0), int(total.v or 0)

    def commonest(table: DataFrame, limit: int) -> list[bytes]:
        """At most ``limit`` words; ties by word."""
        return [bytes(r.word) for r in table.orderBy(F.desc("c"), "word").limit(limit).collect()]

    names = commonest(vocabulary, UNITS)
    size = F.octet_length("word")
    tail = vocabulary.select(F.substring("word", F.greatest(size - 1, F.lit(1)), F.lit(2)).alias("word"), "c")
    ends = commonest(tail.groupBy("word").agg(F.sum("c").alias("c")), ENDINGS)
    endings = [b"\n" + e for e in ends]
    units = Units(names, endings)
    # every word of LEAST occurrences by hash, with its first unit
    words = flat_map_rows(
        vocabulary.filter((F.col("c") >= LEAST) & (F.col("word") != F.lit(END))), ["word"],
        partial(_first_units, names, endings),
        [T.StructField("key", T.LongType()), T.StructField("unit", T.IntegerType())],
    ).toArrow()
    keys, at = np.unique(words["key"].to_numpy(), return_index=True)
    ends_at = np.arange(units.size - 1 - len(endings), units.size)
    unit_of = np.concatenate([[0], words["unit"].to_numpy()[at], ends_at]).astype(np.int64)
    numbers = sc.broadcast((keys, endings))
    with _small_batches(docs.sparkSession, TEXTS):
        blocks = space.keep(neighbours(train, numbers, len(unit_of), n), "neighbours")
    if vocabulary.filter(F.col("word").isin([F.lit(w) for w in names[-1:]]) & (F.col("c") < LEAST)).isEmpty():
        bigrams = coarse_bigrams(blocks, unit_of, units.size)
    else:  # some of the first units are rarer than the others
        bigrams = np.zeros((units.size, units.size))
        cells = unit_bigrams(train, units).toArrow()
        bigrams[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["n"].to_numpy()
    cls, table = refined(blocks, exchange(bigrams)[unit_of].astype(np.int8))
    known = sc.broadcast(cls)
    # words and tokens of each class
    of_class = flat_map_rows(
        vocabulary, ["word", "c"],
        partial(_class_counter, numbers, known),
        [T.StructField("class", T.IntegerType()), T.StructField("c", T.LongType())],
    ).groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    inside = np.full(cls.max() + 1, 0.5)
    for r in of_class:
        inside[r["class"]] = r.n + 0.5 * (r.v + 1)
    # the commonest words: the least count such that there are not more than FREQUENT
    steps = vocabulary.groupBy(F.floor(F.log("c") * 16).alias("step")).agg(
        F.count("*").alias("k"), F.min("c").alias("c")
    )
    least, upto = n + 1, 0
    for r in steps.orderBy(F.desc("step")).collect():
        upto += r.k
        if upto > FREQUENT:
            break
        least = r.c
    frequent = vocabulary.filter(F.col("c") >= least).toArrow()
    shared = sc.broadcast(
        (frequent["word"].to_pylist(), frequent["c"].to_pylist(), keys, endings, cls,
         transitions(table).tolist(), np.log10(inside).tolist())
    )
    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("logs", T.DoubleType()), T.StructField("by_class", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType())),
    ]
    numbered = docs.select("doc_id", "text")
    parts = map_rows(numbered, ["text"], partial(_scorer, shared), fields, ["doc_id"])
    with _small_batches(docs.sparkSession, TEXTS):
        parts = space.keep(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    rest = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rest = rest.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = (
        rest.join(vocabulary, "word")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("more"),
            F.sum("times").alias("more_known"),
        )
    )
    unknown = F.log10(F.lit(0.5)) * F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    slim = parts.select("row", "doc_id", "n_tokens", "known", "by_class", (F.col("logs") + unknown).alias("logs"))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return slim.join(found, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (logs + F.col("by_class")).alias("score"),
    )


def _first_units(names: list[bytes], endings: list[bytes]):
    units = Units(names, endings)
    return lambda word: [(_key(bytes(word)), units(bytes(word)))]


def _class_counter(numbers, known):
    units, cls = Numbers(*numbers.value), known.value.tolist()
    return lambda word, c: [(cls[units(bytes(word))], c)]


def lm_scores(docs: DataFrame) -> DataFrame:
    """The scores of every document, learned outside the held-out fifth."""
    held = remainder("doc_id", 5) == 1
    return scores(docs, ~held).withColumn("held_out", remainder("doc_id", 5) == 1)
