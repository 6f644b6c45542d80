"""Quality grades by ordinal regression (cumulative logit) on hashed text.

One weight per hashed feature is shared by all grades; ordered thresholds cut the weighted
sum into grades: P(grade <= j) = logistic(threshold_j - sum). That gives the expected grade
and the probability of reaching a grade, by which documents are selected.

Features are relative frequencies, as square roots, of hashed words, of hashed word shapes
(runs of upper case, lower case, digits and each mark), and of words that repeat the word
before. The model is fitted on a bounded sample of labelled rows (``LABELLED``, the smallest
ids by a fixed hash) and then scores every row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import label_sample, map_rows, sampled_texts, unused

#: Buckets of hashed words and of hashed shapes; a few dense features follow them.
WORDS, SHAPES, DENSE = 4096, 1024, 3
SIZE = WORDS + SHAPES + DENSE
LABELLED = 8_000
GRADES = 3
#: A document is selected if it reaches grade ``SELECT_GRADE`` with this probability.
SELECT_GRADE, SELECT_PROBABILITY = 1, 0.5
NAMES = ("expected_grade", "p_select")

_MARKS = ".,;:!?"
_REPEAT = re.compile(r"(.)\1+")


class _Classes(dict):
    """Character to its class: A, a, 0 or itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        made = c if not c.isalnum() else "0" if c.isdigit() else "A" if c.isupper() else "a"
        self[code] = made
        return made


def shape(word: str, classes: dict) -> str:
    """``Word,`` to ``Aa,``, ``WORD%%`` to ``A%``, ``2024`` to ``0``; runs count once."""
    if word.isalpha() and word.islower():
        return "a"
    if word.istitle() and word.isalpha():
        return "Aa"
    return _REPEAT.sub(r"\1", word[:64].translate(classes))[:16]


class Hasher:
    """Features of a text; the buckets of a word are remembered up to a bounded number."""

    REMEMBERED = 300_000

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.classes = _Classes()

    def buckets(self, word: str) -> int:
        """The word's bucket, and its shape's in the bits above."""
        core = word.strip(_MARKS)
        form = shape(core, self.classes)
        if len(core) < len(word):
            form += word[len(word.rstrip(_MARKS)) :][:2]
        if form not in self.shapes:
            if len(self.shapes) >= self.REMEMBERED:
                self.shapes.clear()
            self.shapes[form] = WORDS + zlib.crc32(form.encode("utf-8", "replace")) % SHAPES
        return self.shapes[form] << 16 | zlib.crc32(core.lower().encode("utf-8", "replace")) % WORDS

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values, each index once."""
        words = text.split()
        n = len(words)
        if not n:
            return np.array([SIZE - 1]), np.array([1.0])
        counts = Counter(words)
        if len(self.seen) >= self.REMEMBERED:
            self.seen.clear()
        for word in [w for w in counts if w not in self.seen]:
            self.seen[word] = self.buckets(word)
        both = np.fromiter(map(self.seen.__getitem__, counts), np.int64, len(counts))
        times = np.fromiter(counts.values(), float, len(counts))
        sums = np.bincount(both & 0xFFFF, times, SIZE) + np.bincount(both >> 16, times, SIZE)
        sums /= n
        sums[SIZE - 3] = sum(map(eq, words, words[1:])) / n
        sums[SIZE - 2] = len(counts) / n
        at = np.flatnonzero(sums)
        return at, np.sqrt(sums[at])


@dataclass
class Model:
    """Shared weights and ordered thresholds; without labels every grade is the highest."""

    weights: list[float] | None = None
    thresholds: list[float] | None = None

    def tails(self, at: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 ... highest."""
        if self.weights is None:
            return np.ones(GRADES - 1)
        eta = float(values @ weights[at])
        return 1.0 / (1.0 + np.exp(np.clip(np.array(self.thresholds) - eta, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = 200) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam on the whole sample.

    Thresholds stay ordered because their gaps are fitted as exponentials. Grades that do
    not occur get no mass: their threshold joins its neighbour.
    """
    lengths = [len(at) for at, _ in rows]
    row = np.repeat(np.arange(len(rows)), lengths)
    at = np.concatenate([a for a, _ in rows])
    values = np.concatenate([v for _, v in rows])
    n = len(rows)
    below = np.clip([(np.sum(grades < j) + 0.5) / (n + 1) for j in range(1, GRADES)], 0.01, 0.99)
    first = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    p = np.concatenate([np.zeros(SIZE), first[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([p[SIZE : SIZE + 1], np.exp(p[SIZE + 1 :])]))
        eta = np.bincount(row, values * p[at], n)
        # cumulative probabilities with the open ends
        z = np.clip(cuts[None, :] - eta[:, None], -30, 30)
        cumulative = np.hstack([np.zeros((n, 1)), 1 / (1 + np.exp(-z)), np.ones((n, 1))])
        slope = cumulative * (1 - cumulative)
        hi, lo = grades + 1, grades
        i = np.arange(n)
        mass = np.maximum(cumulative[i, hi] - cumulative[i, lo], 1e-9)
        # the log likelihood by eta and by each cut
        by_eta = -(slope[i, hi] - slope[i, lo]) / mass
        by_cut = np.zeros((n, GRADES + 1))
        by_cut[i, hi] += slope[i, hi] / mass
        by_cut[i, lo] -= slope[i, lo] / mass
        by_cut = by_cut[:, 1:-1].mean(axis=0)
        up = np.bincount(at, values * by_eta[row], SIZE) / n - 1e-4 * p[:SIZE]
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([up, tail[:1], tail[1:] * np.exp(p[SIZE + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    cuts = np.cumsum(np.concatenate([p[SIZE : SIZE + 1], np.exp(p[SIZE + 1 :])]))
    return Model(p[:SIZE].round(5).tolist(), cuts.round(5).tolist())


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grade of a labelled row: 0 bad, 1 readable but toxic, 2 good. Null without a quality."""
    clean = (F.coalesce(F.col(toxic), F.lit(0)) == 0).cast("int")
    return F.when(F.col(quality) > 0, 1 + clean).when(F.col(quality) <= 0, 0)


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """The model of at most ``limit`` labelled rows; a model without weights if there are none."""
    texts = sampled_texts(docs, label_sample(labels, rating(), limit))

    def make():
        hasher = Hasher()
        return lambda text: tuple(x.tolist() for x in hasher(text))

    fields = [
        T.StructField("at", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.FloatType())),
    ]
    rows = map_rows(texts, ["text"], make, fields, ["doc_id", "label"]).orderBy("doc_id").collect()
    grades = np.array([min(r.label, GRADES - 1) for r in rows], dtype=int)
    if len(set(grades.tolist())) < 2:
        return Model()
    return fit([(np.array(r.at), np.array(r["values"])) for r in rows], grades)


def graded(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = NAMES) -> DataFrame:
    """The ``keep`` columns, ``expected_grade`` and ``p_select`` of every row.

    A null text counts as empty; rows repeat as they do in ``docs``.
    """

    def make():
        hasher = Hasher()
        weights = None if model.weights is None else np.array(model.weights)

        def step(text: str | None) -> tuple[float, float]:
            tails = model.tails(*hasher(text or ""), weights)
            return float(tails.sum()), float(tails[SELECT_GRADE - 1])

        return step

    return map_rows(docs, ["text"], make, [T.StructField(n, T.DoubleType()) for n in names], keep)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_select and selected of every document."""
    rows = graded(docs, learn(docs, labels), ["doc_id"])
    return rows.withColumn("selected", F.col("p_select") >= SELECT_PROBABILITY)


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are selected, with their own columns."""
    names = unused(docs, "expected_grade"), unused(docs, "p_select")
    rows = graded(docs, learn(docs, labels), docs.columns, names)
    return rows.filter(F.col(names[1]) >= SELECT_PROBABILITY).drop(*names)
