"""Toxicity by a lexicon trie crossed with Levenshtein automata, in context.

Every distinct word of a text is run through one automaton: the lexicon's trie crossed with
a Levenshtein automaton whose states say how many edits were spent where. It is made
deterministic as it is used, and most words leave it after three or four letters. Matches
are then weighed by the words around them: inside quotation marks or after words of
reporting they count as quoted, next to words of address they count as aimed at someone. A
small logistic model over these counts gives the score.

The lexicon has fixed terms and terms learned from labelled texts: words and word stems much
commoner in toxic texts. Learning uses a bounded sample of labelled rows (``LABELLED``); half
of it finds the terms, the other half fits the weights, so that the weights know how far
learned terms can be trusted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import (
    flat_map_rows,
    label_sample,
    map_rows,
    remainder,
    sampled_texts,
    unused,
)

#: Abusive terms, words that report speech, words that address someone.
TERMS = (
    "asshole", "bastard", "bitch", "clown", "coward", "cretin", "cunt", "degenerate",
    "despicable", "disgusting", "dumbass", "faggot", "filth", "fuck", "fucking", "idiot",
    "imbecile", "jerk", "loser", "moron", "nigger", "parasite", "pathetic", "pig", "retard",
    "scum", "scumbag", "shit", "slut", "stupid", "subhuman", "trash", "vermin", "whore",
    "worthless",
)
REPORTING = frozenset(
    "said says say wrote writes written called calls quote quoted quotes term word words "
    "insult insults slur slurs definition defined meaning dictionary reported alleged".split()
)
ADDRESS = frozenset("you your youre yourself u ur he she they these those".split())
LEET = str.maketrans("013457@$", "oieastas")
_LEET = frozenset("013457@$")

#: Most labelled rows learned from; they are the smallest ids by a fixed hash.
LABELLED = 16_000
#: Most learned terms; least number of toxic texts that hold one, least log odds, and least
#: surplus of toxic texts over those expected, in standard deviations.
LEARNED, LEAST_TEXTS, LEAST_ODDS, LEAST_SURPLUS = 1_000, 3, 1.0, 4.0
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
WINDOW = 6

_TOKEN = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")
_QUOTES = re.compile(r"[\"“”„«»]")
#: Weights without any labels: bias, aimed, plain, quoted, misspelled, learned, density.
PRIOR = np.array([-4.0, 3.5, 3.0, 0.3, 1.0, 2.0, 2.0, 0.5])


def edits_allowed(term: str) -> int:
    """No edit for short terms, one from five letters on, two from nine on."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """The trie of the terms, crossed with Levenshtein automata, determinised lazily.

    The first letter takes no edits, as misspellings nearly always keep it.
    """

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget: list[int] = [0]
        for term in terms:
            at, allowed = 0, edits_allowed(term)
            for letter in term:
                self.budget[at] = max(self.budget[at], allowed)
                nxt = self.children[at].get(letter)
                if nxt is None:
                    nxt = self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                at = nxt
            self.term[at] = term
            self.budget[at] = max(self.budget[at], allowed)
        start = self._closed({0: 0})
        self.states = {start: 0}
        self.members = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.accepts = [self._accepted(start)]

    def _closed(self, spent: dict[int, int]) -> tuple[tuple[int, int], ...]:
        """Add what skipping letters of a term reaches; keep the fewest edits per node."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            if not node:
                continue
            e = spent[node] + 1
            for nxt in self.children[node].values():
                if e <= self.budget[nxt] and e < spent.get(nxt, 9):
                    spent[nxt] = e
                    todo.append(nxt)
        return tuple(sorted(spent.items()))

    def _accepted(self, state: tuple[tuple[int, int], ...]) -> tuple[str, int] | None:
        found = [
            (e, self.term[n])
            for n, e in state
            if self.term[n] is not None and e <= edits_allowed(self.term[n])
        ]
        return (min(found)[1], min(found)[0]) if found else None

    def _step(self, state: int, letter: str) -> int:
        spent: dict[int, int] = {}
        for node, e in self.members[state]:
            for l, nxt in self.children[node].items():
                if not node and l != letter:
                    continue
                cost = e + (l != letter)
                if cost <= self.budget[nxt] and cost < spent.get(nxt, 9):
                    spent[nxt] = cost
            if node and e + 1 <= self.budget[node] and e + 1 < spent.get(node, 9):
                spent[node] = e + 1
        members = self._closed(spent)
        known = self.states.get(members)
        if known is None:
            known = self.states[members] = len(self.members)
            self.members.append(members)
            self.moves.append({})
            self.accepts.append(self._accepted(members))
        self.moves[state][letter] = known
        return known

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, and the number of edits."""
        state = 0
        for letter in word:
            nxt = self.moves[state].get(letter)
            state = self._step(state, letter) if nxt is None else nxt
            if not self.members[state]:
                return None
        return self.accepts[state]


@dataclass
class Model:
    """What scoring needs: learned words and stems, weights, and harmless words near a term."""

    words: dict[str, float] = field(default_factory=dict)
    harmless: list[str] = field(default_factory=list)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: PRIOR.tolist())


class Scorer:
    """Counts and score of one text. A word's match is remembered up to a bounded number."""

    REMEMBERED = 300_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.lexicon = Lexicon(list(TERMS))
        self.hits: dict[str, tuple[str, float]] = {}
        self.near: set[str] = set()
        self.others: set[str] = set(model.harmless)
        self.heads = {s[: STEMS[0]] for s in model.stems}
        self.weights = np.array(model.weights)

    def look_up(self, word: str) -> tuple[str, float] | None:
        """(kind, weight): kind is term, misspelled or learned."""
        near = self.lexicon.match(word)
        if near and near[1] == 0:
            return ("term", 1.0)
        if not near and not _LEET.isdisjoint(word):
            near = self.lexicon.match(word.translate(LEET))
        if near:
            return ("misspelled", 1.0)
        weight = self.model.words.get(word, 0.0)
        if word[: STEMS[0]] in self.heads:
            stems = (self.model.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)
            weight = max([weight, *stems])
        return ("learned", weight) if weight else None

    def remember(self, words: set[str]) -> None:
        if len(self.others) + len(self.hits) >= self.REMEMBERED:
            self.others, self.hits, self.near = set(self.model.harmless), {}, set()
        for word in words.difference(self.others).difference(self.near):
            hit = self.look_up(word)
            if hit:
                self.hits[word] = hit
                self.near.add(word)
            else:
                self.others.add(word)

    def matches(self, text: str) -> tuple[int, list[tuple]]:
        """Number of words, and for every match: word, position, kind, weight, context."""
        lower = text.lower()
        tokens = _TOKEN.findall(lower)
        words = set(tokens)
        self.remember(words)
        found = {w: self.hits[w] for w in words & self.near}
        if not found:
            return len(tokens), []
        out, marks, last = [], 0, 0
        for p, m in enumerate(_TOKEN.finditer(lower)):
            hit = found.get(m.group())
            if hit:
                line = lower.rfind("\n", last, m.start())
                if line >= 0:  # a quotation ends with its line at the latest
                    marks, last = 0, line
                marks += len(_QUOTES.findall(lower, last, m.start()))
                last = m.start()
                around = tokens[max(0, p - WINDOW) : p]
                if marks % 2 or not REPORTING.isdisjoint(around):
                    context = "quoted"
                elif not ADDRESS.isdisjoint(around[-3:]):
                    context = "aimed"
                else:
                    context = "plain"
                out.append((m.group(), p, *hit, context))
        return len(tokens), out

    def features(self, n: int, found: list[tuple]) -> np.ndarray:
        """Features of a text of ``n`` words with these matches."""
        counts = Counter()
        for _, _, kind, weight, context in found:
            if kind == "term":
                counts[context] += 1
            elif context != "quoted":
                counts[kind] += weight if kind == "learned" else 1
            else:
                counts["quoted"] += 1
        strong = counts["aimed"] + counts["plain"] + counts["learned"]
        return np.array(
            [1.0, *(math.log1p(counts[k]) for k in ("aimed", "plain", "quoted", "misspelled", "learned")),
             math.log1p(100.0 * strong / max(n, 20)), float(strong > 1)]
        )

    def score(self, n: int, found: list[tuple]) -> float:
        z = float(self.features(n, found) @ self.weights)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the logistic loss, drawn towards ``prior``."""
    w = prior.astype(float).copy()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _term_counter():
    scorer = Scorer(Model())

    def count(text: str, label: int) -> list[tuple[str, str, int, int]]:
        """Distinct words of a text: those near a term, and the others with their stems."""
        n, found = scorer.matches(text)
        hits = {w: kind for w, _, kind, _, _ in found}
        words = set(_TOKEN.findall(text.lower())).difference(hits)
        stems = {w[:n] for w in words for n in STEMS if len(w) > n}
        rows = [("near", w) for w, kind in hits.items() if kind == "misspelled"]
        rows += [("word", w) for w in words] + [("stem", s) for s in stems]
        return [(*r, int(label == 1), int(label != 1)) for r in rows]

    return count


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """Terms and weights from at most ``limit`` labelled rows outside the held-out quarter."""
    sample = label_sample(labels, F.col("toxic"), limit, remainder("doc_id", 4) != 2)
    texts = sampled_texts(docs, sample).withColumn("half", remainder("doc_id", 2))
    size = {
        (r.half, r.toxic): r.n
        for r in texts.groupBy("half", (F.col("label") == 1).alias("toxic"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    n_toxic, n_clean = size.get((0, True), 0), size.get((0, False), 0)
    model = Model()
    if not sum(size.get((h, True), 0) for h in (0, 1)):
        return model
    counted = flat_map_rows(
        texts.filter("half = 0"),
        ["text", "label"],
        _term_counter,
        [T.StructField("kind", T.StringType()), T.StructField("term", T.StringType()),
         T.StructField("toxic", T.IntegerType()), T.StructField("clean", T.IntegerType())],
    )
    odds = F.log(
        ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    )
    summed = counted.groupBy("kind", "term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    # how far a term's toxic texts exceed what their share would make of all its texts
    expected = (F.col("toxic") + F.col("clean")) * (n_toxic / max(1, n_toxic + n_clean))
    surplus = (F.col("toxic") - expected) / F.sqrt(expected + 0.5)
    weighed = summed.withColumns({"odds": odds, "surplus": surplus})
    toxic = (F.col("toxic") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)
    toxic &= F.col("surplus") >= LEAST_SURPLUS
    terms = weighed.filter((F.col("kind") != "near") & toxic)
    harmless = weighed.filter((F.col("kind") == "near") & (F.col("clean") > 0) & ~toxic)
    for r in terms.orderBy(F.desc("surplus"), "kind", "term").limit(LEARNED).collect():
        weights = model.words if r.kind == "word" else model.stems
        weights[r.term] = round(min(r.odds / 3, 1.5), 4)
    model.harmless = [r.term for r in harmless.orderBy(F.desc("clean"), "term").limit(LEARNED).collect()]
    rows = map_rows(
        texts.filter("half = 1"),
        ["text"],
        lambda: (lambda s: lambda text: (s.features(*s.matches(text)).tolist(),))(Scorer(model)),
        [T.StructField("x", T.ArrayType(T.DoubleType()))],
        keep=["label"],
    ).collect()
    if any(r.label == 1 for r in rows):
        x = np.array([r.x for r in rows])
        y = np.array([float(r.label == 1) for r in rows])
        model.weights = fit_logistic(x, y, PRIOR).round(6).tolist()
    return model


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``score`` and ``matches`` of every row.

    A null text counts as empty; an empty text has no matches and the score of the bias.
    Rows repeat as they do in ``docs``.
    """

    def make():
        scorer = Scorer(model)

        def step(value: str | None) -> tuple:
            n, found = scorer.matches(value or "")
            return scorer.score(n, found), [
                {"word": w, "position": p, "kind": k, "context": c} for w, p, k, _, c in found
            ]

        return step

    match = T.StructType(
        [T.StructField("word", T.StringType()), T.StructField("position", T.LongType()),
         T.StructField("kind", T.StringType()), T.StructField("context", T.StringType())]
    )
    fields = [T.StructField("score", T.DoubleType()), T.StructField("matches", T.ArrayType(match))]
    return map_rows(docs, [text], make, fields, keep)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches, n_quoted of every document."""
    model = learn(docs, labels)
    rows = scored(docs, model, ["doc_id"])
    return rows.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("matches").cast("long").alias("n_matches"),
        F.size(F.filter("matches", lambda m: m["context"] == "quoted")).cast("long").alias("n_quoted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their own columns."""
    private = unused(docs, "toxicity")
    model = learn(docs, labels)

    def make():
        scorer = Scorer(model)
        return lambda value: (scorer.score(*scorer.matches(value or "")),)

    rows = map_rows(docs, ["text"], make, [T.StructField(private, T.DoubleType())], docs.columns)
    return rows.filter(F.col(private) < THRESHOLD).drop(private)
