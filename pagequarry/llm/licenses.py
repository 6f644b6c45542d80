"""License scans: short notices found with a bounded number of edits.

A notice that occurs with at most k edits holds at least one of its k + 1 pieces unchanged
(pigeonhole). All pieces of all notices are searched in one pass (Aho-Corasick); around every
piece that occurs the ``regex`` library matches the whole notice with at most k errors, and
reports its span and edits. Besides, the base phrases are counted where their words stand
consecutively.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import ASCII_LOWER, WORD, map_rows

#: Base phrases, and notices by label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license, version 2.0"),
    ("apache", "apache license, version 2.0"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "licensed under the bsd license"),
    ("cc-by", "creative commons attribution 4.0 international"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "gnu general public license, version 3"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mpl", "mozilla public license, version 2.0"),
    ("proprietary", "proprietary and confidential"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: One edit for so many characters of a notice.
CHARACTERS_PER_EDIT = 12

_WORD = re.compile(WORD)
_PHRASES = [(tuple(p.split()), label) for p, label in BASE.items()]


def edits(notice: str) -> int:
    return max(1, len(notice) // CHARACTERS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """Offset and text of the notice's k + 1 pieces, of nearly equal length."""
    n = edits(notice) + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds notices and base phrases in one text."""

    def __init__(self, notices: list[tuple[str, str]] = NOTICES) -> None:
        self.notices = notices
        self.patterns = [
            regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={edits(n)}}}") for _, n in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (_, notice) in enumerate(notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By notice, the stretches of text that may hold it; overlapping ones are joined."""
        found: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.seeds.iter(text):
            for k, offset in uses:
                notice = self.notices[k][1]
                start = max(0, last + 1 - size - offset - edits(notice))
                end = last + 1 - size - offset + len(notice) + edits(notice)
                found.setdefault(k, []).append([start, min(end, len(text))])
        for k, spans in found.items():
            joined: list[list[int]] = []
            for start, end in sorted(spans):
                if joined and start <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], end)
                else:
                    joined.append([start, end])
            found[k] = joined
        return found

    def notices_in(self, lower: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of every notice, in order of place.

        A notice that overlaps a kept one with fewer edits is left out.
        """
        out = set()
        for k, spans in self.windows(lower).items():
            label, notice = self.notices[k]
            shortest, todo = len(notice) - edits(notice), list(spans)
            while todo:  # the pattern gives the best match of a stretch; others are on both sides of it
                start, end = todo.pop()
                if end - start >= shortest and (m := self.patterns[k].search(lower, start, end)):
                    out.add((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                    todo += [(start, m.start()), (m.end(), end)]
        kept: list[tuple[str, int, int, int]] = []
        for least in sorted({x[3] for x in out}):
            # what is kept so far as disjoint stretches
            starts, ends = [], []
            for _, start, end, _ in sorted(kept, key=lambda x: x[1]):
                if ends and start < ends[-1]:
                    ends[-1] = max(ends[-1], end)
                else:
                    starts.append(start)
                    ends.append(end)
            for x in (x for x in out if x[3] == least):
                before = bisect_left(starts, x[2]) - 1  # the last one that begins before the end of x
                if before < 0 or ends[before] <= x[1]:
                    kept.append(x)
        return sorted(kept, key=lambda x: (x[1], x[2], x[0], x[3]))

    def base(self, words: list[str]) -> list[tuple[int, str]]:
        """Place and label of every base phrase."""
        out = []
        at = -1
        while True:
            try:
                at = words.index("license", at + 1)
            except ValueError:
                return sorted(out)
            for phrase, label in _PHRASES:
                start = at - len(phrase) + 1
                if start >= 0 and tuple(words[start : at + 1]) == phrase:
                    out.append((start, label))

    def __call__(self, text: str | None) -> tuple:
        lower = (text or "").translate(ASCII_LOWER) if not (text or "").isascii() else (text or "").lower()
        words = _WORD.findall(lower)
        base = self.base(words) if "license" in lower else []
        notices = self.notices_in(lower)
        labels = {label for _, label in base}
        best = max((1 - e / (2 * CHARACTERS_PER_EDIT) for _, _, _, e in notices), default=0.0)
        return (
            len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted(labels)), ",".join(sorted(labels | {n[0] for n in notices})),
            1.0 if base else max(0.0, best),
            [{"label": l, "start": s, "end": t, "edits": e} for l, s, t, e in notices],
        )


_SPAN = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
     T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]
)
_FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("notices", T.ArrayType(_SPAN)),
]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, counts of base phrases, labels, score and the notices' spans.

    A null text counts as empty: no words, no labels, score 0. Rows repeat as in ``docs``.
    Spans are in characters of the text.
    """
    return map_rows(docs, [text], Scanner, _FIELDS, keep)


def licenses(docs: DataFrame) -> DataFrame:
    """What the scan finds in every document, spans as their number."""
    rows = scan(docs, ["doc_id"])
    return rows.withColumn("notices", F.size("notices").cast("long")).withColumnRenamed("notices", "n_notices")
