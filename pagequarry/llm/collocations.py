"""Collocations: frequent phrases by partitions (SON), scored by their weakest cut.

Words are counted first; those without the support begin, end or lie in no frequent phrase, so
texts are cut there (while the others fit a broadcast of ``AT_ONCE`` words; else shards go by their
own counts). Texts of a language are dealt at random into shards of some ``SHARD_BYTES``. A task
mines one shard completely, phrase length by phrase length: a phrase is looked for only where both phrases
within it that are one word shorter are frequent in the shard. A shard's support is the global
one lowered to its share of the language's bytes, s = floor((support - 1) * share) + 1. What is
frequent nowhere has at most the sum of all s - 1 places, which is less than the support, so the
union of the shards' phrases misses none. By the same count, phrases that cannot reach the support
with what the other shards may have kept back are left out of the union at once.

A second pass over the texts counts the union exactly, at most ``AT_ONCE`` candidates in a
broadcast; more of them take several passes, split by their first words so that each pass holds
all beginnings of its candidates. Scores and nesting are joins of the counted table with itself.

A null text is empty and a null language ``und``. Repeated rows count each. An empty table gives
no rows; extra columns do not matter. While a language has fewer shards than the support, a shard
asks for two places or more; beyond that it lists every phrase it holds, which stays exact but
moves about as many rows as there are words; larger shards (``shard_bytes``) defer that.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.components import Workspace

#: Bytes that end a piece (all become line ends), the tab, A-Z to a-z (fixed values).
CLEAN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "
)
SUPPORT, LONGEST, KEPT = 100, 5, 2000
SHARD_BYTES, AT_ONCE = 96 << 20, 2_000_000
#: Distinct words of a language that a counting task holds before it passes them on.
HELD = 1 << 18
#: Words that a task counts candidates in, at least, where there are more tasks than cores.
WORDS_IN_TASK = 1 << 26
#: Ids of the end of a piece and of nothing between two blanks.
END, NOTHING, NO_WORD = 0, 1, -2


def split_words(text: str) -> list[bytes]:
    """Words, line ends between pieces, and nothing between two blanks."""
    return text.encode().translate(CLEAN).replace(b"\n", b" \n ").split(b" ")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f: all words and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Tally] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, tally in held.items():
                del tally[b"\n"], tally[b""]
                columns = [
                    pa.array([lang] * len(tally), pa.string()),
                    pa.array([w.decode() for w in tally], pa.string()),
                    pa.array(list(tally.values()), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "f"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Tally()).update(split_words(text))
                if len(held[lang]) >= HELD:
                    yield from emit()
        yield from emit()

    return _texts(docs).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_ids(text: str, ids: dict[bytes, int]) -> np.ndarray:
    """Ids of a text's words, with ``END`` after each piece and for words that have none."""
    words = split_words(text)
    found = np.fromiter(map(ids.get, words, repeat(END)), np.int32, len(words))
    return np.append(found[found != NOTHING], np.int32(END))


class Ids(dict):
    """Numbers all words as they come."""

    def get(self, word: bytes, _: int) -> int:
        return self.setdefault(word, len(self))


def mined(words: np.ndarray, least: int, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first places, counts) of phrases of two words or more with ``least`` places in a shard.

    ``words`` has ``END`` after each piece. Only the places of frequent phrases are held, with the
    numbers of these phrases; two at adjoining places make a longer one.
    """
    counts = np.bincount(words, minlength=END + 1)
    counts[END] = 0
    frequent = counts >= least
    at = np.flatnonzero(frequent[words]).astype(np.int32)
    here = (np.cumsum(frequent, dtype=np.int32) - 1)[words[at]]
    for length in range(1, longest + 1):
        if length > 1:
            pairs = np.flatnonzero(at[1:] == at[:-1] + 1)
            keys = here[pairs] * np.int64(len(counts)) + here[pairs + 1]
            at = at[pairs]
            order = np.argsort(keys)
            keys = keys[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            counts = np.diff(np.append(starts, len(keys)))
            del keys
            frequent = counts >= least
            here = np.empty(len(order), np.int32)
            here[order] = np.repeat(np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32), counts)
            del order
            at, here = at[here >= 0], here[here >= 0]
        counts = counts[frequent]
        if length > 1:
            places = np.empty(len(counts), np.int64)
            places[here[::-1]] = at[::-1]
            yield length, places, counts


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """lang, text, and of its language all bytes; each shard's rows side by side in one partition."""
    rows = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("doc_id", "text").alias("h"),
    )
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    # one row per language
    dealt = rows.join(F.broadcast(sizes), "lang").withColumn("shard", F.pmod("h", F.ceil((F.col("bytes") + 1) / shard_bytes)))
    return dealt.drop("h").repartition("lang", "shard").sortWithinPartitions("lang", "shard")


def local_phrases(
    docs: DataFrame, support: int, shard_bytes: int, known: Broadcast | None = None, longest: int = LONGEST
) -> DataFrame:
    """lang, phrase, over: places beyond those that a shard would not have told of.

    A row without a phrase tells what a shard may keep back. ``known`` has the words of each
    language that are frequent everywhere together, as phrases have no others; without it a
    shard goes by its own words.
    """

    def _batch(lang, phrase, over) -> pa.RecordBatch:
        columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(over, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "over"])

    def numbers(lang: str) -> dict[bytes, int]:
        ids = Ids({b"\n": END, b"": NOTHING})
        if known is None:
            return ids
        for word in known.value.get(lang, ()):
            ids.get(word, END)
        return dict(ids)

    def mine(lang: str, all_bytes: int, size: int, ids: dict, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate(parts)
        parts.clear()
        names = list(ids)
        back = (support - 1) * size // max(all_bytes, 1)
        yield _batch([lang], [None], [back])
        for length, places, counts in mined(words, back + 1, longest):
            for k in range(0, len(places), 50_000):
                block = words[places[k : k + 50_000, None] + np.arange(length)].tolist()
                phrases = [b" ".join([names[w] for w in row]).decode() for row in block]
                yield _batch([lang] * len(phrases), phrases, counts[k : k + 50_000] - back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, size = None, {}, [], 0
        for batch in batches:
            for shard in zip(*(batch.column(c).to_pylist() for c in ("lang", "bytes", "shard", "text"))):
                text, shard = shard[-1], shard[:-1]
                if shard != now:
                    if now is not None:
                        yield from mine(now[0], now[1], size, ids, parts)
                    now, ids, parts, size = shard, numbers(shard[0]), [], 0
                parts.append(word_ids(text, ids))
                size += len(text.encode())
        if now is not None:
            yield from mine(now[0], now[1], size, ids, parts)

    return _shards(docs, shard_bytes).mapInArrow(run, "lang string, phrase string, over long")


def steps(phrases: dict[str, int]) -> tuple:
    """Of phrases and their ids: numbers of the words, and for each length ids and sorted steps.

    A step is a beginning's number and the word that follows it; all beginnings are among the phrases.
    """
    split = {p: p.split(" ") for p in phrases}
    number = {w: k for k, w in enumerate(sorted(p for p in phrases if len(split[p]) == 1))}
    words = {w.encode(): k for w, k in number.items()}
    levels, ids = [], [np.array([phrases[w] for w in number], np.int64)]
    for length in range(2, max(map(len, split.values()), default=1) + 1):
        now = [p for p, of in split.items() if len(of) == length]
        keys = [number[p[: -len(split[p][-1]) - 1]] * len(words) + words[split[p][-1].encode()] for p in now]
        order = np.argsort(np.array(keys, np.int64))
        levels.append(np.array(keys, np.int64)[order])
        ids.append(np.array([phrases[p] for p in now], np.int64)[order])
        number = {now[k]: n for n, k in enumerate(order.tolist())}
    return words, ids, levels


class Counter:
    """Counts given phrases in texts of one language by their steps."""

    def __init__(self, words: dict[bytes, int], ids: list[np.ndarray], levels: list[np.ndarray]) -> None:
        self.words, self.ids, self.levels = {**words, b"": NO_WORD}, ids, levels
        self.size = len(words)
        self.counts = [np.zeros(len(i), np.int64) for i in ids]

    def add(self, text: str) -> None:
        pieces = split_words(text)
        word = np.fromiter(map(self.words.get, pieces, repeat(-1)), np.int64, len(pieces))
        here = word = word[word != NO_WORD]
        for k, keys in enumerate(self.levels):
            here, following = here[:-1], word[k + 1 :]
            at = np.flatnonzero((here >= 0) & (following >= 0))
            wanted = here[at] * self.size + following[at]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
            hit = keys[place] == wanted if len(keys) else np.zeros(0, bool)
            here = np.full(len(here), -1, np.int64)
            here[at[hit]] = place[hit]
            self.counts[k + 1] += np.bincount(place[hit], minlength=len(keys))


def exact_counts(
    docs: DataFrame, candidates: DataFrame, space: Workspace, at_once: int, n_words: int
) -> DataFrame:
    """lang, phrase, f: all places of the candidates (id, lang, phrase), of two words or more, in the texts."""
    spark = docs.sparkSession
    rows = _texts(docs)
    # a task passes on up to all candidates, so it should count in much text
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_words // WORDS_IN_TASK))
    passes = -(-candidates.count() // at_once)
    part = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 1)), F.lit(max(passes, 1)))
    counted = None
    for k in range(passes):
        table = candidates.filter(part == k).select("lang", "phrase", "id").toArrow()
        by_lang: dict[str, dict[str, int]] = {}
        for lang, phrase, i in zip(*(table[c].to_pylist() for c in ("lang", "phrase", "id"))):
            by_lang.setdefault(lang, {})[phrase] = i
        for phrases in by_lang.values():
            for w in {w for p in phrases for w in p.split(" ")} - phrases.keys():
                phrases[w] = -1
        sent = spark.sparkContext.broadcast({lang: steps(p) for lang, p in by_lang.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counters = {lang: Counter(*x) for lang, x in sent.value.items()}
            for batch in batches:
                # texts of a language are counted together, as arrays pay off when long
                held: dict[str, list[str]] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    if lang in counters:
                        held.setdefault(lang, []).append(text)
                for lang, texts in held.items():
                    counters[lang].add("\n".join(texts))
            for c in counters.values():
                for ids, counts in zip(c.ids, c.counts):
                    some = (counts > 0) & (ids >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some])], ["id", "f"])

        one = space.keep(rows.coalesce(tasks).mapInArrow(run, "id long, f long").groupBy("id").agg(F.sum("f").alias("f")), "counts")
        counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        return candidates.select("lang", "phrase", F.lit(0).cast("long").alias("f"))
    return candidates.join(counted, "id").select("lang", "phrase", "f")


def frequent_phrases(
    docs: DataFrame,
    space: Workspace,
    support: int = SUPPORT,
    shard_bytes: int = SHARD_BYTES,
    at_once: int = AT_ONCE,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to ``LONGEST`` words with the support, and (lang, n)."""
    words = space.keep(word_counts(docs), "words")
    totals = space.keep(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = words.filter(F.col("f") >= support)
    known = None
    if frequent.count() <= at_once:
        by_lang: dict[str, list[bytes]] = {}
        table = frequent.select("lang", "word").toArrow()
        for lang, word in zip(table["lang"].to_pylist(), table["word"].to_pylist()):
            by_lang.setdefault(lang, []).append(word.encode())
        known = docs.sparkSession.sparkContext.broadcast(by_lang)
    local = space.keep(local_phrases(docs, support, shard_bytes, known), "local")
    back = local.filter("phrase IS NULL").groupBy("lang").agg(F.sum("over").alias("back"))
    told = local.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("over").alias("over"))
    possible = told.join(F.broadcast(back), "lang").filter(F.col("back") + F.col("over") >= support)
    candidates = space.keep(possible.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase"), "candidates")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    counted = exact_counts(docs, candidates, space, at_once, n_words).filter(F.col("f") >= support)
    return space.keep(frequent.withColumnRenamed("word", "phrase").unionByName(counted), "frequent"), totals


def collocations(docs: DataFrame, support: int = SUPPORT, kept: int = KEPT, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``kept`` phrases of each language."""
    space = Workspace(docs.sparkSession, "collocations")
    frequent, totals = frequent_phrases(docs, space, support, **sizes)
    words = F.split("phrase", " ")
    long = frequent.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).filter(F.size("words") > 1)
    # a phrase that lies in one of any length with as many places also lies in one a word longer
    within = (
        long.filter(F.size("words") > 2)
        .select("lang", F.col("a").alias("longer"), F.explode(F.array(
            F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "),
            F.array_join(F.slice("words", F.lit(2), F.size("words") - 1), " "),
        )).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    cuts = long.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
    )
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = "decimal(19,0)"
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(F.broadcast(totals), "lang").withColumn(
        "score", F.expr(f"(cast(1000 * a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    )
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    alone = weakest.join(within, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < cut.a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("cut.a"), "phrase")
    return (
        alone.withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= kept)
        .select("lang", "rank", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    )


ORACLE = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts
), spaced AS (
  SELECT lang, row_number() OVER () AS id, string_split(trim(regexp_replace(piece, '[\\x20\\x09]+', ' ', 'g')), ' ') AS words
  FROM pieces
), words AS (
  SELECT lang, id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM spaced WHERE words <> ['']
), phrases AS (
  SELECT lang, w AS p1, p1 || ' ' || lead(w, 1) OVER o AS p2, p2 || ' ' || lead(w, 2) OVER o AS p3,
         p3 || ' ' || lead(w, 3) OVER o AS p4, p4 || ' ' || lead(w, 4) OVER o AS p5
  FROM words WINDOW o AS (PARTITION BY id ORDER BY i)
), counted AS (
  SELECT lang, 1 AS size, p1 AS phrase, count(*) AS f FROM phrases GROUP BY ALL
  UNION ALL SELECT lang, 2, p2, count(*) FROM phrases WHERE p2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, p3, count(*) FROM phrases WHERE p3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, p4, count(*) FROM phrases WHERE p4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 5, p5, count(*) FROM phrases WHERE p5 IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang
), frequent AS MATERIALIZED (
  SELECT * FROM counted WHERE f >= {SUPPORT}
), candidates AS MATERIALIZED (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM frequent WHERE size > 1
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1 : size], ' ') AS rest
  FROM candidates, unnest(range(1, size)) AS ks(k)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
         ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.first
  JOIN frequent y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), alone AS (
  SELECT * FROM weakest w WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = w.lang AND len(c.phrase) > len(w.phrase) AND 100 * c.a >= 100 * w.a
    AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' '))
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM alone
) WHERE rank <= {KEPT}
"""
