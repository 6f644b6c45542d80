"""Byte-level BPE: ranked merges over the bytes of distinct words, decoding by joined pieces.

Texts are split by the tokenizer's pattern in one pass without an exchange; a task merges each
distinct word it meets once and remembers its ids (``REMEMBERED`` words at most, then it begins
anew). Words that are tokens as they stand have their rank as id. There are two forms of the
merges, with the same ids, both over a literal map of ranks:

* folded in Spark's higher-order functions (``native=True``, the default): the task numbers its
  words and puts the bytes of each new one into a row ahead of the texts that use it; the fold keeps a
  word's ids and the ranks of its neighbouring pairs, and each step merges the leftmost pair of least
  rank and looks up the two pairs that this makes; then the ids are put in the place of the numbers.
  The fold is quadratic in a word's length, so words of more than ``LONG`` bytes take the heap, as
  do all words of vocabularies of more than 2**17 tokens, for which its numbers have no room.
* in the task, by a heap of pairs (``native=False``).

Spark interprets expressions inside higher-order functions, so the fold costs several times the
heap; the README has the figures. All texts are split by the same regular
expressions, so a word's ids do not depend on its neighbours. Decoding looks up the bytes of every
id and joins them, in Spark expressions.

A null or empty text has no ids. Repeated rows count each, and clashing columns do not matter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagequarry.session import bound_batches

#: Longer words (in bytes) are merged by a heap.
LONG = 1024
#: From so many tokens on, a step of the fold cuts the tokens instead of going over all.
SHORT = 32
#: Distinct words a task holds, pieces between spaces, and words it puts in one row.
REMEMBERED, PIECES, WORDS_IN_ROW = 1 << 19, 1 << 17, 2048
#: Texts taken in or handed on together.
TEXTS = 512


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, which are their ids, and the pattern that splits texts."""

    ranks: dict[bytes, int]
    pattern: str

    def pairs(self) -> dict[tuple[int, int], int]:
        """Every pair of tokens whose bytes together are a token."""
        found = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    found[left, right] = rank
        return found

    def splitter(self) -> Callable[[str], list[str]]:
        """Splits a text into words. The library's \\s also knows the separators 1C to 1F, the tokenizer's does not."""
        pattern = self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        return regex.compile(pattern).findall


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """From lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        lines = [line.split() for line in f if line.strip()]
    return Vocabulary({base64.b64decode(a): int(b) for a, b in lines}, pattern)


def _literal(spark: SparkSession, **columns: pa.Array) -> Column:
    """One struct of arrays, binary ones as strings of these bytes, as a scalar subquery, which is a literal when the query runs.

    It has to be added to a table as a column first (``withColumn``), because subqueries must
    not stand within higher-order functions; a column used once is put in its place.
    """
    one = pa.table({k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in columns.items()})
    given = [F.col(k).cast("array<string>").alias(k) if pa.types.is_binary(v.type) else k for k, v in columns.items()]
    return spark.createDataFrame(one).select(F.struct(*given).alias("x")).scalar()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(pairs: dict[tuple[int, int], int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of left tokens and one table: a pair's entry stands at its left token's offset plus the right token.

    An entry is left token and rank; free ones have a left token that no pair has.
    """
    rights: dict[int, list[int]] = {}
    for left, right in pairs:
        rights.setdefault(left, []).append(right)
    tokens, size = 1 << bits, 1 << bits + 4
    while True:
        offsets = np.zeros(tokens, np.int64)
        entries = np.full(size + tokens, tokens - 2 << bits, np.int64)
        used = np.zeros(size + tokens, bool)
        for left, row in sorted(rights.items(), key=lambda x: (-len(x[1]), x[0])):
            row = np.array(row)
            first = left * 2654435761 % size
            for at in range(first, first + size, 64):
                tried = (at + np.arange(64)) % size
                good = tried[~used[tried[:, None] + row].any(axis=1)]
                if len(good):
                    break
            else:
                break
            at = offsets[left] = good[0]
            used[at + row] = True
            entries[at + row] = [(left << bits) + pairs[left, r] for r in row.tolist()]
        else:
            return offsets, entries
        size *= 2  # rows do not fit between each other


class Encoder:
    """Expressions over the literal tables of a vocabulary."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary) -> None:
        self.spark, self.vocabulary = spark, vocabulary
        size = max(vocabulary.ranks.values()) + 1
        #: Bits of a token or rank, and of the byte at which a token starts; the largest token is the edge of a word.
        self.bits, self.starts = (size + 1).bit_length(), (LONG + 2).bit_length()
        pieces: list[bytes | None] = [None] * size
        for token, rank in vocabulary.ranks.items():
            pieces[rank] = token
        self.pieces = _literal(spark, pieces=pa.array(pieces, pa.binary()))

    @property
    def foldable(self) -> bool:
        """Whether a number of the fold has room for the tokens."""
        return 3 * self.bits + self.starts < 63

    @cached_property
    def tables(self) -> Column:
        ranks, bits, low = self.vocabulary.ranks, self.bits, self.bits + self.starts
        edge = (1 << bits) - 1
        offsets, entries = _placed(self.vocabulary.pairs(), bits)
        singles = [ranks[bytes([b])] for b in range(256)]
        none = edge << bits + low
        first = [none if (r := ranks.get(bytes([a, b]))) is None else r << low for a in range(256) for b in range(256)]
        first = [x + singles[k >> 8] for k, x in enumerate(first)] + [none + x for x in singles] + [none + edge]
        return _literal(
            self.spark,
            offsets=pa.array(offsets, pa.int32()),
            entries=pa.array(entries << low, pa.int64()),
            first=pa.array(first, pa.int64()),
        )

    def fold(self, t: Column, word: Column) -> Column:
        """Ids of one word of at most ``LONG`` bytes: all ranked merges folded over its bytes.

        The word comes as ``byte_pairs`` has it. The fold's state has one number for each token, and one for the
        edge on either side: what the table's entry for it and the next token differs in from one of
        its own, the rank of the pair that they make, the byte it starts at, its id. So the least number is the
        leftmost pair of least rank, and pairs that do not merge are larger than all that do.
        """
        bits, low = self.bits, self.bits + self.starts
        token, start = F.lit((1 << bits) - 1), F.lit((1 << low) - (1 << bits))

        def pair(left: Column, right: Column) -> Column:
            at = F.get(t["offsets"], left.cast("int")) + right
            return F.get(t["entries"], at.cast("int"))

        def merge(s: Column, k: Column) -> Column:
            least, left = F.get(s, k), F.get(s, k - 1)
            m, of = F.shiftright(least, low), left.bitwiseAND(token)
            following = pair(m, F.get(s, k + 2).bitwiseAND(token))
            # (left << bits + low) ^ left in one product
            made = following.bitwiseXOR(m * ((1 << bits + low) + 1)).bitwiseXOR(least.bitwiseAND(start))
            ahead = pair(of, m).bitwiseXOR(of * ((1 << bits + low) + 1)).bitwiseXOR(left.bitwiseAND(start))
            # cutting has a high cost of its own, going over all numbers one for each
            put = F.transform(
                s, lambda x, i: F.when(i == k, made).when(i == k - 1, ahead).when(i == k + 1, F.lit(None)).otherwise(x)
            )
            cut = F.flatten(F.array(F.slice(s, 1, k - 1), F.array(ahead, made), F.slice(s, k + 3, LONG + 2)))
            return F.when(F.size(s) < SHORT, F.filter(put, F.isnotnull)).otherwise(cut)

        def step(s: Column) -> Column:
            least = F.array_min(s)
            at = (F.array_position(s, least) - 1).cast("int")
            return F.when(least >= 1 << bits + low, s).otherwise(_let(at, lambda k: merge(s, k)))

        begun = F.transform(word, lambda c, i: F.get(t["first"], c) + i * (1 << bits))
        return F.aggregate(
            F.slice(word, 4, LONG),
            begun,
            lambda s, _: step(s),
            lambda s: F.transform(F.slice(s, 2, F.size(s) - 2), lambda x: x.bitwiseAND(token).cast("int")),
        )

    def decode(self, encoded: DataFrame, ids: str = "ids", out: str = "bytes") -> DataFrame:
        """``encoded`` with the bytes of its ids: their binary pieces joined."""
        made = _let(
            F.col("__pieces"),
            lambda p: F.array_join(
                F.transform(F.col(ids), lambda i: F.get(p["pieces"], i)), ""
            ),
        )
        tables = encoded.select("*", self.pieces.alias("__pieces"))
        return tables.select(*encoded.columns, made.cast("binary").alias(out))


def byte_pairs(words: list[str]) -> pa.ListArray:
    """Every word's bytes, each with the one after it; the last has none, and on either side is the edge."""
    coded = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in coded], dtype=np.int64)
    codes = np.frombuffer(b"".join(coded), np.uint8).astype(np.int32)
    pairs = codes * 256 + np.append(codes[1:], np.int32(0))[: len(codes)]
    pairs[ends - 1] = 65536 + codes[ends - 1]
    edge = 65536 + 256
    starts = ends - np.diff(ends, prepend=0)
    pairs = np.insert(pairs, np.concatenate([starts, ends]), edge)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + 2 * np.arange(1, len(words) + 1)]), pa.int32()), pa.array(pairs))


def encode_word(word: bytes, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ids of a word of any length: pairs in a heap, tokens in a linked list."""
    ids = [ranks[bytes([b])] for b in word]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := pairs.get((ids[k], ids[k + 1])))
            is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, left, right = heapq.heappop(heap)
        j = after[k]
        if ids[k] != left or j >= n or ids[j] != right:
            continue
        ids[k], ids[j] = rank, -1
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if (r := pairs.get((rank, ids[after[k]]))) is not None:
                heapq.heappush(heap, (r, k, rank, ids[after[k]]))
        if (p := before[k]) >= 0 and (r := pairs.get((ids[p], rank))) is not None:
            heapq.heappush(heap, (r, p, ids[p], rank))
    return [i for i in ids if i >= 0]


#: Stands for the words of a piece that cannot be split by itself.
NO_CUT = False


class Numberer:
    """Texts as numbers of words, and the new words among them.

    Patterns of this kind cut a text before a plain space or line end that follows no white space,
    so pieces between these are split once and remembered; where white space stands beside them
    the whole text is split. A word that is a token has its id as number, one of more than
    ``longest`` bytes those of its tokens; others are numbered from ``first`` on.
    """

    def __init__(self, vocabulary: Vocabulary, longest: int) -> None:
        self.vocabulary, self.longest = vocabulary, longest
        self.split, self.ranks = vocabulary.splitter(), vocabulary.ranks
        self.first = max(vocabulary.ranks.values()) + 1
        self.forget()

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """Only words that the heap merges need them."""
        return self.vocabulary.pairs()

    def forget(self) -> None:
        self.numbers: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | bool] = {}
        self.next, self.new = self.first, []

    def make_room(self) -> bool:
        """Pieces are forgotten by themselves, as their words keep their numbers; whether those went, too."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
            return True
        if len(self.pieces) > PIECES:
            self.pieces = {}
        return False

    def number(self, word: str) -> bytes:
        made = self.numbers.get(word)
        if made is None:
            of = word.encode()
            at = self.ranks.get(of)
            if at is not None:
                made = at.to_bytes(4, "little")
            elif len(of) > self.longest:
                made = np.array(encode_word(of, self.ranks, self.pairs), "<u4").tobytes()
                if len(of) > LONG:
                    return made
            else:
                made = self.next.to_bytes(4, "little")
                self.next += 1
                self.new.append(word)
            self.numbers[word] = made
        return made

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.number, self.split(text)))

    def piece(self, piece: str) -> bytes | bool:
        """Of what follows a space, or begins with a line end."""
        if not piece or piece[-1].isspace():
            made = NO_CUT
        else:
            made = self.whole(piece if piece[0] == "\n" else " " + piece)
        self.pieces[piece] = made
        return made

    def __call__(self, text: str) -> bytes:
        first, *pieces = text.replace("\n", " \n").split(" ")
        if pieces and (not first or first[-1].isspace()):
            return self.whole(text)
        found = list(map(self.pieces.get, pieces))
        if None in found:
            known, piece = self.pieces.get, self.piece
            for k, x in enumerate(found):
                if x is None:
                    x = known(pieces[k])  # it may have come up a moment ago
                    found[k] = piece(pieces[k]) if x is None else x
        if NO_CUT in found:
            return self.whole(text)
        return self.whole(first) + b"".join(found)


_NUMBERED = [
    T.StructField("numbers", T.BinaryType()),
    T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("begin", T.BooleanType()),
]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(k, TEXTS) for k in range(0, batch.num_rows, TEXTS))


def _numbered(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str) -> DataFrame:
    """The ``keep`` columns and the ``numbers`` of every text's words; ahead of them rows of new ``words``.

    ``begin`` marks a row of words from which on numbers are given anew.
    """
    slim = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    kept = [slim.schema[c] for c in keep]
    schema = T.StructType([*kept, *_NUMBERED])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numberer, begin = Numberer(vocabulary, LONG), True
        for batch in _slices(batches):
            texts, start = batch.column("__text").to_pylist(), 0
            while start < len(texts):
                begin |= numberer.make_room()
                coded, end = [], start
                while end < len(texts) and len(numberer.new) < WORDS_IN_ROW * 16:
                    coded.append(numberer(texts[end]))
                    end += 1
                new, numberer.new = numberer.new, []
                rows = [*range(0, len(new), WORDS_IN_ROW), len(new)] if new else [0, 0]
                first = [begin and k == 0 for k in range(len(rows) - 1)]
                begin = False
                nothing = [pa.nulls(len(first), f.type) for f in arrow][: len(keep)]
                words = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), byte_pairs(new))
                made = [pa.nulls(len(first), pa.binary()), words, pa.array(first)]
                yield pa.RecordBatch.from_arrays([*nothing, *made], schema=arrow)
                part = batch.slice(start, end - start)
                made = [pa.array(coded, pa.binary()), pa.nulls(len(coded), words.type), pa.nulls(len(coded), pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], schema=arrow)
                start = end

    return slim.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def _with_ids(folded: DataFrame, keep: list[str], first: int) -> DataFrame:
    """Ids in the place of the numbers, from the rows of words that came ahead in the same partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids of all numbers one after the other, where each number's end; a token has itself
        ids, ends = np.arange(first, dtype="<i4"), np.arange(first + 1)
        new_ids, new_ends = [], []
        for batch in _slices(batches):
            numbers, begin, words = (batch.column(c) for c in ("numbers", "begin", "word_ids"))
            at = []
            for k, new in enumerate(begin.to_pylist()):
                if new is None:
                    at.append(k)
                    continue
                if at:  # texts before these words
                    yield made(batch, at, numbers, ids, ends)
                    at = []
                if new:
                    ids, ends, new_ids, new_ends = ids[:first], ends[: first + 1], [], []
                of = words[k].values
                new_ids.append(of.flatten().to_numpy(zero_copy_only=False).astype("<i4"))
                last = (new_ends[-1] if new_ends else ends)[-1]
                new_ends.append(last + np.cumsum(of.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
                if k + 1 == len(begin) or begin[k + 1].as_py() is None:
                    ids, ends = np.concatenate([ids, *new_ids]), np.concatenate([ends, *new_ends])
                    new_ids, new_ends = [], []
            if at:
                yield made(batch, at, numbers, ids, ends)

    def made(batch: pa.RecordBatch, at: list[int], numbers: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        texts = [np.frombuffer(numbers[k].as_buffer(), "<u4") for k in at]
        of = np.concatenate(texts).astype(np.int64)
        starts, sizes = ends[of], ends[of + 1] - ends[of]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
        cuts = upto[np.concatenate([[0], np.cumsum([len(x) for x in texts])])]
        raw = flat.tobytes()
        return _ids_batch([batch.column(c).take(pa.array(at)) for c in keep], keep,
                          [raw[4 * a : 4 * b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())])

    return folded.mapInArrow(run, _ids_schema(folded, keep))


def _merged(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str) -> DataFrame:
    """Ids of every text, all words merged in the task."""
    slim = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numberer = Numberer(vocabulary, 0)
        for batch in _slices(batches):
            made = []
            for text in batch.column("__text").to_pylist():
                numberer.make_room()
                made.append(numberer(text))
            yield _ids_batch([batch.column(c) for c in keep], keep, made)

    return slim.mapInArrow(run, _ids_schema(slim, keep))


def _ids_schema(rows: DataFrame, keep: list[str]) -> T.StructType:
    kinds = {"ids": T.ArrayType(T.IntegerType()), "ids_binary": T.BinaryType()}
    return T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(n, k) for n, k in kinds.items())])


def _ids_batch(kept: list[pa.Array], keep: list[str], made: list[bytes]) -> pa.RecordBatch:
    sizes = np.cumsum([0, *(len(x) // 4 for x in made)], dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(made), "<i4")))
    return pa.RecordBatch.from_arrays([*kept, ids, pa.array(made, pa.binary())], [*keep, "ids", "ids_binary"])


def encoded(
    docs: DataFrame, encoder: Encoder, keep: list[str], text: str = "text", native: bool = True
) -> DataFrame:
    """The ``keep`` columns, ``ids``, and these as little-endian 32-bit integers, of every row.

    Its Python steps hold a batch of texts, or of their ids, at once, so the session's batches are bounded.
    """
    bound_batches(docs.sparkSession)
    names = {c: f"__kept{k}" for k, c in enumerate(keep)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(text).alias("__given"))
    inner = list(names.values())
    if not native or not encoder.foldable:
        made = _merged(rows, encoder.vocabulary, inner, "__given")
        return made.select(*(F.col(n).alias(c) for c, n in names.items()), "ids", "ids_binary")
    numbered = _numbered(rows, encoder.vocabulary, inner, "__given").withColumn("__pairs", encoder.tables)
    folds = _let(F.col("__pairs"), lambda t: F.transform("words", lambda w: encoder.fold(t, w)))
    folded = numbered.select(*inner, "numbers", "begin", folds.alias("word_ids"))
    made = _with_ids(folded, inner, max(encoder.vocabulary.ranks.values()) + 1)
    return made.select(*(F.col(n).alias(c) for c, n in names.items()), "ids", "ids_binary")


def token_digests(docs: DataFrame, vocabulary: Vocabulary, native: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    encoder = Encoder(docs.sparkSession, vocabulary)
    ids = encoded(docs, encoder, ["doc_id"], native=native)
    return encoder.decode(ids).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("ids_binary", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
