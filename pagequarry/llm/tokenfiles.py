"""Token ids of documents in files of Simple-8b words, in order of document id.

A word of 64 bits holds a selector in its top four bits and, in the other sixty, as many ids of
one width as fit: 60 of one bit, 30 of two, down to one of 60. Selector 0 is the escape: its
word holds a position in the block's list of values that need more than sixty bits. Documents
are coded in runs of ``RUN`` ids, the last one shorter; each run begins with a new word, and its
last word may be part full.

A block holds whole documents, at least one, and is closed at ``BLOCK_IDS`` ids or ``BLOCK_DOCUMENTS``. Its bytes are,
little-endian: ``MAGIC``, then as uint32 the numbers of documents, words, escaped values and
runs; the number of ids of each document (uint64); the first word of each run and the number of
words (uint32, padded to whole 64 bits); the escaped values (uint64); the words (uint64). With
these offsets a block, or one document of it, is decoded without loops over ids.

A file set is a Parquet table of blocks, so it can lie in any store Spark writes to and a lost
task is written again: ``shard`` and ``block`` give the order, ``first`` the ids of the shard
before the block, ``doc_ids`` its documents. Shards are ranges of (doc_id, digest of the text);
rows without an id come first, rows that share one are in order of their digests, and equal
rows are all kept. Extra columns do not matter; an empty table gives an empty file set.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import worker_state
from pagequarry.llm.components import Workspace

MAGIC = b"S8B1"
#: (ids in a word, bits of each) by selector; selector 0 is the escape (fixed values).
SLOTS = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
         (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
MOST = 60
RUN = 2048
COUNTS = np.array([c for c, _ in SLOTS])
PAYLOAD = np.uint64((1 << 60) - 1)
#: A block is closed at so many ids or documents.
BLOCK_IDS, BLOCK_DOCUMENTS = 1 << 20, 1 << 16
#: Distinct chunks whose ids a Python worker remembers.
REMEMBERED = 1 << 20
#: Texts encoded together.
TEXTS = 512
#: Stands for the ids of what cannot be encoded by itself.
NO_CUT = False
#: Marks that this kind of tokenizer keeps apart from a letter before them.
END_MARKS = ".,;:!?#$%&*()"
#: Cut before plain white space that follows no white space: there every tokenizer of this kind cuts.
CHUNKS = re.compile(r"\s*\S+(?:[^\S \t\n\r]\s*\S*)*|\s+")


#: Length in bits of each number of 16 bits.
SHORT = np.frexp(np.arange(1 << 16))[1].astype(np.int8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Length in bits of each value."""
    if values.max(initial=0) < len(SHORT):
        return SHORT[values]
    long = np.zeros(len(values), np.int8)
    for shift in (0, 16, 32, 48):
        part = (values >> np.uint64(shift)) & np.uint64(len(SHORT) - 1)
        long = np.where(part > 0, SHORT[part] + shift, long)
    return long.astype(np.int8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place, the selector that takes most values from there on, for widths ``bits``.

    A window's widest value comes from two shorter windows that cover it.
    """
    n = len(bits)
    chosen = np.zeros(n, np.int8)
    widest = {1: bits}
    for s in range(len(SLOTS) - 1, 0, -1):
        count, room = SLOTS[s]
        if count > 1:
            half = max(c for c in widest if c < count)
            window, gap = widest[half].copy(), count - half
            np.maximum(window[: n - gap], widest[half][gap:], out=window[: n - gap])
            widest[count] = window
        np.copyto(chosen, s, where=widest[count] <= room)
    return chosen


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the runs that documents of these sizes are cut into, and the runs before each document."""
    count = -(-sizes // RUN)
    before = np.cumsum(count) - count
    runs = np.full(int(count.sum()), RUN, np.int64)
    full = count > 0
    runs[(before + count - 1)[full]] = (sizes - (count - 1) * RUN)[full]
    return runs, before


def _word_starts(starts: np.ndarray, ends: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where words begin: from each start on by ``step``, all runs at once."""
    found = np.zeros(len(step), bool)
    at = starts
    while len(at):
        found[at] = True
        at = at + step[at]
        inside = at < ends
        if not inside.all():
            at, ends = at[inside], ends[inside]
    return np.flatnonzero(found)


def pack(documents: Sequence[np.ndarray]) -> bytes:
    """A block of the given documents' ids (non-negative integers)."""
    sizes = np.array([len(d) for d in documents], np.int64)
    runs, _ = _runs(sizes)
    ids = np.concatenate([np.zeros(0, np.uint64), *documents], dtype=np.uint64, casting="unsafe")
    # zeros between runs, so that a last word may be part full
    starts = np.cumsum(runs + MOST) - runs - MOST
    values = np.zeros(len(ids) + MOST * len(runs), np.uint64)
    values[np.arange(len(ids)) + np.repeat(MOST * np.arange(len(runs)), runs)] = ids
    selector = _selectors(_bits(values))
    words_at = _word_starts(starts, starts + runs, COUNTS[selector])
    chosen = selector[words_at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    escaped = values[words_at[chosen == 0]]
    words[chosen == 0] |= np.arange(len(escaped), dtype=np.uint64)
    for s in range(1, len(SLOTS)):
        count, bits = SLOTS[s]
        at = np.flatnonzero(chosen == s)
        if len(at):
            first, payload = words_at[at], words[at]
            for j in range(count):
                payload |= values[first + j] << np.uint64(bits * j)
            words[at] = payload
    offsets = np.append(np.searchsorted(words_at, starts), len(words))
    offsets = np.append(offsets, np.zeros(len(offsets) % 2, np.int64))
    head = np.array([len(sizes), len(words), len(escaped), len(runs)], "<u4")
    parts = [head, sizes.astype("<u8"), offsets.astype("<u4"), escaped.astype("<u8"), words.astype("<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def unpack(block: bytes) -> list[np.ndarray]:
    """The documents' ids of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    documents, n, n_escaped, n_runs = (int(x) for x in np.frombuffer(block, "<u4", 4, 4))
    at = 20
    sizes = np.frombuffer(block, "<u8", documents, at).astype(np.int64)
    runs, _ = _runs(sizes)
    at += 8 * documents
    offsets = np.frombuffer(block, "<u4", n_runs + 1, at).astype(np.int64)
    at += 4 * (n_runs + 1 + (n_runs + 1) % 2)
    escaped = np.frombuffer(block, "<u8", n_escaped, at)
    words = np.frombuffer(block, "<u8", n, at + 8 * n_escaped)
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selector]
    before = np.concatenate([[0], np.cumsum(held)])
    # the last word of a run holds what the words before it have left
    held[offsets[1:] - 1] -= before[offsets[1:]] - before[offsets[:-1]] - runs
    starts = np.concatenate([[0], np.cumsum(held)])
    values = np.zeros(starts[-1], np.uint64)
    at = np.flatnonzero(selector == 0)
    values[starts[at]] = escaped[(words[at] & PAYLOAD).astype(np.int64)]
    for s in range(1, len(SLOTS)):
        count, bits = SLOTS[s]
        at = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(at) else 0):
            some = at[held[at] > j]
            values[starts[some] + j] = (words[some] >> np.uint64(bits * j)) & mask
    return np.split(values, np.cumsum(sizes)[:-1]) if documents else []


class Encoder:
    """Ids of whole texts by a tokenizer file, remembering the pieces between spaces.

    This kind of tokenizer cuts a text before plain white space that follows none, so the ids of
    the pieces are the text's. Pieces are taken at single spaces and line ends; where a text has
    white space beside these, by ``CHUNKS``. ``end`` is appended to each text. Strings of special
    tokens are ordinary text.
    """

    def __init__(self, tokenizer: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.end = np.uint32(end).tobytes()
        # which tokens begin with a space or line end, as this kind of vocabulary writes these bytes
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True
        self.forget()

    def forget(self) -> None:
        #: ids of a chunk as it stands, and of what follows a space (with it) or begins with a line
        #: end; the latter ``NO_CUT`` where no cut is allowed
        self.alone: dict[str, bytes] = {}
        self.spaced: dict[str, bytes | bool] = {}

    def _learn_spaced(self, new: set[str]) -> None:
        """Joins new pieces to long texts, as a call for each would cost more than its encoding."""
        words, lines, cut = set(), [], []
        spaced = self.spaced
        for w in new:
            if not w or w[-1].isspace():
                spaced[w] = NO_CUT
            elif w[0] == "\n":
                lines.append(w)
            elif w[-1] in END_MARKS and (base := w.rstrip(END_MARKS)) and base[-1] < "\u0250" and base[-1].isalpha():
                cut.append((w, base))
                if base not in spaced:
                    words.add(base)
            else:
                words.add(w)
        words = list(words)
        for pieces, mark in ((words, " "), (lines, "")):
            groups = [pieces[k : k + 64] for k in range(0, len(pieces), 64)]
            texts = [mark + mark.join(g) for g in groups]
            for group, coded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(coded.ids, np.uint32)
                starts = (4 * np.flatnonzero(self.begins[ids])).tolist()
                raw = ids.tobytes()
                spaced.update(zip(group, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)]))))
        for w, base in cut:
            marks = w[len(base) :]
            spaced[w] = spaced[base] + (self.alone.get(marks) or self._chunked(marks))

    def _chunked(self, text: str) -> bytes:
        chunks = CHUNKS.findall(text)
        new = list({c for c in chunks if c not in self.alone})
        coded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.alone.update((c, np.array(e.ids, np.uint32).tobytes()) for c, e in zip(new, coded))
        return b"".join(map(self.alone.__getitem__, chunks))

    def __call__(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        return [x for k in range(0, len(texts), TEXTS) for x in self._together(texts[k : k + TEXTS])]

    def _together(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        if len(self.alone) + len(self.spaced) > REMEMBERED:
            self.forget()
        get, waiting, new = self.spaced.get, [], set()
        for text in (t or "" for t in texts):
            first, *pieces = text.replace("\n", " \n").split(" ")
            found = list(map(get, pieces))
            gaps = []
            if None in found:
                gaps = [k for k, x in enumerate(found) if x is None]
                pieces = [pieces[k] for k in gaps]
                new.update(pieces)
            waiting.append((text, first, found, gaps, pieces))
        self._learn_spaced(new)
        made, ids = [], self.spaced.__getitem__
        for text, first, found, gaps, pieces in waiting:
            for k, x in zip(gaps, map(ids, pieces)):
                found[k] = x
            if found and (not first or first[-1].isspace()):
                found.append(NO_CUT)
            try:
                coded = b"".join([self._chunked(first), *found, self.end])
            except TypeError:  # white space beside a space
                coded = self._chunked(text) + self.end
            made.append(np.frombuffer(coded, np.uint32))
        return made


BLOCKS = "shard int, block int, first long, n_ids long, doc_ids array<bigint>, payload binary"


def write(docs: DataFrame, tokenizer: str, path: str, end: int = 0, text: str = "text") -> None:
    """Writes the ids of every text below ``path``; ``tokenizer`` is the JSON of a tokenizer."""
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select("doc_id", whole.alias("text"), F.xxhash64(whole).alias("digest"))
    dealt = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given the task its core
        encode = worker_state((tokenizer, end), lambda: Encoder(tokenizer, end))
        shard = TaskContext.get().partitionId()
        number = first = size = 0
        ids, held = [], []

        def block() -> pa.RecordBatch:
            columns = [[shard], [number], [first], [size], [ids], [pack(held)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "block", "first", "n_ids", "doc_ids", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            coded = encode(batch.column("text").to_pylist())
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), coded):
                ids.append(doc_id)
                held.append(x)
                size += len(x)
                if size >= BLOCK_IDS or len(ids) >= BLOCK_DOCUMENTS:
                    yield block()
                    number, first, size = number + 1, first + size, 0
                    ids, held = [], []
        if held:
            yield block()

    dealt.drop("digest").mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document of a file set, start counted over all shards."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    schema = "shard int, doc_id long, n_tokens long, local long, ids array<bigint>"
    return _decoded(blocks, schema, lambda x: x.tolist()).select("doc_id", "start", "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a file set."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    schema = "shard int, doc_id long, n_tokens long, local long, ids_crc32 long"
    made = _decoded(blocks, schema, lambda x: zlib.crc32(x.astype("<u4").tobytes()))
    return made.select("doc_id", "start", "n_tokens", "ids_crc32")


def _decoded(blocks: DataFrame, schema: str, use) -> DataFrame:
    """A row per document with ``use`` of its ids as last column, and its start over all shards."""
    spark = blocks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                documents = unpack(b["payload"])
                sizes = np.array([len(d) for d in documents], np.int64)
                columns = {
                    "shard": pa.array([b["shard"]] * len(sizes), pa.int32()),
                    "doc_id": pa.array(b["doc_ids"], pa.int64()),
                    "n_tokens": pa.array(sizes),
                    "local": pa.array(b["first"] + np.cumsum(sizes) - sizes),
                    last: pa.array([use(d) for d in documents], kind),
                }
                yield pa.RecordBatch.from_pydict(columns)

    last = schema.split(", ")[-1].split(" ")[0]
    kind = pa.list_(pa.int64()) if last == "ids" else pa.int64()
    # one row per shard: the manifest, from which each shard's first position follows
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = np.concatenate([[0], np.cumsum([r.n for r in sizes])]).astype(int).tolist()
    manifest = spark.createDataFrame([(r.shard, b) for r, b in zip(sizes, before)], "shard int, before long")
    documents = blocks.select("shard", "first", "doc_ids", "payload").mapInArrow(run, schema)
    return documents.join(F.broadcast(manifest), "shard").withColumn("start", F.col("before") + F.col("local"))


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' ids and returns what is read back: doc_id, start, n_tokens, ids_crc32."""
    space = Workspace(docs.sparkSession, "tokenfiles")
    path = f"{space.folder}/ids"
    write(docs, tokenizer, path)
    return digests(docs.sparkSession, path)
