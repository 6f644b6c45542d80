"""Near duplicates by DartMinHash signatures and banding.

A document is a weighted set of shingles of five words. Darts are thrown by hashing into
cells of (shingle, weight interval, rank interval): how many darts a cell has, and each dart's
place, depend on the cell alone, so all documents see the same darts. Darts above a shingle's
weight miss; every other belongs to one of ``COORDINATES`` coordinates, and the one of
least rank in a coordinate is its hash. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Cells are opened in order of rank until
every coordinate has a dart, so a document costs its size plus k log k darts.

Documents that agree in all rows of a band share a bucket. Only small buckets are expanded
into pairs: members of larger ones are compared with a leader and classes are formed. Buckets
that then still hold several classes are worked through by themselves, in blocks of bounded
size with the shingle sets at hand: classes are joined as links between them are found, and
what leaves a block are the links that joined some, fewer than it has members. So each two
documents that share a bucket are compared or already in one class. Signatures decide
clear pairs (over four standard deviations from the threshold); the others are decided by
their whole shingle sets (32-bit hashes).

The given weights are 1 for each shingle, that is plain Jaccard similarity; ``counted``
weighs a shingle by how often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import map_rows, unused
from pagequarry.llm.components import Workspace, components
from pagequarry.llm.decontaminate import words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 7
COORDINATES = BANDS * ROWS
#: Similarity by signature beyond which the signature decides.
SURE, SURELY_NOT = 0.9, 0.7
#: Buckets of so few members have all their pairs listed at once.
SMALL = 6
#: Members of a bucket that are compared with each other in one group.
BLOCK = 1024
#: The first rank interval is [0, 2**FIRST); each further one doubles the end.
FIRST = -4
#: Shingles handled at once.
CHUNK = 150_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64(salt * _GOLD & 0xFFFFFFFFFFFFFFFF))


class _Hashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return made


class Shingler:
    """Hashed shingles of a text; the hash of a word is remembered up to a bounded number."""

    REMEMBERED = 300_000

    def __init__(self) -> None:
        self.seen = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """All shingles in order; a text of fewer than five words is one shingle."""
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(self.seen) > self.REMEMBERED:
            self.seen.clear()
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE, len(words))
        n = len(words) - size + 1
        out = h[:n].copy()
        for k in range(1, size):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[k : k + n]
        return mix(out)


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities, for drawing counts from uniform numbers."""
    n = int(mean + 12 * np.sqrt(mean) + 16)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n)))])
    return np.cumsum(np.exp(np.arange(n) * np.log(mean) - mean - logs))


def signatures(elements: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """DartMinHash of ``n`` sets: 32-bit hashes, one row per set, zero rows for empty sets.

    ``elements`` (hashes) with positive ``weights``, each belonging to the set numbered ``of``.
    """
    k = COORDINATES
    made = np.zeros(n * k, np.uint32)
    filled = np.zeros(n * k, bool)
    missing = np.bincount(of, minlength=n).astype(bool) * k
    # weight intervals [0, 1), [1, 2), [2, 4), ...: an element takes part in those it reaches
    layers = []
    low, high = 0.0, 1.0
    while True:
        part = np.flatnonzero(weights > low)
        if not len(part):
            break
        layers.append((len(layers), low, high, part))
        low, high = high, high * 2
    cell, begin, end = 0, 0.0, 2.0**FIRST
    tables: dict[float, np.ndarray] = {}
    while missing.any():
        slots, ranks = [], []
        for layer, low, high, part in layers:
            part = part[missing[of[part]] > 0]
            if not len(part):
                continue
            mean = (high - low) * (end - begin)
            if mean not in tables:
                tables[mean] = _poisson_table(mean)
            base = _salted(elements[part], 1 + layer * 128 + cell)
            u = (base >> np.uint64(11)).astype(float) / 2**53
            count = np.searchsorted(tables[mean], u)
            thrown = np.repeat(np.arange(len(part)), count)
            number = np.arange(len(thrown)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(base[thrown] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
            if high - low > 1 or weights[part].min() < high:
                height = low + (high - low) * ((_salted(dart, 3) >> np.uint64(11)).astype(float) / 2**53)
                hit = height < weights[part][thrown]
                thrown, dart = thrown[hit], dart[hit]
            slot = of[part][thrown] * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            open_ = ~filled[slot]
            slots.append(slot[open_])
            ranks.append(_salted(dart[open_], 5) >> np.uint64(32))
        if slots:
            key = np.sort(np.concatenate(slots).astype(np.uint64) << np.uint64(32) | np.concatenate(ranks))
            slot = (key >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else slot
            made[slot[first]] = (key[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ np.uint32(cell * 0x9E3779B1 & 0xFFFFFFFF)
            filled[slot[first]] = True
            missing = missing - np.bincount(slot[first] // k, minlength=n)
        cell, begin, end = cell + 1, end, end * 2
    return made.reshape(n, k)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + rows[:, :, r] + np.uint64(1))
    return keys.view(np.int64)


FEATURES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("digest", T.BinaryType()),
     T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
)


def features(docs: DataFrame, counted: bool = False) -> DataFrame:
    """doc_id, digest of the text, band keys (none without words), signature in bytes."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_digest().alias("digest"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts, start = batch.column("text").to_pylist(), 0
            while start < len(texts):
                elements, weights, size, k = [], [], 0, start
                while k < len(texts) and size < CHUNK:
                    e, c = np.unique(shingler(texts[k]), return_counts=True)
                    elements.append(e)
                    weights.append(c if counted else np.ones(len(e)))
                    size += len(e)
                    k += 1
                of = np.repeat(np.arange(k - start), [len(e) for e in elements])
                made = signatures(np.concatenate(elements), np.concatenate(weights).astype(float), of, k - start)
                empty = [not len(e) for e in elements]
                keys = band_keys(made)
                part = batch.slice(start, k - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("digest"),
                        pa.array([[] if z else r for z, r in zip(empty, keys)], pa.list_(pa.int64())),
                        pa.array([r.tobytes() for r in made.astype(np.uint8)], pa.binary()),
                    ],
                    FEATURES.names,
                )
                start = k

    return texts.mapInArrow(run, FEATURES)


def _sets(docs: DataFrame, counted: bool) -> DataFrame:
    """node and its shingles: sorted 32-bit hashes, repeated as often as weighted."""

    def make():
        shingler = Shingler()

        def step(text: str | None) -> tuple[bytes]:
            s = (shingler(text) >> np.uint64(32)).astype(np.uint32)
            return ((np.sort(s) if counted else np.unique(s)).tobytes(),)

        return step

    return map_rows(docs, ["text"], make, [T.StructField("shingles", T.BinaryType())], ["node"])


def _jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    if len(np.unique(x)) == len(x) and len(np.unique(y)) == len(y):
        shared = int(np.sum(both[1:] == both[:-1]))
    else:  # weighted sets: the smaller count of each shingle
        (ux, cx), (uy, cy) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(ux, uy, return_indices=True)
        shared = int(np.minimum(cx[i], cy[j]).sum())
    return shared / (len(both) - shared)


def _agreement(a: bytes, b: bytes) -> float:
    """Similarity estimated from signatures in bytes, chance agreement taken out."""
    same = np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))
    return float((same - 1 / 256) / (1 - 1 / 256))


def _joining_links(threshold: float, group: pa.Table) -> pa.Table:
    """Links that join classes of a block of a bucket, at most one for each class.

    Every two members of different classes are compared, in the bucket of their first shared band.
    """
    i, j, key = (group[n][0].as_py() for n in ("i", "j", "key"))
    node, cls, mine = (group[n].to_numpy() for n in ("node", "class", "mine"))
    names, of = np.unique(cls, return_inverse=True)
    found = []
    if len(names) > 1 and (i == j or len(np.unique(mine)) > 1):
        bands = np.array(group["bands"].to_pylist(), np.int64)
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
        # members of the commonest class need not be compared with each other
        outside = np.flatnonzero(of != np.bincount(of).argmax())
        is_outside = np.zeros(len(node), bool)
        is_outside[outside] = True
        place = np.arange(len(node))
        for start in range(0, len(outside), 32):
            rows = outside[start : start + 32]
            same = (sketch[rows, None, :] == sketch[None, :, :]).mean(axis=2)
            estimate = (same - 1 / 256) / (1 - 1 / 256)
            close = (estimate >= threshold - (THRESHOLD - SURELY_NOT)) & (of[rows, None] != of[None, :])
            close &= ~is_outside[None, :] | (rows[:, None] < place[None, :])
            if i != j:
                close &= mine[rows, None] != mine[None, :]
            at, b = np.nonzero(close)
            a = rows[at]
            shared = bands[a] == bands[b]
            first = shared.any(axis=1) & (bands[a, shared.argmax(axis=1)] == key)
            found.append((estimate[at, b][first], a[first], b[first]))
    made: list[tuple[int, int]] = []
    if found:
        estimate, a, b = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(-estimate, kind="stable")
        sure = estimate >= threshold + (SURE - THRESHOLD)
        sets, parent = group["shingles"], list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for k in order.tolist():
            x, y = int(a[k]), int(b[k])
            one, other = root(int(of[x])), root(int(of[y]))
            if one != other and (sure[k] or _jaccard(sets[x].as_py(), sets[y].as_py()) >= threshold):
                parent[one] = other
                made.append((int(node[x]), int(node[y])))
    return pa.table({n: pa.array([m[k] for m in made], pa.int64()) for k, n in enumerate("ab")})


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    left = table.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = table.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")


def classes(docs: DataFrame, counted: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, digest, class_id, is_kept, n_members) of every document.

    A document is a doc_id and a text, given by its digest: rows that agree in both are one, rows
    that share only the id are different ones. Rows without doc_id are left out here. A class is a
    connected component of texts of similarity ``threshold`` or more; empty texts are equal. Its
    first document, by id and digest, is kept and gives the class its id. (Two classes have one
    id only where rows share a doc_id and differ; each still keeps a document.) ``n_members``
    counts the documents of its class.
    """
    space = Workspace(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    all_ = space.keep(features(docs, counted), "features")
    # one row for each distinct text, numbered: equal texts have equal bands
    own = space.keep(
        all_.groupBy("digest")
        .agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    numbers = own.select("digest", "node")
    copies = space.keep(all_.select("doc_id", "digest").distinct().join(numbers, "digest"), "copies")
    # what leaders are drawn by does not depend on the numbering
    rows = own.select("node", F.xxhash64("digest").alias("drawn"), F.explode("bands").alias("key"))
    # most buckets have one member, so leaders are only sought in the others
    several = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = space.keep(rows.join(several, "key"), "members")
    leaders = members.groupBy("key").agg(F.min(F.struct("drawn", "node"))["node"].alias("leader"))
    shared = space.keep(members.join(leaders, "key"), "buckets")
    sketches = space.keep(
        own.select("node", "sketch").join(members.select("node").distinct(), "node"), "sketches"
    )
    # one document of each text that is wanted, then its text; a merge join at every size, so
    # that a small run says what a large one costs
    wanted = copies.join(sketches.select("node"), "node", "left_semi")
    wanted = wanted.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("one"))
    wanted = wanted.select("node", "one.doc_id", "one.digest")
    texts = docs.withColumn("digest", text_digest()).join(wanted.hint("merge"), ["doc_id", "digest"])
    sets = space.keep(_sets(texts.dropDuplicates(["node"]), counted), "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs at or above the threshold."""
        estimate = map_rows(
            _with_both(pairs, sketches, "sketch"), ["x", "y"],
            lambda: lambda x, y: (_agreement(x, y),),
            [T.StructField("similarity", T.DoubleType())], ["a", "b"],
        )
        sure, not_ = threshold + (SURE - THRESHOLD), threshold - (THRESHOLD - SURELY_NOT)
        estimate = space.keep(estimate.filter(F.col("similarity") >= not_), "estimates")
        unsure = estimate.filter(F.col("similarity") < sure).select("a", "b")
        exact = map_rows(
            _with_both(unsure, sets, "shingles"), ["x", "y"],
            lambda: lambda x, y: (_jaccard(x, y),),
            [T.StructField("similarity", T.DoubleType())], ["a", "b"],
        )
        return (
            estimate.filter(F.col("similarity") >= sure)
            .unionByName(exact.filter(F.col("similarity") >= threshold))
            .select("a", "b")
        )

    def led(table: DataFrame) -> DataFrame:
        """Members of buckets with each of their buckets' leaders, which for a node are few."""
        each = table.select("node", "leader").filter("node != leader")
        return each.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()

    def every(table: DataFrame) -> DataFrame:
        """All pairs of members of one bucket."""
        left = table.select("key", F.col("node").alias("a"))
        right = table.select("key", F.col("node").alias("b"))
        return left.join(right, "key").filter("a < b").select("a", "b").distinct()

    def apart(table: DataFrame) -> DataFrame:
        """Rows of buckets that hold several classes, with the class."""
        cls = F.coalesce("v", "node")
        rows = table.join(known.withColumnRenamed("u", "node"), "node", "left").withColumn("class", cls)
        mixed = rows.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo != hi")
        return rows.drop("v").join(mixed.select("key"), "key", "left_semi")

    def joining(table: DataFrame) -> DataFrame:
        """Links that join the classes within buckets.

        A bucket is dealt over blocks, and every two blocks meet in a group of bounded size.
        """
        sized = table.select("key", "node", "class", F.ceil(F.col("m") / BLOCK).cast("int").alias("n"))
        rows = sized.join(own.select("node", "bands", "sketch").hint("merge"), "node").join(sets.hint("merge"), "node")
        mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
        each = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        each = each.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})

        def links(group: pa.Table) -> pa.Table:
            return _joining_links(threshold, group)

        return each.drop("other", "n").groupBy("key", "i", "j").applyInArrow(links, "a long, b long")

    small, large = shared.filter(F.col("m") <= SMALL), shared.filter(F.col("m") > SMALL)
    pairs = space.keep(every(small).unionByName(led(large)).distinct(), "pairs")
    known = components(space.keep(compared(pairs), "links"), space)
    more = space.keep(joining(apart(large)), "links")
    if not more.isEmpty():
        known = components(more.unionByName(known.select(F.col("u").alias("a"), F.col("v").alias("b"))), space)
    found = copies.join(known.withColumnRenamed("u", "node"), "node", "left").withColumn("of", F.coalesce("v", "node"))
    kept = found.groupBy("of").agg(
        F.min(F.struct("doc_id", "digest")).alias("kept"), F.count("*").alias("n_members")
    )
    return found.join(kept, "of").select(
        "doc_id", "digest", F.col("kept.doc_id").alias("class_id"),
        (F.struct("doc_id", "digest") == F.col("kept")).alias("is_kept"), "n_members",
    )


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, is_kept, n_members: one row for each doc_id and text; rows without doc_id are left out."""
    return classes(docs).select("doc_id", "class_id", "is_kept", "n_members")


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the smallest doc_id; rows without doc_id all stay."""
    mark = unused(docs, "__digest")
    dropped = classes(docs).filter(~F.col("is_kept")).select("doc_id", F.col("digest").alias(mark))
    kept = docs.withColumn(mark, text_digest()).join(dropped, ["doc_id", mark], "left_anti")
    first = F.col("doc_id").isNotNull()
    return (
        kept.filter(first).dropDuplicates(["doc_id", mark]).unionByName(kept.filter(~first)).select(*docs.columns)
    )
