"""Nearest neighbours by inner product with a forest of hash prefixes.

Each tree gives every vector a long string of hash bits (signs of random projections) and
keeps the vectors sorted by it. A query descends each tree to the longest prefix that it
shares with any vector, by binary search. Then all trees ascend together, one bit at a time,
and the vectors under the prefixes become candidates until there are enough; candidates are
ranked by the inner product of the original vectors in double precision.

Inner products become angles by one more component: vectors get what they lack to the largest
length, queries get 0. The rows are dealt over shards of bounded size by a hash; each shard
is a forest of its own, and blocks of queries meet every shard. The number of candidates is a
share of the shard, fitted on a bounded sample (``SAMPLE`` rows) so that the sample's recall
reaches ``RECALL``; all rows are indexed. Equal vectors stand under one entry with the
smallest ids that any query can need, so a very common vector fills no shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
TREES, BITS = 32, 32
#: Rows in a shard, queries in a block, rows the candidates' share is fitted on.
SHARD, QUERIES, SAMPLE = 16_384, 4_096, 8_192
RECALL = 0.96
SHARES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.1, 1.4, 2.0, 3.0)
SEED = 20_240_613


def projections(size: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """Fixed random directions, the same everywhere: (size + 1, trees * bits)."""
    return np.random.default_rng(SEED).standard_normal((size + 1, trees * bits))


def hash_strings(vectors: np.ndarray, extra: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One integer of ``BITS`` bits per vector and tree, the first bit highest."""
    signs = (np.hstack([vectors, extra[:, None]]) @ planes) > 0
    bits = signs.reshape(len(vectors), -1, BITS).astype(np.uint64)
    return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


class Forest:
    """Sorted hash strings of some vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, planes: np.ndarray) -> None:
        self.vectors, self.planes = vectors, planes
        lack = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
        strings = hash_strings(vectors, lack, planes)
        self.order = np.argsort(strings, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(strings, self.order.T, axis=0).T.copy()

    def ranges(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree, the sorted rows that share the first ``level`` bits."""
        low_bits = np.uint64((1 << (BITS - level)) - 1)
        start, end = strings & ~low_bits, strings | low_bits
        lo = np.stack([np.searchsorted(s, start[:, t], "left") for t, s in enumerate(self.sorted)], axis=1)
        hi = np.stack([np.searchsorted(s, end[:, t], "right") for t, s in enumerate(self.sorted)], axis=1)
        return lo, hi

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query, rows found by ascending from the longest shared prefixes."""
        strings = hash_strings(queries, np.zeros(len(queries)), self.planes)
        n, trees = len(queries), len(self.sorted)
        lo, hi = np.zeros((n, trees), np.int64), np.full((n, trees), len(self.vectors), np.int64)
        open_ = np.ones(n, bool)
        for level in range(BITS, -1, -1):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            l, h = self.ranges(strings[at], level)
            done = (h - l).sum(axis=1) >= wanted
            lo[at[done]], hi[at[done]] = l[done], h[done]
            open_[at[done]] = False
        for q in range(n):
            mask = np.zeros(len(self.vectors), bool)
            for t in range(trees):
                mask[self.order[t, lo[q, t] : hi[q, t]]] = True
            yield np.flatnonzero(mask)

    def nearest(self, queries: np.ndarray, wanted: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, the ``top`` best candidates and all that tie with the last, and scores."""
        for q, at in enumerate(self.candidates(queries, wanted)):
            # one product at a time and in a fixed order, so that equal vectors score equally
            scores = np.einsum("ij,j->i", self.vectors[at], queries[q])
            if len(at) > top:
                least = np.partition(scores, len(at) - top)[len(at) - top]
                keep = scores >= least
                at, scores = at[keep], scores[keep]
            yield at, scores


def fit_share(sample: np.ndarray, longest: float, planes: np.ndarray) -> float:
    """Least share of candidates with the wanted recall on the sample."""
    if len(sample) <= 4 * TOP:
        return SHARES[-1] * 100
    forest = Forest(sample, longest, planes)
    queries = sample[:: max(1, len(sample) // 64)][:64]
    exact = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :TOP]
    for share in SHARES:
        found = forest.candidates(queries, math.ceil(share * len(sample)))
        hits = [len(np.intersect1d(c, e)) for c, e in zip(found, exact)]
        if np.mean(hits) >= RECALL * TOP:
            return share
    return SHARES[-1] * 100


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of rows that take part: no null, no bad or zero vector."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("vector", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return rows.filter(~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(False)))


def search(rows: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows but itself.

    Both tables hold vec_id and vector as ``usable`` gives them; all vectors have one length.
    Ties go to the smaller vec_id. Rows that repeat a vec_id count once each id and vector. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.distinct()
    stats = rows.agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("size"),
        F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"),
    ).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats.n:
        return spark.createDataFrame([], schema)
    # equal vectors become one entry with the ids a query can need: top and one for itself
    by_vector = Window.partitionBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = rows.withColumn("k", F.row_number().over(by_vector)).filter(F.col("k") <= top + 1)
    entries = few.groupBy("vector").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, top + 1).alias("ids"))
    shards = max(1, math.ceil(stats.n / SHARD))
    entries = entries.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0], F.lit(1)), F.lit(shards)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    sampled = np.array(sample["vector"].to_pylist(), float).reshape(-1, stats.size)
    share = fit_share(np.unique(sampled, axis=0), stats.longest, projections(stats.size))
    longest, size = stats.longest, stats.size
    asked = queries.distinct().withColumn("block", F.xxhash64("vec_id"))
    count = asked.count()
    blocks = max(1, math.ceil(count / QUERIES))
    asked = asked.withColumn("block", F.pmod("block", F.lit(blocks)))

    def upto(n: int):
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    # each block of queries meets each shard: a copy of the queries per shard, of the shard per block
    left = entries.select("shard", F.explode(upto(blocks)).alias("block"), "ids", "vector")
    right = asked.select(
        F.explode(upto(shards)).alias("shard"), "block",
        F.col("vec_id").alias("query_id"), F.col("vector").alias("query"),
    )

    def meet(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(shard) and len(block):
            vectors = _matrix(shard["vector"], size)
            ids = shard["ids"].to_pylist()
            # every shard gets its part of the candidates
            wanted = max(math.ceil(share * len(vectors)), 4 * top)
            forest = Forest(vectors, longest, projections(size))
            names, wanted_vectors = block["query_id"].to_pylist(), _matrix(block["query"], size)
            for name, (at, scores) in zip(names, forest.nearest(wanted_vectors, wanted, top + 1)):
                best = sorted(
                    (-s, i) for k, s in zip(at.tolist(), scores.tolist()) for i in ids[k] if i != name
                )[:top]
                found += [(name, i, -s) for s, i in best]
        q, v, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    near = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    values = column.combine_chunks()
    return np.asarray(values.flatten(), dtype=float).reshape(-1, size)


def nearest_of_queries(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    rows = usable(embeddings)
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0))
