"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import shared_folder


class Workspace:
    """A new folder below the shared one; ``keep`` writes a table there and reads it again."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.count = spark, 0
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, table: DataFrame, name: str = "table") -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}-{name}"
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return (
        small.filter("v != m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(u, v): every node of an edge but the least of its component, and that least node.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and loops do not matter.
    """
    work = space.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u != v")
        .distinct(),
        "edges",
    )

    def state(t: DataFrame) -> tuple:
        r = t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    last = state(work)
    while last[0]:
        work = space.keep(_stars(work), "stars")
        now = state(work)
        if now == last:
            break
        last = now
    return work
