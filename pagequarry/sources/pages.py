"""Page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = ["page_id", "url", "html"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*PAGE_COLUMNS)


def spread(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``pages`` in at least as many partitions as the cluster has cores.

    A file with one row group is read by one task, and reading markup would then run on one
    core. Tables with as many files as cores pass unchanged: their markup is not shuffled.
    ``pages`` should be a scan, and ``key`` (nearly) unique.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if len(pages.inputFiles()) >= cores:
        return pages
    return pages.repartition(cores, F.col(key))
