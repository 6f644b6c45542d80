"""Extraction of pages as they arrive, with Structured Streaming.

Extraction has no state, so the batch operators serve streams unchanged. Results are appended
batch by batch, and the table of current results is a view of them: the last write of each
key. Nothing is rewritten in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pagequarry.operators.store import latest
from pagequarry.plans.scrape import scrape_pages
from pagequarry.schemas import PAGES


def arriving_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the Parquet page files that turn up in a folder."""
    return spark.readStream.schema(PAGES).parquet(folder)


def start_scraping(
    pages: DataFrame,
    store: str,
    checkpoint: str,
    content_tags: Sequence[str] | None = None,
    noise_tags: Sequence[str] | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Write the results of a page stream below ``store``.

    Each micro-batch owns one folder, so a batch that is repeated after a failure replaces
    its own output and nothing is stored twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/write_seq={batch_id}")

    results = scrape_pages(pages, content_tags, noise_tags)
    writer = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def current_results(spark: SparkSession, store: str) -> DataFrame:
    """The last result of each key."""
    written = spark.read.option("basePath", store).parquet(store)
    return latest(written.withColumn("write_seq", F.col("write_seq").cast("bigint")))
