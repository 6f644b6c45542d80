"""Cleaning a corpus in stages; each stage's rows are written as Parquet and read by the next.

1. toxicity: documents with a toxicity score at the threshold or above go.
2. quality: documents unlikely to reach the grade of readable text go.
3. near_duplicates: of each class of (near) copies the document of smallest id stays.
4. decontamination: documents that hold a benchmark item go.
5. byte_bpe: the token ids of every document left, checked by decoding them.

Stages 1 to 4 return rows of ``documents`` with their own columns. Rows without doc_id take
part in all stages but are no near copies of anything; a null text counts as empty. Empty
inputs give empty outputs with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, decontaminate, neardup, quality, toxicity
from pagequarry.llm.common import shared_folder, table
from pagequarry.llm.queries import public_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding them gives the text's bytes."""
    encoder = bpe.Encoder(spark, public_vocabulary())
    ids = bpe.encoded(docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit("")).cast("binary"))),
                      encoder, ["doc_id", "__digest"])
    return encoder.decode(ids).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.col("ids").cast("array<int>").alias("ids"),
        (F.md5("bytes") == F.col("__digest")).alias("decodes"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: The stages learn models and walk class graphs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
