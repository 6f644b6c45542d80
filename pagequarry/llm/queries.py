"""One query per operator over its whole table, and the SQL checks of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import (
    blocks,
    bpe,
    brown,
    collocations,
    decontaminate,
    forest,
    licenses,
    neardup,
    quality,
    tokencounts,
    tokenfiles,
    toxicity,
    variants,
)
from pagequarry.llm.common import table
from pagequarry.llm.components import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[build.__name__] = build
    return build


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade and selection of every document."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded bytes of every document."""
    return bpe.token_digests(table(spark, folder, "documents"), public_vocabulary())


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document, and which one of each class is kept."""
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Base phrases and license notices of every document."""
    return licenses.licenses(table(spark, folder, "documents"))


@query
def op9_brown(spark: SparkSession, folder: str) -> DataFrame:
    """Base score and class-based score of every document."""
    return brown.lm_scores(table(spark, folder, "documents"))


@query
def op2_hash_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return forest.nearest_of_queries(table(spark, folder, "embeddings"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals after all batches of a history of changes, one of which is sent twice."""
    space = Workspace(spark, "tokencounts")
    changes = space.keep(tokencounts.document_changes(table(spark, folder, "documents")), "changes")
    store = tokencounts.Store(spark, f"{space.folder}/store")
    for batch in (1, 2, 2, 3):
        store.commit(str(batch), changes.filter(F.col("batch") == batch))
    return store.totals()


ORACLES["op3_token_counts"] = tokencounts.ORACLE


@query
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return blocks.extracted(table(spark, folder, "pages"))


@query
def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document written as Simple-8b blocks, and what is read back of them."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return tokenfiles.token_files(table(spark, folder, "documents"), f.read())


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the texts with its near words, commonest near form and root."""
    return variants.spelling_variants(table(spark, folder, "documents"))


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best collocations of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


ORACLES["op11_collocations"] = collocations.ORACLE
