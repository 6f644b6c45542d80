"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A change says what a document counted before and counts now under one tokenizer version: an
insert has no before, a delete no now, a recount both. Each change becomes signed amounts
(minus what was, plus what is, each under its own source and language), and only sums of
amounts are kept, so totals never have to be recomputed from documents.

Changes are committed in batches. A batch's sums are one folder under the store; the folder
counts once its ``_SUCCESS`` marker is there, and a committed batch is never written again, so a
batch that is sent twice changes nothing and one that failed half-way is redone. Totals
are the sums over all committed batches; ``compact`` folds them into a snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens", "chars"]
#: Tokenizer versions: what a token is, as a regular expression (fixed values).
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]",
}
DELTA = "source string, lang string, tokenizer string, documents long, tokens long, chars long"


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Number of tokens; 0 for null and empty texts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKENIZERS[tokenizer])).cast("long")


def amounts(changes: DataFrame) -> DataFrame:
    """Signed sums by source, language and tokenizer.

    ``changes`` has change_id, tokenizer, and structs ``before`` and ``after`` of source, lang,
    tokens, chars (null where there is none). Rows that repeat a change_id count once.
    Null sources and languages are keys of their own. Sums are formed before any exchange,
    so a source with a third of all changes is no larger than others.
    """
    once = changes.dropDuplicates(["change_id"])
    sides = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("before").alias("of")),
        F.struct(F.lit(1).alias("sign"), F.col("after").alias("of")),
    )
    signed = once.select("tokenizer", F.explode(sides).alias("s")).filter("s.of IS NOT NULL")
    return (
        signed.groupBy(F.col("s.of.source").alias("source"), F.col("s.of.lang").alias("lang"), "tokenizer")
        .agg(
            F.sum("s.sign").cast("long").alias("documents"),
            F.sum(F.col("s.sign") * F.coalesce("s.of.tokens", F.lit(0))).cast("long").alias("tokens"),
            F.sum(F.col("s.sign") * F.coalesce("s.of.chars", F.lit(0))).cast("long").alias("chars"),
        )
        .select(*KEYS, *SUMS)
    )


class Store:
    """Committed batches of signed sums below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _folders(self) -> list[str]:
        """Committed batches."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        paths = [s.getPath().toString() for s in files.listStatus(at) if s.isDirectory()]
        return sorted(p for p in paths if self._exists(f"{p}/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch once; False if it was committed before."""
        path = f"{self.folder}/batch-{batch}"
        if self._exists(f"{path}/_SUCCESS"):
            return False
        amounts(changes).write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys whose documents are all gone are left out."""
        folders = self._folders()
        rows = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.filter("documents != 0 OR tokens != 0 OR chars != 0")

    def compact(self, other: str) -> Store:
        """A store in another folder with the totals in one table, which knows the batches they are from.

        Each batch leaves an empty folder with its name, so that one sent again counts no second time.
        """
        made = Store(self.spark, other)
        for folder in self._folders():
            name = folder.rsplit("/", 1)[1]
            if name.startswith("batch-"):
                mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{made.folder}/{name}/_SUCCESS")
                mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()
        self.totals().write.mode("overwrite").parquet(f"{made.folder}/totals")
        return made


def document_changes(docs: DataFrame) -> DataFrame:
    """A history of changes over all documents: change_id, batch, tokenizer, before, after.

    Batch 1 inserts every document as counted by the first tokenizer. Batch 2 deletes those
    whose id is divisible by 10. Batch 3 recounts the others by the second tokenizer if
    their id is divisible by 3: a delete under the first, an insert under the second version. Each
    is read off the document itself, so the history grows with the table.

    Rows that agree in id, source, language and text are one document; rows that share only the id
    are different ones. Every row without an id is a document of its own. It is inserted, and
    never deleted or recounted, as no divisor applies. (``ORACLE`` leaves such rows out, and takes
    rows of one id for one document if all their counts agree.)
    """
    ids = F.col("doc_id")
    # nulls are marked, as the hash skips them; an empty text counts as a null one does
    parts = [x for c in ("source", "lang") for x in (F.col(c).isNull(), F.col(c))]
    digest = F.xxhash64(*parts, F.coalesce("text", F.lit("")))
    occurrence = F.when(ids.isNull(), F.monotonically_increasing_id())
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    first, second = TOKENIZERS

    def counted(tokens: Column) -> Column:
        return F.struct(
            F.col("source").alias("source"), F.col("lang").alias("lang"), tokens.alias("tokens"), F.col("chars").alias("chars")
        )

    recounted = (ids % 3 == 0) & (ids % 10 != 0)
    rows = docs.select(
        ids.alias("id"), digest.alias("digest"), occurrence.alias("occurrence"), "source", "lang", size.alias("chars"),
        count_tokens(F.col("text"), first).alias("one"),
        F.when(recounted, count_tokens(F.col("text"), second)).alias("two"),
    )
    one, two = counted(F.col("one")), counted(F.col("two"))
    none = F.lit(None).cast("struct<source:string,lang:string,tokens:bigint,chars:bigint>")

    def change(batch: int, tokenizer: str, before: Column, after: Column) -> Column:
        return F.struct(
            F.lit(batch).alias("batch"), F.lit(tokenizer).alias("tokenizer"), before.alias("before"), after.alias("after")
        )

    gone = F.col("id") % 10 == 0
    again = F.col("two").isNotNull()
    listed = F.array_compact(
        F.array(
            change(1, first, none, one),
            F.when(gone, change(2, first, one, none)),
            F.when(again, change(3, first, one, none)),
            F.when(again, change(3, second, none, two)),
        )
    )
    each = rows.select("id", "digest", "occurrence", F.explode(listed).alias("c"))
    document = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.col("occurrence").cast("string")))
    key = F.concat_ws("/", F.col("c.batch").cast("string"), F.col("c.tokenizer"), document, F.col("digest").cast("string"))
    return each.select(key.alias("change_id"), "c.batch", "c.tokenizer", "c.before", "c.after")


ORACLE = r"""
WITH d AS (
  SELECT DISTINCT doc_id, source, lang, length(coalesce(text, '')) AS chars,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS one,
    len(regexp_extract_all(coalesce(text, ''),
      '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]')) AS two
  FROM documents),
k AS (
  SELECT source, lang, chars,
    CASE WHEN doc_id % 3 = 0 THEN 'words-2' ELSE 'words-1' END AS tokenizer,
    CASE WHEN doc_id % 3 = 0 THEN two ELSE one END AS tokens
  FROM d WHERE doc_id % 10 != 0)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens,
  CAST(sum(chars) AS BIGINT) AS chars
FROM k GROUP BY source, lang, tokenizer
"""
