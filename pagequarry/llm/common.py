"""What several operators share: table reading, per-row Python steps, label samples, folders."""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words by their ASCII letters and digits and every character beyond ASCII (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z to a-z and nothing else, as a table for str.translate.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="pagequarry-llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a folder of its own machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id's text modulo ``divisor``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def map_rows(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], Callable[..., tuple]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] = (),
) -> DataFrame:
    """One output row per input row: the ``keep`` columns and what the step returns.

    ``make`` is called once per task and returns the step, so state built by it (a cache, an
    automaton) serves the whole task. Nulls reach the step as None.
    """
    kept = [df.schema[c] for c in keep]
    slim = df.select(*dict.fromkeys([*keep, *inputs]))
    schema = T.StructType([*kept, *fields])
    names, kinds = [f.name for f in fields], [_arrow(f.dataType) for f in fields]
    inputs, keep = list(inputs), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = [step(*x) for x in zip(*(batch.column(c).to_pylist() for c in inputs))]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *made], [*keep, *names]
            )

    return slim.mapInArrow(run, schema)


def flat_map_rows(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], Callable[..., Sequence[tuple]]],
    fields: Sequence[T.StructField],
    rows_at_once: int = 20_000,
) -> DataFrame:
    """Any number of output rows per input row, in batches of bounded size."""
    slim = df.select(*inputs)
    schema = T.StructType(list(fields))
    names, kinds = [f.name for f in fields], [_arrow(f.dataType) for f in fields]
    inputs = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held = make(), []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names
            )

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in inputs)):
                held.extend(step(*x))
                if len(held) >= rows_at_once:
                    yield emit(held)
                    held = []
        if held:
            yield emit(held)

    return slim.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def worker_state(key: object, make: Callable[[], object]):
    """What a Python worker keeps from one task to the next; the last key only.

    Functions travel by value, so variables of their modules last for one task.
    """
    kept = sys.modules.setdefault("pagequarry_worker_state", types.ModuleType("pagequarry_worker_state"))
    if getattr(kept, "key", None) != key:
        kept.key, kept.value = key, make()
    return kept.value


def label_sample(
    labels: DataFrame, label: Column, limit: int, learn: Column | None = None
) -> DataFrame:
    """At most ``limit`` labelled ids: doc_id, label. The smallest ids by a fixed hash.

    ``learn`` says which rows may be learned from. An id labelled more than once counts once,
    with its largest label; null ids and null labels do not count.
    """
    rows = labels if learn is None else labels.filter(learn)
    single = (
        rows.select("doc_id", label.alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    return single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, label of the sampled ids. The sample is small by its limit."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")
