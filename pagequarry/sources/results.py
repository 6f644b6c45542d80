"""Result tables as files: JSON in the stored form, or Parquet."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagequarry import settings as S
from pagequarry.operators.reports import utc_text
from pagequarry.schemas import RESULT_COLUMNS, RESULTS


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 in UTC; microseconds only where there are any."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.when(whole, utc_text(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        utc_text(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )


def serialize(results: DataFrame) -> DataFrame:
    """The nine stored fields in their order, without markup, time as text."""
    return results.withColumn("scraped_at", iso_timestamp(F.col("scraped_at"))).select(
        *RESULT_COLUMNS
    )


def write_json(results: DataFrame, path: str) -> None:
    """One JSON document per line; nulls are written, text is kept as it is."""
    serialize(results).write.option("ignoreNullFields", False).json(path)


def write_parquet(results: DataFrame, path: str) -> None:
    """Typed results; keeps any further columns, such as the storage key."""
    results.write.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# a value of its own, as the reading step travels to the executors without the package
_NO_STATUS = S.NO_STATUS


def _time(value: object) -> datetime:
    """A time text as ``datetime.fromisoformat`` reads it, without an offset as UTC; else now."""
    if not isinstance(value, str) or not value:
        return datetime.now(timezone.utc)
    time = datetime.fromisoformat(value)
    return time.astimezone(timezone.utc) if time.tzinfo else time.replace(tzinfo=timezone.utc)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _read_document(text: str | None) -> dict:
    """The fields of one stored document, or why it was refused."""
    try:
        data = json.loads(text if text is not None else "")
        if not isinstance(data, dict):
            raise ValueError("the document is no object")
        status, links = data.get("status_code", _NO_STATUS), data.get("links", [])
        return {
            "url": _text(data.get("url", "")),
            "status_code": int(status) if isinstance(status, int) and abs(status) < 1 << 31 else None,
            "title": _text(data.get("title", "")),
            "content": _text(data.get("content", "")),
            "links": [_text(x) for x in links] if isinstance(links, list) else None,
            "success": s if isinstance(s := data.get("success", False), bool) else None,
            "error": _text(data.get("error")),
            "scraped_at": _time(data.get("scraped_at")),
            "used_browser": b if isinstance(b := data.get("used_browser", False), bool) else None,
        }
    except (ValueError, RecursionError, OverflowError) as e:
        return {"refused": f"{type(e).__name__}: {e}"}


def read_documents(documents: DataFrame, column: str = "value") -> DataFrame:
    """Every row of ``documents`` with the fields of its JSON document and ``refused``.

    A document is read as Python's ``json`` and ``datetime.fromisoformat`` read it, whatever
    its size: of repeated keys the last counts, NaN is a number, a missing key takes its
    default while an explicit null stays null. A time that is missing or not text becomes
    now. A document that cannot be read keeps its row: its fields are null and
    ``refused`` says why. Values of another type than the field's become null, or JSON text.
    """
    valid = F.is_valid_utf8(F.col(column))
    kept = [f for f in documents.schema if f.name != column and f.name not in RESULT_COLUMNS]
    source = documents.select(
        *(f.name for f in kept), F.when(valid, F.col(column)).alias(column), valid.alias("__valid")
    )
    fields = [*RESULTS.fields, T.StructField("refused", T.StringType())]
    kinds = {f.name: to_arrow_type(f.dataType, timestamp_utc=True) for f in fields}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"refused": "the document is no UTF-8"} if valid is False else _read_document(text)
                for text, valid in zip(batch.column(column).to_pylist(), batch.column("__valid").to_pylist())
            ]
            made = [pa.array([r.get(n) for r in rows], kind) for n, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *made], [*(f.name for f in kept), *kinds]
            )

    return source.mapInArrow(read, T.StructType([*kept, *fields]))


def parse_documents(documents: DataFrame, column: str = "value") -> DataFrame:
    """Results of the documents that can be read; ``read_documents`` also has the others."""
    return read_documents(documents, column).filter("refused IS NULL").select(*RESULT_COLUMNS)


def refused_documents(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Path and reason of stored documents that cannot be read."""
    files = spark.read.text(path, wholetext=one_per_file)
    named = files.select("value", F.col("_metadata.file_path").alias("path"))
    return read_documents(named).filter("refused IS NOT NULL").select("path", "refused")


def read_json(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Stored results, one document per line or (indented or not) one per file."""
    return parse_documents(spark.read.text(path, wholetext=one_per_file))
