"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import normalize
from pagequarry.settings import WHITESPACE


# Expressions used inside lambdas are written as SQL text: one call to the JVM instead of
# hundreds. These make its parts.


def sql_text(value: str) -> str:
    """String literal."""
    return "'" + "".join(c if c.isalnum() and c.isascii() else f"\\u{ord(c):04x}" for c in value) + "'"


def sql_let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once however often it is used.

    Inside lambdas Spark evaluates an expression again at each use; a lambda parameter is
    evaluated once.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_strip(text: str) -> str:
    return f"trim(BOTH {sql_text(WHITESPACE)} FROM {text})"


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace, by Python's idea of whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Runs of blanks and tabs become one blank, runs of newlines one newline; then strip.

    Most texts have no such runs, and looking for two bytes is far cheaper than a pattern.
    """
    blanks = F.regexp_replace(text, r"[ \t]+", " ")
    spaced = F.when(text.contains("  ") | text.contains("\t"), blanks).otherwise(text)
    lines = F.regexp_replace(spaced, r"\n{2,}", "\n")
    return strip(F.when(text.contains("\n\n"), lines).otherwise(spaced))


def clean_text(table: DataFrame, column: str, into: str) -> DataFrame:
    """``table`` plus ``into``: the column NFKC-normalised, collapsed and stripped; "" for null."""
    read = normalize(table.withColumn(into, F.col(column)), [into])
    return read.withColumn(into, F.coalesce(collapse(F.col(into)), F.lit("")))
