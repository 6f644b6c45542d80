"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("use_browser", T.BooleanType()),
        T.StructField("timeout", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("use_browser", T.BooleanType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("scraped_at", T.TimestampType()),
        T.StructField("used_browser", T.BooleanType()),
    ]
)

RESULT_COLUMNS = RESULTS.fieldNames()

# One page as its elements and text runs (see functions.dom).
DOM = T.StructType(
    [
        T.StructField(
            "scopes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tags", T.ArrayType(T.StringType())),
                        T.StructField("kind", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "elements",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tag", T.StringType()),
                        T.StructField("scope", T.IntegerType()),
                        T.StructField("first", T.IntegerType()),
                        T.StructField("last", T.IntegerType()),
                        T.StructField("href", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "texts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("text", T.StringType()),
                        T.StructField("scope", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)
