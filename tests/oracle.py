"""Compare a query with its SQL check: same columns, types and rows."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
DUCK_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "BOOLEAN": "boolean", "INTEGER": "int", "DOUBLE": "double"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        if name in TABLES:
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def differences(frame, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    types = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    found = []
    if dict(frame.dtypes) != types:
        found.append(f"schema {dict(frame.dtypes)} vs {types}")
    columns = sorted(frame.columns)
    if columns != sorted(relation.columns):
        return found
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    theirs = sorted(
        repr(tuple(r)) for r in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    )
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows vs {len(theirs)}")
    mine, yours = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
    if ours != theirs:
        found.append(f"{len(mine)} differing rows, such as {mine[:1]} vs {yours[:1]}")
    return found
