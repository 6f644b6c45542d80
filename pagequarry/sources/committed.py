"""A result store that commits: versions of hash buckets, of which a write replaces those it touches.

Rows lie in Parquet below ``data/<write>/bucket=<n>``, by a hash of their storage key. A version is a
small document below ``versions`` that names the folder of each bucket. A write first puts its
rows into a folder of its own, then merges the buckets it touches with what they held, and
at last creates the next version's document, which is what commits it. A write that dies earlier
leaves folders that no version names; readers never see them. Two writers that start from
the same version try to create the same document, and the later one gets ``CommitConflict``.

Readers are pinned to a version and read the folders it names; a lookup reads the buckets of its
keys only. Cost of a write: the batch once, and the touched buckets. What passes the driver is
bounded by the number of buckets.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators import store

BUCKETS = 64


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


class ResultStore:
    """Results by storage key below ``path``, in any file system Spark writes to.

    ``buckets`` counts when the store is begun; later the first version's number holds.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._to_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._to_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils.toString

    # -- versions ----------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        at = self._to_path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _document(self, version: int) -> dict | None:
        """A version's document; None when its writer died before it was whole."""
        stream = self._fs.open(self._to_path(f"{self.path}/versions/{version:010d}.json"))
        try:
            return json.loads(self._text(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names("versions") if n.endswith(".json")]

    def versions(self) -> list[int]:
        """Versions there are, 0 (the empty store) not among them."""
        return [n for n in self._numbers() if self._document(n)]

    def _version(self, version: int | None) -> dict:
        if version is None:
            for n in reversed(self._numbers()):
                if found := self._document(n):
                    return found
            version = 0
        if version == 0:
            return {"version": 0, "buckets": {}, "of": self._buckets, "schema": None, "batches": {}}
        found = self._document(version) if version in self._numbers() else None
        if found is None:
            raise ValueError(f"no version {version}")
        return found

    def current(self) -> int:
        return self._version(None)["version"]

    def _create(self, document: dict) -> None:
        number = max([*self._numbers(), 0]) + 1
        if number > document["version"] and self._version(None)["version"] >= document["version"]:
            raise CommitConflict(f"version {document['version']} is there already")
        document["version"] = number
        try:  # never replaces a document
            stream = self._fs.create(self._to_path(f"{self.path}/versions/{number:010d}.json"), False)
        except Py4JJavaError as e:
            raise CommitConflict(f"version {number} is there already") from e
        stream.write(bytearray(json.dumps(document).encode()))
        stream.close()

    # -- reading -----------------------------------------------------------------------

    def _bucket(self, of: int) -> Column:
        return F.pmod(F.xxhash64("storage_key"), F.lit(of)).cast("int")

    def _rows(self, document: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version, or of some of its buckets."""
        if document["schema"] is None:
            raise ValueError("nothing has been committed yet")
        named = {int(b): folder for b, folder in document["buckets"].items()}
        wanted = named if buckets is None else {b: named[b] for b in buckets if b in named}
        schema = T.StructType.fromJson(document["schema"])
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, one per storage key."""
        return self._rows(self._version(version))

    def _touched(self, keyed: DataFrame, document: dict) -> list[int]:
        found = keyed.select(self._bucket(document["of"]).alias("b")).distinct().collect()
        return [r.b for r in found]

    def lookup(self, requests: DataFrame, request_id: str, version: int | None = None) -> DataFrame:
        """Each request with its stored result, as ``operators.store.lookup``, from its keys' buckets only."""
        document = self._version(version)
        rows = self._rows(document, self._touched(store.with_key(requests), document))
        return store.lookup(requests, rows, request_id)

    # -- writing -----------------------------------------------------------------------

    def _write(self, rows: DataFrame, of: int) -> tuple[str, list[int]]:
        """Folder written, and the buckets in it."""
        folder = f"data/{uuid.uuid4().hex}"
        bucketed = rows.withColumn("bucket", self._bucket(of))
        bucketed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder, [int(n.split("=")[1]) for n in self._names(folder) if n.startswith("bucket=")]

    def _sent(self, document: dict, batch: tuple[str, int] | None) -> bool:
        return batch is not None and document["batches"].get(batch[0], -1) >= batch[1]

    def commit(self, results: DataFrame, order: str = "write_seq", batch: tuple[str, int] | None = None) -> int:
        """Upserts results; within the batch the last by ``order`` wins, and the batch over what is stored.

        ``batch`` names a writer and counts its batches up: a batch sent again is not written again.
        Returns the version that holds the batch.
        """
        document = self._version(None)
        if self._sent(document, batch):
            return document["version"]
        incoming = store.latest(results, order)
        schema = json.loads(incoming.schema.json())
        folder, touched = self._write(incoming, document["of"])
        buckets = dict(document["buckets"])
        held = [b for b in touched if str(b) in buckets]
        if held:
            new = self.spark.read.schema(incoming.schema).parquet(*(f"{self.path}/{folder}/bucket={b}" for b in held))
            kept = self._rows(document, held).join(new.select("storage_key"), "storage_key", "left_anti")
            merged, _ = self._write(kept.unionByName(new, allowMissingColumns=True).select(*incoming.columns), document["of"])
        for b in touched:
            buckets[str(b)] = merged if b in held else folder
        return self._next(document, buckets, schema, batch)

    def delete(self, urls: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Removes the results of ``urls``; returns the version without them."""
        document = self._version(None)
        if self._sent(document, batch) or document["schema"] is None:
            return document["version"]
        keys = store.with_key(urls).select("storage_key").distinct()
        touched = [b for b in self._touched(keys, document) if str(b) in document["buckets"]]
        buckets = dict(document["buckets"])
        if touched:
            left = self._rows(document, touched).join(keys, "storage_key", "left_anti")
            folder, remaining = self._write(left, document["of"])
            for b in touched:
                if b in remaining:
                    buckets[str(b)] = folder
                else:
                    del buckets[str(b)]
        return self._next(document, buckets, document["schema"], batch)

    def _next(self, document: dict, buckets: dict, schema: dict, batch: tuple[str, int] | None) -> int:
        batches = document["batches"] | ({batch[0]: batch[1]} if batch else {})
        made = {"version": document["version"] + 1, "buckets": buckets, "of": document["of"], "schema": schema, "batches": batches}
        self._create(made)
        return made["version"]
