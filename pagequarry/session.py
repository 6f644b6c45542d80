"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Settings that matter for these jobs. All can be changed at run time.
RUNTIME_SETTINGS = {
    # results carry UTC instants
    "spark.sql.session.timeZone": "UTC",
    # pages are wide rows: bound an Arrow batch by rows and by bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
    # coalescing and skew splitting at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch as ``tune`` does, where the session allows more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(RUNTIME_SETTINGS[name])
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


@cache
def _own_folder() -> str:
    """Folder of this process for a local session, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="pagequarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """Session for tests and single-machine runs."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagequarry")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", _own_folder())
        # recording the Python line of every column operation costs several calls to the JVM
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    return tune(builder.getOrCreate())


def work_folder(spark: SparkSession) -> str:
    """New folder below ``spark.checkpoint.dir``, the one all executors share.

    Only a session whose executors are this process may do without that setting: it gets a
    folder that goes when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/pagequarry-{uuid.uuid4().hex}"
