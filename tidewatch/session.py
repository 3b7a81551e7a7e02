"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.errors import SharedFolderError

# Event times are UTC instants; adaptive execution splits skewed join partitions
# and sizes shuffle partitions at run time.
_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; safe to call on a session that is already in use."""
    for key, value in _RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_own_dir: str | None = None
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests on one machine)
    a local folder is made, and removed when the process ends. Elsewhere the setting is required: other machines
    would not see a local folder.
    """
    global _own_dir
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise SharedFolderError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="tidewatch-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        folder = _own_dir
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``remove_scratch`` deletes it."""
    path = f"{shared_dir(spark)}/tidewatch/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has made so far; returns how many were there.

    Call it when results that read them lazily have been written.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def settled(rows: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    For results much smaller than their input that a larger join uses next: they
    survive the loss of executors, are computed once, and their size is known when
    Spark plans the join, so a small side is broadcast and a large one is not.
    """
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
