"""Looking at folders through the Hadoop file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _resolve(spark, path)
    return system.exists(hadoop)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if it is there already. Of two writers only one succeeds."""
    system, hadoop = _resolve(spark, path)
    system.mkdirs(hadoop.getParent())
    if not system.createNewFile(hadoop):
        return False
    out = system.create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def remove_folders(spark: SparkSession, pattern: str) -> int:
    """Delete the folders that match a glob pattern; returns how many."""
    system, hadoop = _resolve(spark, pattern)
    found = [status.getPath() for status in system.globStatus(hadoop) or [] if status.isDirectory()]
    for folder in found:
        system.delete(folder, True)
    return len(found)


def partition_values(spark: SparkSession, root: str, column: str) -> list[str]:
    """Values of the ``column=value`` folders right below ``root``; none if it is missing."""
    system, hadoop = _resolve(spark, f"{root}/{column}=*")
    found = system.globStatus(hadoop) or []
    return [status.getPath().getName().split("=", 1)[1] for status in found if status.isDirectory()]


def newest_text(spark: SparkSession, folder: str) -> tuple[str | None, str]:
    """Name of the last file (by name) of a folder, and the text of the last one that is not empty.

    A file that its writer has created but not filled yet counts for the name only.
    """
    system, hadoop = _resolve(spark, folder)
    if not system.exists(hadoop):
        return None, ""
    files = sorted(((s.getPath().getName(), s) for s in system.listStatus(hadoop) if s.isFile()), key=lambda f: f[0], reverse=True)
    for _, status in files:
        if status.getLen():
            source = system.open(status.getPath())
            try:
                return files[0][0], spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            finally:
                source.close()
    return (files[0][0] if files else None), ""
