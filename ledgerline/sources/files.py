"""Small files through the file system of Hadoop: folders on HDFS, object stores and disks alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerline.sources.workspace import delete, file_system

__all__ = ["create", "delete", "names", "read"]


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def create(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new file; fails if there is one, so only one of several writers succeeds."""
    stream = file_system(spark, path).create(_path(spark, path), False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def read(spark: SparkSession, path: str) -> str:
    stream = file_system(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder; none if it does not exist."""
    files, where = file_system(spark, folder), _path(spark, folder)
    if not files.exists(where):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(where))
