"""Tables of one database of the session's catalog, stored below one folder.

A table that the catalog knows keeps more than its files: how it is bucketed, so that equal
keys of two tables meet without a shuffle, and which partitions it has, so that a lookup
asks for one and lists its directory only.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.workspace import Kept


def new_database(label: str) -> str:
    return f"ledgerline_{label}_{uuid.uuid4().hex}"


class Catalog:
    """The database ``name``, created with its first table."""

    def __init__(self, spark: SparkSession, name: str, folder: str):
        self.spark = spark
        self.name = name
        self.folder = folder.rstrip("/")
        self._exists = False
        self._kept = Kept(spark)
        self._lock = threading.Lock()

    def _create(self) -> None:
        with self._lock:
            if not self._exists:
                self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.name}` LOCATION '{self.folder}'")
                self._exists = True

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def save(
        self,
        table: str,
        df: DataFrame,
        partition_by: tuple[str, ...] = (),
        bucket_by: tuple[int, str] | None = None,
        options: dict[str, str] | None = None,
    ) -> DataFrame:
        """Writes ``df`` as ``table`` and returns it as the catalog reads it."""
        self._create()
        writer = df.write.mode("overwrite").format("parquet").options(**(options or {}))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if bucket_by:
            buckets, key = bucket_by
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.option("path", self.path(table)).saveAsTable(f"`{self.name}`.`{table}`")
        self._kept.add(self.path(table))
        return self.table(table)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"`{self.name}`.`{table}`")

    def is_whole(self) -> bool:
        """Whether the files of all its tables, and the database, are still there."""
        known = not self._exists or self.spark.catalog.databaseExists(self.name)
        return known and self._kept.is_whole()

    def drop(self) -> None:
        """Forgets the database and its tables; the files stay."""
        with self._lock:
            self.spark.sql(f"DROP DATABASE IF EXISTS `{self.name}` CASCADE")
            self._exists = False
            self._kept.clear()


def table_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of ``df``; the size of its files if it is a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
