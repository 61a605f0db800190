"""Tables written once to the cluster's shared folder and read back from there."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER_SETTING = "spark.checkpoint.dir"
WAREHOUSE_SETTING = "spark.sql.warehouse.dir"
# Says that a file: folder is a mount that all machines share, so that it is not tried out.
SHARED_MOUNT_SETTING = "spark.ledgerline.sharedMount"
# Tasks per core that write to a folder to find out whether it is shared.
TRIAL_TASKS = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read.

    It is the first of these that they share: the one that the session names in
    ``spark.checkpoint.dir``, the one of ``SparkContext.setCheckpointDir``, that of the
    warehouse. What is written to a folder that is not shared would be lost without an error,
    so on a cluster a folder of disks is tried out before it is used. A local master, where
    driver and executors are one process, takes the named folder or a temporary one.
    """
    named = [spark.conf.get(SHARED_FOLDER_SETTING, None), _checkpoint_folder(spark)]
    if _is_one_process(spark):
        return next((x.rstrip("/") for x in named if x), None) or tempfile.mkdtemp(prefix="ledgerline-")
    folders = [x.rstrip("/") for x in (*named, spark.conf.get(WAREHOUSE_SETTING, None)) if x]
    mounted = spark.conf.get(SHARED_MOUNT_SETTING, "false") == "true"
    for folder in folders:
        if mounted or _scheme(spark, folder) != "file" or _is_shared(spark, folder):
            return folder
    raise RuntimeError(
        f"set {SHARED_FOLDER_SETTING} to a folder that all executors share; not shared are: {folders}"
    )


def _is_one_process(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")) is not None


def _checkpoint_folder(spark: SparkSession) -> str | None:
    context = getattr(spark, "sparkContext", None)
    return context.getCheckpointDir() if context else None


_tried: dict[tuple[str, str], bool] = {}
_tried_lock = threading.Lock()


def _is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether rows that tasks write below ``folder`` are found there again, tried once per application."""
    key = (spark.sparkContext.applicationId, folder)
    with _tried_lock:
        if key not in _tried:
            _tried[key] = _finds_what_it_wrote(spark, f"{folder.rstrip('/')}/ledgerline/trial-{uuid.uuid4().hex}")
        return _tried[key]


def _finds_what_it_wrote(spark: SparkSession, path: str) -> bool:
    tasks = TRIAL_TASKS * spark.sparkContext.defaultParallelism
    try:
        # A file per task: those that another machine keeps to itself are missing below.
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == tasks
    except (PySparkException, Py4JJavaError):
        return False
    finally:
        delete(spark, path)


def _scheme(spark: SparkSession, folder: str) -> str:
    return urlsplit(folder).scheme or file_system(spark, folder).getScheme()


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it exists."""
    file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(bytes, files, time of the last change) of a file or folder."""
    files = file_system(spark, path)
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    summary = files.getContentSummary(found)
    return (
        summary.getLength(), summary.getFileCount(), files.getFileStatus(found).getModificationTime()
    )


class Kept:
    """Written folders and what they held then, to tell whether any has lost files since."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._contents: dict[str, tuple[int, int]] = {}

    def _found(self, path: str) -> tuple[int, int]:
        return fingerprint(self.spark, path)[:2]

    def add(self, path: str) -> None:
        self._contents[path] = self._found(path)

    def is_whole(self) -> bool:
        """Whether every folder is there with as many files and bytes as were written."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for path, contents in list(self._contents.items()):
            found = files.Path(path)
            if not file_system(self.spark, path).exists(found) or self._found(path) != contents:
                return False
        return True

    def clear(self) -> None:
        self._contents.clear()


class Workspace:
    """Named Parquet tables below one folder.

    A written table cuts the lineage, survives lost executors, and gives the
    optimizer the table's true size, on which it decides whether to broadcast.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/ledgerline/{label}-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}
        self._folders: set[str] = set()
        self._kept = Kept(spark)
        self._lock = threading.RLock()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def scope(self, label: str) -> Workspace:
        """A fresh workspace inside this one: its names are those of one call only."""
        inner = object.__new__(Workspace)
        inner.spark = self.spark
        inner.root = f"{self.root}/{label}-{uuid.uuid4().hex}"
        inner._tables, inner._folders, inner._lock = {}, set(), threading.RLock()
        inner._kept = self._kept
        return inner

    def is_whole(self) -> bool:
        """Whether all that was written here, scopes included, is still there."""
        return self._kept.is_whole()

    def close(self) -> None:
        """Deletes all that was written here, scopes included."""
        with self._lock:
            self._tables.clear()
            self._folders.clear()
            self._kept.clear()
            delete(self.spark, self.root)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def table(
        self,
        name: str,
        build: Callable[[], DataFrame],
        options: dict[str, str] | None = None,
        partition_by: list[str] | None = None,
    ) -> DataFrame:
        """The table ``name``; built and written the first time it is asked for."""
        with self._lock:
            if name not in self._tables:
                rows = build()
                writer = rows.write.mode("overwrite").options(**(options or {}))
                if partition_by:
                    writer = writer.partitionBy(*partition_by)
                writer.parquet(self.path(name))
                self._kept.add(self.path(name))
                reader = self.spark.read.schema(rows.schema)
                self._tables[name] = reader.parquet(self.path(name))
            return self._tables[name]

    def has(self, name: str) -> bool:
        with self._lock:
            return name in self._tables

    def keep(self, name: str, table: DataFrame) -> None:
        """Takes a table that is stored elsewhere under ``name``, without a copy."""
        with self._lock:
            self._tables[name] = table

    def folder(self, name: str, write: Callable[[str], None]) -> str:
        """The path ``name``; filled by ``write`` the first time it is asked for."""
        with self._lock:
            if name not in self._folders:
                write(self.path(name))
                self._kept.add(self.path(name))
                self._folders.add(name)
            return self.path(name)
