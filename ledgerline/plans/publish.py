"""Publishing: write a version, audit what was written, then switch all tables at once.

A version is a folder of its own, ``data/<version id>/<zone>/<table>``. When all of its tables
are written, they are read back: every table must hold the rows that its job has written, and
the given checks (key constraints) run over the files themselves. Then one small file,
``versions/<number>.json``, is created, which is the switch: readers take the highest number,
so they see all tables of one version, the old one or the new one. Of two publishers at a time
one finds its number taken and fails. Whatever fails before leaves the old version as it was.

For SQL there are views ``<name>_<zone>.<table>``. ``register`` points them to a version, in any
session; it refuses databases that belong to another root. Views are replaced one by one; a
crash in between is mended by the next ``register``, while ``read`` never mixes versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources import files

Zones = dict[str, dict[str, DataFrame]]

ROOT_PROPERTY = "ledgerline.root"


class PublishError(RuntimeError):
    """A version was not published; readers keep the one they have."""


def _number(name: str) -> int:
    return int(name.removesuffix(".json"))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, the latest one last."""
    found = files.names(spark, f"{root.rstrip('/')}/versions")
    return sorted(_number(name) for name in found if name.endswith(".json"))


def _manifest(spark: SparkSession, root: str, version: int | None) -> dict:
    known = versions(spark, root)
    if not known:
        raise PublishError(f"nothing is published below {root}")
    wanted = known[-1] if version is None else version
    return json.loads(files.read(spark, f"{root.rstrip('/')}/versions/{wanted:010d}.json"))


def read(spark: SparkSession, root: str, version: int | None = None) -> Zones:
    """All tables of one version, the latest unless another is named."""
    manifest = _manifest(spark, root, version)
    folder = f"{root.rstrip('/')}/{manifest['folder']}"
    return {
        zone: {table: spark.read.parquet(f"{folder}/{zone}/{table}") for table in tables}
        for zone, tables in manifest["rows"].items()
    }


def _write(df: DataFrame, path: str) -> int:
    """Writes a table and returns the rows that its job has counted."""
    written = Observation()
    df.observe(written, F.count("*").alias("rows")).write.mode("errorifexists").parquet(path)
    return written.get["rows"]


def publish(
    spark: SparkSession, zones: Zones, root: str, name: str, checks: Callable[[Zones], None]
) -> int:
    """Writes, audits and publishes all tables; returns the number of the version."""
    root = root.rstrip("/")
    for zone in zones:
        _require_own(spark, f"{name}_{zone}", root)
    known = versions(spark, root)
    version = known[-1] + 1 if known else 1
    folder = f"data/{uuid.uuid4().hex}"
    try:
        rows = {
            zone: {table: _write(df, f"{root}/{folder}/{zone}/{table}") for table, df in tables.items()}
            for zone, tables in zones.items()
        }
        stored = {
            zone: {table: spark.read.parquet(f"{root}/{folder}/{zone}/{table}") for table in tables}
            for zone, tables in zones.items()
        }
        _audit(stored, rows)
        checks(stored)
        manifest = json.dumps({"version": version, "folder": folder, "rows": rows})
        files.create(spark, f"{root}/versions/{version:010d}.json", manifest)
    except BaseException:
        files.delete(spark, f"{root}/{folder}")
        raise
    register(spark, root, name, version)
    return version


def _audit(stored: Zones, rows: dict[str, dict[str, int]]) -> None:
    wrong = []
    for zone, tables in stored.items():
        for table, df in tables.items():
            # Counted from the footers of the files.
            found = df.count()
            if found != rows[zone][table]:
                wrong.append(f"{zone}.{table}: {found} rows read, {rows[zone][table]} written")
    if wrong:
        raise PublishError("; ".join(wrong))


def _owner(spark: SparkSession, database: str) -> str | None:
    """The root that a database belongs to; None if there is no such database."""
    if not spark.catalog.databaseExists(database):
        return None
    described = spark.sql(f"DESCRIBE DATABASE EXTENDED `{database}`").collect()
    properties = next((r[1] for r in described if r[0] == "Properties"), "")
    marked = f"({ROOT_PROPERTY},"
    return properties.split(marked)[1].split(")")[0] if marked in properties else ""


def _require_own(spark: SparkSession, database: str, root: str) -> None:
    owner = _owner(spark, database)
    if owner not in (None, root):
        raise PublishError(f"database {database} belongs to {owner or 'something else'}, not to {root}")


def register(spark: SparkSession, root: str, name: str, version: int | None = None) -> None:
    """Points the views of databases ``<name>_<zone>`` to a version, the latest by default."""
    root = root.rstrip("/")
    manifest = _manifest(spark, root, version)
    for zone, tables in manifest["rows"].items():
        database = f"{name}_{zone}"
        _require_own(spark, database, root)
        spark.sql(
            f"CREATE DATABASE IF NOT EXISTS `{database}` WITH DBPROPERTIES ('{ROOT_PROPERTY}' = '{root}')"
        )
        for table in tables:
            path = f"{root}/{manifest['folder']}/{zone}/{table}"
            spark.sql(
                f"CREATE OR REPLACE VIEW `{database}`.`{table}` AS SELECT * FROM parquet.`{path}`"
            )


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Deletes all but the latest versions, their manifests first; returns the numbers deleted."""
    root = root.rstrip("/")
    gone = versions(spark, root)[: -max(keep, 1)]
    for version in gone:
        folder = _manifest(spark, root, version)["folder"]
        files.delete(spark, f"{root}/versions/{version:010d}.json")
        files.delete(spark, f"{root}/{folder}")
    return gone
