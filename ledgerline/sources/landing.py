"""Landing of raw exports in one pass: good rows, damaged lines, and how many there are of each.

Files are read once, as lines, and a line is parsed with the columns of the export. It is
damaged if it has another number of fields, or if a quote stays open in it (a quoted field that
goes on in the next line leaves one open in both). One job writes all lines, parted by their
damage, and an observation of that job counts them. Damaged lines keep their text and the name
of their file, good ones their fields only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.export import (
    DAMAGE, RAW_COLUMNS, STAGING_COLUMNS, MalformedExportError, read_fields,
)
from ledgerline.sources.workspace import Workspace

NONE, FIELDS, QUOTE = "none", "fields", "quote"
# As the reader of whole files, but for one line.
LINE_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": DAMAGE,
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# Damaged lines that an error shows.
SHOWN = 3


@dataclass(frozen=True)
class Landing:
    """Staging rows, damaged lines (``damage``, ``line``, ``file``), counters of the job."""

    staging: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]

    @property
    def damaged(self) -> int:
        return self.counts["wrong_field_count"] + self.counts["open_quotes"]


def _from_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row`` (its fields), ``line``, ``file`` and ``damage`` of each line but headers."""
    columns = ", ".join(f"`{name}` STRING" for name in (*RAW_COLUMNS, DAMAGE))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    row = F.col("row")
    header = reduce(Column.__and__, [row[name].eqNullSafe(F.lit(name)) for name in RAW_COLUMNS])
    damage = F.when(quotes % 2 == 1, QUOTE).when(row[DAMAGE].isNotNull(), FIELDS).otherwise(NONE)
    return (
        spark.read.text(path)
        .select(
            # A byte order mark, and what is left of a line break.
            F.regexp_replace("value", "^﻿|\r$", "").alias("line"),
            F.col("_metadata.file_path").alias("file"),
        )
        .where(F.trim("line") != "")
        .withColumn("row", F.from_csv("line", columns, LINE_OPTIONS))
        .withColumn("damage", damage)
        .where(~(header & (F.col("damage") == NONE)))
    )


def _from_records(spark: SparkSession, path: str) -> DataFrame:
    """The same of records that may go over several lines; a file is one task."""
    fields = read_fields(spark, path, multi_line=True).select("*", F.col("_metadata.file_path").alias("file"))
    return fields.select(
        F.struct(*RAW_COLUMNS).alias("row"),
        F.col(DAMAGE).alias("line"),
        "file",
        F.when(F.col(DAMAGE).isNotNull(), FIELDS).otherwise(NONE).alias("damage"),
    )


def land_csv(
    spark: SparkSession,
    path: str,
    workspace: Workspace,
    multi_line: bool = False,
    allow_damaged: bool = False,
) -> Landing:
    """Lands the export below ``path``; damaged lines stop it unless they are allowed.

    They are written either way, so the error names the table that holds them. Columns are
    taken by position; a line that repeats the header is none of the rows.
    """
    lines = _from_records(spark, path) if multi_line else _from_lines(spark, path)
    good = F.col("damage") == NONE
    fields = [
        F.when(good, F.coalesce(F.col("row")[raw], F.lit(""))).alias(name)
        for raw, name in RAW_COLUMNS.items()
    ]
    text = [F.when(~good, F.col(name)).alias(name) for name in ("line", "file")]
    landed = Observation()
    counted = lines.select(*fields, *text, "damage").observe(
        landed,
        F.count("*").alias("total_rows"),
        F.count_if(F.col("damage") == FIELDS).alias("wrong_field_count"),
        F.count_if(F.col("damage") == QUOTE).alias("open_quotes"),
    )
    table = workspace.table("landed", lambda: counted, partition_by=["damage"])
    found = Landing(
        table.where(good).select(*STAGING_COLUMNS),
        table.where(~good).select("damage", "line", "file"),
        dict(landed.get),
    )
    if found.damaged and not allow_damaged:
        shown = [f"{r.damage} in {r.file}: {r.line}" for r in found.quarantine.limit(SHOWN).collect()]
        raise MalformedExportError(
            f"{path}: {found.counts}; all damaged lines are in {workspace.path('landed')}; {shown}"
        )
    return found
