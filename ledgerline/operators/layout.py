"""Tables laid out for lookups, in place of secondary indexes.

A layout is a table of the catalog in partitions. The catalog prunes partitions, so a lookup
lists the directory of one; the statistics of row groups and the page index do the rest.
Partitions are a value of the rows themselves, such as the month of a date, or for keys of
any kind a hash of the key. Range partitions are cut on the partition, the key and a unique
column behind it, so a key with very many rows spreads over several files.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.catalog import Catalog, table_bytes

PART = "part"
# Hashed partitions of a layout, at least; more for larger tables.
LEAST_PARTS = 16
PART_BYTES = 512 << 20
ROWS_PER_FILE = 1_000_000

# Small row groups and pages: a lookup reads one of them, not a whole file.
SMALL_ROW_GROUPS = {"parquet.block.size": str(1024 * 1024), "parquet.page.size": str(64 * 1024)}


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def parts_for(table: DataFrame) -> int:
    """Hashed partitions for the rows of a stored table, in proportion to its files."""
    return max(LEAST_PARTS, -(-table_bytes(table) // PART_BYTES))


@dataclass(frozen=True)
class Layout:
    """A partitioned table of the catalog, sorted by ``key`` within its partitions.

    ``partition`` is the column that parts it; ``parts`` is how many there are if it is a hash
    of the key, else None, and ``partition_of`` gives the partition of a key as SQL.
    """

    table: DataFrame
    key: str
    partition: str
    parts: int | None = None
    partition_of: str | None = None

    @property
    def rows(self) -> DataFrame:
        return self.table.drop(self.partition)

    def of(self, value: Any, *columns: str | Column) -> DataFrame:
        """The given columns (else all) of the rows of one key."""
        kind = self.table.schema[self.key].dataType
        wanted = F.lit(value).cast(kind)
        if self.parts is not None:
            part = part_of(wanted, self.parts)
        else:
            part = F.expr(self.partition_of.format(key=f"CAST('{value}' AS {kind.simpleString()})"))
        here = (F.col(self.partition) == part) & (F.col(self.key) == wanted)
        names = columns or tuple(name for name in self.table.columns if name != self.partition)
        return self.table.where(here).select(*names)


def laid_out(
    df: DataFrame,
    catalog: Catalog,
    name: str,
    order: list[str],
    parts: int | None = None,
    by: tuple[str, str] | None = None,
    rows_per_file: int = ROWS_PER_FILE,
    bloom_filter: str | None = None,
) -> Layout:
    """``df`` written for lookups by the first column of ``order``.

    ``by`` names a partition and says in SQL what it is of a key; otherwise partitions are
    ``parts`` hashes (see ``parts_for``). Files hold at most ``rows_per_file`` rows; the width of the shuffle is the session's. ``bloom_filter`` names a
    further column that row groups can be skipped by.
    """
    options = dict(SMALL_ROW_GROUPS) | {"maxRecordsPerFile": str(rows_per_file)}
    if bloom_filter:
        options[f"parquet.bloom.filter.enabled#{bloom_filter}"] = "true"
    key = order[0]
    if by:
        partition, partition_of = by
        placed = df.withColumn(partition, F.expr(partition_of.format(key=f"`{key}`")))
    else:
        partition, partition_of = PART, None
        parts = parts or LEAST_PARTS
        placed = df.withColumn(partition, part_of(F.col(key), parts))
    ranged = placed.repartitionByRange(partition, *order).sortWithinPartitions(partition, *order)
    table = catalog.save(name, ranged, partition_by=(partition,), options=options)
    return Layout(table, key, partition, parts, partition_of)
