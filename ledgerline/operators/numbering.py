"""Row numbers and quantile groups over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.workspace import Workspace

def in_ranges(df: DataFrame, order: list[str], workspace: Workspace, name: str) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written, with its partition as ``range_no``.

    Writing settles which partition a row is in, also for tasks that run again.
    """
    return workspace.table(
        name,
        lambda: df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()),
    )


def row_number_in_ranges(
    ranged: DataFrame, order: list[str], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Adds ``row_number``, the 1-based position of each row in ``order``, per value of ``keys``.

    The number is the size of the earlier ranges plus the position inside the
    row's own. Both are computed per range, so a key that fills many ranges is
    never in one task; sizes are one row per range and key.
    """
    piece = ["range_no", *keys]
    earlier = (
        Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        ranged.groupBy(*piece)
        .count()
        .select(*piece, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    )
    inside = F.row_number().over(Window.partitionBy(*piece).orderBy(*order))
    return (
        ranged.withColumn("inside", inside)
        .join(starts, piece)
        .withColumn("row_number", F.col("before") + F.col("inside"))
        .drop("inside", "before")
    )


def global_row_number(
    df: DataFrame, order: list[str], workspace: Workspace, name: str
) -> DataFrame:
    """Adds ``row_number``, the position of each row of the whole table in ``order``."""
    ranged = in_ranges(df, order, workspace, name)
    return row_number_in_ranges(ranged, order).drop("range_no")


def add_ntiles(
    df: DataFrame, orders: dict[str, list[str]], buckets: int, workspace: Workspace
) -> DataFrame:
    """Adds one ``ntile`` column per entry of ``orders``, from the row number in that order.

    Each order must be total. The number of rows is a subquery with one value. Names
    are scoped to this call, so a workspace may serve several tables.
    """
    scope = workspace.scope("ntiles")
    rows = df.agg(F.count("*")).scalar()
    size, larger = F.floor(rows / buckets), rows % buckets
    for name, order in orders.items():
        df = global_row_number(df, order, scope, f"ranges_of_{name}")
        position = F.col("row_number") - 1
        in_larger = F.floor(position / (size + 1))
        in_rest = larger + F.floor((position - larger * (size + 1)) / F.greatest(size, F.lit(1)))
        tile = F.when(position < larger * (size + 1), in_larger).otherwise(in_rest) + 1
        df = df.withColumn(name, tile.cast("int")).drop("row_number")
    return df
