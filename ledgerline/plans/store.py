"""Orders and order items, stored so that they meet by order number without a shuffle.

Both are tables in equally many buckets of the order number, one sorted file each, so a
join, a grouping or a key check by order reads bucket by bucket. A bucket is one task, which
cannot be split. Orders with more than ``HOT_ROWS`` rows therefore keep their items in a table
of their own, without buckets: there are at most as many of them as rows over ``HOT_ROWS``,
their headers are written beside, and that join is left to Spark, which broadcasts the headers
by their true size or splits the skewed partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.checks import cascade_exclude
from ledgerline.sources.catalog import Catalog, table_bytes

KEY = "increment_id"
# Rows of an order from which on its items are stored apart.
HOT_ROWS = 1_000_000
# Staging bytes that one bucket stands for.
BUCKET_BYTES = 128 << 20
MOST_BUCKETS = 100_000


@dataclass(frozen=True)
class OrderStore:
    """Orders, items of usual orders, and headers and items of hot ones, if there are any."""

    orders: DataFrame
    usual_items: DataFrame
    hot_orders: DataFrame | None = None
    hot_items: DataFrame | None = None

    @property
    def items(self) -> DataFrame:
        if self.hot_items is None:
            return self.usual_items
        return self.usual_items.unionByName(self.hot_items)

    def join(self, header: Callable[[DataFrame], DataFrame], how: str = "inner") -> DataFrame:
        """All items joined by order number with what ``header`` makes of their orders."""
        joined = self.usual_items.join(header(self.orders), KEY, how)
        if self.hot_items is None:
            return joined
        return joined.unionByName(self.hot_items.join(header(self.hot_orders), KEY, how))


def bucket_count(staging: DataFrame) -> int:
    """In proportion to the table; at least the width of the session's shuffles."""
    width = int(staging.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKETS, max(width, -(-table_bytes(staging) // BUCKET_BYTES)))


def hot_orders(order_flags: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Numbers of orders with more rows than that."""
    rows = order_flags.groupBy(KEY).agg(F.sum("rows").alias("rows"))
    return rows.where(F.col("rows") > hot_rows).select(KEY)


def save_store(
    catalog: Catalog, orders: DataFrame, items: DataFrame, hot: DataFrame, buckets: int
) -> OrderStore:
    """Writes orders and items; ``hot`` is a written table of the orders to store apart."""

    def bucketed(name: str, rows: DataFrame) -> DataFrame:
        # Dealt as buckets are, so each of them is one file.
        return catalog.save(name, rows.repartition(buckets, KEY), bucket_by=(buckets, KEY))

    stored = bucketed("orders", orders)
    if hot.isEmpty():
        return OrderStore(stored, bucketed("order_items", items))
    columns = items.columns
    usual = bucketed("order_items", cascade_exclude(items, hot, KEY).select(*columns))
    headers = stored.join(hot, KEY, "left_semi").select(*stored.columns)
    apart = items.join(hot, KEY, "left_semi").select(*columns)
    return OrderStore(
        stored, usual, catalog.save("hot_orders", headers), catalog.save("hot_order_items", apart)
    )
