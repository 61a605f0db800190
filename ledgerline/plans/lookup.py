"""Lookups of the model by customer, date, product and order, and the tables that serve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.layout import Layout, laid_out, parts_for
from ledgerline.plans.store import KEY, OrderStore
from ledgerline.sources.catalog import Catalog

COLUMNS = ("increment_id", "order_date", "sku", "price", "qty_ordered")
MONTH = "order_month"

# Access path -> (source, sort order). The first column is what is looked up. Items by order
# need no copy: the stored items are bucketed by order number.
LAYOUTS = {
    "orders_by_customer": ("orders", ["customer_id", "order_date", "increment_id"]),
    "items_by_customer": ("owned_items", ["customer_id", "order_date", "increment_id", "item_id"]),
    "orders_by_date": ("orders", ["order_date", "increment_id"]),
    "items_by_sku": ("order_items", ["sku", "item_id"]),
}


def customer_order_lookup(store: OrderStore, customer: int) -> DataFrame:
    """Items of one customer's orders, from the stored tables as they are."""
    mine = F.col("customer_id") == customer
    return store.join(lambda orders: orders.where(mine).select(KEY, "order_date")).select(*COLUMNS)


def customer_order_lookup_laid_out(items_by_customer: Layout, customer: int) -> DataFrame:
    """The same from items that carry their customer and order date: no join is left."""
    return items_by_customer.of(customer, *COLUMNS)


def order_lookup(store: OrderStore, increment_id: str) -> DataFrame:
    """Items of one order: Spark reads the one bucket that can hold it."""
    return store.items.where(F.col(KEY) == increment_id)


def sku_lookup(items_by_sku: Layout, sku: str) -> DataFrame:
    """Items of one product, from one partition."""
    return items_by_sku.of(sku)


def orders_on_days(orders_by_date: Layout, dim_date: DataFrame, which: Column) -> DataFrame:
    """Orders of the days that ``which`` chooses, with the calendar of each.

    The partition is part of the join key, so what is left of the calendar prunes months at
    run time, before orders are read.
    """
    days = dim_date.where(which).select(
        F.col("full_date").alias("order_date"), F.col("month_start").alias(MONTH),
        "year", "quarter", "iso_weekday", "is_weekend",
    )
    return orders_by_date.table.join(days, [MONTH, "order_date"]).select(
        "increment_id", "order_date", "customer_id", "payment_method", "grand_total",
        "iso_weekday", "is_weekend",
    )


def lookup_table(name: str, store: OrderStore, catalog: Catalog) -> Layout:
    """One access path of the model, written."""
    source, order = LAYOUTS[name]
    if source == "owned_items":
        owner = (KEY, "customer_id", "order_date")
        df = store.join(lambda orders: orders.select(*owner))
    else:
        df = store.orders if source == "orders" else store.items
    if order[0] == "order_date":
        return laid_out(df, catalog, name, order, by=(MONTH, "trunc({key}, 'MM')"))
    # By the stored table: the optimizer's guess for a join is the product of both sides.
    parts = parts_for(store.orders if source == "orders" else store.items)
    return laid_out(df, catalog, name, order, parts=parts)


def layout_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [
        table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layout_name"), "rows")
        for name, table in tables.items()
    ]
    combined = counted[0]
    for more in counted[1:]:
        combined = combined.unionByName(more)
    return combined
