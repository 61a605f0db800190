"""Star schema over the model: dates, customers, products and item-level sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.analytics import NO_CATEGORY, NO_STATUS, is_money
from ledgerline.plans.store import OrderStore

# Members for facts without a customer or a product.
GUEST_KEY = -1
NO_PRODUCT = "(none)"


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def dim_date(orders: DataFrame) -> DataFrame:
    """One row per day from the first to the last order date."""
    days = orders.agg(
        F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day")
    ).select(F.explode(F.sequence("first_day", "last_day")).alias("full_date"))
    day = F.col("full_date")
    return days.select(
        date_key(day).alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.trunc(day, "MM").alias("month_start"),
        F.dayofmonth(day).alias("day_of_month"),
        (F.weekday(day) + 1).alias("iso_weekday"),
        (F.weekday(day) >= 5).alias("is_weekend"),
    )


def dim_customer(customers: DataFrame) -> DataFrame:
    spark = customers.sparkSession
    guest = spark.range(1).select(
        F.lit(GUEST_KEY).cast("bigint").alias("customer_key"),
        F.lit(None).cast("date").alias("customer_since"),
        F.lit(True).alias("is_guest"),
    )
    known = customers.select(
        F.col("customer_id").alias("customer_key"), "customer_since", F.lit(False).alias("is_guest")
    )
    return known.unionByName(guest)


def dim_product(products: DataFrame) -> DataFrame:
    spark = products.sparkSession
    category = F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("category")
    known = products.select(F.col("sku").alias("product_key"), category)
    none = spark.range(1).select(
        F.lit(NO_PRODUCT).alias("product_key"), F.lit(NO_CATEGORY).alias("category")
    )
    return known.unionByName(none)


def fact_sales(store: OrderStore) -> DataFrame:
    """One row per order item, with the attributes of its order."""
    money = F.coalesce(is_money(), F.lit(False))
    header = (
        "increment_id", "customer_id", "order_date", "payment_method", "status",
        money.alias("is_money"),
    )
    return store.join(lambda orders: orders.select(*header)).select(
        "item_id",
        "increment_id",
        date_key(F.col("order_date")).alias("date_key"),
        F.coalesce("customer_id", F.lit(GUEST_KEY)).alias("customer_key"),
        F.coalesce("sku", F.lit(NO_PRODUCT)).alias("product_key"),
        "payment_method",
        F.coalesce("status", F.lit(NO_STATUS)).alias("status"),
        "is_money",
        "price",
        "qty_ordered",
        "gross_value",
        "discount_amount",
        (F.col("gross_value") - F.col("discount_amount")).alias("net_value"),
    )


def star_totals(fact: DataFrame, order_items: DataFrame) -> DataFrame:
    """Rows and sums of the fact table next to those of the model."""

    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count("*").alias("item_rows"),
            F.sum("qty_ordered").alias("units"),
            F.sum("gross_value").cast("double").alias("gross_value"),
            F.sum("discount_amount").cast("double").alias("discount_amount"),
        ).select(F.lit(name).alias("table_name"), "*")

    return totals(fact, "fact_sales").unionByName(totals(order_items, "order_items"))
