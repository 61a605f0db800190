"""The normalized model: customers, products, orders and order items from staging.

All exclusion rules are about orders, so staging is reduced once to one row per
order, and the rules run on that. What they give is a table of the few orders to
leave out, which is written and then joined at whatever strategy its true size
allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY, gross_value, loses_digits, money, whole_number
from ledgerline.functions.text import (
    BLANK,
    ORDER_DATE_FORMAT,
    SINCE_FORMAT,
    is_populated,
    is_regular_sku,
    null_tokens,
    parse_date,
)
from ledgerline.operators.checks import (
    as_long,
    cascade_exclude,
    count_rows,
    majority_value,
    valid_rows,
    wholly_matching_groups,
)
from ledgerline.operators.constraints import (
    fk_violations,
    pk_violations,
    require_no_violations,
)
from ledgerline.plans import audit

# The longest text each model column may hold.
LENGTH_LIMITS = {
    "products": {"sku": 100, "category_name": 50},
    "orders": {"increment_id": 50, "payment_method": 50, "status": 20},
    "order_items": {"increment_id": 50, "sku": 100},
}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "products": "sku",
    "orders": "increment_id",
    "order_items": "item_id",
}

# child, foreign key, parent
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers"),
    ("order_items", "increment_id", "orders"),
    ("order_items", "sku", "products"),
)


def build_order_flags(staging: DataFrame) -> DataFrame:
    """What the exclusion rules ask of an order, one row per order (and customer)."""
    return (
        valid_rows(staging)
        .where(F.col("increment_id").isNotNull())
        .groupBy("increment_id", "customer_id", "customer_since")
        .agg(
            F.coalesce(F.bool_or(is_regular_sku("sku")), F.lit(False)).alias("has_regular_sku"),
            F.coalesce(F.bool_or(audit.is_internal()), F.lit(False)).alias("has_internal_payment"),
            F.count("*").alias("rows"),
        )
    )


def build_service_accounts(order_flags: DataFrame) -> DataFrame:
    """Customers all of whose orders are internal bookings."""
    counted = wholly_matching_groups(
        order_flags.where(is_populated("customer_id")),
        "customer_id", "increment_id", F.col("has_internal_payment"), "orders", "internal",
    )
    return counted.where(F.col("orders") == F.col("internal")).select("customer_id")


def build_excluded_orders(order_flags: DataFrame, service_accounts: DataFrame) -> DataFrame:
    """Orders that must not enter the model, with the reason.

    An order stays if it has a row with a regular SKU and a row of a customer
    who is no service account. Only orders with an internal payment can belong
    to a service account, so only these few are looked up.
    """
    internal, named = F.col("has_internal_payment"), F.col("customer_id").isNotNull()
    flagged = service_accounts.select("customer_id", F.lit(True).alias("is_service"))
    usual = order_flags.where(~internal).withColumn("has_customer", named)
    booked = (
        order_flags.where(internal)
        .join(flagged, "customer_id", "left")
        .withColumn("has_customer", named & F.col("is_service").isNull())
    )
    columns = ["increment_id", "has_regular_sku", "has_customer"]
    per_order = (
        usual.select(*columns)
        .unionByName(booked.select(*columns))
        .groupBy("increment_id")
        .agg(F.bool_or("has_regular_sku").alias("regular"), F.bool_or("has_customer").alias("owned"))
    )
    return per_order.where(~F.col("regular") | ~F.col("owned")).select(
        "increment_id", (~F.col("regular")).alias("is_test_only")
    )


def build_split_orders(
    order_flags: DataFrame, service_accounts: DataFrame, excluded_orders: DataFrame
) -> DataFrame:
    """Service accounts that share an order with another customer: only their rows go.

    Empty as long as every order has one customer.
    """
    return (
        order_flags.where("has_internal_payment")
        .select("increment_id", "customer_id")
        .distinct()
        .join(service_accounts, "customer_id", "left_semi")
        .transform(cascade_exclude, excluded_orders, "increment_id")
    )


def customer_key() -> Column:
    return null_tokens("customer_id").try_cast("bigint")


def _without_split(rows: DataFrame, split_orders: DataFrame) -> DataFrame:
    return cascade_exclude(rows, split_orders, "increment_id", "customer_id")


def build_customers(
    order_flags: DataFrame, excluded_orders: DataFrame, split_orders: DataFrame
) -> DataFrame:
    known = order_flags.where(null_tokens("customer_id").isNotNull())
    return (
        _without_split(known, split_orders)
        .transform(cascade_exclude, excluded_orders, "increment_id")
        .select(
            customer_key().alias("customer_id"),
            parse_date(null_tokens("customer_since"), SINCE_FORMAT).alias("customer_since"),
        )
        .distinct()
    )


def build_products(staging: DataFrame) -> DataFrame:
    named = valid_rows(staging).where(is_populated("sku") & is_regular_sku("sku"))
    return majority_value(named, "sku", "category_name_1", audit.CATEGORY_TOKENS, "category_name")


def build_orders(
    staging: DataFrame, excluded_orders: DataFrame, split_orders: DataFrame
) -> DataFrame:
    """One row per accepted order; rows are reduced to orders before they are joined."""
    rows = valid_rows(staging).where(
        F.col("increment_id").isNotNull() & F.col("customer_id").isNotNull()
    )
    headers = _without_split(rows, split_orders).select(
        "increment_id",
        customer_key().alias("customer_id"),
        parse_date("created_at", ORDER_DATE_FORMAT).alias("order_date"),
        "payment_method",
        F.nullif("status", F.lit(BLANK)).alias("status"),
        money("grand_total").alias("grand_total"),
    )
    return cascade_exclude(headers.distinct(), excluded_orders, "increment_id")


def build_order_items(staging: DataFrame, excluded_orders: DataFrame) -> DataFrame:
    """Items of accepted orders.

    Every regular, non-blank SKU of a populated row is a product by
    construction, so the product reference is the SKU itself and needs no join;
    the foreign-key check proves it.
    """
    price, quantity = money("price"), whole_number("qty_ordered")
    return (
        valid_rows(staging)
        .where(is_regular_sku("sku") & F.col("increment_id").isNotNull())
        .select("item_id", "increment_id", "sku", "price", "qty_ordered", "discount_amount")
        .transform(cascade_exclude, excluded_orders, "increment_id")
        .select(
            F.col("item_id").try_cast("bigint").alias("item_id"),
            "increment_id",
            F.nullif("sku", F.lit(BLANK)).alias("sku"),
            price.alias("price"),
            quantity.alias("qty_ordered"),
            F.abs(money("discount_amount")).cast(MONEY).alias("discount_amount"),
            gross_value(price, quantity).alias("gross_value"),
        )
    )


def primary_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    reports = [pk_violations(tables[name], name, key) for name, key in PRIMARY_KEYS.items()]
    return _stacked(reports)


def foreign_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    return _stacked([foreign_key_check(tables, *link) for link in FOREIGN_KEYS])


def require_keys(zones: dict[str, dict[str, DataFrame]]) -> None:
    """Raises if a primary or foreign key of the model tables is violated."""
    tables = {name: zones["oltp"][name] for name in PRIMARY_KEYS}
    require_no_violations(primary_key_report(tables), "null_keys", "repeated_keys")
    require_no_violations(foreign_key_report(tables), "orphan_keys")


def foreign_key_check(tables: dict[str, DataFrame], child: str, key: str, parent: str) -> DataFrame:
    return fk_violations(tables[child], child, key, tables[parent], parent, PRIMARY_KEYS[parent])


def _stacked(reports: list[DataFrame]) -> DataFrame:
    combined = reports[0]
    for report in reports[1:]:
        combined = combined.unionByName(report)
    return combined


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [
        count_rows(table, name="row_count").select(F.lit(name).alias("table_name"), "row_count")
        for name, table in tables.items()
    ]
    return _stacked(counted)


def unparsed_values(staging: DataFrame) -> DataFrame:
    """(target, unparsed_rows): text that is no missing-value token but does not parse whole.

    Amounts count if they do not parse, or have more decimals than the model keeps.
    """

    def lost(text: Column, parsed: Column) -> Column:
        return F.count_if(text.isNotNull() & parsed.isNull())

    def lost_money(name: str) -> Column:
        unread = F.col(name).isNotNull() & money(name).isNull()
        return F.count_if(unread | loses_digits(name))

    since, order_date = null_tokens("customer_since"), null_tokens("created_at")
    counted = valid_rows(staging).agg(
        lost(null_tokens("customer_id"), customer_key()).alias("customer_id"),
        lost(since, parse_date(since, SINCE_FORMAT)).alias("customer_since"),
        lost(order_date, parse_date(order_date, ORDER_DATE_FORMAT)).alias("order_date"),
        lost_money("grand_total").alias("grand_total"),
        lost(F.col("item_id"), F.col("item_id").try_cast("bigint")).alias("item_id"),
        lost_money("price").alias("price"),
        lost(F.col("qty_ordered"), whole_number("qty_ordered")).alias("qty_ordered"),
        lost_money("discount_amount").alias("discount_amount"),
    )
    return as_long(counted, "target", "unparsed_rows")
