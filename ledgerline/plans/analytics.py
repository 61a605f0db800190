"""Business views over the model: monthly figures, RFM, cohorts, category revenue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import percent, ratio
from ledgerline.operators.checks import share_of_total
from ledgerline.operators.cuts import add_groups
from ledgerline.operators.distinct import id_sets, set_sizes
from ledgerline.plans.audit import CREDIT_METHODS, INTERNAL_METHODS
from ledgerline.plans.store import KEY, OrderStore
from ledgerline.sources.workspace import Workspace

NO_CATEGORY = "Uncategorized"
NO_STATUS = "unknown"
NO_METHOD = "(none)"

AMOUNT = "decimal(28,4)"


def is_money() -> Column:
    """True for an order whose total counts as revenue; an unknown method is none."""
    named = ~F.col("payment_method").isin(*CREDIT_METHODS, *INTERNAL_METHODS)
    return F.coalesce(named, F.lit(False))


def _total(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0).cast(AMOUNT)).cast(AMOUNT)


def monthly_kpi(orders: DataFrame) -> DataFrame:
    """Orders, customers, revenue, average order value and change to the month before."""
    per_month = orders.groupBy(F.trunc("order_date", "MM").alias("order_month")).agg(
        F.count("*").alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_if(is_money()).alias("money_orders"),
        _total(F.when(is_money(), F.col("grand_total"))).alias("revenue"),
    )
    # One row per calendar month is left, so one task orders them.
    before = F.lag("revenue").over(Window.orderBy("order_month"))
    return per_month.withColumn("before", before).select(
        "order_month",
        "orders",
        "customers",
        "money_orders",
        F.col("revenue").cast("double").alias("revenue"),
        ratio(F.col("revenue"), F.col("money_orders")).alias("avg_order_value"),
        percent(F.col("revenue") - F.col("before"), F.col("before")).alias("revenue_change_pct"),
    )


def customer_activity(orders: DataFrame) -> DataFrame:
    """Last order date, number of orders and money per known customer."""
    return (
        orders.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.max("order_date").alias("last_order"),
            F.count("*").alias("frequency"),
            _total(F.when(is_money(), F.col("grand_total"))).alias("monetary"),
        )
    )


def rfm_segments(orders: DataFrame, workspace: Workspace) -> DataFrame:
    """Scores 1 to 5 for recency, frequency and money, and a segment per customer.

    What is written on the way belongs to this call alone.
    """
    scope = workspace.scope("rfm")
    activity = scope.table("customer_activity", lambda: customer_activity(orders))
    values = {"r_score": "last_order", "f_score": "frequency", "m_score": "monetary"}
    scored = add_groups(activity, values, "customer_id", groups=5)
    latest = activity.agg(F.max("last_order")).scalar()
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    segment = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "champions")
        .when(f >= 4, F.when(r >= 3, "loyal").otherwise("at risk"))
        .when(r >= 4, F.when(f <= 2, "new").otherwise("promising"))
        .when(r <= 2, F.when(f <= 2, "lost").otherwise("slipping"))
        .otherwise("regular")
    )
    return scored.select(
        "customer_id",
        F.date_diff(latest, "last_order").cast("bigint").alias("recency_days"),
        "frequency",
        "monetary",
        r.cast("bigint").alias("r_score"),
        f.cast("bigint").alias("f_score"),
        m.cast("bigint").alias("m_score"),
        segment.alias("segment"),
    )


def rfm_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.sum("monetary").alias("monetary"),
    )


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Customers active in each month after the month of their first order."""
    month = F.trunc("order_date", "MM")
    active = (
        orders.where(F.col("customer_id").isNotNull())
        .select("customer_id", month.alias("active_month"))
        .distinct()
    )
    # A customer now has one row per calendar month, which bounds the window.
    first = F.min("active_month").over(Window.partitionBy("customer_id"))
    period = F.months_between("active_month", "cohort_month").cast("bigint")
    cells = (
        active.withColumn("cohort_month", first)
        .groupBy("cohort_month", period.alias("period"))
        .agg(F.count("*").alias("customers"))
    )
    size = F.first("customers").over(Window.partitionBy("cohort_month").orderBy("period"))
    return cells.withColumn("cohort_size", size).withColumn(
        "retention_pct", percent(F.col("customers"), F.col("cohort_size"))
    )


def customer_sets(orders: DataFrame) -> DataFrame:
    """Who ordered, as sets of customers per month and payment method."""
    month = F.trunc("order_date", "MM").alias("month")
    return id_sets(orders, [month, "payment_method"], "customer_id")


def customer_reach(sets: DataFrame) -> DataFrame:
    """Different customers per month, quarter, year and payment method, and of all time.

    Every figure is a union of the stored sets; no order is read again.
    """
    month = F.col("month")
    year = F.year(month).cast("string")
    periods = {
        "month": F.date_format(month, "yyyy-MM"),
        "quarter": F.concat(year, F.lit("-Q"), F.quarter(month).cast("string")),
        "year": year,
        "method": F.coalesce("payment_method", F.lit(NO_METHOD)),
        "all": F.lit("all"),
    }
    counted = [
        set_sizes(sets, [F.lit(grain).alias("grain"), period.alias("period")], "customers")
        for grain, period in periods.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def category_revenue(store: OrderStore, products: DataFrame) -> DataFrame:
    """Item-level sales per category, without orders whose total is no money.

    Orders without money are the few, so they are taken out by an anti join;
    items are then summed per SKU before products are joined.
    """
    sold = store.join(lambda orders: orders.where(~is_money()).select(KEY), "left_anti")
    per_sku = sold.groupBy("sku").agg(
        F.count("*").alias("items"),
        F.sum("qty_ordered").alias("units"),
        F.sum("gross_value").alias("gross"),
        F.sum("discount_amount").alias("discount"),
    )
    label = F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("category")
    return (
        per_sku.join(products, "sku", "left")
        .groupBy(label)
        .agg(
            F.sum("items").alias("items"),
            F.sum("units").alias("units"),
            F.sum("gross").alias("gross"),
            F.sum("discount").alias("discount"),
        )
        .select(
            "category",
            "items",
            "units",
            F.col("gross").cast("double").alias("gross_revenue"),
            F.col("discount").cast("double").alias("discount"),
            (F.col("gross") - F.col("discount")).cast("double").alias("net_revenue"),
        )
    )


def status_breakdown(orders: DataFrame) -> DataFrame:
    label = F.coalesce("status", F.lit(NO_STATUS)).alias("status")
    counted = orders.groupBy(label).agg(F.count("*").alias("orders"))
    return share_of_total(counted, "orders", "pct_of_orders")


def payment_mix(orders: DataFrame) -> DataFrame:
    counted = orders.groupBy("payment_method").agg(
        F.count("*").alias("orders"),
        _total(F.when(is_money(), F.col("grand_total"))).cast("double").alias("revenue"),
    )
    return share_of_total(counted, "orders", "pct_of_orders")
