"""Every named query, as a function of a warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import is_populated
from ledgerline.operators import constraints
from ledgerline.operators.checks import length_violations
from ledgerline.plans import analytics, audit, lookup, model, reconcile, star
from ledgerline.plans.warehouse import Warehouse, open_retail
from ledgerline.sources.export import RAW_COLUMNS, malformed_rows, read_csv

# What the lookup queries look up; orders and products are those with the least key.
LOOKUP_CUSTOMER = 74
LOOKUP_YEAR = 1998

Query = Callable[[Warehouse], DataFrame]


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for results that leave Spark."""
    amounts = [name for name, kind in df.dtypes if kind.startswith("decimal")]
    return df.withColumns({name: F.col(name).cast("double") for name in amounts})


# --- landing ---------------------------------------------------------------


def zone_layout(w: Warehouse) -> DataFrame:
    """Rows of every table in the three zones."""
    counted = [
        table.agg(F.count("*").alias("rows")).select(
            F.lit(zone).alias("zone"), F.lit(name).alias("table_name"), "rows"
        )
        for zone, tables in w.zones().items()
        for name, table in tables.items()
    ]
    combined = counted[0]
    for more in counted[1:]:
        combined = combined.unionByName(more)
    return combined


def staging_schema(w: Warehouse) -> DataFrame:
    """The staging columns with their header and the rows that hold a value, in one scan."""
    staging = w.staging()
    counted = staging.agg(*[F.count_if(is_populated(c)).alias(c) for c in staging.columns])
    header = F.create_map(*[F.lit(x) for raw, name in RAW_COLUMNS.items() for x in (name, raw)])
    return counted.unpivot([], staging.columns, "column_name", "populated_rows").select(
        "column_name", header[F.col("column_name")].alias("raw_name"), "populated_rows"
    )


def csv_ingest_server(w: Warehouse) -> DataFrame:
    """All rows after a round trip through CSV."""
    return read_csv(w.spark, w.exported_csv())


def csv_ingest_client(w: Warehouse) -> DataFrame:
    """The missing-value tokens that are left after a round trip through CSV."""
    return audit.missing_token_profile(read_csv(w.spark, w.exported_csv()))


def csv_quarantine(w: Warehouse) -> DataFrame:
    """Landed rows, and lines kept aside by their damage, of an export with damaged lines.

    The summed item ids show that each line is kept as it was. They are whole numbers of 64
    bits, and decimals only if a sum does not fit into these.
    """
    landing = w.damaged_landing()
    first = F.element_at(F.split("line", ","), 1)
    rows = landing.staging.select(F.lit("none").alias("damage"), F.col("item_id")).unionByName(
        landing.quarantine.select("damage", first.alias("item_id"))
    )
    item_id = F.col("item_id").try_cast("bigint").cast("decimal(28,0)")
    summed = w.workspace.table(
        "quarantine_sums",
        lambda: rows.groupBy("damage").agg(
            F.count("*").alias("rows"), F.sum(item_id).alias("item_ids")
        ),
    )
    fitting = F.col("item_ids").try_cast("bigint")
    fits = summed.where(F.col("item_ids").isNotNull() & fitting.isNull()).isEmpty()
    return summed.withColumn("item_ids", fitting) if fits else summed


LANDING: dict[str, Query] = {
    "zone_layout": zone_layout,
    "staging_schema": staging_schema,
    "csv_ingest_server": csv_ingest_server,
    "csv_ingest_client": csv_ingest_client,
    "csv_quarantine": csv_quarantine,
    "csv_malformed_rows": lambda w: malformed_rows(w.spark, w.exported_csv()),
}

# --- audit -----------------------------------------------------------------


def _on_staging(question: Callable[..., DataFrame], *args) -> Query:
    return lambda w: question(w.staging(), *args)


def _on_amounts(question: Callable[..., DataFrame]) -> Query:
    return lambda w: question(w.order_amounts())


_per_order = audit.order_attribute_consistency
_per_any_order = audit.order_attribute_consistency_any_row

AUDIT: dict[str, Query] = {
    "dq_shape_profile": lambda w: audit.shape_profile(w.staging()),
    "dq_shape_offenders": lambda w: audit.shape_offenders(w.staging()),
    "dq_redundant_pairs": lambda w: audit.redundant_pairs(w.staging()),
    "dq_row_count_filtered": _on_staging(audit.row_count_filtered),
    "dq_row_count_total_vs_populated": _on_staging(audit.row_count_total_vs_populated),
    "dq_duplicate_item_id": _on_staging(audit.duplicate_item_id),
    "dq_duplicate_item_id_summary": _on_staging(audit.duplicate_item_id_summary),
    "dq_customer_since_consistency": _on_staging(audit.customer_since_consistency),
    "dq_customer_since_consistency_summary": _on_staging(audit.customer_since_consistency_summary),
    "dq_sku_category_raw_conflicts": _on_staging(audit.sku_category_raw_conflicts),
    "dq_sku_category_drilldown": _on_staging(audit.sku_category_drilldown),
    "dq_category_fake_null_count": _on_staging(audit.category_fake_null_count),
    "dq_sku_category_real_conflicts": _on_staging(audit.sku_category_real_conflicts),
    "sku_category_majority": _on_staging(audit.sku_category_majority),
    "dq_empty_sku": _on_staging(audit.empty_sku),
    "dq_distinct_sku": _on_staging(audit.distinct_sku),
    "dq_majority_map_count": _on_staging(audit.majority_map_count),
    "dq_sku_category_max_length": _on_staging(audit.sku_category_max_length),
    "dq_status_consistency": _on_staging(_per_any_order, "status", "status_variants"),
    "dq_status_distribution": _on_staging(audit.status_distribution),
    "dq_payment_consistency": _on_staging(_per_any_order, "payment_method", "payment_variants"),
    "dq_order_consistency_summary": _on_staging(audit.order_consistency_summary),
    "dq_order_consistency_with_null_summary": _on_staging(audit.order_consistency_with_null_summary),
    "dq_item_vs_grand_total": _on_staging(audit.item_vs_grand_total),
    "dq_grand_total_drilldown": _on_staging(audit.grand_total_drilldown),
    "dq_grand_total_per_order": _on_amounts(audit.grand_total_per_order),
    "dq_grand_total_violations": _on_amounts(audit.grand_total_violations),
    "dq_grand_total_violations_summary": _on_amounts(audit.grand_total_violations_summary),
    "dq_zero_total_drilldown": lambda w: audit.zero_total_drilldown(
        w.staging(), w.zero_total_customers()
    ),
    "payment_method_share": _on_staging(audit.payment_method_share),
    "dq_internal_payment_rows": _on_staging(audit.internal_payment_rows),
    "dq_internal_customer_profile": _on_staging(audit.internal_customer_profile),
    "service_accounts": _on_staging(audit.service_accounts),
    "dq_redundant_date_column": _on_staging(audit.redundant_date_column),
    "dq_redundant_date_column_summary": _on_staging(audit.redundant_date_column_summary),
    "dq_date_month_range": _on_staging(audit.date_month_range),
    "dq_date_month_range_summary": _on_staging(audit.date_month_range_summary),
    "dq_created_at_consistency": _on_staging(_per_order, "created_at", "date_variants"),
    "dq_numeric_pattern": _on_staging(audit.numeric_pattern),
    "dq_integer_pattern": _on_staging(audit.integer_pattern),
    "dq_customer_id_completeness": _on_staging(audit.customer_id_completeness),
    "dq_increment_id_completeness": _on_staging(audit.increment_id_completeness),
    "dq_negative_qty": _on_staging(audit.negative_qty),
    "dq_id_patterns": _on_staging(audit.id_patterns),
    "dq_non_numeric_increment_ids": _on_staging(audit.non_numeric_increment_ids),
    "dq_non_numeric_increment_ids_summary": _on_staging(audit.non_numeric_increment_ids_summary),
    "dq_customer_consistency": _on_staging(_per_order, "customer_id", "customer_variants"),
    "dq_customer_since_values": _on_staging(audit.customer_since_values, 20),
    "dq_customer_since_non_date": _on_staging(audit.customer_since_non_date),
    "dq_na_token_rows": _on_staging(audit.na_token_rows),
    "dq_na_token_scan": _on_staging(audit.na_token_scan),
    "dq_customer_since_pattern": _on_staging(audit.customer_since_pattern),
    "dq_customer_backslash_n": _on_staging(audit.customer_backslash_n),
    "dq_missing_token_profile": _on_staging(audit.missing_token_profile),
    "dq_mv_raw_cast": _on_staging(audit.mv_raw_cast),
    "dq_mv_non_numeric_values": _on_staging(audit.mv_non_numeric_values),
    "dq_mv_dash_sample": _on_staging(audit.mv_dash_sample, 12),
    "dq_mv_dash_count": _on_staging(audit.mv_dash_count),
    "dq_mv_vs_gross": _on_staging(audit.mv_vs_gross),
    "dq_mv_mismatch_sample": _on_staging(audit.mv_mismatch_sample, 20),
    "dq_mv_vs_rounded_gross": _on_staging(audit.mv_vs_rounded_gross),
    "dq_backslash_n_scan": _on_staging(audit.backslash_n_scan),
    "dq_status_backslash_n_rows": _on_staging(audit.status_backslash_n_rows),
    "dq_test_sku_list": _on_staging(audit.test_sku_list),
    "dq_test_sku_rows": _on_staging(audit.test_sku_rows),
    "dq_baseline_orders_customers": _on_staging(audit.baseline_orders_customers),
    "dq_fully_test_customers": _on_staging(audit.fully_test_customers),
    "dq_negative_money": _on_staging(audit.negative_money),
    "dq_negative_discount_rows": _on_staging(audit.negative_discount_rows),
    "dq_discount_exceeds_gross": _on_staging(audit.discount_exceeds_gross),
    "dq_discount_order_level": _on_amounts(audit.discount_order_level),
    "dq_discount_item_level": _on_amounts(audit.discount_item_level),
    "dq_discount_residual": _on_amounts(audit.discount_residual),
    "dq_discount_hypotheses": _on_amounts(audit.discount_hypotheses),
    "dq_order_text_max_length": _on_staging(audit.order_text_max_length),
    "dq_row_findings": _on_staging(audit.row_findings),
}

# --- model -----------------------------------------------------------------


def _build(name: str) -> Query:
    return lambda w: _doubles(w.build(name))


def _primary_key(name: str) -> Query:
    def check(w: Warehouse) -> DataFrame:
        return constraints.pk_violations(getattr(w, name)(), name, model.PRIMARY_KEYS[name])

    return check


def _foreign_key(child: str, key: str, parent: str) -> Query:
    def check(w: Warehouse) -> DataFrame:
        tables = {child: getattr(w, child)(), parent: getattr(w, parent)()}
        return model.foreign_key_check(tables, child, key, parent)

    return check


def model_length_limits(w: Warehouse) -> DataFrame:
    tables = w.model()
    reports = [
        length_violations(tables[name], limits).select(F.lit(name).alias("table_name"), "*")
        for name, limits in model.LENGTH_LIMITS.items()
    ]
    combined = reports[0]
    for more in reports[1:]:
        combined = combined.unionByName(more)
    return combined


def model_unparsed_values(w: Warehouse) -> DataFrame:
    """Values that were text in staging and became NULL in the model."""
    return model.unparsed_values(w.staging())


MODEL: dict[str, Query] = {
    "build_customers": _build("customers"),
    "pk_customers": _primary_key("customers"),
    "build_products": _build("products"),
    "pk_products": _primary_key("products"),
    "build_orders": _build("orders"),
    "pk_orders": _primary_key("orders"),
    "fk_orders_customers": _foreign_key("orders", "customer_id", "customers"),
    "build_order_items": _build("order_items"),
    "pk_order_items": _primary_key("order_items"),
    "fk_items_orders": _foreign_key("order_items", "increment_id", "orders"),
    "fk_items_products": _foreign_key("order_items", "sku", "products"),
    "model_excluded_orders": lambda w: model.build_excluded_orders(
        w.order_flags(), w.service_accounts()
    ),
    "model_length_limits": model_length_limits,
    "model_unparsed_values": model_unparsed_values,
    "oltp_row_counts": lambda w: model.row_counts(w.model()),
    "recon_test_only_orders": lambda w: reconcile.test_only_orders(w.staging()),
    "recon_service_account_items": lambda w: reconcile.service_account_items(
        w.staging(), w.service_accounts()
    ),
    "recon_order_status_nulls": lambda w: reconcile.order_status_nulls(w.orders()),
    "recon_product_category_nulls": lambda w: reconcile.product_category_nulls(w.products()),
    "recon_uncategorized_impact": lambda w: reconcile.uncategorized_impact(
        w.order_items(), w.products()
    ),
    "recon_ledger": lambda w: reconcile.ledger(w.staging(), w.model()),
    "recon_contents": lambda w: reconcile.contents(
        {name: w.build(name) for name in w.model()}, w.model(), w.workspace
    ),
}

# --- lookup and layout -----------------------------------------------------


def customer_order_lookup(w: Warehouse, customer: int = LOOKUP_CUSTOMER) -> DataFrame:
    return _doubles(lookup.customer_order_lookup(w.store(), customer))


def customer_order_lookup_indexed(w: Warehouse, customer: int = LOOKUP_CUSTOMER) -> DataFrame:
    found = lookup.customer_order_lookup_laid_out(w.lookup_table("items_by_customer"), customer)
    return _doubles(found)


def _least(w: Warehouse, key: str) -> str:
    return w.order_items().agg(F.min(key)).first()[0]


def order_lookup(w: Warehouse, increment_id: str | None = None) -> DataFrame:
    return _doubles(lookup.order_lookup(w.store(), increment_id or _least(w, "increment_id")))


def sku_lookup(w: Warehouse, sku: str | None = None) -> DataFrame:
    return _doubles(lookup.sku_lookup(w.lookup_table("items_by_sku"), sku or _least(w, "sku")))


def orders_on_weekends(w: Warehouse, year: int = LOOKUP_YEAR) -> DataFrame:
    """Orders of the weekends of one year's last quarter; the calendar prunes the months."""
    which = (F.col("year") == year) & (F.col("quarter") == 4) & F.col("is_weekend")
    return _doubles(lookup.orders_on_days(w.lookup_table("orders_by_date"), w.calendar(), which))


def clustered_layout(w: Warehouse) -> DataFrame:
    return lookup.layout_counts(w.access_paths())


LOOKUP: dict[str, Query] = {
    "customer_order_lookup": customer_order_lookup,
    "customer_order_lookup_indexed": customer_order_lookup_indexed,
    "clustered_layout": clustered_layout,
    "order_lookup": order_lookup,
    "sku_lookup": sku_lookup,
    "orders_on_weekends": orders_on_weekends,
}

# --- analysis --------------------------------------------------------------

ANALYSIS: dict[str, Query] = {
    "v_monthly_kpi": lambda w: analytics.monthly_kpi(w.orders()),
    "v_rfm_segments": lambda w: _doubles(w.rfm_segments()),
    "rfm_summary": lambda w: _doubles(analytics.rfm_summary(w.rfm_segments())),
    "v_cohort_retention": lambda w: analytics.cohort_retention(w.orders()),
    "customer_reach": lambda w: analytics.customer_reach(w.customer_sets()),
    "category_revenue": lambda w: analytics.category_revenue(w.store(), w.products()),
    "status_breakdown": lambda w: analytics.status_breakdown(w.orders()),
    "payment_mix": lambda w: analytics.payment_mix(w.orders()),
    "star_dim_date": lambda w: star.dim_date(w.orders()),
    "star_dim_customer": lambda w: star.dim_customer(w.customers()),
    "star_dim_product": lambda w: star.dim_product(w.products()),
    "star_fact_sales": lambda w: _doubles(star.fact_sales(w.store())),
    "star_totals": lambda w: star.star_totals(
        star.fact_sales(w.store()), w.order_items()
    ),
}

QUERIES: dict[str, Query] = {**LANDING, **AUDIT, **MODEL, **LOOKUP, **ANALYSIS}


def runnable(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a function of a session and a folder of retail tables."""
    return lambda spark, folder: query(open_retail(spark, folder.rstrip("/")))
