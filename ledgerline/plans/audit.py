"""The data-quality audit of the staging table, one function per question.

Functions named after a check return its findings; where a clean table gives no
rows, a ``*_summary`` says how much was checked. Most questions are about
populated rows; the exceptions keep the filter their question needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY, clean_money, gross_value, money, whole_number
from ledgerline.functions.text import (
    BACKSLASH_N,
    BLANK,
    CASTABLE_TEXT,
    DIGITS_TEXT,
    INTEGER_TEXT,
    MISSING_TOKENS,
    NUMERIC_TEXT,
    ORDER_DATE_FORMAT,
    SPREADSHEET_NA,
    YEAR_MONTH_TEXT,
    is_populated,
    is_regular_sku,
    is_test_sku,
    not_matching,
    null_tokens,
    parse_date,
)
from ledgerline.operators import checks, redundancy, shapes
from ledgerline.operators.checks import count_each, count_rows, valid_rows, within
from ledgerline.operators.redundancy import Reading
from ledgerline.sources.export import STAGING_COLUMNS

# Payment methods for internal bookings and for credit orders.
INTERNAL_METHODS = ("marketingexpense", "financesettlement")
CREDIT_METHODS = ("customercredit", "productcredit")

CATEGORY_TOKENS = (BACKSLASH_N, BLANK)

# Order-level attributes, each expected to have one value per order.
ORDER_ATTRIBUTES = ("status", "payment_method", "grand_total", "created_at", "customer_id")


def is_internal() -> Column:
    return F.col("payment_method").isin(*INTERNAL_METHODS)


def _gross() -> Column:
    return gross_value(money("price"), whole_number("qty_ordered"))


def _first(rows: DataFrame, order: str, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy(F.asc_nulls_last(order)).limit(limit)


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in columns})


# --- volume and uniqueness -------------------------------------------------


def row_count_filtered(staging: DataFrame) -> DataFrame:
    return valid_rows(staging).agg(
        F.count("*").alias("total_rows"), F.count("item_id").alias("non_empty_rows")
    )


def row_count_total_vs_populated(staging: DataFrame) -> DataFrame:
    return staging.agg(
        F.count("*").alias("total_rows"),
        F.count(F.nullif("item_id", F.lit(BLANK))).alias("non_empty_rows"),
    )


def duplicate_item_id(staging: DataFrame) -> DataFrame:
    return checks.uniqueness_check(valid_rows(staging), "item_id")


def duplicate_item_id_summary(staging: DataFrame) -> DataFrame:
    return checks.uniqueness_summary(valid_rows(staging), "item_id")


# --- values that a key should determine ------------------------------------


def customer_since_consistency(staging: DataFrame) -> DataFrame:
    return checks.fd_check(valid_rows(staging), "customer_id", F.col("customer_since"))


def customer_since_consistency_summary(staging: DataFrame) -> DataFrame:
    return checks.fd_summary(
        valid_rows(staging), "customer_id", {"customer_since": F.col("customer_since")}
    )


def order_attribute_consistency(staging: DataFrame, attribute: str, name: str) -> DataFrame:
    """Orders with several values of ``attribute``; populated rows only."""
    return checks.fd_check(valid_rows(staging), "increment_id", F.col(attribute), name)


def order_attribute_consistency_any_row(staging: DataFrame, attribute: str, name: str) -> DataFrame:
    """The same over every row that names an order, whether or not it has an item id."""
    return checks.fd_check(valid_rows(staging, "increment_id"), "increment_id", F.col(attribute), name)


def order_consistency_summary(staging: DataFrame) -> DataFrame:
    """All order-level attributes in one grouping of the orders."""
    values = {name: F.col(name) for name in ORDER_ATTRIBUTES}
    return checks.fd_summary(valid_rows(staging), "increment_id", values)


def order_consistency_with_null_summary(staging: DataFrame) -> DataFrame:
    """As above, with a missing-value token counted as a variant of its own."""
    values = {name: null_tokens(name) for name in ORDER_ATTRIBUTES}
    return checks.fd_summary(valid_rows(staging), "increment_id", values, count_null=True)


# --- SKU and category ------------------------------------------------------


def sku_category_raw_conflicts(staging: DataFrame) -> DataFrame:
    return checks.fd_check(valid_rows(staging), "sku", F.col("category_name_1"))


def sku_category_real_conflicts(staging: DataFrame) -> DataFrame:
    real = null_tokens("category_name_1", CATEGORY_TOKENS)
    return checks.fd_check(valid_rows(staging), "sku", real, "real_variants")


def sku_category_drilldown(staging: DataFrame, skus: list[str] | None = None) -> DataFrame:
    """Rows per category of the given SKUs, or of all SKUs with real conflicts.

    The conflicts are found in the counted categories, not in the rows again.
    """
    rows = staging if skus is None else staging.where(F.col("sku").isin(*skus))
    counted = rows.groupBy("sku", "category_name_1").agg(
        F.count("*").alias("count"), F.count_if(is_populated("item_id")).alias("populated")
    )
    if skus is None:
        real = null_tokens("category_name_1", CATEGORY_TOKENS)
        conflicts = checks.fd_check(counted.where(F.col("populated") > 0), "sku", real)
        counted = counted.join(conflicts, "sku", "left_semi")
    return counted.drop("populated")


def category_fake_null_count(staging: DataFrame) -> DataFrame:
    return checks.token_scan(valid_rows(staging), {"fake_null": "category_name_1"}, BACKSLASH_N)


def sku_category_majority(staging: DataFrame) -> DataFrame:
    named = valid_rows(staging).where(is_populated("sku"))
    return checks.majority_value(named, "sku", "category_name_1", CATEGORY_TOKENS, "category_name_1")


def empty_sku(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), F.col("sku") == BLANK)


def distinct_sku(staging: DataFrame) -> DataFrame:
    return staging.where(is_populated("sku")).agg(F.count_distinct("sku").alias("count"))


def majority_map_count(staging: DataFrame) -> DataFrame:
    return count_rows(sku_category_majority(staging))


def sku_category_max_length(staging: DataFrame) -> DataFrame:
    return checks.length_bounds(
        valid_rows(staging).where(is_populated("sku")),
        {"max_sku_length": "sku", "max_category_length": "category_name_1"},
    )


# --- status and payment ----------------------------------------------------


def status_distribution(staging: DataFrame) -> DataFrame:
    counted = checks.value_distribution(
        valid_rows(staging), "status", "item_count", {"order_count": "increment_id"}
    )
    return counted.orderBy(F.desc("order_count"), F.asc_nulls_last("status"))


def payment_method_share(staging: DataFrame) -> DataFrame:
    orders = valid_rows(staging).groupBy("payment_method").agg(
        F.count_distinct("increment_id").alias("orders")
    )
    return checks.share_of_total(orders, "orders", "pct_of_orders").orderBy(F.desc("orders"))


def internal_payment_rows(staging: DataFrame) -> DataFrame:
    rows = valid_rows(staging).where(is_internal())
    return _as_double(
        rows.select("payment_method", "status", "customer_id", money("grand_total").alias("grand_total")),
        "grand_total",
    )


def internal_customer_profile(staging: DataFrame, customers: list[str] | None = None) -> DataFrame:
    """Orders per payment method of the given customers, or of all with an internal order."""
    rows = valid_rows(staging)
    if customers is not None:
        rows = rows.where(F.col("customer_id").isin(*customers))
    profile = rows.groupBy("customer_id", "payment_method").agg(
        F.count_distinct("increment_id").alias("orders")
    )
    if customers is None:
        suspects = profile.where(is_internal()).select("customer_id")
        profile = profile.join(suspects, "customer_id", "left_semi")
    return profile.orderBy("customer_id", "payment_method")


def service_accounts(staging: DataFrame) -> DataFrame:
    """Customers all of whose orders are internal bookings."""
    rows = valid_rows(staging).where(is_populated("customer_id"))
    counted = checks.wholly_matching_groups(
        rows, "customer_id", "increment_id", is_internal(), "total_orders", "internal_orders"
    )
    return counted.where(F.col("internal_orders") == F.col("total_orders")).orderBy(
        F.desc("total_orders"), "customer_id"
    )


# --- order totals ----------------------------------------------------------


def _item_and_order_total(staging: DataFrame) -> DataFrame:
    item_total = (_gross() - money("discount_amount")).alias("calculated_total")
    return staging.select("*", item_total, money("grand_total").alias("actual_total"))


def item_vs_grand_total(staging: DataFrame, limit: int | None = None) -> DataFrame:
    """Items whose own value differs from the total they carry; ``limit`` gives a sample."""
    different = (
        _item_and_order_total(valid_rows(staging))
        .where(F.col("calculated_total") != F.col("actual_total"))
        .select("item_id", "calculated_total", "actual_total")
    )
    if limit is not None:
        different = different.orderBy("item_id").limit(limit)
    return _as_double(different, "calculated_total", "actual_total")


def grand_total_drilldown(staging: DataFrame, items: list[str] | None = None) -> DataFrame:
    """The calculation behind the given items, or behind all that differ."""
    rows = _item_and_order_total(staging)
    if items is not None:
        rows = rows.where(F.col("item_id").isin(*items))
    else:
        rows = rows.where(F.col("calculated_total") != F.col("actual_total"))
    columns = ["item_id", "increment_id", "qty_ordered", "status", "discount_amount"]
    rows = rows.select(*columns, "calculated_total", "actual_total")
    return _as_double(rows, "calculated_total", "actual_total")


def build_order_amounts(staging: DataFrame) -> DataFrame:
    """Number of items, totals, discounts and gross value of every order, in one grouping.

    All questions about amounts of orders read this table.
    """
    discount = F.abs(money("discount_amount"))
    return (
        valid_rows(staging)
        .groupBy("increment_id")
        .agg(
            F.count("*").alias("items"),
            F.count_distinct("grand_total").alias("distinct_totals"),
            F.coalesce(F.min("discount_amount") == F.max("discount_amount"), F.lit(False)).alias(
                "one_discount"
            ),
            F.sum(_gross()).alias("sum_gross"),
            F.max(discount).alias("shared_discount"),
            F.sum(discount).alias("summed_discount"),
            F.max(money("grand_total")).alias("order_grand_total"),
        )
    )


def grand_total_per_order(order_amounts: DataFrame) -> DataFrame:
    several = order_amounts.where(F.col("items") > 1)
    return several.select("increment_id", F.col("items").alias("items_in_order"), "distinct_totals")


def grand_total_violations(order_amounts: DataFrame) -> DataFrame:
    per_order = grand_total_per_order(order_amounts)
    return per_order.where(F.col("distinct_totals") > 1).select("increment_id")


def grand_total_violations_summary(order_amounts: DataFrame) -> DataFrame:
    return count_each(
        grand_total_per_order(order_amounts),
        {"multi_item_orders": F.lit(True), "violating_orders": F.col("distinct_totals") > 1},
    )


def build_zero_total_customers(staging: DataFrame) -> DataFrame:
    """Customers with a total of zero, each once."""
    return staging.where(money("grand_total") == 0).select("customer_id").distinct()


def zero_total_drilldown(
    staging: DataFrame, customers: DataFrame, dates: list[str] | None = None
) -> DataFrame:
    """Rows of the given customers, one each in ``customers``, and dates."""
    rows = staging.join(customers, "customer_id", "left_semi")
    if dates is not None:
        rows = rows.where(F.col("created_at").isin(*dates))
    return rows.select(
        "item_id", "status", "created_at", "price", "grand_total", "payment_method", "customer_id"
    )


# --- dates, patterns, identifiers ------------------------------------------


def redundant_date_column(staging: DataFrame, limit: int | None = None) -> DataFrame:
    rows = valid_rows(staging).where(F.col("created_at") != F.col("working_date"))
    if limit is not None:
        rows = rows.orderBy("item_id").limit(limit)
    return rows.select("created_at", "working_date")


def redundant_date_column_summary(staging: DataFrame) -> DataFrame:
    return checks.redundant_columns(valid_rows(staging), F.col("created_at"), F.col("working_date"))


def _first_date_part() -> Column:
    return F.split_part("created_at", F.lit("/"), F.lit(1)).try_cast("int")


def date_month_range(staging: DataFrame, limit: int | None = None) -> DataFrame:
    rows = valid_rows(staging).where(_first_date_part() > 12)
    if limit is not None:
        rows = rows.orderBy("item_id").limit(limit)
    return rows.select("created_at")


def date_month_range_summary(staging: DataFrame) -> DataFrame:
    month = _first_date_part()
    return valid_rows(staging).agg(
        F.min(month).cast("bigint").alias("first_month"),
        F.max(month).cast("bigint").alias("last_month"),
        F.count_if(month > 12).alias("above_twelve"),
    )


NUMERIC_COLUMNS = ("price", "qty_ordered", "discount_amount", "grand_total")


def numeric_pattern(staging: DataFrame) -> DataFrame:
    bad = checks.any_mismatch(dict.fromkeys(NUMERIC_COLUMNS, NUMERIC_TEXT))
    return count_rows(valid_rows(staging), bad, "bad_rows")


def integer_pattern(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), not_matching("qty_ordered", INTEGER_TEXT))


def customer_id_completeness(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), ~is_populated("customer_id"))


def increment_id_completeness(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), ~is_populated("increment_id"))


def negative_qty(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), whole_number("qty_ordered") < 0)


def id_patterns(staging: DataFrame) -> DataFrame:
    customer = not_matching("customer_id", DIGITS_TEXT) & ~F.col("customer_id").isin(*MISSING_TOKENS)
    return count_each(
        valid_rows(staging),
        {
            "item_id_non_numeric": not_matching("item_id", DIGITS_TEXT),
            "increment_id_non_numeric": not_matching("increment_id", DIGITS_TEXT),
            "customer_id_non_numeric": customer,
        },
    )


def non_numeric_increment_ids(staging: DataFrame) -> DataFrame:
    rows = valid_rows(staging).where(not_matching("increment_id", DIGITS_TEXT))
    return rows.select("increment_id")


def non_numeric_increment_ids_summary(staging: DataFrame) -> DataFrame:
    return non_numeric_increment_ids(staging).agg(
        F.count("*").alias("rows"), F.count_distinct("increment_id").alias("orders")
    )


def customer_since_values(staging: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct values, or the first of them in text order."""
    values = valid_rows(staging).select("customer_since").distinct()
    return _first(values, "customer_since", limit)


def customer_since_non_date(staging: DataFrame) -> DataFrame:
    rows = valid_rows(staging).where(~F.col("customer_since").like("%-%"))
    return rows.groupBy("customer_since").count().orderBy(F.asc_nulls_last("customer_since"))


def na_token_rows(staging: DataFrame) -> DataFrame:
    return staging.where(F.col("customer_since") == SPREADSHEET_NA)


def na_token_scan(staging: DataFrame) -> DataFrame:
    columns = {
        "increment_fake": "increment_id",
        "sku_fake": "sku",
        "category_fake": "category_name_1",
        "payment_fake": "payment_method",
        "status_fake": "status",
    }
    return checks.token_scan(valid_rows(staging), columns, SPREADSHEET_NA)


def customer_since_pattern(staging: DataFrame) -> DataFrame:
    since = F.col("customer_since")
    bad = (since != SPREADSHEET_NA) & not_matching(since, YEAR_MONTH_TEXT)
    return count_rows(valid_rows(staging), bad)


def customer_backslash_n(staging: DataFrame) -> DataFrame:
    columns = {
        "customer_id_backslash_n": "customer_id",
        "customer_since_backslash_n": "customer_since",
    }
    return checks.token_scan(valid_rows(staging), columns, BACKSLASH_N)


def missing_token_profile(staging: DataFrame) -> DataFrame:
    """Every staging column against every missing-value token, in one pass."""
    tokens = {"blank": BLANK, "backslash_n": BACKSLASH_N, "spreadsheet_na": SPREADSHEET_NA}
    return checks.token_profile(valid_rows(staging), staging.columns, tokens)


# --- the MV column ---------------------------------------------------------


def _is_dash() -> Column:
    return F.trim("mv") == "-"


def _mv_differs_from(value: Column) -> Column:
    return ~_is_dash() & (clean_money("mv") != value)


def mv_raw_cast(staging: DataFrame) -> DataFrame:
    """Rows whose text does not cast as it stands, for its commas or its dash.

    The test is a pattern: a cast that fails on most rows is several times slower.
    """
    return count_rows(valid_rows(staging), not_matching("mv", CASTABLE_TEXT), "uncastable_rows")


def mv_non_numeric_values(staging: DataFrame) -> DataFrame:
    bare = F.trim(F.replace("mv", F.lit(","), F.lit("")))
    return valid_rows(staging).where(not_matching(bare, NUMERIC_TEXT)).select("mv").distinct()


def mv_dash_sample(staging: DataFrame, limit: int | None = None) -> DataFrame:
    """The dash rows, or the first of them by item id."""
    columns = ["item_id", "price", "qty_ordered", "discount_amount", "mv", "status", "sku"]
    return _first(valid_rows(staging).where(_is_dash()).select(*columns), "item_id", limit)


def mv_dash_count(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), _is_dash())


def mv_vs_gross(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), _mv_differs_from(_gross()))


def mv_mismatch_sample(staging: DataFrame, limit: int | None = None) -> DataFrame:
    """The differing rows, or the first of them by item id."""
    rows = valid_rows(staging).where(_mv_differs_from(_gross()))
    return _first(rows, "item_id", limit).select("mv", "price", "qty_ordered")


def mv_vs_rounded_gross(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), _mv_differs_from(F.round(_gross(), 0)))


# --- test data -------------------------------------------------------------


def backslash_n_scan(staging: DataFrame) -> DataFrame:
    columns = {
        "status_fake_null": "status",
        "payment_fake_null": "payment_method",
        "sku_fake_null": "sku",
    }
    return checks.token_scan(valid_rows(staging), columns, BACKSLASH_N)


def status_backslash_n_rows(staging: DataFrame) -> DataFrame:
    return valid_rows(staging).where(F.col("status") == BACKSLASH_N)


def test_sku_list(staging: DataFrame) -> DataFrame:
    rows = valid_rows(staging).where(F.col("sku").ilike("%test%"))
    counted = rows.groupBy("sku").agg(F.count("*").alias("row_count"))
    return counted.orderBy(F.desc("row_count"), "sku")


def test_sku_rows(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), is_test_sku("sku"))


def baseline_orders_customers(staging: DataFrame) -> DataFrame:
    return valid_rows(staging).agg(
        F.count_distinct("increment_id").alias("total_orders"),
        F.count_distinct("customer_id").alias("total_customers"),
    )


def fully_test_customers(staging: DataFrame) -> DataFrame:
    counted = checks.wholly_matching_groups(
        valid_rows(staging), "customer_id", "increment_id", is_regular_sku("sku"),
        "total_orders", "non_test_orders",
    )
    return counted.where(F.col("non_test_orders") == 0).agg(
        F.count("*").alias("fully_test_customers"), F.sum("total_orders").alias("orders_affected")
    )


# --- discounts and lengths -------------------------------------------------


def negative_money(staging: DataFrame) -> DataFrame:
    return count_each(
        valid_rows(staging),
        {
            "negative_price": money("price") < 0,
            "negative_discount": money("discount_amount") < 0,
        },
    )


def negative_discount_rows(staging: DataFrame) -> DataFrame:
    return valid_rows(staging).where(money("discount_amount") < 0)


def discount_exceeds_gross(staging: DataFrame) -> DataFrame:
    return count_rows(valid_rows(staging), F.abs(money("discount_amount")) > _gross())


def discount_candidates(order_amounts: DataFrame) -> DataFrame:
    """Orders of several items that all carry the same discount, which is not zero."""
    repeated = (F.col("items") > 1) & F.col("one_discount")
    return order_amounts.where(repeated & (F.col("shared_discount") != 0))


def _discount_formulas() -> dict[str, Column]:
    """How the items of an order and its one discount may add up to its total."""
    return {
        "order_level": F.col("sum_gross") - F.col("shared_discount"),
        "item_level": F.col("sum_gross") - F.col("summed_discount"),
    }


def discount_hypotheses(order_amounts: DataFrame) -> DataFrame:
    """Both formulas and the residual from one pass over the orders."""
    return checks.hypothesis_test(
        discount_candidates(order_amounts), _discount_formulas(), F.col("order_grand_total"),
        total="total_candidates", every="both", none="neither",
    )


def discount_order_level(order_amounts: DataFrame) -> DataFrame:
    tested = discount_hypotheses(order_amounts)
    return tested.select(
        "total_candidates",
        F.col("order_level").alias("matches_hypothesis"),
        (F.col("total_candidates") - F.col("order_level")).alias("mismatches"),
    )


def discount_item_level(order_amounts: DataFrame) -> DataFrame:
    tested = discount_hypotheses(order_amounts)
    return tested.select(F.col("item_level").alias("matches_summed_hypothesis"))


def discount_residual(order_amounts: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidate orders that neither formula explains; ``limit`` gives a sample."""
    amounts = ["sum_gross", "shared_discount", "summed_discount", "order_grand_total"]
    actual = F.col("order_grand_total")
    explained = {name: within(formula, actual) for name, formula in _discount_formulas().items()}
    rows = (
        discount_candidates(order_amounts)
        .where(~explained["order_level"] & ~explained["item_level"])
        .select("increment_id", *amounts)
    )
    if limit is not None:
        rows = rows.orderBy("increment_id").limit(limit)
    return _as_double(rows, *amounts)


def order_text_max_length(staging: DataFrame) -> DataFrame:
    return checks.length_bounds(
        valid_rows(staging),
        {
            "max_increment_id_length": "increment_id",
            "max_payment_method_length": "payment_method",
            "max_status_length": "status",
        },
    )


# --- the audit at a glance -------------------------------------------------


def row_findings(staging: DataFrame) -> DataFrame:
    """All row-level findings with their share of the populated rows, in one scan."""
    bad_number = checks.any_mismatch(dict.fromkeys(NUMERIC_COLUMNS, NUMERIC_TEXT))
    dash, gross = _is_dash(), _gross()
    conditions = {
        "category_backslash_n": F.col("category_name_1") == BACKSLASH_N,
        "status_backslash_n": F.col("status") == BACKSLASH_N,
        "status_blank": F.col("status") == BLANK,
        "sku_blank": F.col("sku") == BLANK,
        "test_sku": is_test_sku("sku"),
        "customer_na": F.col("customer_id") == SPREADSHEET_NA,
        "order_id_with_suffix": not_matching("increment_id", DIGITS_TEXT),
        "number_unreadable": bad_number,
        "date_columns_differ": F.col("created_at") != F.col("working_date"),
        "mv_dash": dash,
        "mv_differs_from_gross": _mv_differs_from(gross),
        "mv_differs_from_rounded_gross": _mv_differs_from(F.round(gross, 0)),
        "internal_payment": is_internal(),
        "discount_negative": money("discount_amount") < 0,
        "discount_exceeds_gross": F.abs(money("discount_amount")) > gross,
    }
    counted = count_each(valid_rows(staging), {**conditions, "valid_rows": F.lit(True)})
    findings = counted.unpivot("valid_rows", list(conditions), "finding", "rows")
    return checks.materiality(
        findings.select("finding", "rows", "valid_rows"), "rows", "valid_rows"
    )


# --- found, not given ------------------------------------------------------

# Columns whose values have a form; names, labels and product keys are free text.
FORMED_COLUMNS = (
    "item_id", "created_at", "price", "qty_ordered", "grand_total", "increment_id",
    "discount_amount", "working_date", "mv", "year", "month", "customer_since", "m_y", "fy",
    "customer_id",
)
AMOUNT_COLUMNS = ("price", "qty_ordered", "grand_total", "discount_amount", "mv", "year", "month")
DATE_COLUMNS = ("created_at", "working_date")


def shape_profile(staging: DataFrame) -> DataFrame:
    """The shapes of all columns with a form, and a pattern for each."""
    return shapes.shape_profile(valid_rows(staging), FORMED_COLUMNS)


def shape_offenders(staging: DataFrame) -> DataFrame:
    """Values whose shape is rare in their column."""
    return shapes.shape_offenders(valid_rows(staging), FORMED_COLUMNS)


def readings() -> list[Reading]:
    """Every column as text, some as numbers or dates, and amounts that follow from others."""

    def number(value: Column) -> Column:
        return value.cast(MONEY).cast("string")

    as_text = [Reading(c, "text", F.nullif(F.col(c), F.lit(BLANK))) for c in STAGING_COLUMNS]
    as_number = [Reading(c, "number", number(clean_money(c))) for c in AMOUNT_COLUMNS]
    as_date = [
        Reading(c, "date", parse_date(c, ORDER_DATE_FORMAT).cast("string")) for c in DATE_COLUMNS
    ]
    derived = [
        Reading("gross", "number", number(_gross())),
        Reading("rounded gross", "number", number(F.round(_gross(), 0))),
        Reading("month and year", "text", F.concat("month", F.lit("-"), "year")),
    ]
    return [*as_text, *as_number, *as_date, *derived]


def redundant_pairs(staging: DataFrame) -> DataFrame:
    """All pairs of columns, read one way or another, that agree in every populated row."""
    return redundancy.redundant_pairs(valid_rows(staging), "item_id", readings())
