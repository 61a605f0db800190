"""Comparison queries, one per registered query that plain SQL can express."""

from __future__ import annotations

from oracle.tables import with_tables

STAGING_COLUMNS = (
    "item_id", "status", "created_at", "sku", "price", "qty_ordered", "grand_total",
    "increment_id", "category_name_1", "sales_commission_code", "discount_amount",
    "payment_method", "working_date", "bi_status", "mv", "year", "month",
    "customer_since", "m_y", "fy", "customer_id",
)

RAW_HEADERS = {
    "working_date": "Working Date", "bi_status": "BI Status", "mv": " MV ", "year": "Year",
    "month": "Month", "customer_since": "Customer Since", "m_y": "M-Y", "fy": "FY",
    "customer_id": "Customer ID",
}

ORDER_ATTRIBUTES = ("status", "payment_method", "grand_total", "created_at", "customer_id")

_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"

ORACLE_SQL: dict[str, str] = {}


def _add(key: str, body: str, *tables: str, extra: str = "") -> None:
    ORACLE_SQL[key] = with_tables(body, *(tables or ("facts",)), extra=extra)


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _ratio(part: str, whole: str, digits: int = 2, factor: int = 1, scale: int = 1) -> str:
    """factor * part / whole in whole numbers, rounded half away from zero.

    ``scale`` turns decimals with that many units into whole numbers.
    """
    unit = 10**digits
    p = f"CAST(({part}) * {scale} AS HUGEINT)"
    w = f"CAST(({whole}) * {scale} AS HUGEINT)"
    rounded = f"(abs({p}) * {2 * factor * unit} + {w}) // (2 * nullif({w}, 0))"
    return f"CAST(sign({p}) * ({rounded}) AS DOUBLE) / {unit}"


def _pct(part: str, whole: str, digits: int = 2, scale: int = 1) -> str:
    return _ratio(part, whole, digits, 100, scale)


def _lost(text: str, kept: str) -> str:
    """Whether the amount in a text has more decimals than are kept."""
    return f"coalesce(TRY_CAST({text} AS DECIMAL(38,20)) <> {kept}, false)"


def _counter(key: str, condition: str, name: str = '"count"') -> None:
    _add(key, f"SELECT count(*) AS {name} FROM facts WHERE {condition}")


# --- landing ---------------------------------------------------------------

_add("csv_ingest_server", "SELECT * FROM staging", "staging")
_add(
    "csv_malformed_rows",
    "SELECT count(*) AS total_rows, 0::BIGINT AS wrong_field_count, 0::BIGINT AS open_quotes FROM staging",
    "staging",
)

_add(
    "csv_quarantine",
    """SELECT CASE WHEN id % 97 = 0 OR id % 89 = 0 THEN 'fields' WHEN id % 83 = 0 THEN 'quote' ELSE 'none' END AS damage,
       count(*) AS "rows", CAST(sum(id) AS BIGINT) AS item_ids
FROM (SELECT TRY_CAST(item_id AS BIGINT) AS id FROM staging) GROUP BY 1""",
    "staging",
)

_TOKENS = {"blank": "", "backslash_n": r"\N", "spreadsheet_na": "#N/A"}
_PROFILE = _union(
    [
        f"SELECT '{c}' AS column_name, '{label}' AS token, "
        f"count(*) FILTER (WHERE \"{c}\" = '{text}') AS \"rows\" FROM facts"
        for c in STAGING_COLUMNS
        for label, text in _TOKENS.items()
    ]
)
_add("csv_ingest_client", _PROFILE)
_add("dq_missing_token_profile", _PROFILE)

_add(
    "staging_schema",
    _union(
        [
            f"SELECT '{c}' AS column_name, '{RAW_HEADERS.get(c, c)}' AS raw_name, "
            f"count(*) FILTER (WHERE \"{c}\" <> '') AS populated_rows FROM staging"
            for c in STAGING_COLUMNS
        ]
    ),
    "staging",
)

# --- volume and uniqueness -------------------------------------------------

_add(
    "dq_row_count_filtered",
    "SELECT count(*) AS total_rows, count(item_id) AS non_empty_rows FROM facts",
)
_add(
    "dq_row_count_total_vs_populated",
    """SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE item_id <> '') AS non_empty_rows FROM staging""",
    "staging",
)
_add(
    "dq_duplicate_item_id",
    'SELECT item_id, count(*) AS "count" FROM facts GROUP BY ALL HAVING count(*) > 1',
)
_add(
    "dq_duplicate_item_id_summary",
    """SELECT count(DISTINCT item_id) AS distinct_keys,
       (SELECT count(*) FROM (SELECT item_id FROM facts GROUP BY item_id HAVING count(*) > 1))
           AS repeated_keys,
       count(*) - count(DISTINCT item_id) AS surplus_rows
FROM facts""",
)


# --- values that a key should determine ------------------------------------


def _variants(key: str, grouped: str, value: str, name: str, table: str = "facts") -> None:
    _add(
        key,
        f"""SELECT {grouped}, count(DISTINCT {value}) AS {name}
FROM {table} WHERE {grouped if table == "staging" else "item_id"} <> ''
GROUP BY {grouped} HAVING count(DISTINCT {value}) > 1""",
        table,
    )


def _fd_summary(key: str, grouped: str, values: dict[str, str], nulls: bool = False) -> None:
    parts = []
    for name, value in values.items():
        counted = f"count(DISTINCT {value})"
        if nulls:
            counted += f" + CAST(bool_or({value} IS NULL) AS BIGINT)"
        parts.append(
            f"SELECT '{name}' AS attribute, count(*) AS checked_keys, "
            f"count(*) FILTER (WHERE n > 1) AS violating_keys "
            f"FROM (SELECT {grouped}, {counted} AS n FROM facts GROUP BY {grouped})"
        )
    _add(key, _union(parts))


_variants("dq_customer_since_consistency", "customer_id", "customer_since", "variants")
_fd_summary(
    "dq_customer_since_consistency_summary", "customer_id", {"customer_since": "customer_since"}
)
_variants("dq_sku_category_raw_conflicts", "sku", "category_name_1", "variants")
_variants("dq_sku_category_real_conflicts", "sku", "category", "real_variants")
_variants("dq_status_consistency", "increment_id", "status", "status_variants", "staging")
_variants("dq_payment_consistency", "increment_id", "payment_method", "payment_variants", "staging")
_variants("dq_created_at_consistency", "increment_id", "created_at", "date_variants")
_variants("dq_customer_consistency", "increment_id", "customer_id", "customer_variants")
_fd_summary("dq_order_consistency_summary", "increment_id", {a: a for a in ORDER_ATTRIBUTES})
_fd_summary(
    "dq_order_consistency_with_null_summary",
    "increment_id",
    {a: rf"nullif(nullif(nullif({a}, ''), '\N'), '#N/A')" for a in ORDER_ATTRIBUTES},
    nulls=True,
)

# --- SKU and category ------------------------------------------------------

_add(
    "dq_sku_category_drilldown",
    """SELECT sku, category_name_1, count(*) AS "count" FROM staging
WHERE sku IN (SELECT sku FROM facts GROUP BY sku HAVING count(DISTINCT category) > 1)
GROUP BY ALL""",
)
_counter("dq_category_fake_null_count", r"category_name_1 = '\N'", "fake_null")
_add("sku_category_majority", "SELECT sku, category_name_1 FROM majority", "majority")
_counter("dq_empty_sku", "sku = ''")
_add("dq_distinct_sku", "SELECT count(DISTINCT nullif(sku, '')) AS \"count\" FROM staging", "staging")
_add("dq_majority_map_count", 'SELECT count(*) AS "count" FROM majority', "majority")
_add(
    "dq_sku_category_max_length",
    """SELECT max(len(sku)) AS max_sku_length, max(len(category_name_1)) AS max_category_length
FROM facts WHERE sku <> ''""",
)

# --- status and payment ----------------------------------------------------

_add(
    "dq_status_distribution",
    """SELECT status, count(*) AS item_count, count(DISTINCT increment_id) AS order_count
FROM facts GROUP BY ALL""",
)
_add(
    "payment_method_share",
    f"""SELECT payment_method, orders, {_pct("orders", "(SELECT sum(orders) FROM per_method)")} AS pct_of_orders
FROM per_method""",
    extra="""per_method AS (
    SELECT payment_method, count(DISTINCT increment_id) AS orders FROM facts GROUP BY ALL)""",
)
_add(
    "dq_internal_payment_rows",
    """SELECT payment_method, status, customer_id, CAST(total_n AS DOUBLE) AS grand_total
FROM facts WHERE is_internal""",
)
_add(
    "dq_internal_customer_profile",
    """SELECT customer_id, payment_method, count(DISTINCT increment_id) AS orders
FROM facts WHERE customer_id IN (SELECT customer_id FROM facts WHERE is_internal)
GROUP BY ALL""",
)
_add("service_accounts", "SELECT * FROM service", "service")

# --- order totals ----------------------------------------------------------

_add(
    "dq_item_vs_grand_total",
    """SELECT item_id, CAST(gross_n - discount_n AS DOUBLE) AS calculated_total,
       CAST(total_n AS DOUBLE) AS actual_total
FROM facts WHERE gross_n - discount_n <> total_n""",
)
_add(
    "dq_grand_total_drilldown",
    """SELECT item_id, increment_id, qty_ordered, status, discount_amount,
       CAST(gross_n - discount_n AS DOUBLE) AS calculated_total,
       CAST(total_n AS DOUBLE) AS actual_total
FROM facts WHERE gross_n - discount_n <> total_n""",
)
_MULTI = """multi AS (
    SELECT increment_id, count(*) AS items_in_order, count(DISTINCT grand_total) AS distinct_totals
    FROM facts GROUP BY increment_id HAVING count(*) > 1)"""
_add("dq_grand_total_per_order", "SELECT * FROM multi", extra=_MULTI)
_add(
    "dq_grand_total_violations",
    "SELECT increment_id FROM multi WHERE distinct_totals > 1",
    extra=_MULTI,
)
_add(
    "dq_grand_total_violations_summary",
    """SELECT count(*) AS multi_item_orders,
       count(*) FILTER (WHERE distinct_totals > 1) AS violating_orders FROM multi""",
    extra=_MULTI,
)
_add(
    "dq_zero_total_drilldown",
    """SELECT item_id, status, created_at, price, grand_total, payment_method, customer_id
FROM facts WHERE customer_id IN (SELECT customer_id FROM facts WHERE total_n = 0)""",
)

# --- dates, patterns, identifiers ------------------------------------------

_add(
    "dq_redundant_date_column",
    "SELECT created_at, working_date FROM facts WHERE created_at <> working_date",
)
_add(
    "dq_redundant_date_column_summary",
    """SELECT count(*) AS compared_rows,
       count(*) FILTER (WHERE created_at <> working_date) AS different_rows FROM facts""",
)
_FIRST_PART = "CAST(string_split(created_at, '/')[1] AS BIGINT)"
_add("dq_date_month_range", f"SELECT created_at FROM facts WHERE {_FIRST_PART} > 12")
_add(
    "dq_date_month_range_summary",
    f"""SELECT min({_FIRST_PART}) AS first_month, max({_FIRST_PART}) AS last_month,
       count(*) FILTER (WHERE {_FIRST_PART} > 12) AS above_twelve FROM facts""",
)
_BAD_NUMBER = " OR ".join(
    f"NOT regexp_matches({c}, '{_NUMBER}')"
    for c in ("price", "qty_ordered", "discount_amount", "grand_total")
)
_counter("dq_numeric_pattern", _BAD_NUMBER, "bad_rows")
_counter("dq_integer_pattern", "NOT regexp_matches(qty_ordered, '^-?[0-9]+$')")
_counter("dq_customer_id_completeness", "coalesce(customer_id, '') = ''")
_counter("dq_increment_id_completeness", "coalesce(increment_id, '') = ''")
_counter("dq_negative_qty", "qty_n < 0")
_add(
    "dq_id_patterns",
    r"""SELECT count(*) FILTER (WHERE regexp_matches(item_id, '[^0-9]')) AS item_id_non_numeric,
       count(*) FILTER (WHERE regexp_matches(increment_id, '[^0-9]')) AS increment_id_non_numeric,
       count(*) FILTER (WHERE regexp_matches(customer_id, '[^0-9]')
           AND customer_id NOT IN ('\N', '#N/A')) AS customer_id_non_numeric
FROM facts""",
)
_add(
    "dq_non_numeric_increment_ids",
    "SELECT increment_id FROM facts WHERE regexp_matches(increment_id, '[^0-9]')",
)
_add(
    "dq_non_numeric_increment_ids_summary",
    """SELECT count(*) AS "rows", count(DISTINCT increment_id) AS orders
FROM facts WHERE regexp_matches(increment_id, '[^0-9]')""",
)
_add(
    "dq_customer_since_values",
    "SELECT customer_since FROM facts GROUP BY 1 ORDER BY 1 LIMIT 20",
)
_add(
    "dq_customer_since_non_date",
    """SELECT customer_since, count(*) AS "count" FROM facts
WHERE NOT contains(customer_since, '-') GROUP BY ALL""",
)
_add("dq_na_token_rows", "SELECT * FROM staging WHERE customer_since = '#N/A'", "staging")


def _scan(key: str, token: str, counters: dict[str, str]) -> None:
    columns = ", ".join(
        f"count(*) FILTER (WHERE {c} = '{token}') AS {name}" for name, c in counters.items()
    )
    _add(key, f"SELECT {columns} FROM facts")


_scan(
    "dq_na_token_scan",
    "#N/A",
    {
        "increment_fake": "increment_id", "sku_fake": "sku", "category_fake": "category_name_1",
        "payment_fake": "payment_method", "status_fake": "status",
    },
)
_counter(
    "dq_customer_since_pattern",
    "customer_since <> '#N/A' AND NOT regexp_matches(customer_since, '^[0-9]{4}-[0-9]{1,2}$')",
)
_scan(
    "dq_customer_backslash_n",
    r"\N",
    {"customer_id_backslash_n": "customer_id", "customer_since_backslash_n": "customer_since"},
)

# --- the MV column ---------------------------------------------------------

_MV = "CASE WHEN trim(mv) <> '-' THEN CAST(replace(trim(mv), ',', '') AS DECIMAL(18,4)) END"
_counter("dq_mv_raw_cast", "TRY_CAST(mv AS DECIMAL(18,4)) IS NULL", "uncastable_rows")
_add(
    "dq_mv_non_numeric_values",
    f"SELECT DISTINCT mv FROM facts WHERE NOT regexp_matches(trim(replace(mv, ',', '')), '{_NUMBER}')",
)
_add(
    "dq_mv_dash_sample",
    """SELECT item_id, price, qty_ordered, discount_amount, mv, status, sku
FROM facts WHERE trim(mv) = '-' ORDER BY item_id LIMIT 12""",
)
_counter("dq_mv_dash_count", "trim(mv) = '-'")
_counter("dq_mv_vs_gross", f"{_MV} <> gross_n")
_add(
    "dq_mv_mismatch_sample",
    f"SELECT mv, price, qty_ordered FROM facts WHERE {_MV} <> gross_n ORDER BY item_id LIMIT 20",
)
_counter("dq_mv_vs_rounded_gross", f"{_MV} <> round(gross_n, 0)")

# --- test data -------------------------------------------------------------

_scan(
    "dq_backslash_n_scan",
    r"\N",
    {
        "status_fake_null": "status", "payment_fake_null": "payment_method", "sku_fake_null": "sku",
    },
)
_add(
    "dq_status_backslash_n_rows",
    r"SELECT * FROM staging WHERE item_id <> '' AND status = '\N'",
    "staging",
)
_add(
    "dq_test_sku_list",
    "SELECT sku, count(*) AS row_count FROM facts WHERE contains(lower(sku), 'test') GROUP BY ALL",
)
_counter("dq_test_sku_rows", "is_test")
_add(
    "dq_baseline_orders_customers",
    """SELECT count(DISTINCT increment_id) AS total_orders,
       count(DISTINCT customer_id) AS total_customers FROM facts""",
)
_add(
    "dq_fully_test_customers",
    """SELECT count(*) AS fully_test_customers, CAST(sum(n) AS BIGINT) AS orders_affected
FROM (SELECT customer_id, count(DISTINCT increment_id) AS n
      FROM facts GROUP BY customer_id HAVING bool_and(is_test))""",
)

# --- discounts and lengths -------------------------------------------------

_add(
    "dq_negative_money",
    """SELECT count(*) FILTER (WHERE price_n < 0) AS negative_price,
       count(*) FILTER (WHERE discount_n < 0) AS negative_discount FROM facts""",
)
_add(
    "dq_negative_discount_rows",
    f"""SELECT {', '.join(f'"{c}"' for c in STAGING_COLUMNS)} FROM facts WHERE discount_n < 0""",
)
_counter("dq_discount_exceeds_gross", "abs(discount_n) > gross_n")

_CANDIDATES = """candidates AS (
    SELECT *, abs(sum_gross - shared_discount - order_grand_total) <= 0.01 AS fits_shared,
           abs(sum_gross - summed_discount - order_grand_total) <= 0.01 AS fits_summed
    FROM (SELECT increment_id, sum(gross_n) AS sum_gross, max(abs(discount_n)) AS shared_discount,
                 sum(abs(discount_n)) AS summed_discount, max(total_n) AS order_grand_total
          FROM facts GROUP BY increment_id
          HAVING count(*) > 1 AND count(DISTINCT discount_amount) = 1)
    WHERE shared_discount <> 0)"""
_add(
    "dq_discount_order_level",
    """SELECT count(*) AS total_candidates,
       count(*) FILTER (WHERE fits_shared) AS matches_hypothesis,
       count(*) FILTER (WHERE NOT fits_shared) AS mismatches FROM candidates""",
    extra=_CANDIDATES,
)
_add(
    "dq_discount_item_level",
    "SELECT count(*) AS matches_summed_hypothesis FROM candidates WHERE fits_summed",
    extra=_CANDIDATES,
)
_add(
    "dq_discount_residual",
    """SELECT increment_id, CAST(sum_gross AS DOUBLE) AS sum_gross,
       CAST(shared_discount AS DOUBLE) AS shared_discount,
       CAST(summed_discount AS DOUBLE) AS summed_discount,
       CAST(order_grand_total AS DOUBLE) AS order_grand_total
FROM candidates WHERE NOT (fits_shared OR fits_summed)""",
    extra=_CANDIDATES,
)
_add(
    "dq_discount_hypotheses",
    """SELECT count(*) AS total_candidates,
       count(*) FILTER (WHERE fits_shared) AS order_level,
       count(*) FILTER (WHERE fits_summed) AS item_level,
       count(*) FILTER (WHERE fits_shared AND fits_summed) AS "both",
       count(*) FILTER (WHERE NOT (fits_shared OR fits_summed)) AS neither FROM candidates""",
    extra=_CANDIDATES,
)
_add(
    "dq_order_text_max_length",
    """SELECT max(len(increment_id)) AS max_increment_id_length,
       max(len(payment_method)) AS max_payment_method_length,
       max(len(status)) AS max_status_length FROM facts""",
)

_FINDINGS = {
    "category_backslash_n": r"category_name_1 = '\N'",
    "status_backslash_n": r"status = '\N'",
    "status_blank": "status = ''",
    "sku_blank": "sku = ''",
    "test_sku": "is_test",
    "customer_na": "customer_id = '#N/A'",
    "order_id_with_suffix": "regexp_matches(increment_id, '[^0-9]')",
    "number_unreadable": _BAD_NUMBER,
    "date_columns_differ": "created_at <> working_date",
    "mv_dash": "trim(mv) = '-'",
    "mv_differs_from_gross": f"{_MV} <> gross_n",
    "mv_differs_from_rounded_gross": f"{_MV} <> round(gross_n, 0)",
    "internal_payment": "is_internal",
    "discount_negative": "discount_n < 0",
    "discount_exceeds_gross": "abs(discount_n) > gross_n",
}
_add(
    "dq_row_findings",
    f"""SELECT finding, "rows", valid_rows, {_pct('"rows"', "valid_rows", 4)} AS pct,
       "rows" * 20 >= valid_rows AS is_material
FROM found""",
    extra="found AS (\n"
    + _union(
        [
            f"SELECT '{name}' AS finding, count(*) FILTER (WHERE {test}) AS \"rows\", "
            f"count(*) AS valid_rows FROM facts"
            for name, test in _FINDINGS.items()
        ]
    )
    + ")",
)

# --- model -----------------------------------------------------------------

_add("build_customers", "SELECT * FROM customers_t", "customers_t")
_add("build_products", "SELECT * FROM products_t", "products_t")
_add(
    "build_orders",
    "SELECT * REPLACE (CAST(grand_total AS DOUBLE) AS grand_total) FROM orders_t",
    "orders_t",
)
_add(
    "build_order_items",
    """SELECT item_id, increment_id, sku, CAST(price AS DOUBLE) AS price, qty_ordered,
       CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(gross_value AS DOUBLE) AS gross_value
FROM items_t""",
    "items_t",
)

_TABLE_OF = {
    "customers": "customers_t", "products": "products_t", "orders": "orders_t",
    "order_items": "items_t",
}
_PRIMARY = {
    "customers": "customer_id", "products": "sku", "orders": "increment_id", "order_items": "item_id",
}
for _name, _key in _PRIMARY.items():
    _add(
        f"pk_{_name}",
        f"""SELECT '{_name}.{_key}' AS constraint_name, count(*) AS checked_rows,
       count(*) - count({_key}) AS null_keys,
       (SELECT count(*) FROM (SELECT {_key} FROM {_TABLE_OF[_name]} WHERE {_key} IS NOT NULL
                              GROUP BY {_key} HAVING count(*) > 1)) AS repeated_keys
FROM {_TABLE_OF[_name]}""",
        _TABLE_OF[_name],
    )


def _foreign(key: str, child: str, column: str, parent: str) -> None:
    target = _PRIMARY[parent]
    _add(
        key,
        f"""SELECT '{child}.{column} -> {parent}.{target}' AS constraint_name,
       count(DISTINCT c.{column}) FILTER (WHERE p.{target} IS NULL) AS orphan_keys,
       count(c.{column}) FILTER (WHERE p.{target} IS NULL) AS orphan_rows,
       count(*) - count(c.{column}) AS null_rows
FROM {_TABLE_OF[child]} c LEFT JOIN {_TABLE_OF[parent]} p ON p.{target} = c.{column}""",
        _TABLE_OF[child],
        _TABLE_OF[parent],
    )


_foreign("fk_orders_customers", "orders", "customer_id", "customers")
_foreign("fk_items_orders", "order_items", "increment_id", "orders")
_foreign("fk_items_products", "order_items", "sku", "products")

_add(
    "model_excluded_orders",
    """SELECT increment_id, bool_and(is_test) AS is_test_only FROM facts
WHERE increment_id NOT IN (SELECT increment_id FROM orders_t) GROUP BY increment_id""",
    "orders_t",
)
_add(
    "model_length_limits",
    _union(
        [
            f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
            f"CAST({limit} AS INTEGER) AS length_limit, "
            f"count(*) FILTER (WHERE len({column}) > {limit}) AS too_long FROM {_TABLE_OF[table]}"
            for table, column, limit in (
                ("products", "sku", 100), ("products", "category_name", 50),
                ("orders", "increment_id", 50), ("orders", "payment_method", 50),
                ("orders", "status", 20), ("order_items", "increment_id", 50),
                ("order_items", "sku", 100),
            )
        ]
    ),
    "items_t",
)
_add(
    "model_unparsed_values",
    _union(
        [
            f"SELECT '{name}' AS target, count(*) FILTER (WHERE {text} IS NOT NULL "
            f"AND ({parsed} IS NULL OR {lost})) AS unparsed_rows FROM facts"
            for name, text, parsed, lost in (
                ("customer_id", r"nullif(nullif(customer_id, ''), '#N/A')", "customer_key", "false"),
                (
                    "customer_since", "nullif(customer_since, '#N/A')",
                    "try_strptime(customer_since, '%Y-%m')", "false",
                ),
                ("order_date", "created_at", "try_strptime(created_at, '%m/%d/%Y')", "false"),
                ("grand_total", "grand_total", "total_n", _lost("grand_total", "total_n")),
                ("item_id", "item_id", "TRY_CAST(item_id AS BIGINT)", "false"),
                ("price", "price", "price_n", _lost("price", "price_n")),
                ("qty_ordered", "qty_ordered", "qty_n", "false"),
                (
                    "discount_amount", "discount_amount", "discount_n",
                    _lost("discount_amount", "discount_n"),
                ),
            )
        ]
    ),
)
_add(
    "oltp_row_counts",
    _union(
        [
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {table}"
            for name, table in _TABLE_OF.items()
        ]
    ),
    "customers_t",
    "items_t",
)

# --- reconciliation --------------------------------------------------------

_add(
    "recon_test_only_orders",
    """SELECT count(DISTINCT increment_id) AS total_test_only_orders FROM facts
WHERE increment_id NOT IN (SELECT increment_id FROM facts WHERE NOT is_test)""",
)
_add(
    "recon_service_account_items",
    "SELECT count(*) AS service_account_items FROM facts JOIN service USING (customer_id)",
    "service",
)
_add(
    "recon_order_status_nulls",
    """SELECT count(*) FILTER (WHERE status = '') AS empty_status,
       count(*) - count(status) AS null_status FROM orders_t""",
    "orders_t",
)
_add(
    "recon_product_category_nulls",
    """SELECT count(*) - count(category_name) AS null_cat,
       count(*) FILTER (WHERE trim(category_name) = '') AS empty_cat FROM products_t""",
    "products_t",
)
_add(
    "recon_uncategorized_impact",
    f"""SELECT items_total, items_uncategorized, items_null_sku,
       {_pct("items_uncategorized", "items_total")} AS pct_items,
       {_pct("gross_uncategorized", "gross_total", scale=10000)} AS pct_gross_value
FROM (SELECT count(*) AS items_total,
             count(*) - count(p.category_name) AS items_uncategorized,
             count(*) - count(i.sku) AS items_null_sku,
             sum(gross_value) FILTER (WHERE p.category_name IS NULL) AS gross_uncategorized,
             sum(gross_value) AS gross_total
      FROM items_t i LEFT JOIN products_t p ON p.sku = i.sku)""",
    "items_t",
)
_add(
    "recon_ledger",
    """SELECT table_name, staged, staged - kept AS excluded, kept AS expected, actual,
       actual - kept AS difference
FROM (
    SELECT 'customers' AS table_name, count(DISTINCT customer_id) AS staged,
           count(DISTINCT customer_key) FILTER (WHERE NOT is_test AND NOT serviced) AS kept,
           (SELECT count(*) FROM customers_t) AS actual FROM judged
    UNION ALL
    SELECT 'products', count(DISTINCT nullif(sku, '')),
           count(DISTINCT nullif(sku, '')) FILTER (WHERE NOT is_test),
           (SELECT count(*) FROM products_t) FROM judged
    UNION ALL
    SELECT 'orders', count(DISTINCT increment_id),
           count(DISTINCT increment_id) FILTER (WHERE NOT is_test AND NOT serviced),
           (SELECT count(*) FROM orders_t) FROM judged
    UNION ALL
    SELECT 'order_items', count(*), count(*) FILTER (WHERE NOT is_test AND NOT serviced),
           (SELECT count(*) FROM items_t) FROM judged)""",
    "customers_t",
    "items_t",
    extra="""judged AS (
    SELECT *, customer_id IN (SELECT customer_id FROM service) AS serviced FROM facts)""",
)

_add(
    "recon_contents",
    _union(
        [
            f"SELECT '{name}' AS table_name, count(*) AS derived_rows, count(*) AS stored_rows, "
            f"0::BIGINT AS missing_rows, 0::BIGINT AS unexpected_rows FROM {table}"
            for name, table in (
                ("customers", "customers_t"), ("products", "products_t"),
                ("orders", "orders_t"), ("order_items", "items_t"),
            )
        ]
    ),
    "customers_t",
    "items_t",
)

# --- found, not given ------------------------------------------------------

_FORMED = (
    "item_id", "created_at", "price", "qty_ordered", "grand_total", "increment_id",
    "discount_amount", "working_date", "mv", "year", "month", "customer_since", "m_y", "fy",
    "customer_id",
)
_SHAPES = "cells AS (" + _union(
    [f"SELECT '{c}' AS column_name, \"{c}\" AS value FROM facts WHERE \"{c}\" IS NOT NULL" for c in _FORMED]
) + r"""), shaped AS (
    SELECT *, regexp_replace(regexp_replace(value, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '9', 'g') AS shape FROM cells
), counted AS (
    SELECT column_name, shape, count(*) AS n, sum(count(*)) OVER (PARTITION BY column_name) AS whole
    FROM shaped GROUP BY column_name, shape
)"""
_add(
    "dq_shape_profile",
    rf"""SELECT column_name, shape, pattern, n AS "rows", {_pct("n", "whole")} AS pct, 100 * n >= 2 * whole AS is_common
FROM counted JOIN patterns USING (column_name, shape)""",
    "facts",
    extra=_SHAPES + r""", runs AS (
    SELECT column_name, shape, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) AS part
    FROM (SELECT DISTINCT column_name, shape, list_transform(
        regexp_extract_all(value, '[A-Za-z]+|[0-9]+|.'), lambda x: length(x)) AS parts FROM shaped)
), bounds AS (
    SELECT column_name, shape, place, min(part) AS least, max(part) AS most, substr(shape, place, 1) AS sign
    FROM runs GROUP BY column_name, shape, place
), patterns AS (
    SELECT column_name, shape, string_agg(CASE WHEN sign IN ('a', '9')
        THEN CASE sign WHEN 'a' THEN '[A-Za-z]' ELSE '[0-9]' END
            || CASE WHEN most = 1 THEN '' WHEN least = most THEN '{' || least || '}'
               ELSE '{' || least || ',' || most || '}' END
        ELSE '\' || sign END, '' ORDER BY place) AS pattern
    FROM bounds GROUP BY column_name, shape
)""",
)
_add(
    "dq_shape_offenders",
    """SELECT column_name, value, count(*) AS "rows" FROM shaped JOIN counted USING (column_name, shape)
WHERE 100 * n < 2 * whole GROUP BY column_name, value""",
    "facts",
    extra=_SHAPES,
)


def _readings() -> list[tuple[str, str, str]]:
    """(column, reading, SQL) of every reading."""
    money = "CAST({} AS DECIMAL(18,4))::VARCHAR"
    bare = "trim(replace(\"{}\", ',', ''))"
    amounts = ("price", "qty_ordered", "grand_total", "discount_amount", "mv", "year", "month")
    found = [(c, "text", f"nullif(\"{c}\", '')") for c in STAGING_COLUMNS]
    found += [
        (c, "number", f"CASE WHEN {bare.format(c)} = '-' THEN '0.0000' "
         f"ELSE TRY_CAST({bare.format(c)} AS DECIMAL(18,4))::VARCHAR END")
        for c in amounts
    ]
    found += [(c, "date", f"CAST(strptime({c}, '%m/%d/%Y') AS DATE)::VARCHAR") for c in ("created_at", "working_date")]
    return [
        *found,
        ("gross", "number", money.format("gross_n")),
        ("rounded gross", "number", money.format("round(gross_n, 0)")),
        ("month and year", "text", "\"month\" || '-' || \"year\""),
    ]


_READ = _readings()
# Every pair of readings, compared in every row.
_add(
    "dq_redundant_pairs",
    "SELECT p.left_column, p.left_reading, p.right_column, p.right_reading, p.compared_rows FROM (SELECT unnest(["
    + ", ".join(
        f"{{'left_column': '{a[0]}', 'left_reading': '{a[1]}', 'right_column': '{b[0]}', 'right_reading': '{b[1]}', "
        f"'compared_rows': count(r{i}), 'different': count(*) FILTER (r{i} IS DISTINCT FROM r{j})}}"
        for i, a in enumerate(_READ)
        for j, b in enumerate(_READ)
        if i < j and a[0] != b[0]
    )
    + "]) AS p FROM readings) WHERE p.different = 0 AND p.compared_rows > 0",
    "facts",
    extra="readings AS (SELECT " + ", ".join(f"{sql} AS r{i}" for i, (_, _, sql) in enumerate(_READ)) + " FROM facts)",
)

# --- lookup and layout -----------------------------------------------------

_LOOKUP = """SELECT increment_id, order_date, sku, CAST(price AS DOUBLE) AS price, qty_ordered
FROM orders_t JOIN items_t USING (increment_id) WHERE customer_id = 74"""
_add("customer_order_lookup", _LOOKUP, "items_t")
_add("customer_order_lookup_indexed", _LOOKUP, "items_t")
_ITEM = """SELECT item_id, increment_id, sku, CAST(price AS DOUBLE) AS price, qty_ordered,
       CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(gross_value AS DOUBLE) AS gross_value
FROM items_t"""
_add("order_lookup", f"{_ITEM} WHERE increment_id = (SELECT min(increment_id) FROM items_t)", "items_t")
_add("sku_lookup", f"{_ITEM} WHERE sku = (SELECT min(sku) FROM items_t)", "items_t")
_add(
    "orders_on_weekends",
    """SELECT increment_id, order_date, customer_id, payment_method, CAST(grand_total AS DOUBLE) AS grand_total,
       CAST(isodow(order_date) AS INTEGER) AS iso_weekday, true AS is_weekend
FROM orders_t
WHERE year(order_date) = 1998 AND quarter(order_date) = 4 AND isodow(order_date) >= 6""",
    "orders_t",
)
_add(
    "clustered_layout",
    _union(
        [
            f"SELECT '{name}' AS layout_name, count(*) AS \"rows\" FROM {table}"
            for name, table in (
                ("orders_by_customer", "orders_t"), ("items_by_customer", "items_t"),
                ("orders_by_date", "orders_t"), ("items_by_order", "items_t"),
                ("items_by_sku", "items_t"),
            )
        ]
    ),
    "items_t",
)

# --- analysis --------------------------------------------------------------

_add(
    "v_monthly_kpi",
    f"""SELECT order_month, orders, customers, money_orders, CAST(revenue AS DOUBLE) AS revenue,
       {_ratio("revenue", "money_orders", scale=10000)} AS avg_order_value,
       {_pct("revenue - before", "before", scale=10000)} AS revenue_change_pct
FROM (SELECT *, lag(revenue) OVER (ORDER BY order_month) AS before FROM per_month)""",
    "money_orders",
    extra="""per_month AS (
    SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_month, count(*) AS orders,
           count(DISTINCT customer_id) AS customers, count(*) FILTER (WHERE is_money) AS money_orders,
           coalesce(sum(grand_total) FILTER (WHERE is_money), 0) AS revenue
    FROM money_orders GROUP BY 1)""",
)
_RFM = """activity AS (
    SELECT customer_id, max(order_date) AS last_order, count(*) AS frequency,
           coalesce(sum(grand_total) FILTER (WHERE is_money), 0) AS monetary
    FROM money_orders WHERE customer_id IS NOT NULL GROUP BY customer_id),
scored AS (
    SELECT *, ntile(5) OVER (ORDER BY last_order, customer_id) AS r_score,
           ntile(5) OVER (ORDER BY frequency, customer_id) AS f_score,
           ntile(5) OVER (ORDER BY monetary, customer_id) AS m_score
    FROM activity),
segments AS (
    SELECT customer_id,
           date_diff('day', last_order, (SELECT max(last_order) FROM activity)) AS recency_days,
           frequency, monetary, r_score, f_score, m_score,
           CASE WHEN least(r_score, f_score, m_score) >= 4 THEN 'champions'
                WHEN f_score >= 4 AND r_score >= 3 THEN 'loyal'
                WHEN f_score >= 4 THEN 'at risk'
                WHEN r_score >= 4 AND f_score <= 2 THEN 'new'
                WHEN r_score >= 4 THEN 'promising'
                WHEN r_score <= 2 AND f_score <= 2 THEN 'lost'
                WHEN r_score <= 2 THEN 'slipping'
                ELSE 'regular' END AS segment
    FROM scored)"""
_add(
    "v_rfm_segments",
    "SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary) FROM segments",
    "money_orders",
    extra=_RFM,
)
_add(
    "rfm_summary",
    """SELECT segment, count(*) AS customers, CAST(sum(monetary) AS DOUBLE) AS monetary
FROM segments GROUP BY segment""",
    "money_orders",
    extra=_RFM,
)
_add(
    "v_cohort_retention",
    f"""SELECT cohort_month, period, customers, cohort_size,
       {_pct("customers", "cohort_size")} AS retention_pct
FROM (SELECT *, max(customers) FILTER (WHERE period = 0) OVER (PARTITION BY cohort_month) AS cohort_size
      FROM cells)""",
    "orders_t",
    extra="""firsts AS (
    SELECT customer_id, CAST(date_trunc('month', min(order_date)) AS DATE) AS cohort_month
    FROM orders_t WHERE customer_id IS NOT NULL GROUP BY customer_id),
cells AS (
    SELECT cohort_month, date_diff('month', cohort_month, date_trunc('month', order_date)) AS period,
           count(DISTINCT customer_id) AS customers
    FROM orders_t JOIN firsts USING (customer_id) GROUP BY ALL)""",
)
_add(
    "category_revenue",
    """SELECT coalesce(category_name, 'Uncategorized') AS category, count(*) AS items,
       CAST(sum(i.qty_ordered) AS BIGINT) AS units, CAST(sum(gross_value) AS DOUBLE) AS gross_revenue,
       CAST(sum(discount_amount) AS DOUBLE) AS discount,
       CAST(sum(gross_value - discount_amount) AS DOUBLE) AS net_revenue
FROM items_t i
JOIN money_orders o ON o.increment_id = i.increment_id AND o.is_money
LEFT JOIN products_t p ON p.sku = i.sku
GROUP BY 1""",
    "items_t",
    "money_orders",
)
_add(
    "status_breakdown",
    f"""SELECT status, orders, {_pct("orders", "(SELECT count(*) FROM orders_t)")} AS pct_of_orders
FROM (SELECT coalesce(status, 'unknown') AS status, count(*) AS orders FROM orders_t GROUP BY 1)""",
    "orders_t",
)
_add(
    "payment_mix",
    f"""SELECT payment_method, orders, CAST(revenue AS DOUBLE) AS revenue,
       {_pct("orders", "(SELECT count(*) FROM orders_t)")} AS pct_of_orders
FROM (SELECT payment_method, count(*) AS orders,
             coalesce(sum(grand_total) FILTER (WHERE is_money), 0) AS revenue
      FROM money_orders GROUP BY 1)""",
    "money_orders",
)

_DIM_DATE = """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date,
       CAST(year(d) AS INTEGER) AS "year", CAST(quarter(d) AS INTEGER) AS quarter,
       CAST(month(d) AS INTEGER) AS "month", CAST(date_trunc('month', d) AS DATE) AS month_start,
       CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS iso_weekday,
       isodow(d) >= 6 AS is_weekend
FROM (SELECT unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS d
      FROM orders_t)"""
_DIM_CUSTOMER = """SELECT customer_id AS customer_key, customer_since, false AS is_guest FROM customers_t
UNION ALL SELECT -1, NULL, true"""
_DIM_PRODUCT = """SELECT sku AS product_key, coalesce(category_name, 'Uncategorized') AS category
FROM products_t UNION ALL SELECT '(none)', 'Uncategorized'"""
_add("star_dim_date", _DIM_DATE, "orders_t")
_add("star_dim_customer", _DIM_CUSTOMER, "customers_t")
_add("star_dim_product", _DIM_PRODUCT, "products_t")
_add(
    "star_fact_sales",
    """SELECT i.item_id, increment_id, CAST(strftime(o.order_date, '%Y%m%d') AS INTEGER) AS date_key,
       coalesce(o.customer_id, -1) AS customer_key, coalesce(i.sku, '(none)') AS product_key,
       o.payment_method, coalesce(o.status, 'unknown') AS status, o.is_money,
       CAST(i.price AS DOUBLE) AS price, i.qty_ordered, CAST(i.gross_value AS DOUBLE) AS gross_value,
       CAST(i.discount_amount AS DOUBLE) AS discount_amount,
       CAST(i.gross_value - i.discount_amount AS DOUBLE) AS net_value
FROM items_t i JOIN money_orders o USING (increment_id)""",
    "items_t",
    "money_orders",
)
_add(
    "star_totals",
    _union(
        [
            f"""SELECT '{name}' AS table_name, count(*) AS item_rows,
       CAST(sum(qty_ordered) AS BIGINT) AS units, CAST(sum(gross_value) AS DOUBLE) AS gross_value,
       CAST(sum(discount_amount) AS DOUBLE) AS discount_amount FROM {source}"""
            for name, source in (
                ("fact_sales", "items_t JOIN orders_t USING (increment_id)"),
                ("order_items", "items_t"),
            )
        ]
    ),
    "items_t",
)

_add(
    "customer_reach",
    _union(
        [
            f"SELECT '{grain}' AS grain, {period} AS period, count(DISTINCT customer_id) AS customers "
            "FROM orders_t WHERE customer_id IS NOT NULL GROUP BY 1, 2"
            for grain, period in (
                ("month", "strftime(order_date, '%Y-%m')"),
                ("quarter", "year(order_date) || '-Q' || quarter(order_date)"),
                ("year", "CAST(year(order_date) AS VARCHAR)"),
                ("method", "coalesce(payment_method, '(none)')"),
                ("all", "'all'"),
            )
        ]
    ),
    "orders_t",
)

_add(
    "zone_layout",
    _union(
        [
            f"SELECT '{zone}' AS \"zone\", '{name}' AS table_name, count(*) AS \"rows\" FROM {source}"
            for zone, name, source in (
                ("staging", "export", "staging"),
                ("oltp", "customers", "customers_t"),
                ("oltp", "products", "products_t"),
                ("oltp", "orders", "orders_t"),
                ("oltp", "order_items", "items_t"),
                ("olap", "dim_date", f"({_DIM_DATE})"),
                ("olap", "dim_customer", f"({_DIM_CUSTOMER})"),
                ("olap", "dim_product", f"({_DIM_PRODUCT})"),
                ("olap", "fact_sales", "items_t JOIN orders_t USING (increment_id)"),
                (
                    "olap", "v_monthly_kpi",
                    "(SELECT DISTINCT date_trunc('month', order_date) FROM orders_t)",
                ),
                (
                    "olap", "v_rfm_segments",
                    "(SELECT DISTINCT customer_id FROM orders_t WHERE customer_id IS NOT NULL)",
                ),
                (
                    "olap", "v_cohort_retention",
                    "(SELECT DISTINCT date_trunc('month', order_date) AS active, "
                    "date_trunc('month', min(order_date) OVER (PARTITION BY customer_id)) AS cohort "
                    "FROM orders_t WHERE customer_id IS NOT NULL)",
                ),
            )
        ]
    ),
    "customers_t",
    "items_t",
)
