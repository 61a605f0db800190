"""Common table expressions shared by the comparison queries.

Each entry is one named relation. ``with_tables`` puts the wanted relation
and everything it reads in front of a query body.
"""

from __future__ import annotations

# The three genuine products whose name holds "test".
GENUINE_SKUS = (
    "SKMT_Blood Test",
    "Aladdin_Test Star Cricket Ball - Red & White",
    "sst_Vous Deteste-Regular fit-Medium",
)

_GENUINE_LIST = ", ".join(f"'{sku}'" for sku in GENUINE_SKUS)

# Relation name -> (relations it reads, SQL text).
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {}

_TABLES["numbered"] = (
    (),
    """
SELECT l_orderkey AS ok, o_custkey AS ck, l_partkey AS pk,
       o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS ordered_on,
       p_name, p_type,
       CASE WHEN l_partkey % 97 = 5 THEN CAST(0 AS DECIMAL(12,2))
            ELSE CAST(p_retailprice AS DECIMAL(12,2)) END AS unit_price,
       CAST(l_quantity AS INTEGER) AS qty,
       CAST(l_discount AS DECIMAL(4,2)) AS rate,
       row_number() OVER (
           PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
                    l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS line_no,
       l_orderkey * 1000000000 + line_no AS iid, l_orderkey * 100 + line_no AS mark
FROM lineitem
JOIN orders ON o_orderkey = l_orderkey
JOIN part ON p_partkey = l_partkey""",
)

_TABLES["priced"] = (
    ("numbered",),
    """
SELECT *,
       CAST(unit_price * qty AS DECIMAL(18,2)) AS line_gross,
       CASE WHEN ok % 20 IN (1, 2, 3) THEN CAST(10 + ok % 50 AS DECIMAL(18,2))
            WHEN mark % 499 = 0 THEN CAST(-25 AS DECIMAL(18,2))
            ELSE CAST(round(unit_price * qty * rate, 2) AS DECIMAL(18,2)) END AS line_discount,
       CASE WHEN ck % 500 = 116 THEN 'marketingexpense'
            WHEN ck % 500 = 36 AND ok % 2 = 0 THEN 'financesettlement'
            WHEN ok % 80 = 5 THEN 'customercredit'
            WHEN ok % 400 = 6 THEN 'productcredit'
            WHEN o_orderpriority[1:1] IN ('1', '4') THEN 'cod'
            WHEN o_orderpriority[1:1] = '2' THEN 'Payaxis'
            WHEN o_orderpriority[1:1] = '3' THEN 'Easypay'
            ELSE 'bankalfalah' END AS method
FROM numbered""",
)

_TABLES["totalled"] = (
    ("priced",),
    """
SELECT *,
       CASE WHEN method IN ('customercredit', 'productcredit') THEN CAST(0 AS DECIMAL(38,2))
            WHEN ok % 20 = 1 THEN sum(line_gross) OVER per_order - max(abs(line_discount)) OVER per_order
            WHEN ok % 20 = 3 THEN sum(line_gross) OVER per_order + 150
            ELSE sum(line_gross) OVER per_order - sum(abs(line_discount)) OVER per_order
       END AS order_total
FROM priced
WINDOW per_order AS (PARTITION BY ok)""",
)

_TABLES["staging"] = (
    ("totalled",),
    rf"""
SELECT CAST(iid AS VARCHAR) AS item_id,
       CASE WHEN ck % 400 = 17 AND ok % 2 = 0 THEN '\N'
            WHEN ok % 997 = 0 THEN ''
            WHEN o_orderstatus = 'F' THEN 'complete'
            WHEN o_orderstatus = 'O' THEN 'canceled'
            ELSE 'order_refunded' END AS status,
       concat_ws('/', month(ordered_on), day(ordered_on), year(ordered_on)) AS created_at,
       CASE WHEN ck % 400 = 17 OR ok % 250 = 3 THEN 'test-product'
            WHEN mark % 3001 = 0 THEN ''
            WHEN pk = 40 THEN '{GENUINE_SKUS[0]}'
            WHEN pk = 41 THEN '{GENUINE_SKUS[1]}'
            WHEN pk = 42 THEN '{GENUINE_SKUS[2]}'
            WHEN pk % 80 = 7 THEN 'AhadTest-' || pk
            ELSE replace(p_name, ' ', '_') || '-' || pk END AS sku,
       CAST(unit_price AS VARCHAR) AS price,
       CAST(qty AS VARCHAR) AS qty_ordered,
       CAST(CAST(order_total AS DECIMAL(18,2)) AS VARCHAR) AS grand_total,
       CAST(100000000 + ok AS VARCHAR) || CASE WHEN ok % 1500 = 9 THEN '-1' ELSE '' END AS increment_id,
       CASE WHEN pk % 300 = 13 OR mark % 77 = 0 THEN '\N'
            WHEN pk % 200 = 11 AND ok % 3 = 0 THEN 'UNISEX'
            ELSE p_type END AS category_name_1,
       '\N' AS sales_commission_code,
       CAST(line_discount AS VARCHAR) AS discount_amount,
       method AS payment_method,
       concat_ws('/', month(ordered_on), day(ordered_on), year(ordered_on)) AS working_date,
       'Gross' AS bi_status,
       CASE WHEN line_gross = 0 THEN ' - '
            ELSE ' ' || format('{{:,}}', CAST(round(line_gross, 0) AS BIGINT)) || ' ' END AS mv,
       CAST(year(ordered_on) AS VARCHAR) AS "year",
       CAST(month(ordered_on) AS VARCHAR) AS "month",
       CASE WHEN ok % 3001 = 8 THEN '#N/A'
            ELSE (2015 + ck % 4) || '-' || (1 + ck % 12) END AS customer_since,
       month(ordered_on) || '-' || year(ordered_on) AS m_y,
       'FY' || (year(ordered_on) % 100) AS fy,
       CASE WHEN ok % 3001 = 8 THEN '#N/A' ELSE CAST(ck AS VARCHAR) END AS customer_id
FROM totalled
UNION ALL
SELECT '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', ''
FROM orders WHERE o_orderkey % 3 = 0""",
)

# Populated rows with the parsed values next to the raw text.
_TABLES["facts"] = (
    ("staging",),
    rf"""
SELECT *,
       TRY_CAST(price AS DECIMAL(18,4)) AS price_n,
       TRY_CAST(qty_ordered AS INTEGER) AS qty_n,
       TRY_CAST(discount_amount AS DECIMAL(18,4)) AS discount_n,
       TRY_CAST(grand_total AS DECIMAL(18,4)) AS total_n,
       TRY_CAST(price AS DECIMAL(18,4))::DECIMAL(28,4) * TRY_CAST(qty_ordered AS INTEGER) AS gross_n,
       sku ILIKE '%test%' AND sku NOT IN ({_GENUINE_LIST}) AS is_test,
       payment_method IN ('marketingexpense', 'financesettlement') AS is_internal,
       CASE WHEN customer_id NOT IN ('\N', '', '#N/A') THEN CAST(customer_id AS BIGINT) END AS customer_key,
       CASE WHEN category_name_1 NOT IN ('\N', '') THEN category_name_1 END AS category
FROM staging
WHERE item_id <> ''""",
)

_TABLES["service"] = (
    ("facts",),
    """
SELECT customer_id, count(DISTINCT increment_id) AS total_orders,
       count(DISTINCT CASE WHEN is_internal THEN increment_id END) AS internal_orders
FROM facts WHERE customer_id <> ''
GROUP BY customer_id
HAVING count(DISTINCT increment_id) = count(DISTINCT CASE WHEN is_internal THEN increment_id END)""",
)

_TABLES["majority"] = (
    ("facts",),
    """
SELECT sku, category AS category_name_1, bool_or(is_test) AS is_test
FROM facts WHERE sku <> ''
GROUP BY sku, category
QUALIFY row_number() OVER (
    PARTITION BY sku ORDER BY category IS NULL, count(*) DESC, category) = 1""",
)

_TABLES["customers_t"] = (
    ("facts", "service"),
    r"""
SELECT DISTINCT customer_key AS customer_id,
       CAST(strptime(nullif(nullif(nullif(customer_since, '\N'), ''), '#N/A'), '%Y-%m') AS DATE) AS customer_since
FROM facts
WHERE customer_key IS NOT NULL
  AND customer_id NOT IN (SELECT customer_id FROM service)
  AND increment_id IN (SELECT increment_id FROM facts WHERE NOT is_test)""",
)

_TABLES["products_t"] = (
    ("majority",),
    """
SELECT sku, category_name_1 AS category_name FROM majority WHERE NOT is_test""",
)

_TABLES["orders_t"] = (
    ("facts", "service"),
    """
SELECT DISTINCT increment_id, customer_key AS customer_id,
       CAST(strptime(created_at, '%m/%d/%Y') AS DATE) AS order_date,
       payment_method, nullif(status, '') AS status, total_n AS grand_total
FROM facts
WHERE customer_id NOT IN (SELECT customer_id FROM service)
  AND increment_id IN (SELECT increment_id FROM facts WHERE NOT is_test)""",
)

_TABLES["items_t"] = (
    ("facts", "orders_t", "products_t"),
    """
SELECT CAST(f.item_id AS BIGINT) AS item_id, f.increment_id, p.sku AS sku,
       f.price_n AS price, f.qty_n AS qty_ordered,
       abs(f.discount_n) AS discount_amount, f.gross_n AS gross_value
FROM facts f
LEFT JOIN products_t p ON p.sku = nullif(f.sku, '')
WHERE NOT f.is_test AND f.increment_id IN (SELECT increment_id FROM orders_t)""",
)

# Orders whose amount counts as money: the four non-cash methods are left out.
_TABLES["money_orders"] = (
    ("orders_t",),
    """
SELECT *, coalesce(payment_method NOT IN
       ('customercredit', 'productcredit', 'marketingexpense', 'financesettlement'), false) AS is_money
FROM orders_t""",
)


def _needed(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        reads, _ = _TABLES[name]
        for found in [*_needed(reads), name]:
            if found not in ordered:
                ordered.append(found)
    return ordered


def with_tables(body: str, *names: str, extra: str = "") -> str:
    """``body`` preceded by the relations ``names`` and all they depend on."""
    parts = [f"{name} AS MATERIALIZED ({_TABLES[name][1]}\n)" for name in _needed(names)]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
