"""Staging rows in the layout of the raw export, derived from retail tables.

``orders``, ``lineitem`` and ``part`` are joined and rewritten as text with the
artifacts of the export: missing-value tokens, test SKUs, service accounts,
order-level totals, three discount conventions, padding rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import BACKSLASH_N, GENUINE_TEST_SKUS, SPREADSHEET_NA
from ledgerline.operators.constraints import fk_violations, require_no_violations
from ledgerline.operators.numbering import in_ranges, row_number_in_ranges
from ledgerline.sources.export import STAGING_COLUMNS
from ledgerline.sources.workspace import Workspace

RETAIL_TABLES = ("orders", "lineitem", "part")

# Lines are numbered in this order within their order.
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)

# Item ids leave room for so many lines of an order.
LINES_PER_ORDER = 1_000_000_000
# Order keys beyond this, times that room, are no whole numbers of 64 bits. Lines of such
# orders are counted through instead, from the least id that no other order can have.
FAR_KEY = 9_200_000_000
FAR_IDS = FAR_KEY * LINES_PER_ORDER

AMOUNT = "decimal(18,2)"


def staging_from_retail(spark: SparkSession, folder: str, workspace: Workspace) -> DataFrame:
    """The staging rows; stops if a line has no order or no part."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    part = spark.read.parquet(f"{folder}/part.parquet")
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    links = (("l_orderkey", orders, "orders", "o_orderkey"), ("l_partkey", part, "part", "p_partkey"))
    for key, parent, name, parent_key in links:
        report = fk_violations(lineitem, "lineitem", key, parent, name, parent_key)
        require_no_violations(report, "orphan_keys", "null_rows")

    # Equal lines differ in "copy", so that even copies of one line can be split. The
    # number is given at the scan, where a task that runs again gives it alike.
    copies = lineitem.withColumn("copy", F.monotonically_increasing_id())
    totalled = _totalled(_lines(copies, part, orders, "copy"), workspace)
    padding = orders.where(F.col("o_orderkey") % 3 == 0).select(
        *[F.lit("").alias(name) for name in STAGING_COLUMNS]
    )
    return _as_export(totalled).unionByName(padding)


def _lines(lineitem: DataFrame, part: DataFrame, orders: DataFrame, *more: str) -> DataFrame:
    """Lines with the columns of their order and part that the export needs."""
    pk = F.col("l_partkey")
    joined = (
        lineitem.select("l_orderkey", *LINE_ORDER, *more)
        .join(part.select("p_partkey", "p_name", "p_type", "p_retailprice"), pk == F.col("p_partkey"))
        .join(orders.drop("o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("ok"),
        F.col("o_custkey").alias("ck"),
        pk.alias("pk"),
        F.col("o_orderdate").cast("date").alias("ordered_on"),
        "o_orderstatus",
        "p_name",
        "p_type",
        _payment_method().alias("method"),
        F.when(pk % 97 == 5, F.lit(0)).otherwise(F.col("p_retailprice")).cast("decimal(12,2)").alias("unit_price"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_discount").cast("decimal(4,2)").alias("rate"),
        *LINE_ORDER,
        *more,
    )


def _payment_method() -> Column:
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    priority = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(ck % 500 == 116, "marketingexpense")
        .when((ck % 500 == 36) & (ok % 2 == 0), "financesettlement")
        .when(ok % 80 == 5, "customercredit")
        .when(ok % 400 == 6, "productcredit")
        .when(priority.isin("1", "4"), "cod")
        .when(priority == "2", "Payaxis")
        .when(priority == "3", "Easypay")
        .otherwise("bankalfalah")
    )


def _with_amounts(numbered: DataFrame) -> DataFrame:
    """Adds gross and discount of a line to lines numbered by ``line_no``."""
    ok = F.col("ok")
    gross = F.col("unit_price") * F.col("qty")
    return numbered.withColumn("gross", gross.cast(AMOUNT)).withColumn(
        "discount",
        F.when((ok % 20).isin(1, 2, 3), (10 + ok % 50).cast(AMOUNT))
        .when(_marked(499), F.lit(-25).cast(AMOUNT))
        .otherwise(F.round(gross * F.col("rate"), 2).cast(AMOUNT)),
    )


def _marked(every: int) -> Column:
    """Whether a line carries an artifact: 100 times its order and its number are divisible.

    The order is reduced first, so that keys of any size do not overflow.
    """
    return (F.col("ok") % every * 100 + F.col("line_no")) % every == 0


def _is_far() -> Column:
    return ~F.col("ok").between(-FAR_KEY, FAR_KEY - 1)


def _before_far_orders(ranged: DataFrame) -> DataFrame:
    """Per piece of a far order: lines of far orders before that order, in the order of keys.

    Nothing is read of ranges without such keys.
    """
    pieces = ranged.where(_is_far()).groupBy("range_no", "ok").count()
    sizes = pieces.groupBy("range_no").agg(F.sum("count").alias("size"))
    earlier_ranges = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier_pieces = (
        Window.partitionBy("range_no").orderBy("ok").rowsBetween(Window.unboundedPreceding, -1)
    )
    nothing = F.lit(0).cast("bigint")
    # One row per range.
    starts = sizes.select(
        "range_no", F.coalesce(F.sum("size").over(earlier_ranges), nothing).alias("start")
    )
    inside = pieces.withColumn(
        "inside", F.coalesce(F.sum("count").over(earlier_pieces), nothing)
    )
    before = F.min(F.col("start") + F.col("inside")).over(Window.partitionBy("ok"))
    return inside.join(starts, "range_no").select("range_no", "ok", before.alias("far_lines_before"))


def _item_id() -> Column:
    far = F.lit(FAR_IDS) + F.col("far_lines_before") + F.col("line_no")
    return F.when(_is_far(), far).otherwise(F.col("ok") * LINES_PER_ORDER + F.col("line_no"))


def _order_sums() -> dict[str, Column]:
    return {
        "order_gross": F.sum("gross"),
        "order_discount": F.sum(F.abs("discount")),
        "largest_discount": F.max(F.abs("discount")),
    }


def _totalled(lines: DataFrame, workspace: Workspace) -> DataFrame:
    """Numbers and totals the lines of each order, which may be any number.

    Lines are spread over range partitions. Every step works on the piece of an order
    that lies in one range; pieces are few, so numbers and sums of whole orders come
    from a table of pieces.
    """
    order, piece = [*LINE_ORDER, "copy"], ["range_no", "ok"]
    ranged = in_ranges(lines, ["ok", *order], workspace, "lines_in_ranges")
    numbered = row_number_in_ranges(ranged, order, ("ok",))
    priced = _with_amounts(numbered.withColumnRenamed("row_number", "line_no").drop("copy"))
    sums = _order_sums()
    whole_order = Window.partitionBy("ok")
    of_pieces = priced.groupBy(*piece).agg(*[total.alias(name) for name, total in sums.items()])
    of_orders = of_pieces.select(
        *piece,
        F.sum("order_gross").over(whole_order).alias("order_gross"),
        F.sum("order_discount").over(whole_order).alias("order_discount"),
        F.max("largest_discount").over(whole_order).alias("largest_discount"),
    )
    numbered_orders = of_orders.join(_before_far_orders(ranged), piece, "left")
    return priced.join(numbered_orders, piece).withColumn("iid", _item_id()).drop("range_no")


def _as_export(totalled: DataFrame) -> DataFrame:
    ok, ck, pk, iid = (F.col(name) for name in ("ok", "ck", "pk", "iid"))
    day = F.col("ordered_on")
    year, month = F.year(day).cast("string"), F.month(day).cast("string")
    created_at = F.concat_ws("/", month, F.dayofmonth(day).cast("string"), year)
    pk_text = pk.cast("string")
    guest = ok % 3001 == 8

    status = (
        F.when((ck % 400 == 17) & (ok % 2 == 0), BACKSLASH_N)
        .when(ok % 997 == 0, "")
        .when(F.col("o_orderstatus") == "F", "complete")
        .when(F.col("o_orderstatus") == "O", "canceled")
        .otherwise("order_refunded")
    )
    sku = (
        F.when((ck % 400 == 17) | (ok % 250 == 3), "test-product")
        .when(_marked(3001), "")
        .when(pk == 40, GENUINE_TEST_SKUS[0])
        .when(pk == 41, GENUINE_TEST_SKUS[1])
        .when(pk == 42, GENUINE_TEST_SKUS[2])
        .when(pk % 80 == 7, F.concat(F.lit("AhadTest-"), pk_text))
        .otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), pk_text))
    )
    category = (
        F.when((pk % 300 == 13) | _marked(77), BACKSLASH_N)
        .when((pk % 200 == 11) & (ok % 3 == 0), "UNISEX")
        .otherwise(F.col("p_type"))
    )
    total = (
        F.when(F.col("method").isin("customercredit", "productcredit"), F.lit(0))
        .when(ok % 20 == 1, F.col("order_gross") - F.col("largest_discount"))
        .when(ok % 20 == 3, F.col("order_gross") + 150)
        .otherwise(F.col("order_gross") - F.col("order_discount"))
    )
    mv = F.when(F.col("gross") == 0, " - ").otherwise(
        F.concat(F.lit(" "), F.format_number(F.round("gross", 0), 0), F.lit(" "))
    )
    since = F.concat_ws("-", (2015 + ck % 4).cast("string"), (1 + ck % 12).cast("string"))

    values = {
        "item_id": iid.cast("string"),
        "status": status,
        "created_at": created_at,
        "sku": sku,
        "price": F.col("unit_price").cast("string"),
        "qty_ordered": F.col("qty").cast("string"),
        "grand_total": total.cast(AMOUNT).cast("string"),
        "increment_id": F.concat(
            (100_000_000 + ok.cast("decimal(19,0)")).cast("string"),
            F.when(ok % 1500 == 9, "-1").otherwise("")
        ),
        "category_name_1": category,
        "sales_commission_code": F.lit(BACKSLASH_N),
        "discount_amount": F.col("discount").cast("string"),
        "payment_method": F.col("method"),
        "working_date": created_at,
        "bi_status": F.lit("Gross"),
        "mv": mv,
        "year": year,
        "month": month,
        "customer_since": F.when(guest, SPREADSHEET_NA).otherwise(since),
        "m_y": F.concat_ws("-", month, year),
        "fy": F.concat(F.lit("FY"), (F.year(day) % 100).cast("string")),
        "customer_id": F.when(guest, SPREADSHEET_NA).otherwise(ck.cast("string")),
    }
    return totalled.select(*[values[name].alias(name) for name in STAGING_COLUMNS])
