"""Hand-written rows for every artifact of the raw export."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import money as amounts
from ledgerline.functions import text
from ledgerline.operators import checks
from ledgerline.operators.constraints import (
    ConstraintError,
    fk_orphans,
    fk_violations,
    pk_duplicates,
    pk_violations,
)
from ledgerline.plans import analytics, audit, model, reconcile
from ledgerline.plans.store import OrderStore
from ledgerline.plans.warehouse import Warehouse
from ledgerline.sources.export import (
    RAW_COLUMNS,
    MalformedExportError,
    malformed_rows,
    read_csv,
    write_csv,
)
from tests.conftest import BLANK_ROW, PLAIN_ROW


def value(df):
    rows = df.collect()
    assert len(rows) == 1
    return tuple(rows[0])


def column_of(spark, texts, expression):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    return [row[0] for row in df.select(expression("c").alias("v")).collect()]


# --- expressions -----------------------------------------------------------


def test_missing_tokens_become_null(spark):
    found = column_of(spark, ["\\N", "", "#N/A", "N", "x", None], text.null_tokens)
    assert found == [None, None, None, "N", "x", None]


def test_clean_money(spark):
    found = column_of(spark, [" 1,350 ", " - ", "1,234,567.5", "abc", ""], amounts.clean_money)
    assert found == [Decimal(1350), Decimal(0), Decimal("1234567.5"), None, None]


def test_pattern_is_not_fooled_by_line_break(spark):
    found = column_of(
        spark, ["1", "1\n", "-1.5", "1."], lambda c: text.not_matching(c, text.NUMERIC_TEXT)
    )
    assert found == [False, True, False, True]


def test_dates_padded_or_not(spark):
    found = column_of(
        spark, ["8/4/2016", "08/04/2016", "13/1/2016", "", "#N/A"],
        lambda c: text.parse_date(c, text.ORDER_DATE_FORMAT),
    )
    day = datetime.date(2016, 8, 4)
    assert found == [day, day, None, None, None]


def test_since_is_first_of_month(spark):
    found = column_of(
        spark, ["2016-8", "2016-08"], lambda c: text.parse_date(c, text.SINCE_FORMAT)
    )
    assert found == [datetime.date(2016, 8, 1)] * 2


def test_test_skus(spark):
    skus = ["test-product", "AhadTest-7", "SKMT_Blood Test", "lamp", "", None]
    assert column_of(spark, skus, text.is_test_sku) == [True, True, False, False, False, None]
    assert column_of(spark, skus, text.is_regular_sku) == [False, False, True, True, True, None]


def test_percent_rounds_half_away_and_survives_zero(spark):
    df = spark.createDataFrame([(1, 8), (1, 800), (1, 0), (-1, 800)], "a long, b long")
    from pyspark.sql import functions as F

    found = [r[0] for r in df.select(amounts.percent(F.col("a"), F.col("b"), 1)).collect()]
    assert found == [12.5, 0.1, None, -0.1]
    found = [r[0] for r in df.select(amounts.percent(F.col("a"), F.col("b"), 2)).collect()]
    assert found == [12.5, 0.13, None, -0.13]


def test_castable_text_is_what_a_cast_accepts(spark):
    texts = [" 900 ", " 1,350 ", " - ", "-5", "+5", ".5", "5.", "1e3", "1e", "", " ", "abc", "1 2"]
    castable = column_of(spark, texts, lambda c: ~text.not_matching(c, text.CASTABLE_TEXT))
    cast = column_of(spark, texts, amounts.money)
    assert castable == [found is not None for found in cast]


# --- audit -----------------------------------------------------------------


def test_padding_rows_are_not_populated(staged):
    rows = staged({}, BLANK_ROW)
    assert value(audit.row_count_total_vs_populated(rows)) == (2, 1)
    assert value(audit.row_count_filtered(rows)) == (1, 1)


def test_majority_prefers_any_real_value(staged):
    rows = staged({"category_name_1": "Phones"}, *[{"category_name_1": "\\N"}] * 88)
    assert value(audit.sku_category_majority(rows)) == ("lamp", "Phones")


def test_majority_tie_takes_first_in_text_order(staged):
    rows = staged(*[{"category_name_1": c} for c in ("b", "a", "b", "a", "c")])
    assert value(audit.sku_category_majority(rows)) == ("lamp", "a")


def test_majority_without_real_value_is_null(staged):
    rows = staged({"category_name_1": "\\N"}, {"category_name_1": ""})
    assert value(audit.sku_category_majority(rows)) == ("lamp", None)


def test_fd_check_ignores_null_unless_told(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("k", "a"), ("k", None), ("j", "a"), ("j", "b")], "k string, v string")
    assert [tuple(r) for r in checks.fd_check(df, "k", F.col("v")).collect()] == [("j", 2)]
    strict = checks.fd_check(df, "k", F.col("v"), count_null=True)
    assert sorted(tuple(r) for r in strict.collect()) == [("j", 2), ("k", 2)]


def test_fd_summary_of_several_attributes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [("k", "a", 1), ("k", "b", 1), ("j", "a", 1), ("j", "a", None)], "k string, v string, w int"
    )
    found = checks.fd_summary(df, "k", {"v": F.col("v"), "w": F.col("w")}).collect()
    assert sorted(tuple(r) for r in found) == [("v", 2, 1), ("w", 2, 0)]


def test_order_total_belongs_to_the_order(staged):
    rows = staged(
        {"price": "420", "grand_total": "980"}, {"price": "560", "grand_total": "980"}
    )
    assert value(audit.grand_total_per_order(audit.build_order_amounts(rows))) == ("900", 2, 1)
    assert audit.grand_total_violations(audit.build_order_amounts(rows)).count() == 0
    assert audit.item_vs_grand_total(rows).count() == 2
    assert audit.item_vs_grand_total(rows, limit=1).collect()[0].item_id == "1"
    assert audit.grand_total_drilldown(rows, items=["2"]).count() == 1


def test_status_check_reads_rows_without_item(staged):
    rows = staged({}, {"item_id": "", "status": "canceled"})
    found = audit.order_attribute_consistency_any_row(rows, "status", "status_variants")
    assert value(found) == ("900", 2)
    assert audit.order_attribute_consistency(rows, "status", "status_variants").count() == 0


def test_dates_that_break_the_rules_are_found(staged):
    rows = staged({"created_at": "25/1/2016"}, {})
    assert [tuple(r) for r in audit.date_month_range(rows).collect()] == [("25/1/2016",)]
    assert value(audit.redundant_date_column_summary(rows)) == (2, 1)
    assert audit.redundant_date_column(rows, limit=5).count() == 1


def test_bad_numbers_are_counted(staged):
    rows = staged({"price": "1,000"}, {"qty_ordered": "1.5"}, {"discount_amount": ""}, {})
    assert value(audit.numeric_pattern(rows)) == (2,)
    assert value(audit.integer_pattern(rows)) == (1,)


def test_suffix_and_tokens_in_ids(staged):
    rows = staged(
        {"increment_id": "100542843-1"}, {"customer_id": "#N/A"}, {"customer_id": "x1"}
    )
    assert value(audit.id_patterns(rows)) == (0, 1, 1)
    assert value(audit.non_numeric_increment_ids_summary(rows)) == (1, 1)


def test_mv_column(staged):
    rows = staged(
        {"mv": " 1,349 ", "price": "1349.1"},
        {"mv": " - ", "price": "0.00"},
        {"mv": " 100 "},
        {"mv": " 3 ", "price": "2.5"},
    )
    assert value(audit.mv_raw_cast(rows)) == (2,)
    assert value(audit.mv_dash_count(rows)) == (1,)
    assert value(audit.mv_vs_gross(rows)) == (2,)
    assert value(audit.mv_vs_rounded_gross(rows)) == (0,)
    assert value(audit.mv_non_numeric_values(rows)) == (" - ",)


def test_discount_hypotheses(staged):
    def order(number, total):
        row = {"increment_id": number, "price": "50", "discount_amount": "10", "grand_total": total}
        return [row, row]

    rows = staged(*order("1", "90"), *order("2", "80"), *order("3", "240"))
    assert value(audit.discount_order_level(audit.build_order_amounts(rows))) == (3, 1, 2)
    assert value(audit.discount_item_level(audit.build_order_amounts(rows))) == (1,)
    assert [r.increment_id for r in audit.discount_residual(audit.build_order_amounts(rows)).collect()] == ["3"]


def test_negative_discount_is_counted_and_turned(staged, warehouse_of):
    row = {"price": "5995", "discount_amount": "-599.5", "grand_total": "5395.5"}
    assert value(audit.negative_money(staged(row))) == (0, 1)
    item = warehouse_of(row).order_items().first()
    assert item.discount_amount == Decimal("599.5")
    assert item.gross_value - item.discount_amount == Decimal("5395.5")


def test_materiality_threshold(spark):
    df = spark.createDataFrame([(5, 100), (4, 100)], "part long, whole long")
    found = checks.materiality(df, "part", "whole").collect()
    assert [(r.pct, r.is_material) for r in found] == [(5.0, True), (4.0, False)]


# --- model -----------------------------------------------------------------


INTERNAL = {"payment_method": "marketingexpense"}


def test_service_account_is_excluded_and_mixed_customer_kept(warehouse_of):
    w = warehouse_of(
        {"customer_id": "116", "increment_id": "1", **INTERNAL},
        {"customer_id": "36", "increment_id": "2"},
        *[{"customer_id": "36", "increment_id": str(n), **INTERNAL} for n in (3, 4, 5, 6)],
    )
    assert [r.customer_id for r in w.service_accounts().collect()] == ["116"]
    assert {r.customer_id for r in w.customers().collect()} == {36}
    assert {r.increment_id for r in w.orders().collect()} == {"2", "3", "4", "5", "6"}
    assert w.order_items().count() == 5


def test_test_cascade(warehouse_of):
    test = {"sku": "test-product"}
    w = warehouse_of(
        {"increment_id": "1", "customer_id": "5", **test},
        {"increment_id": "2", "customer_id": "5"},
        {"increment_id": "2", "customer_id": "5", **test},
        {"increment_id": "3", "customer_id": "6", **test},
    )
    assert {r.increment_id for r in w.orders().collect()} == {"2"}
    assert {r.customer_id for r in w.customers().collect()} == {5}
    assert [r.sku for r in w.order_items().collect()] == ["lamp"]
    assert [r.sku for r in w.products().collect()] == ["lamp"]
    assert value(reconcile.test_only_orders(w.staging())) == (2,)
    assert value(audit.fully_test_customers(w.staging())) == (1, 1)
    excluded = {r.increment_id: r.is_test_only for r in w.excluded_orders().collect()}
    assert excluded == {"1": True, "3": True}


def test_guest_order_keeps_null_customer(warehouse_of):
    w = warehouse_of({"customer_id": "#N/A", "customer_since": "#N/A"}, {"increment_id": "901"})
    assert {(r.increment_id, r.customer_id) for r in w.orders().collect()} == {("900", None), ("901", 5)}
    assert w.customers().count() == 1
    w.load_model()


def test_suffix_status_and_sku_rules(warehouse_of):
    w = warehouse_of({"increment_id": "100542843-1", "status": "", "sku": ""})
    order = w.orders().first()
    assert (order.increment_id, order.status) == ("100542843-1", None)
    assert w.order_items().first().sku is None
    impact = reconcile.uncategorized_impact(w.order_items(), w.products())
    assert value(impact) == (1, 1, 1, 100.0, 100.0)


def test_product_of_service_account_stays_without_items(warehouse_of):
    w = warehouse_of({"customer_id": "116", "sku": "only-there", **INTERNAL}, {"increment_id": "2"})
    assert {r.sku for r in w.products().collect()} == {"only-there", "lamp"}
    assert {r.sku for r in w.order_items().collect()} == {"lamp"}


def test_order_shared_by_service_and_other_customer_is_kept(warehouse_of):
    w = warehouse_of(
        {"customer_id": "116", "increment_id": "1", **INTERNAL},
        {"customer_id": "5", "increment_id": "1"},
    )
    assert [r.customer_id for r in w.orders().collect()] == [5]
    assert w.order_items().count() == 2


def test_conflicting_order_breaks_the_primary_key(warehouse_of):
    w = warehouse_of({"status": "complete"}, {"status": "canceled"})
    with pytest.raises(ConstraintError, match="orders.increment_id"):
        w.load_model()


def test_order_equal_after_parsing_is_one_order(warehouse_of):
    w = warehouse_of({"grand_total": "100.0"}, {"grand_total": "100.00"})
    assert w.orders().count() == 1


def test_orphans_are_found_and_null_is_allowed(spark):
    child = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in fk_orphans(child, "k", parent, "id").collect()] == [("b", 2)]
    found = fk_violations(child, "c", "k", parent, "p", "id")
    assert value(found) == ("c.k -> p.id", 1, 2, 1)


def test_repeated_and_null_keys_are_found(spark):
    table = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert value(pk_violations(table, "t", "k")) == ("t.k", 4, 1, 1)
    assert sorted(map(str, [tuple(r) for r in pk_duplicates(table, "k").collect()])) == [
        "('a', 2)", "(None, 1)",
    ]


def test_model_types(warehouse):
    assert dict(warehouse.order_items().dtypes)["gross_value"] == "decimal(29,4)"
    assert dict(warehouse.orders().dtypes)["order_date"] == "date"
    assert dict(warehouse.customers().dtypes) == {"customer_id": "bigint", "customer_since": "date"}


def test_too_long_text_is_reported_not_cut(warehouse_of):
    w = warehouse_of({"sku": "x" * 101})
    found = checks.length_violations(w.products(), model.LENGTH_LIMITS["products"]).collect()
    assert {(r.column_name, r.too_long) for r in found} == {("sku", 1), ("category_name", 0)}
    assert len(w.products().first().sku) == 101


# --- analysis --------------------------------------------------------------


def test_credit_and_internal_orders_are_no_revenue(warehouse_of):
    w = warehouse_of(
        {"increment_id": "1"},
        {"increment_id": "2", "payment_method": "customercredit", "grand_total": "0"},
        {"increment_id": "3", "payment_method": "financesettlement"},
    )
    month = analytics.monthly_kpi(w.orders()).first()
    assert (month.orders, month.money_orders, month.revenue, month.avg_order_value) == (3, 1, 100.0, 100.0)
    category = analytics.category_revenue(w.store(), w.products()).first()
    assert (category.category, category.items, category.net_revenue) == ("Home", 1, 100.0)


def test_month_change_and_retention(warehouse_of):
    w = warehouse_of(
        {"increment_id": "1", "created_at": "1/5/2016"},
        {"increment_id": "2", "created_at": "3/9/2016", "grand_total": "150"},
        {"increment_id": "3", "created_at": "1/7/2016", "customer_id": "6"},
    )
    months = analytics.monthly_kpi(w.orders()).orderBy("order_month").collect()
    assert [m.revenue_change_pct for m in months] == [None, -25.0]
    cells = analytics.cohort_retention(w.orders()).orderBy("period").collect()
    assert [(c.period, c.customers, c.retention_pct) for c in cells] == [(0, 2, 100.0), (2, 1, 50.0)]


# --- CSV -------------------------------------------------------------------


def test_blank_csv_fields_stay_blank(spark, tmp_path):
    row = {**PLAIN_ROW, "sku": "", "mv": " 1,350 ", "category_name_1": 'say "hi", twice'}

    def quoted(field):
        return '"' + field.replace('"', '""') + '"' if set(field) & set('",') else field

    header = ",".join(RAW_COLUMNS)
    line = ",".join(quoted(v) for v in row.values())
    (tmp_path / "export.csv").write_text(f"{header}\n{line}\n{',' * 20}\n")
    found = read_csv(spark, str(tmp_path)).collect()
    assert [r.asDict() for r in found] == [row, BLANK_ROW]
    items = model.build_order_items(
        read_csv(spark, str(tmp_path)), spark.createDataFrame([], "increment_id string")
    ).collect()
    assert [r.sku for r in items] == [None]


def test_warehouse_from_csv_equals_the_one_it_was_written_from(spark, warehouse):
    again = Warehouse.from_csv(spark, warehouse.exported_csv())
    for name, table in again.load_model().items():
        assert sorted(map(str, table.collect())) == sorted(map(str, warehouse.model()[name].collect()))


def test_warehouse_over_stored_staging_makes_no_copy(spark, warehouse):
    again = Warehouse.from_staging(spark, warehouse.staging())
    assert again.staging() is warehouse.staging()
    assert again.orders().count() == warehouse.orders().count()


def test_csv_round_trip(spark, staged, tmp_path):
    rows = staged({"mv": " 1,350 ", "sku": 'a "quoted", name', "category_name_1": "\\N"}, BLANK_ROW)
    write_csv(rows, str(tmp_path / "csv"))
    again = read_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


# --- amounts, methods and files out of the usual ------------------------------


def test_a_very_large_amount_ends_no_question(staged, warehouse_of):
    row = {"price": "99999999999999", "qty_ordered": "1000", "discount_amount": "1"}
    rows = staged(row)
    for question in (
        audit.discount_exceeds_gross, audit.item_vs_grand_total, audit.grand_total_drilldown, audit.mv_vs_gross,
        audit.mv_vs_rounded_gross, audit.row_findings, audit.mv_mismatch_sample, audit.build_order_amounts,
    ):
        question(rows).collect()
    (item,) = warehouse_of(row).order_items().collect()
    assert item.gross_value == Decimal("99999999999999000")


def test_lost_decimals_are_counted(staged):
    rows = staged({"price": "1.23456", "qty_ordered": "1000"}, {"price": "1.23450"}, {"discount_amount": "0.00001"})
    lost = {r.target: r.unparsed_rows for r in model.unparsed_values(rows).collect()}
    assert lost["price"] == 1 and lost["discount_amount"] == 1 and lost["grand_total"] == 0


def test_an_unknown_payment_method_is_no_money_anywhere(spark, warehouse_of):
    w = warehouse_of({"grand_total": "10", "price": "10"})
    orders = w.orders().withColumn("payment_method", F.lit(None).cast("string"))
    assert [r.revenue for r in analytics.monthly_kpi(orders).collect()] == [0.0]
    assert [r.revenue for r in analytics.payment_mix(orders).collect()] == [0.0]
    assert analytics.category_revenue(OrderStore(orders, w.order_items()), w.products()).count() == 0


def test_damaged_exports_stop_the_landing(spark, tmp_path):
    header = ",".join(RAW_COLUMNS)
    good = ",".join(["1"] * len(RAW_COLUMNS))
    damaged = {
        "short": "1,2,3", "long": good + ",5,6,7,8,9", "split": good[:-2] + ',"3\nbreak"',
    }
    for name, line in {"fine": good.replace("1,1", '1,"a ""quoted"" one"', 1), **damaged}.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(f"{header}\n{good}\n{line}\n")
        found = malformed_rows(spark, str(path)).first()
        bad = found.wrong_field_count + found.open_quotes
        if name == "fine":
            assert bad == 0 and Warehouse.from_csv(spark, str(path)).staging().count() == 2
            continue
        assert bad > 0
        with pytest.raises(MalformedExportError, match=name):
            Warehouse.from_csv(spark, str(path)).staging()
        allowed = Warehouse.from_csv(spark, str(path), allow_malformed=True)
        assert allowed.staging().count() == 1 and allowed.quarantine().count() == line.count("\n") + 1
    whole = malformed_rows(spark, str(tmp_path / "split.csv"), multi_line=True).first()
    assert tuple(whole) == (2, 0, 0)


# --- operators on any table -----------------------------------------------------


def test_pattern_check_per_column(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), ("", "7"), ("y", "8"), (None, "c")], "n string, w string")
    patterns = {"n": "^[0-9]+$", "w": "^[a-z]$"}
    found = {r.column_name: r.bad_rows for r in checks.pattern_check(df, patterns).collect()}
    assert found == {"n": 3, "w": 2}
    found = {r.column_name: r.bad_rows for r in checks.pattern_check(df, patterns, ignore=("",)).collect()}
    assert found == {"n": 2, "w": 2}
    bad = {(r.n, r.w): r.bad_columns for r in checks.pattern_offenders(df, patterns, ignore=("",)).collect()}
    assert bad == {("x", "b"): ["n"], ("", "7"): ["w"], ("y", "8"): ["n", "w"]}


def test_hypotheses_of_any_table(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 2), (2, 2, 4), (1, 1, 9)], "a int, b int, c int")
    a, b = F.col("a").cast("decimal(9,2)"), F.col("b").cast("decimal(9,2)")
    found = checks.hypothesis_test(df, {"added": a + b, "multiplied": a * b}, F.col("c"), tolerance="0")
    assert tuple(found.first()) == (4, 2, 2, 1, 1)


def test_reconcile_and_cascade_of_any_table(spark):
    counts = spark.createDataFrame([("t", 10, 3), ("u", 5, 0)], "table_name string, staged long, excluded long")
    actual = spark.createDataFrame([("t", 7), ("u", 4)], "table_name string, row_count long")
    assert sorted(map(tuple, checks.reconcile(counts, actual).collect())) == [("t", 10, 3, 7, 7, 0), ("u", 5, 0, 5, 4, -1)]
    gone = spark.createDataFrame([(1, "x"), (2, "y")], "k int, reason string")
    assert [r.k for r in checks.cascade_exclude(spark.range(1, 5).selectExpr("int(id) k"), gone, "k").orderBy("k").collect()] == [3, 4]
