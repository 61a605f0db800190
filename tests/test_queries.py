"""Every registered query against its SQL twin, and the known values of the test data."""

from __future__ import annotations

import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ledgerline.queries import QUERIES
from tests.conftest import FOLDER
from tools.compare import canonical, normal_dates

TWINS = oracle_sql()


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(TWINS) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    mine = normal_dates(queries()[name](spark, FOLDER).toPandas())
    twin = normal_dates(duck.execute(TWINS[name]).df())
    assert sorted(mine.columns) == sorted(twin.columns)
    assert canonical(mine) == canonical(twin)


def test_entry_returns_rows(spark):
    assert entry(spark).count() == 80


# Values computed once, independently, for the smallest scale.
KNOWN = {
    "dq_row_count_total_vs_populated": (6500, 6000),
    "dq_category_fake_null_count": (102,),
    "dq_empty_sku": (4,),
    "dq_distinct_sku": (201,),
    "dq_majority_map_count": (201,),
    "dq_sku_category_max_length": (44, 8),
    "dq_grand_total_violations_summary": (1365, 0),
    "dq_mv_dash_count": (87,),
    "dq_mv_vs_gross": (4346,),
    "dq_mv_vs_rounded_gross": (0,),
    "dq_backslash_n_scan": (29, 0, 0),
    "dq_test_sku_rows": (181,),
    "dq_baseline_orders_customers": (1473, 151),
    "dq_fully_test_customers": (1, 12),
    "dq_negative_money": (0, 10),
    "dq_discount_exceeds_gross": (9,),
    "dq_discount_order_level": (205, 69, 136),
    "dq_discount_item_level": (70,),
    "dq_order_text_max_length": (11, 17, 14),
    "recon_test_only_orders": (20,),
    "recon_service_account_items": (40,),
    "recon_order_status_nulls": (0, 2),
    "recon_product_category_nulls": (1, 0),
    "recon_uncategorized_impact": (5780, 32, 4, 0.55, 0.66),
}

KNOWN_SIZES = {
    "dq_sku_category_raw_conflicts": 64,
    "dq_sku_category_real_conflicts": 3,
    "dq_item_vs_grand_total": 5891,
    "dq_grand_total_per_order": 1365,
    "dq_discount_residual": 66,
    "dq_test_sku_list": 7,
    "service_accounts": 1,
    "customer_order_lookup": 28,
    "customer_order_lookup_indexed": 28,
    "v_cohort_retention": 769,
    "build_customers": 148,
    "build_products": 197,
    "build_orders": 1443,
    "build_order_items": 5780,
}


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_known_value(spark, name):
    assert tuple(queries()[name](spark, FOLDER).first()) == KNOWN[name]


@pytest.mark.parametrize("name", sorted(KNOWN_SIZES))
def test_known_size(spark, name):
    assert queries()[name](spark, FOLDER).count() == KNOWN_SIZES[name]


def test_ledger_closes(spark):
    ledger = queries()["recon_ledger"](spark, FOLDER).toPandas().set_index("table_name")
    assert (ledger["difference"] == 0).all()
    assert ledger["actual"].to_dict() == {
        "customers": 148, "products": 197, "orders": 1443, "order_items": 5780,
    }


def test_discount_groups_add_up(spark):
    row = queries()["dq_discount_hypotheses"](spark, FOLDER).first()
    assert row.total_candidates == row.order_level + row.item_level - row.both + row.neither


def test_star_totals_equal_the_model(spark):
    totals = queries()["star_totals"](spark, FOLDER).toPandas().set_index("table_name")
    pd.testing.assert_series_equal(
        totals.loc["fact_sales"], totals.loc["order_items"], check_names=False
    )


def test_shares_add_up(spark):
    shares = queries()["payment_method_share"](spark, FOLDER).toPandas()
    assert abs(shares["pct_of_orders"].sum() - 100) < 0.05
