from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerline.plans.warehouse import Warehouse, open_retail  # noqa: E402
from ledgerline.session import local_session  # noqa: E402
from ledgerline.sources.export import STAGING_COLUMNS, STAGING_SCHEMA  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

# A populated row without any artifact; tests name what differs.
PLAIN_ROW = {
    "item_id": "1", "status": "complete", "created_at": "7/1/2016", "sku": "lamp",
    "price": "100.00", "qty_ordered": "1", "grand_total": "100.00", "increment_id": "900",
    "category_name_1": "Home", "sales_commission_code": "\\N", "discount_amount": "0.00",
    "payment_method": "cod", "working_date": "7/1/2016", "bi_status": "Gross", "mv": " 100 ",
    "year": "2016", "month": "7", "customer_since": "2016-7", "m_y": "7-2016", "fy": "FY16",
    "customer_id": "5",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(str(tmp_path_factory.mktemp("spark")), cpus=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def warehouse(spark):
    return open_retail(spark, FOLDER)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "part", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture
def staged(spark):
    """Builds a staging table from partial rows; item ids are numbered when left out."""

    def build(*rows: dict):
        full = [{**PLAIN_ROW, "item_id": str(n), **row} for n, row in enumerate(rows, 1)]
        return spark.createDataFrame(
            [tuple(row[c] for c in STAGING_COLUMNS) for row in full], STAGING_SCHEMA
        )

    return build


@pytest.fixture
def warehouse_of(spark, staged):
    """A warehouse over hand-written staging rows."""

    def build(*rows: dict) -> Warehouse:
        return Warehouse(spark, lambda _: staged(*rows), "test")

    return build


BLANK_ROW = dict.fromkeys(STAGING_COLUMNS, "")
