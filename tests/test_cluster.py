"""Queries whose steps are written tables, in a session whose master is a cluster.

The folder of written tables is then one on disks, which is tried out instead of refused.
"""

from __future__ import annotations

import shutil

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from ledgerline.plans.warehouse import forget_retail, open_retail
from ledgerline.sources import workspace
from ledgerline.sources.workspace import shared_folder
from tests.conftest import FOLDER
from tools.compare import canonical, normal_dates

TWINS = oracle_sql()
MASTER = "spark.master"
RETAIL = ("orders", "lineitem", "part")

NAMES = (
    "build_customers",
    "build_order_items",
    "build_orders",
    "build_products",
    "category_revenue",
    "clustered_layout",
    "csv_ingest_client",
    "csv_ingest_server",
    "csv_malformed_rows",
    "csv_quarantine",
    "customer_order_lookup_indexed",
    "customer_order_lookup",
    "customer_reach",
    "dq_backslash_n_scan",
    "dq_baseline_orders_customers",
    "dq_category_fake_null_count",
    "dq_created_at_consistency",
    "dq_customer_backslash_n",
    "dq_customer_consistency",
    "dq_customer_id_completeness",
    "dq_customer_since_consistency",
    "dq_customer_since_consistency_summary",
    "dq_customer_since_non_date",
    "dq_customer_since_pattern",
)

OPERATORS = (
    "pipeline",
    "op3_mixing",
    "op6_warc",
    "op7_jaccard_join",
    "op10_quotes",
    "op11_alignment",
    "op13_hard_negatives",
)


@pytest.fixture(scope="module")
def cluster(spark):
    """The session, as if its master were a cluster."""
    before = spark.conf.get(MASTER)
    spark.conf.set(MASTER, "spark://somewhere:7077")
    yield spark
    spark.conf.set(MASTER, before)


@pytest.fixture(scope="module")
def export(cluster, tmp_path_factory):
    """The retail tables in a folder of their own, so that their warehouse is a new one."""
    folder = str(tmp_path_factory.mktemp("cluster"))
    for name in RETAIL:
        shutil.copy(f"{FOLDER}/{name}.parquet", folder)
    yield folder
    open_retail(cluster, folder).close()
    forget_retail(cluster, folder)


@pytest.fixture(scope="module")
def twin(cluster):
    """The rows of a query's SQL."""
    con = duckdb.connect()
    for name in RETAIL:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return lambda name: normal_dates(con.execute(TWINS[name]).df())


class Session:
    """A session of a cluster with these settings."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {MASTER: "spark://somewhere:7077"} | settings

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_a_folder_of_disks_is_tried_out_and_taken(cluster):
    named = cluster.conf.get("spark.checkpoint.dir")
    assert shared_folder(cluster) == named
    left = workspace.file_system(cluster, named).globStatus(
        cluster.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{named}/ledgerline/trial-*")
    )
    assert len(left) == 0


def test_a_folder_that_loses_rows_or_cannot_be_written_is_not_shared(cluster, monkeypatch, tmp_path):
    here = f"file:{tmp_path}/t"
    assert workspace._finds_what_it_wrote(cluster, here)
    (tmp_path / "a file").touch()
    assert not workspace._finds_what_it_wrote(cluster, f"file:{tmp_path}/a file/t")
    reader = type(cluster.read)
    lost = lambda self, path, read=reader.parquet: read(self, path).where("id <> 0")
    monkeypatch.setattr(reader, "parquet", lost)
    assert not workspace._finds_what_it_wrote(cluster, here)


def test_the_first_shared_folder_is_taken(monkeypatch):
    settings = {"spark.checkpoint.dir": "file:/own/", "spark.sql.warehouse.dir": "file:/house/"}
    session = Session(**settings)
    monkeypatch.setattr(workspace, "_is_shared", lambda _, folder: folder == "file:/house")
    assert shared_folder(session) == "file:/house"
    monkeypatch.setattr(workspace, "_is_shared", lambda *_: False)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir.*/own.*/house"):
        shared_folder(session)
    mounted = Session(**settings, **{"spark.ledgerline.sharedMount": "true"})
    assert shared_folder(mounted) == "file:/own"


@pytest.mark.parametrize("name", NAMES)
def test_query_on_the_export_equals_its_twin(cluster, export, twin, name):
    mine, its = normal_dates(queries()[name](cluster, export).toPandas()), twin(name)
    assert sorted(mine.columns) == sorted(its.columns)
    assert canonical(mine) == canonical(its)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_gives_the_rows_of_a_local_run(spark, name):
    before, found = spark.conf.get(MASTER), []
    try:
        for master in (spark.sparkContext.master, "spark://somewhere:7077"):
            spark.conf.set(MASTER, master)
            found.append(sorted(map(repr, queries()[name](spark, FOLDER).collect())))
    finally:
        spark.conf.set(MASTER, before)
    assert found[0] == found[1] != []
