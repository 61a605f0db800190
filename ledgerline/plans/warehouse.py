"""All zones of one source: staging, model and layouts, each written once."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators.layout import Layout
from ledgerline.plans import analytics, audit, lookup, model, publish, star
from ledgerline.plans.store import HOT_ROWS, OrderStore, bucket_count, hot_orders, save_store
from ledgerline.sources.catalog import Catalog, new_database
from ledgerline.sources.export import write_csv, write_damaged_csv
from ledgerline.sources.landing import Landing, land_csv
from ledgerline.sources.retail import RETAIL_TABLES, staging_from_retail
from ledgerline.sources.workspace import Workspace, fingerprint

# The three zones, from raw text to analysis.
ZONES = ("staging", "oltp", "olap")


class Warehouse:
    """Tables of one source, built from its staging rows when first asked for."""

    def __init__(
        self,
        spark: SparkSession,
        land: Callable[[Workspace], DataFrame],
        label: str = "warehouse",
        hot_rows: int = HOT_ROWS,
    ):
        self.spark = spark
        self.workspace = Workspace(spark, label)
        self.catalog = Catalog(spark, new_database(label), self.workspace.path("catalog"))
        self.hot_rows = hot_rows
        self.landing: Landing | None = None
        self._damaged: Landing | None = None
        self._land = land
        self._store: OrderStore | None = None
        self._lookup: dict[str, Layout] = {}
        self._lock = threading.RLock()

    @classmethod
    def from_csv(
        cls, spark: SparkSession, path: str, multi_line: bool = False, allow_malformed: bool = False
    ) -> Warehouse:
        """A warehouse over the raw CSV export; damaged rows stop the landing unless allowed.

        Allowed or not, they are in ``landing.quarantine`` and not in staging.
        """

        def land(workspace: Workspace) -> DataFrame:
            warehouse.landing = land_csv(spark, path, workspace, multi_line, allow_malformed)
            # Written already: staging is a part of the landed table.
            return warehouse.landing.staging

        warehouse = cls(spark, land, "csv")
        return warehouse

    @classmethod
    def from_staging(cls, spark: SparkSession, staging: DataFrame) -> Warehouse:
        """A warehouse over staging rows that are stored already, such as a published table."""
        warehouse = cls(spark, lambda _: staging, "staging")
        warehouse.workspace.keep("staging", staging)
        return warehouse

    @classmethod
    def from_retail(cls, spark: SparkSession, folder: str) -> Warehouse:
        """A warehouse over retail tables in Parquet, rewritten as an export."""
        return cls(spark, lambda workspace: staging_from_retail(spark, folder, workspace), "retail")

    def staging(self) -> DataFrame:
        with self._lock:
            if not self.workspace.has("staging"):
                landed = self._land(self.workspace)
                if self.landing is not None:
                    self.workspace.keep("staging", landed)
                return self.workspace.table("staging", lambda: landed)
            return self.workspace.table("staging", self.staging)

    def quarantine(self) -> DataFrame:
        """The damaged lines of a CSV export: ``damage``, ``line``, ``file``."""
        self.staging()
        if self.landing is None:
            raise ValueError("only a CSV export has damaged lines")
        return self.landing.quarantine

    def exported_csv(self) -> str:
        """Path of the staging rows as CSV, written the first time it is asked for."""
        return self.workspace.folder("export_csv", lambda path: write_csv(self.staging(), path))

    def damaged_csv(self) -> str:
        """Path of the staging rows as CSV lines, some of them damaged, written once."""
        return self.workspace.folder(
            "damaged_csv", lambda path: write_damaged_csv(self.staging(), path)
        )

    def damaged_landing(self) -> Landing:
        """What landing makes of that export."""
        with self._lock:
            if self._damaged is None:
                scope = self.workspace.scope("damaged")
                self._damaged = land_csv(self.spark, self.damaged_csv(), scope, allow_damaged=True)
            return self._damaged

    def order_flags(self) -> DataFrame:
        return self.workspace.table("order_flags", lambda: model.build_order_flags(self.staging()))

    def service_accounts(self) -> DataFrame:
        return self.workspace.table(
            "service_accounts", lambda: model.build_service_accounts(self.order_flags())
        )

    def excluded_orders(self) -> DataFrame:
        return self.workspace.table(
            "excluded_orders",
            lambda: model.build_excluded_orders(self.order_flags(), self.service_accounts()),
        )

    def order_amounts(self) -> DataFrame:
        return self.workspace.table(
            "order_amounts", lambda: audit.build_order_amounts(self.staging())
        )

    def zero_total_customers(self) -> DataFrame:
        return self.workspace.table(
            "zero_total_customers", lambda: audit.build_zero_total_customers(self.staging())
        )

    def split_orders(self) -> DataFrame:
        """Usually empty; written, so that Spark knows and broadcasts next to nothing."""
        return self.workspace.table(
            "split_orders",
            lambda: model.build_split_orders(
                self.order_flags(), self.service_accounts(), self.excluded_orders()
            ),
        )

    def build(self, name: str) -> DataFrame:
        """The plan that builds a model table."""
        if name == "products":
            return model.build_products(self.staging())
        if name == "order_items":
            return model.build_order_items(self.staging(), self.excluded_orders())
        if name == "orders":
            return model.build_orders(self.staging(), self.excluded_orders(), self.split_orders())
        return model.build_customers(
            self.order_flags(), self.excluded_orders(), self.split_orders()
        )

    def customers(self) -> DataFrame:
        return self.workspace.table("customers", lambda: self.build("customers"))

    def products(self) -> DataFrame:
        return self.workspace.table("products", lambda: self.build("products"))

    def store(self) -> OrderStore:
        """Orders and items in buckets of the order number, the items of hot orders apart."""
        with self._lock:
            if self._store is None:
                hot = self.workspace.table(
                    "hot_orders", lambda: hot_orders(self.order_flags(), self.hot_rows)
                )
                self._store = save_store(
                    self.catalog, self.build("orders"), self.build("order_items"), hot,
                    bucket_count(self.staging()),
                )
            return self._store

    def orders(self) -> DataFrame:
        return self.store().orders

    def order_items(self) -> DataFrame:
        return self.store().items

    def model(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers(),
            "products": self.products(),
            "orders": self.orders(),
            "order_items": self.order_items(),
        }

    def load_model(self) -> dict[str, DataFrame]:
        """Builds the model and stops with an error if a key constraint is violated."""
        tables = self.model()
        model.require_keys({"oltp": tables})
        return tables

    def lookup_table(self, name: str) -> Layout:
        """One of the tables that serve lookups."""
        with self._lock:
            if name not in self._lookup:
                self._lookup[name] = lookup.lookup_table(name, self.store(), self.catalog)
            return self._lookup[name]

    def access_paths(self) -> dict[str, DataFrame]:
        """The rows of every table that serves lookups; items are stored by order number."""
        tables = {name: self.lookup_table(name).rows for name in lookup.LAYOUTS}
        return tables | {"items_by_order": self.order_items()}

    def calendar(self) -> DataFrame:
        """The date dimension, written, so that Spark knows how small it is."""
        return self.workspace.table("dim_date", lambda: star.dim_date(self.orders()))

    def rfm_segments(self) -> DataFrame:
        return self.workspace.table(
            "rfm_segments", lambda: analytics.rfm_segments(self.orders(), self.workspace)
        )

    def customer_sets(self) -> DataFrame:
        return self.workspace.table(
            "customer_sets", lambda: analytics.customer_sets(self.orders())
        )

    def views(self) -> dict[str, DataFrame]:
        """What business users read first."""
        return {
            "v_monthly_kpi": analytics.monthly_kpi(self.orders()),
            "v_rfm_segments": self.rfm_segments(),
            "v_cohort_retention": analytics.cohort_retention(self.orders()),
        }

    def star(self) -> dict[str, DataFrame]:
        return {
            "dim_date": star.dim_date(self.orders()),
            "dim_customer": star.dim_customer(self.customers()),
            "dim_product": star.dim_product(self.products()),
            "fact_sales": star.fact_sales(self.store()),
        }

    def zones(self) -> dict[str, dict[str, DataFrame]]:
        staging = {"export": self.staging()}
        return dict(zip(ZONES, (staging, self.model(), self.star() | self.views()), strict=True))

    def is_whole(self) -> bool:
        """Whether all tables that were written for this warehouse are still there."""
        return self.workspace.is_whole() and self.catalog.is_whole()

    def close(self) -> None:
        """Deletes all tables that were written for this warehouse."""
        with self._lock:
            self.catalog.drop()
            self.workspace.close()
            self._lookup.clear()
            self._store = self.landing = self._damaged = None

    def __enter__(self) -> Warehouse:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def publish(self, root: str, name: str) -> int:
        """Publishes all zones below ``root`` as databases ``<name>_<zone>``; returns the version.

        Nothing is written if a key constraint of the model is violated, and readers keep the
        version they have until all tables of the new one are written and checked.
        """
        self.load_model()
        return publish.publish(self.spark, self.zones(), root, name, checks=model.require_keys)


_open: dict[tuple[str, str], tuple[tuple, Warehouse]] = {}
_open_lock = threading.Lock()


def open_retail(spark: SparkSession, folder: str) -> Warehouse:
    """The warehouse of a folder, the same one for every query of an application.

    It is built anew if the files of the folder have changed, or if written tables of it are
    gone, because a shared folder was emptied meanwhile.
    """
    key = (spark.sparkContext.applicationId, folder)
    state = tuple(fingerprint(spark, f"{folder}/{name}.parquet") for name in RETAIL_TABLES)
    with _open_lock:
        if key not in _open or _open[key][0] != state or not _open[key][1].is_whole():
            if key in _open:
                _open[key][1].close()
            _open[key] = (state, Warehouse.from_retail(spark, folder))
        return _open[key][1]


def forget_retail(spark: SparkSession, folder: str) -> None:
    """Lets the next query read the folder again, after its files changed."""
    with _open_lock:
        _open.pop((spark.sparkContext.applicationId, folder), None)
