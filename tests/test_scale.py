"""Skewed keys, the ways beyond a size bound, and the shape of the plans."""

from __future__ import annotations

import random
import shutil
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerline.functions.text import is_regular_sku
from ledgerline.operators import checks
from ledgerline.operators.constraints import ConstraintError
from ledgerline.operators.layout import Layout, laid_out, part_of
from ledgerline.operators.numbering import add_ntiles, global_row_number
from ledgerline.plans import analytics, audit, lookup, model, star
from ledgerline.plans.warehouse import Warehouse, forget_retail, open_retail
from ledgerline.queries import QUERIES, csv_quarantine
from ledgerline.sources.catalog import Catalog, new_database
from ledgerline.sources.retail import staging_from_retail
from ledgerline.sources.workspace import Workspace, shared_folder
from tests.conftest import FOLDER


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def workspace(spark):
    return Workspace(spark, "test")


# --- written tables --------------------------------------------------------


def test_tables_go_to_the_named_folder_once(spark, workspace):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert workspace.table("t", build).count() == workspace.table("t", build).count() == 3
    assert len(calls) == 1
    assert workspace.path("t").startswith(spark.conf.get("spark.checkpoint.dir"))


class FakeSession:
    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession(**{"spark.master": "yarn"}))
    named = FakeSession(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})
    assert shared_folder(named) == "hdfs:///x"


# --- numbering -------------------------------------------------------------


def test_global_row_number_is_the_sort_position(spark, workspace):
    chance = random.Random(3)
    data = [(chance.choice(["hot", "hot", "a", "b"]), n) for n in range(500)]
    df = spark.createDataFrame(data, "k string, n int").repartition(7)
    found = global_row_number(df, ["k", "n"], workspace, "numbered").collect()
    assert {(r.k, r.n): r.row_number for r in found} == {
        pair: i for i, pair in enumerate(sorted(data), 1)
    }


@pytest.mark.parametrize("rows", [1, 3, 5, 23, 101])
def test_ntiles_equal_the_window(spark, rows):
    df = spark.range(rows).select("id", (F.col("id") * 7 % 11).alias("v"))
    plain = df.withColumn("t", F.ntile(5).over(Window.orderBy("v", "id")))
    spread = add_ntiles(df, {"t": ["v", "id"]}, 5, Workspace(spark, "b"))
    assert rows_of(plain.select("id", "t")) == rows_of(spread.select("id", "t"))


def test_rfm_of_part_of_the_orders_is_its_own(spark, warehouse):
    """A second call in the same workspace does not return the first one's rows."""
    space = Workspace(spark, "a")
    everybody = analytics.rfm_segments(warehouse.orders(), space)
    some = analytics.rfm_segments(warehouse.orders().where("customer_id < 100"), space)
    few = warehouse.orders().where("customer_id < 100").select("customer_id").distinct().count()
    assert some.count() == few < everybody.count()


def test_orders_with_very_many_lines(spark, tmp_path):
    """An order of 150 and one of 200,000 lines, many of them equal, next to usual ones."""
    for name in ("orders", "part"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    some = [r.o_orderkey for r in spark.read.parquet(f"{FOLDER}/orders.parquet").limit(3).collect()]
    template = lines.limit(1)
    extra = [
        template.crossJoin(spark.range(n).select((F.col("id") % 40).alias("variant")))
        .withColumn("l_orderkey", F.lit(key))
        .withColumn("l_quantity", (1 + F.col("variant")).cast(lines.schema["l_quantity"].dataType))
        .drop("variant")
        for key, n in zip(some, (150, 200_000, 3), strict=True)
    ]
    whole = lines.where(~F.col("l_orderkey").isin(some))
    for more in extra:
        whole = whole.unionByName(more)
    whole.write.parquet(f"{tmp_path}/lineitem.parquet")
    with Warehouse.from_retail(spark, str(tmp_path)) as large:
        tables = large.load_model()
        report = {r.constraint_name: r for r in model.primary_key_report(tables).collect()}
        assert report["order_items.item_id"].checked_rows > 190_000
        assert large.staging().where("item_id <> ''").count() == whole.count()


def test_a_line_without_its_order_stops_the_landing(spark, tmp_path, workspace):
    for name in ("orders", "part", "lineitem"):
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        kept = rows.where("o_orderkey > 10") if name == "orders" else rows
        kept.write.parquet(f"{tmp_path}/{name}.parquet")
    with pytest.raises(ConstraintError, match="lineitem.l_orderkey"):
        staging_from_retail(spark, str(tmp_path), workspace)


# --- skew ------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one order, one SKU and one customer; odd values within."""
    chance = random.Random(11)
    from ledgerline.sources.export import STAGING_COLUMNS, STAGING_SCHEMA
    from tests.conftest import PLAIN_ROW

    rows = []
    for n in range(3000):
        hot = n % 3 == 0
        row = {
            **PLAIN_ROW,
            "item_id": str(n),
            "increment_id": "1" if hot else str(chance.randrange(2, 400)),
            "customer_id": "7" if hot else str(chance.randrange(8, 60)),
            "sku": "hot" if hot else chance.choice(["a", "b", "test-x", "testy", "", "c"]),
            "category_name_1": chance.choice(["u", "v", "w", "\\N", ""]),
            "payment_method": chance.choice(["cod", "marketingexpense"]),
            "status": chance.choice(["complete", "", "canceled"]),
        }
        rows.append(tuple(row[c] for c in STAGING_COLUMNS))
    return spark.createDataFrame(rows, STAGING_SCHEMA).repartition(8)


def test_skewed_variants_equal_brute_force(skewed):
    seen: dict[str, set] = {}
    for row in skewed.collect():
        seen.setdefault(row.increment_id, set()).add(row.status)
    expected = sorted((k, len(v)) for k, v in seen.items() if len(v) > 1)
    found = audit.order_attribute_consistency(skewed, "status", "status_variants")
    assert rows_of(found) == sorted(expected, key=repr)


def test_skewed_majority_equals_brute_force(skewed):
    counts: dict[str, dict] = {}
    for row in skewed.collect():
        if row.sku:
            real = row.category_name_1 if row.category_name_1 not in ("\\N", "") else None
            per_sku = counts.setdefault(row.sku, {})
            per_sku[real] = per_sku.get(real, 0) + 1
    expected = {
        sku: min(found, key=lambda c: (c is None, -found[c], c or "")) for sku, found in counts.items()
    }
    assert dict(rows_of(audit.sku_category_majority(skewed))) == expected


def test_skewed_groups_equal_brute_force(skewed):
    orders: dict[str, dict[str, bool]] = {}
    for row in skewed.collect():
        regular = "test" not in row.sku
        mine = orders.setdefault(row.customer_id, {})
        mine[row.increment_id] = mine.get(row.increment_id, False) or regular
    expected = sorted((c, len(o), sum(o.values())) for c, o in orders.items())
    found = checks.wholly_matching_groups(
        skewed, "customer_id", "increment_id", is_regular_sku("sku"), "total", "matching"
    )
    assert rows_of(found) == sorted(expected, key=repr)


def test_cascade_equals_exists(spark, skewed):
    """The two exclusion tables give what nested EXISTS conditions would."""
    w = Warehouse(spark, lambda _: skewed, "skewed")
    rows = skewed.collect()
    service = {r.customer_id for r in w.service_accounts().collect()}
    real = {r.increment_id for r in rows if "test" not in r.sku}
    expected = {
        (r.increment_id, int(r.customer_id), r.payment_method, r.status or None)
        for r in rows
        if r.customer_id not in service and r.increment_id in real
    }
    found = w.orders().select("increment_id", "customer_id", "payment_method", "status").collect()
    assert {tuple(r) for r in found} == expected
    kept = {e[0] for e in expected}
    items = {int(r.item_id) for r in rows if "test" not in r.sku and r.increment_id in kept}
    assert {r.item_id for r in w.order_items().collect()} == items
    customers = {e[1] for e in expected}
    assert {r.customer_id for r in w.customers().collect()} == customers


def test_builds_do_not_depend_on_the_join_strategy(spark, skewed):
    def built(threshold):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            w = Warehouse(spark, lambda _: skewed, "joins")
            return {name: rows_of(table) for name, table in w.model().items()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert built("-1") == built("10485760")


# --- lookups ---------------------------------------------------------------


def metric(spark, name: str) -> int:
    metrics = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics
    return getattr(metrics, name)().getCount()


@pytest.fixture
def catalog(spark, tmp_path):
    made = Catalog(spark, new_database("test"), str(tmp_path / "catalog"))
    yield made
    made.drop()


def test_lookup_reads_one_partition(spark, warehouse, catalog):
    orders = warehouse.orders()
    table = laid_out(orders, catalog, "by_customer", ["customer_id", "increment_id"], parts=15)
    assert table.rows.count() == orders.count()
    for customer in (74, 36, -5):
        expected = rows_of(orders.where(F.col("customer_id") == customer).select(*sorted(orders.columns)))
        assert rows_of(table.of(customer).select(*sorted(orders.columns))) == expected
    part = spark.range(1).select(part_of(F.lit(74).cast("bigint"), 15)).first()[0]
    plan = plan_of(table.of(74))
    assert f"= {part})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(customer_id,74)" in plan


def test_lookup_lists_one_partition_of_many_files(spark, catalog):
    """The catalog prunes: of 10,000 files only those of one directory are listed."""
    rows = spark.range(10_000, numPartitions=4).selectExpr("id AS key", "id * 2 AS twice")
    table = laid_out(rows, catalog, "many", ["key"], parts=100, rows_per_file=1)
    files = len(list(Path(catalog.path("many")).glob("part=*/*.parquet")))
    assert files == 10_000
    spark.sql(f"REFRESH TABLE `{catalog.name}`.many")
    before = metric(spark, "METRIC_FILES_DISCOVERED"), metric(spark, "METRIC_PARTITIONS_FETCHED")
    fresh = Layout(catalog.table("many"), "key", table.partition, table.parts)
    assert [tuple(r) for r in fresh.of(77).collect()] == [(77, 154)]
    listed = metric(spark, "METRIC_FILES_DISCOVERED") - before[0]
    assert 0 < listed < 300
    assert metric(spark, "METRIC_PARTITIONS_FETCHED") - before[1] <= 2


def test_every_access_path_finds_its_rows(spark, warehouse):
    items, orders = warehouse.order_items(), warehouse.orders()
    order = orders.orderBy("increment_id").first()
    by_order = lookup.order_lookup(warehouse.store(), order.increment_id)
    assert by_order.count() == items.where(F.col("increment_id") == order.increment_id).count() > 0
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        again = lookup.order_lookup(warehouse.store(), order.increment_id)
        assert "SelectedBucketsCount: 1 out of" in plan_of(again.select("*", F.lit(1)))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    by_date = warehouse.lookup_table("orders_by_date").of(order.order_date)
    assert by_date.count() == orders.where(F.col("order_date") == order.order_date).count() > 0
    month = order.order_date.replace(day=1)
    assert str((month - date(1970, 1, 1)).days) in plan_of(by_date).split("PartitionFilters")[1] or str(month) in plan_of(by_date)
    sku = items.where("sku is not null").orderBy("sku").first().sku
    by_sku = warehouse.lookup_table("items_by_sku").of(sku)
    assert by_sku.count() == items.where(F.col("sku") == sku).count() > 0


def test_calendar_prunes_months_at_run_time(spark, warehouse):
    layout, calendar = warehouse.lookup_table("orders_by_date"), warehouse.calendar()
    which = (F.col("year") == 1998) & (F.col("quarter") == 4)
    found = lookup.orders_on_days(layout, calendar, which)
    expected = warehouse.orders().where("order_date BETWEEN '1998-10-01' AND '1998-12-31'")
    columns = ["increment_id", "order_date", "customer_id", "payment_method", "grand_total"]
    assert rows_of(found.select(*columns)) == rows_of(expected.select(*columns)) != []
    assert "dynamicpruning" in plan_of(found).split("PartitionFilters")[1].split("PushedFilters")[0]


def test_lookup_is_equal_on_both_tables(warehouse):
    for customer in (74, 36, 120):
        plain = lookup.customer_order_lookup(warehouse.store(), customer)
        fast = lookup.customer_order_lookup_laid_out(
            warehouse.lookup_table("items_by_customer"), customer
        )
        assert rows_of(plain) == rows_of(fast)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_items_meet_their_orders_without_a_shuffle(warehouse, no_broadcast):
    store = warehouse.store()
    assert "Exchange" not in plan_of(star.fact_sales(store))
    assert "Exchange" not in plan_of(lookup.customer_order_lookup(store, 74))
    below = plan_of(analytics.category_revenue(store, warehouse.products()))
    join = below[below.index("LeftAnti"):]
    assert "Exchange" not in join.split("PushedFilters")[0] and "hashpartitioning(increment_id" not in below
    assert star.fact_sales(store).count() == warehouse.order_items().count()


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_items_of_hot_orders_are_stored_apart(spark, skewed, threshold):
    """An order of most of the rows is in no bucket, and every join finds all of its items."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # No order of internal bookings only, which the model leaves out.
    skewed = skewed.withColumn(
        "payment_method", F.when(F.col("increment_id") == "1", "cod").otherwise(F.col("payment_method"))
    )
    try:
        usual = Warehouse(spark, lambda _: skewed, "usual")
        split = Warehouse(spark, lambda _: skewed, "split", hot_rows=500)
        store = split.store()
        sizes = usual.order_items().groupBy("increment_id").count().where("count > 500")
        assert usual.store().hot_items is None and sizes.count() > 0
        assert store.hot_items.count() == sizes.agg(F.sum("count")).first()[0]
        assert store.usual_items.count() + store.hot_items.count() == usual.order_items().count()
        for result in (
            lambda w: w.order_items(), lambda w: star.fact_sales(w.store()),
            lambda w: analytics.category_revenue(w.store(), w.products()),
            lambda w: w.lookup_table("items_by_customer").rows,
        ):
            assert rows_of(result(split)) == rows_of(result(usual))
        hot = store.hot_orders.first()
        assert rows_of(lookup.order_lookup(store, hot.increment_id)) == rows_of(
            usual.order_items().where(F.col("increment_id") == hot.increment_id)
        )
        split.close()
        usual.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- plans -----------------------------------------------------------------


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_slow_operator(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    for slow in ("CartesianProduct", "NestedLoopJoin", "Python", "MapInPandas", "Generate explode(collect"):
        assert slow not in plan


def test_checks_read_only_their_columns(spark, warehouse):
    plan = plan_of(audit.order_attribute_consistency(warehouse.staging(), "status", "n"))
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert schema == "struct<item_id:string,status:string,increment_id:string"


def test_lookup_pushes_the_customer_down(warehouse):
    plan = plan_of(lookup.customer_order_lookup(warehouse.store(), 74))
    assert "EqualTo(customer_id,74)" in plan


def test_order_items_need_no_shuffle_when_exclusions_are_small(warehouse):
    assert "hashpartitioning" not in plan_of(warehouse.build("order_items"))


def test_order_questions_read_one_written_table(spark, warehouse):
    """No question about order amounts groups staging rows again."""
    for name in ("dq_grand_total_per_order", "dq_discount_order_level", "dq_discount_hypotheses", "dq_discount_residual"):
        df = QUERIES[name](warehouse)
        df.collect()
        assert all("/order_amounts/" in path for path in df.inputFiles()), name
        assert "hashpartitioning" not in plan_of(df), name


def test_closing_leaves_nothing(spark, warehouse):
    import os

    with Warehouse.from_staging(spark, warehouse.staging()) as other:
        other.load_model()
        root = other.workspace.root
        assert os.listdir(root.removeprefix("file:"))
    assert not os.path.exists(root.removeprefix("file:"))


@pytest.mark.parametrize("lost", ["", "catalog/orders/*.parquet"])
def test_queries_of_one_application_outlive_lost_tables(spark, tmp_path, lost):
    """Between two queries of one application the shared folder, or a part of it, is emptied."""
    for name in ("orders", "lineitem", "part"):
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name)
        (rows.where(F.col(key) < 60) if key else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    names = ("build_order_items", "customer_order_lookup", "dq_customer_since_pattern", "fk_items_orders")
    before = [rows_of(queries()[name](spark, str(tmp_path))) for name in names]
    opened = open_retail(spark, str(tmp_path))
    root = Path(opened.workspace.root.removeprefix("file:"))
    found = [root / lost] if "*" not in lost else sorted(root.glob(lost))[:1]
    for path in found:
        shutil.rmtree(path) if path.is_dir() else path.unlink()
    assert found and [rows_of(queries()[name](spark, str(tmp_path))) for name in names] == before
    again = open_retail(spark, str(tmp_path))
    assert again is not opened and again is open_retail(spark, str(tmp_path))
    again.close()
    forget_retail(spark, str(tmp_path))


# --- keys and sums of any size -----------------------------------------------


@pytest.mark.parametrize("shift", [10**10, (1 << 63) - 10**6, -(10**12)])
def test_order_keys_of_any_size(spark, tmp_path, shift):
    """Half of the orders have keys whose item ids, by the product, are beyond 64 bits."""
    spark.read.parquet(f"{FOLDER}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        moved = F.when(F.col(key) % 2 == 1, F.col(key) + shift).otherwise(F.col(key))
        rows.withColumn(key, moved).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    with Warehouse.from_retail(spark, str(tmp_path)) as large:
        large.load_model()
        items = large.staging().where("item_id <> ''").select(
            F.col("item_id").cast("bigint").alias("id"),
            F.regexp_replace("increment_id", "-1$", "").cast("decimal(20,0)").alias("number"),
        )
        found = {(r.number - 100_000_000): r for r in items.groupBy("number").agg(
            F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")
        ).collect()}
        sizes = {r.l_orderkey: r["count"] for r in lines.groupBy("l_orderkey").count().collect()}
        assert {key: r.n for key, r in found.items()} == sizes
        start = 9_200_000_000 * 10**9
        for key in sorted(sizes):
            first = key * 10**9 if key % 2 == 0 or abs(key) < 9_200_000_000 else start
            assert (found[key].least, found[key].most) == (first + 1, first + sizes[key])
            start += sizes[key] * (first == start)
        assert large.order_items().where("item_id IS NULL").isEmpty()
        assert large.order_items().count() > 0.8 * lines.count()


def test_sums_of_item_ids_beyond_64_bits(spark, staged):
    """Damaged lines are summed whole; sums that fit stay whole numbers of 64 bits."""
    top = (1 << 63) - 1
    large = [top - n for n in range(40)]
    for ids, kind in ((large, "decimal(38,0)"), (range(1, 41), "bigint")):
        w = Warehouse.from_staging(spark, staged(*[{"item_id": str(i)} for i in ids]))
        found = csv_quarantine(w)
        assert dict(found.dtypes)["item_ids"] == kind
        kinds = [
            "fields" if i % 97 == 0 or i % 89 == 0 else "quote" if i % 83 == 0 else "none" for i in ids
        ]
        expected = {
            k: (kinds.count(k), sum(i for i, x in zip(ids, kinds, strict=True) if x == k))
            for k in set(kinds)
        }
        assert {r.damage: (r["rows"], int(r.item_ids)) for r in found.collect()} == expected
        w.close()
