"""Merging distinct counts, and the comparison of contents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import contents
from ledgerline.operators.contents import difference
from ledgerline.operators.distinct import id_sets, set_sizes, united
from ledgerline.plans import analytics, reconcile
from ledgerline.sources.workspace import Workspace


@pytest.fixture
def workspace(spark):
    return Workspace(spark, "test")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- distinct counts -------------------------------------------------------


def test_sets_merge_to_exact_counts(spark):
    chance = random.Random(4)
    values = [0, 1, -1, 32767, 32768, 32769, -32768, 2**40, -(2**40), 5, 5, None]
    rows = [(chance.choice("ab"), chance.choice("xyz"), chance.choice(values)) for _ in range(500)]
    rows += [("hot", "x", chance.randrange(100_000)) for _ in range(3000)] + [("none", "x", None)]
    df = spark.createDataFrame(rows, "k string, m string, id long")
    sets = id_sets(df, ["k", "m"], "id")
    for keys in (["k", "m"], ["k"], ["m"]):
        expected: dict = {}
        for k, m, value in rows:
            if value is not None:
                expected.setdefault(tuple({"k": k, "m": m}[c] for c in keys), set()).add(value)
        got = {tuple(r)[:-1]: r.n for r in set_sizes(sets, keys, "n").collect()}
        assert got == {key: len(found) for key, found in expected.items()}
    again = set_sizes(united(sets, ["m"]).unionByName(united(sets, ["m"])), ["m"], "n")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in set_sizes(sets, ["m"], "n").collect()}
    assert set_sizes(sets.limit(0), ["k"], "n").collect() == []
    assert "Expand" not in plan_of(set_sizes(sets, ["k"], "n"))


def test_coarser_counts_read_the_sets_only(spark, warehouse):
    reach = analytics.customer_reach(warehouse.customer_sets())
    reach.collect()
    assert all("/customer_sets/" in path for path in reach.inputFiles())
    assert "Expand" not in plan_of(reach)
    exact = warehouse.orders().agg(F.count_distinct("customer_id")).first()[0]
    assert reach.where("grain = 'all'").first().customers == exact
    months = {r.order_month.strftime("%Y-%m"): r.customers for r in analytics.monthly_kpi(warehouse.orders()).collect()}
    assert {r.period: r.customers for r in reach.where("grain = 'month'").collect()} == months


# --- contents --------------------------------------------------------------


def test_one_changed_amount_in_a_million_rows_is_named(spark, workspace):
    left = spark.range(1_000_000).select("id", (F.col("id") * 7 % 1000).cast("decimal(18,4)").alias("amount"))
    changed = F.when(F.col("id") == 765_432, F.col("amount") + F.lit("0.0001").cast("decimal(18,4)"))
    right = left.select("id", F.coalesce(changed, "amount").cast("decimal(18,4)").alias("amount"))
    found = difference(left, right.repartition(7), "id", workspace, few_rows=500)
    assert (found.left_rows, found.right_rows, found.ranges) == (1_000_000, 1_000_000, 1)
    rows = {r.side: (r.id, str(r.amount)) for r in found.rows.collect()}
    assert rows == {"left": (765_432, "24.0000"), "right": (765_432, "24.0001")}


def test_equal_contents_in_any_order(spark, workspace):
    rows = [(1, "a", None), (2, None, "b"), (2, None, "b"), (None, "c", "d"), (None, None, None)]
    left = spark.createDataFrame(rows, "k int, a string, b string")
    right = spark.createDataFrame(rows[::-1], "k int, a string, b string").select("b", "k", "a")
    found = difference(left, right, "k", workspace)
    assert found.ranges == 0 and found.rows.count() == 0
    empty = difference(left.limit(0), left.limit(0), "k", workspace)
    assert (empty.left_rows, empty.ranges, empty.rows.count()) == (0, 0, 0)


@pytest.mark.parametrize("few_rows", [0, 100_000])
def test_every_kind_of_difference(spark, workspace, few_rows):
    base = [(n, "x", "y") for n in range(300)]
    left = spark.createDataFrame([*base, (1000, None, "z"), (1001, "q", "q"), (1001, "q", "q")], "k int, a string, b string")
    right = spark.createDataFrame([*base[1:], (1000, "z", None), (1001, "q", "q"), (2000, "new", "n")], "k int, a string, b string")
    found = difference(left, right, "k", workspace, few_rows=few_rows)
    assert sorted(map(tuple, found.rows.collect()), key=repr) == sorted([
        ("left", 0, "x", "y"), ("left", 1000, None, "z"), ("left", 1001, "q", "q"),
        ("right", 1000, "z", None), ("right", 2000, "new", "n"),
    ], key=repr)
    with pytest.raises(ValueError, match="columns differ"):
        difference(left, right.withColumnRenamed("a", "c"), "k", workspace)


def test_digests_combine_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id * 2 AS v")
    plan = plan_of(contents.digests(df, "id", 16))
    assert "partial_sum" in plan and "Sort" not in plan


def test_a_changed_model_row_is_found(spark, warehouse, workspace):
    stored = warehouse.model()
    derived = {name: warehouse.build(name) for name in stored}
    clean = reconcile.contents(derived, stored, workspace)
    assert all(r.missing_rows == r.unexpected_rows == 0 < r.stored_rows for r in clean.collect())
    victim = stored["order_items"].orderBy("item_id").first().item_id
    price = F.when(F.col("item_id") == victim, F.lit(0)).otherwise(F.col("price")).cast("decimal(18,4)")
    spoiled = stored | {"order_items": stored["order_items"].withColumn("price", price)}
    report = {r.table_name: r for r in reconcile.contents(derived, spoiled, workspace).collect()}
    assert (report["order_items"].missing_rows, report["order_items"].unexpected_rows) == (1, 1)
    assert report["orders"].missing_rows == 0
