"""Quantile groups by cuts against a window over all rows."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators.cuts import _starts, add_groups
from ledgerline.plans import analytics
from ledgerline.sources.workspace import Workspace

SCHEMA = "id long, whole long, amount decimal(28,4), day date"
ORDERS = {"w": "whole", "a": "amount", "d": "day"}


def windowed(df, groups):
    for name, column in ORDERS.items():
        df = df.withColumn(name, F.ntile(groups).over(Window.orderBy(column, "id")))
    return df


def rows(count, chance):
    start = datetime.date(2000, 1, 1)
    return [
        (
            n * 3 - count,
            # A third of the rows share a value.
            7 if n % 3 == 0 else chance.choice([None, *range(20)]),
            Decimal(chance.randrange(-(10**9), 10**9)) / 10**4 if n % 4 else Decimal("12345678901234567890.1234"),
            start + datetime.timedelta(days=chance.randrange(5)) if n % 10 else None,
        )
        for n in range(count)
    ]


@pytest.mark.parametrize(("count", "groups", "few"), [(3000, 5, 20), (3000, 4, 100_000), (1237, 7, 1), (3, 5, 10), (0, 5, 10)])
def test_groups_equal_a_window_over_all_rows(spark, tmp_path, count, groups, few):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows(count, random.Random(count)), SCHEMA).write.parquet(path)
    df = spark.read.schema(SCHEMA).parquet(path)
    got = add_groups(df, ORDERS, "id", groups, few_rows=few)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windowed(df, groups).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window"))


def test_one_value_and_hidden_ties(spark):
    df = spark.range(1000).select("id", F.lit(1).cast("long").alias("whole"))
    got = add_groups(df, {"g": "whole"}, "id", 4, few_rows=5)
    assert {tuple(r) for r in got.groupBy("g").agg(F.min("id"), F.max("id")).collect()} == {
        (1, 0, 249), (2, 250, 499), (3, 500, 749), (4, 750, 999),
    }


def test_starts_of_groups():
    assert _starts(10, 4) == [3, 6, 8] and _starts(2, 5) == [1, 2, 2, 2] and _starts(0, 3) == [0, 0]


def test_scores_need_no_sort(spark, warehouse):
    segments = analytics.rfm_segments(warehouse.orders(), Workspace(spark, "rfm"))
    plan = segments._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan and "Sort " not in plan
