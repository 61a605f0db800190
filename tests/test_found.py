"""Shapes and redundant columns, found in the data."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.redundancy import Reading, redundant_pairs, signatures
from ledgerline.operators.shapes import shape_offenders, shape_profile
from ledgerline.plans import audit


def test_patterns_match_their_values_only(spark):
    values = ["7/1/2016", "12/31/2016", "AB-7", "", "x.y\nz", "a+b", None, "7/1/2016", "é1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    found = {r.shape: r for r in shape_profile(df, ("v",), 20).collect()}
    assert found["9/9/9"].pattern == r"[0-9]{1,2}\/[0-9]{1,2}\/[0-9]{4}"
    assert found["9/9/9"].rows == 3 and found["9/9/9"].is_common and not found["a-9"].is_common
    assert found["9/9/9"].pct == 37.5
    for value in values:
        if value is not None and "\n" not in value:
            fitting = [s for s, r in found.items() if re.fullmatch(r.pattern, value)]
            assert len(fitting) == 1, value
    rare = {r.value: r.rows for r in shape_offenders(df, ("v",), 20).collect()}
    assert rare == {"AB-7": 1, "": 1, "x.y\nz": 1, "a+b": 1, "é1": 1}
    assert shape_profile(df.limit(0), ("v",)).collect() == []


def test_shapes_find_what_the_given_patterns_find(spark, warehouse):
    staging = warehouse.staging()
    rare = {}
    for r in audit.shape_offenders(staging).collect():
        rare.setdefault(r.column_name, {})[r.value] = r.rows
    ids = audit.non_numeric_increment_ids(staging).groupBy("increment_id").count().collect()
    assert rare["increment_id"] == {r.increment_id: r["count"] for r in ids}
    assert rare["mv"] == {" - ": audit.mv_dash_count(staging).first()[0]}
    not_dates = {r.customer_since for r in audit.customer_since_non_date(staging).collect()}
    assert set(rare["customer_since"]) == not_dates
    assert all(float(v) < 0 for v in rare["discount_amount"])


def test_redundant_columns_are_found(spark, warehouse):
    found = {
        (r.left_column, r.left_reading, r.right_column, r.right_reading): r.compared_rows
        for r in audit.redundant_pairs(warehouse.staging()).collect()
    }
    assert found == {
        ("created_at", "text", "working_date", "text"): 6000, ("created_at", "date", "working_date", "date"): 6000,
        ("mv", "number", "rounded gross", "number"): 6000, ("m_y", "text", "month and year", "text"): 6000,
    }


def test_no_false_pair(spark):
    rows = [(n, str(n % 3), str(n % 3), str((n + 1) % 3), None, "x", None if n == 5 else str(n % 3)) for n in range(200)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string, d string, e string, f string")
    readings = [Reading(c, "text", F.col(c)) for c in "abcdef"]
    found = redundant_pairs(df, "id", readings).collect()
    # The same values in other rows, one value missing, or no value at all are no agreement.
    assert [tuple(r) for r in found] == [("a", "text", "b", "text", 200)]
    plan = signatures(df, "id", readings)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Join" not in plan
    assert redundant_pairs(df, "id", readings[2:]).collect() == []
    with pytest.raises(ValueError, match="value"):
        redundant_pairs(df, "id", [Reading("value", "text", F.col("a"))])
