from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from ledgerline.llm.sampling import per_label


def test_repeated_rows_do_not_thin_a_sample(spark):
    """One id holds nearly all rows of its label; the other 200 ids are sampled all the same."""
    hot = spark.range(1_000_000).select(F.lit(0).cast("long").alias("doc_id"), F.lit("a").alias("label"))
    rest = spark.range(1, 201).select(F.col("id").alias("doc_id"), F.lit("a").alias("label"))
    other = spark.range(1000, 1100).select(F.col("id").alias("doc_id"), F.lit("b").alias("label"))
    rows = hot.unionByName(rest).unionByName(other)
    found = Counter(r.label for r in per_label(rows, "label", 1500).collect())
    assert found == {"a": 201, "b": 100}
    assert Counter(r.label for r in per_label(rows, "label", 50).collect()) == {"a": 50, "b": 50}


def test_repeats_do_not_change_the_sample(spark):
    once = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("label"))
    thrice = once.unionByName(once).unionByName(once)
    ids = lambda rows: sorted(r.doc_id for r in per_label(rows, "label", 400).collect())
    assert ids(once) == ids(thrice) and len(ids(once)) == 1200
