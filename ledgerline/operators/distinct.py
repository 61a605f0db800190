"""Exact distinct counts that merge: sets of whole-number ids as bitmaps.

A set is kept as rows of one bitmap per bucket of 32,768 neighbouring numbers, for every value
of its keys. Bitmaps are built in one pass, before the shuffle already; the sets of coarser
keys are unions of the stored ones, so a month, a year and everything are counted without
another look at the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, IDS = "id_bucket", "ids"


def id_sets(df: DataFrame, keys: list[str | Column], number: str) -> DataFrame:
    """The set of the different ``number`` per value of ``keys``; NULL is no member."""
    value = F.col(number)
    return (
        df.where(value.isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(value).alias(BUCKET))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias(IDS))
    )


def united(sets: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The sets of other, coarser keys."""
    return sets.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(IDS).alias(IDS))


def set_sizes(sets: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """How many members the set of each value of ``keys`` has."""
    whole = united(sets, keys)
    names = whole.columns[: len(keys)]
    return whole.groupBy(*names).agg(F.sum(F.bitmap_count(IDS)).alias(name))
