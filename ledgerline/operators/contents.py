"""Comparison of the contents of two tables, however their rows are ordered or stored.

Rows fall into ranges by a hash of their key. A range is described by its number of rows and
by sums of two hashes of whole rows, which do not depend on the order and which partial
aggregation adds up before the shuffle. Only ranges whose descriptions differ are cut
finer, and the rows of what is left are compared one by one. So equal tables cost one pass each,
and a difference of few rows a pass more per cut, without a sort or join of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.workspace import Workspace

# Ranges that a range is cut into, and how often.
RANGES = 1024
MOST_CUTS = 3
# Rows in differing ranges that are compared one by one without another cut.
FEW_ROWS = 100_000


@dataclass(frozen=True)
class Difference:
    """Rows compared, ranges that differ in the end, and the rows that only one side has."""

    left_rows: int
    right_rows: int
    ranges: int
    rows: DataFrame  # ``side`` (left or right) and the columns of the tables


def _range_of(key: str, ranges: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("range"), key), F.lit(ranges))


def digests(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """``part``, ``n`` and two sums of row hashes per range; the same for rows in any order."""
    # A hash passes over NULL, so where NULLs are is hashed, too.
    whole = [F.col(c) for c in df.columns] + [F.col(c).isNull() for c in df.columns]

    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), *whole).cast("decimal(20,0)"))

    return df.groupBy(_range_of(key, ranges).alias("part")).agg(
        F.count("*").alias("n"), total(1).alias("first"), total(2).alias("second")
    )


def differing_ranges(left: DataFrame, right: DataFrame, key: str, ranges: int) -> DataFrame:
    """``part`` and rows on either side (``n_left``, ``n_right``) of ranges that differ."""
    a, b = digests(left, key, ranges), digests(right, key, ranges)
    names = ("n", "first", "second")
    a = a.select("part", *[F.col(c).alias(f"{c}_left") for c in names])
    b = b.select("part", *[F.col(c).alias(f"{c}_right") for c in names])
    same = [F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right")) for c in names]
    return a.join(b, "part", "full").where(~(same[0] & same[1] & same[2])).select(
        "part", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")
    )


def difference(
    left: DataFrame, right: DataFrame, key: str, workspace: Workspace, few_rows: int = FEW_ROWS
) -> Difference:
    """What two tables of the same columns do not share, repeated rows counted."""
    if sorted(left.dtypes) != sorted(right.dtypes):
        raise ValueError(f"columns differ: {sorted(left.dtypes)} and {sorted(right.dtypes)}")
    right = right.select(*left.columns)
    scope = workspace.scope("difference")
    rows = left.count(), right.count()
    a, b, ranges = left, right, RANGES
    for cut in range(MOST_CUTS):
        found = scope.table(
            f"ranges_{cut}", lambda a=a, b=b, ranges=ranges: differing_ranges(a, b, key, ranges)
        )
        sizes = found.agg(F.count("*").alias("ranges"), F.sum(F.col("n_left") + F.col("n_right")).alias("n")).first()
        # The table of ranges is written, so Spark knows how small it is.
        a, b = (
            side.withColumn("part", _range_of(key, ranges)).join(found.select("part"), "part", "left_semi").drop("part")
            for side in (a, b)
        )
        if (sizes.n or 0) <= few_rows:
            break
        ranges *= RANGES
    only = a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(
        b.exceptAll(a).select(F.lit("right").alias("side"), "*")
    )
    return Difference(*rows, sizes.ranges, scope.table("rows", lambda: only))
