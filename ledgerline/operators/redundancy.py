"""Columns that say the same, found without comparing all pairs row by row.

A column can be read in several ways: as text, as a number, as a date, or as an expression of
several columns. One pass sums, for every reading, hashes of the row's key with what is
read. Two readings that agree in every row have equal sums, whatever the order of the rows;
readings with equal sums are the candidates, and a second pass compares only these exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reading:
    """One way to read a column; ``value`` gives text, NULL where there is nothing to read."""

    column: str
    how: str
    value: Column

    @property
    def name(self) -> str:
        return f"{self.column} as {self.how}"


def signatures(df: DataFrame, key: str, readings: list[Reading]) -> DataFrame:
    """(reading, known, first, second): numbers of the readings, rows read, two sums of hashes."""
    cells = F.array(*[F.struct(F.lit(n).alias("reading"), r.value.alias("value")) for n, r in enumerate(readings)])

    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), key, "value").cast("decimal(20,0)"))

    return (
        df.select(key, F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy("reading")
        .agg(F.count("*").alias("known"), total(1).alias("first"), total(2).alias("second"))
    )


def redundant_pairs(df: DataFrame, key: str, readings: list[Reading]) -> DataFrame:
    """(left_column, left_reading, right_column, right_reading, compared_rows) of all equal readings.

    ``key`` is unique. Pairs of one column with itself, and readings without a value, are none.
    """
    names = [r.column for r in readings]
    if "value" in names or key == "value":
        raise ValueError("no column may be named value")
    # One row per reading.
    classes: dict[tuple, list[int]] = {}
    for row in signatures(df, key, readings).collect():
        classes.setdefault((row.known, row.first, row.second), []).append(row.reading)
    pairs = [
        (a, b)
        for found in classes.values()
        for i, a in enumerate(sorted(found))
        for b in sorted(found)[i + 1 :]
        if readings[a].column != readings[b].column
    ]
    rows = []
    for n, (a, b) in enumerate(pairs):
        left, right = readings[a], readings[b]
        rows.append(
            F.struct(
                F.lit(left.column).alias("left_column"), F.lit(left.how).alias("left_reading"),
                F.lit(right.column).alias("right_column"), F.lit(right.how).alias("right_reading"),
                F.col(f"compared_{n}").alias("compared_rows"), F.col(f"different_{n}").alias("different"),
            )
        )
    if not pairs:
        schema = "left_column string, left_reading string, right_column string, right_reading string, compared_rows long"
        return df.sparkSession.createDataFrame([], schema)
    counts = []
    for n, (a, b) in enumerate(pairs):
        left, right = readings[a].value, readings[b].value
        counts.append(F.count(left).alias(f"compared_{n}"))
        counts.append(F.count_if(~left.eqNullSafe(right)).alias(f"different_{n}"))
    verified = df.agg(*counts).select(F.inline(F.array(*rows)))
    return verified.where("different = 0").drop("different")
