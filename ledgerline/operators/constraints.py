"""Key constraints as checks: a violated constraint is a count above zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pk_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Key values that are NULL or occur more than once."""
    return df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())


def pk_violations(df: DataFrame, table: str, key: str) -> DataFrame:
    """One row: (constraint_name, checked_rows, null_keys, repeated_keys)."""
    name, rows = F.col(key), F.col("count")
    return (
        df.groupBy(key)
        .count()
        .agg(
            F.coalesce(F.sum(rows), F.lit(0)).alias("checked_rows"),
            F.coalesce(F.sum(F.when(name.isNull(), rows)), F.lit(0)).alias("null_keys"),
            F.count_if((rows > 1) & name.isNotNull()).alias("repeated_keys"),
        )
        .select(F.lit(f"{table}.{key}").alias("constraint_name"), "*")
    )


def _unmatched(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, rows) per child key, counted before the join, that no parent row matches.

    NULL is one of them: it matches nothing, which a foreign key allows.
    """
    used = child.groupBy(key).agg(F.count("*").alias("rows"))
    return used.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def fk_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, rows) for every child key without a parent row."""
    return _unmatched(child, key, parent, parent_key).where(F.col(key).isNotNull())


def fk_violations(
    child: DataFrame, child_name: str, key: str, parent: DataFrame, parent_name: str, parent_key: str
) -> DataFrame:
    """One row: (constraint_name, orphan_keys, orphan_rows, null_rows); NULL keys are allowed."""
    rows, is_null = F.col("rows"), F.col(key).isNull()

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0))

    label = f"{child_name}.{key} -> {parent_name}.{parent_key}"
    return (
        _unmatched(child, key, parent, parent_key)
        .agg(
            F.count(key).alias("orphan_keys"),
            total(~is_null).alias("orphan_rows"),
            total(is_null).alias("null_rows"),
        )
        .select(F.lit(label).alias("constraint_name"), "*")
    )


class ConstraintError(ValueError):
    """A table breaks a primary or foreign key."""


def require_no_violations(report: DataFrame, *counters: str) -> None:
    """Raises if a counter of the report, one row per constraint, is above zero."""
    broken = report.where(F.greatest(*[F.col(c) for c in counters], F.lit(0)) > 0).collect()
    if broken:
        raise ConstraintError("; ".join(str(row.asDict()) for row in broken))
