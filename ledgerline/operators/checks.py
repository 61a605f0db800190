"""Data-quality checks that work on any table.

Every grouped check aggregates on the map side first, and distinct counts are
grouped by (key, value) before they are grouped by key, so a key that holds a
large share of the rows arrives at its final task already reduced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import percent
from ledgerline.functions.text import is_populated, not_matching, null_tokens

MATERIALITY_THRESHOLD = 0.05


def valid_rows(df: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows whose key is neither NULL nor blank."""
    return df.where(is_populated(key))


def count_rows(df: DataFrame, condition: Column | None = None, name: str = "count") -> DataFrame:
    """One row with the number of rows that meet ``condition``."""
    rows = df if condition is None else df.where(condition)
    return rows.agg(F.count("*").alias(name))


def count_each(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with one counter per condition, all from a single pass."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in conditions.items()])


def as_long(one_row: DataFrame, label: str, value: str) -> DataFrame:
    """A wide row of counters as (label, value) rows."""
    return one_row.unpivot([], one_row.columns, label, value)


def uniqueness_check(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(key).count().where(F.col("count") > 1)


def uniqueness_summary(df: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, repeated keys, rows beyond the first of each key."""
    count = F.col("count")
    return df.groupBy(key).count().agg(
        F.count("*").alias("distinct_keys"),
        F.count_if(count > 1).alias("repeated_keys"),
        F.coalesce(F.sum(count - 1), F.lit(0)).alias("surplus_rows"),
    )


def fd_check(
    df: DataFrame, key: str, value: Column, name: str = "variants", count_null: bool = False
) -> DataFrame:
    """Keys that do not determine the value: key and number of distinct values.

    NULL is no value, as in COUNT(DISTINCT), unless ``count_null`` is set.
    """
    number = F.count_distinct(F.col(name))
    if count_null:
        number = number + F.bool_or(F.col(name).isNull()).cast("int")
    rows = df.select(key, value.alias(name))
    return rows.groupBy(key).agg(number.alias(name)).where(F.col(name) > 1)


def fd_summary(
    df: DataFrame, key: str, values: dict[str, Column], count_null: bool = False
) -> DataFrame:
    """(attribute, checked_keys, violating_keys) for attributes that a key should determine.

    Whether a key has several values shows in minimum and maximum, which combine
    before the shuffle, so a hot key arrives as one row per task, and no row is
    expanded per attribute as several distinct counts would need.
    """

    def varies(name: str) -> Column:
        several = F.coalesce(F.min(name) != F.max(name), F.lit(False))
        if count_null:
            several = several | (F.min(name).isNotNull() & F.bool_or(F.col(name).isNull()))
        return several.alias(name)

    rows = df.select(key, *[value.alias(name) for name, value in values.items()])
    per_key = rows.groupBy(key).agg(*[varies(name) for name in values])
    totals = per_key.agg(
        F.count("*").alias("checked_keys"), *[F.count_if(name).alias(name) for name in values]
    )
    return totals.unpivot("checked_keys", list(values), "attribute", "violating_keys").select(
        "attribute", "checked_keys", "violating_keys"
    )


def token_scan(df: DataFrame, counters: dict[str, str], token: str) -> DataFrame:
    """One row: per counter name, the rows whose column holds ``token``."""
    return count_each(df, {name: F.col(c) == token for name, c in counters.items()})


def token_profile(df: DataFrame, columns: list[str], tokens: dict[str, str]) -> DataFrame:
    """(column_name, token, rows) for every column and token, from a single pass."""
    pairs = [(c, label, text) for c in columns for label, text in tokens.items()]
    counted = df.agg(*[F.count_if(F.col(c) == text).alias(f"{c}|{label}") for c, label, text in pairs])
    return as_long(counted, "pair", "rows").select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("column_name"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("token"),
        "rows",
    )


def any_mismatch(patterns: dict[str, str]) -> Column:
    """True where at least one column does not match its pattern."""
    tests = [not_matching(name, pattern) for name, pattern in patterns.items()]
    combined = tests[0]
    for test in tests[1:]:
        combined = combined | test
    return combined


def _mismatches(
    df: DataFrame, patterns: dict[str, str], ignore: tuple[str, ...]
) -> dict[str, Column]:
    return {
        name: ~F.col(name).isin(*ignore) & not_matching(name, pattern)
        if ignore
        else not_matching(name, pattern)
        for name, pattern in patterns.items()
    }


def pattern_check(
    df: DataFrame, patterns: dict[str, str], ignore: tuple[str, ...] = ()
) -> DataFrame:
    """(column_name, bad_rows) per column, in one pass; texts in ``ignore`` are not checked."""
    return as_long(count_each(df, _mismatches(df, patterns, ignore)), "column_name", "bad_rows")


def pattern_offenders(
    df: DataFrame, patterns: dict[str, str], ignore: tuple[str, ...] = ()
) -> DataFrame:
    """The rows with a mismatch, and the names of their columns as ``bad_columns``."""
    found = [F.when(bad, F.lit(name)) for name, bad in _mismatches(df, patterns, ignore).items()]
    marked = df.withColumn("bad_columns", F.array_compact(F.array(*found)))
    return marked.where(F.size("bad_columns") > 0)


def hypothesis_test(
    df: DataFrame,
    formulas: dict[str, Column],
    actual: Column,
    tolerance: str = "0.01",
    total: str = "total",
    every: str = "every",
    none: str = "none",
) -> DataFrame:
    """One row: all rows, rows that each formula explains, that every one does, that none does."""
    fits = {name: within(formula, actual, tolerance) for name, formula in formulas.items()}
    all_fit, some_fit = F.lit(True), F.lit(False)
    for fit in fits.values():
        all_fit, some_fit = all_fit & fit, some_fit | fit
    return count_each(df, {total: F.lit(True), **fits, every: all_fit, none: ~some_fit})


def cascade_exclude(df: DataFrame, excluded: DataFrame, *keys: str) -> DataFrame:
    """Rows whose ``keys`` are not among the excluded ones; for each table that carries the keys.

    Written exclusions are joined at whatever strategy their size allows.
    """
    return df.join(excluded.select(*keys), list(keys), "left_anti")


def reconcile(counts: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, staged, excluded, expected, actual, difference).

    ``counts`` has (table_name, staged, excluded), ``actual`` (table_name, row_count); what is
    staged and not excluded should be there.
    """
    expected, found = F.col("staged") - F.col("excluded"), F.col("row_count")
    return counts.join(actual, "table_name").select(
        "table_name",
        "staged",
        "excluded",
        expected.alias("expected"),
        found.alias("actual"),
        (found - expected).alias("difference"),
    )


def length_bounds(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: per output name, the longest text of a column."""
    return df.agg(*[F.max(F.length(c)).cast("bigint").alias(name) for name, c in columns.items()])


def length_violations(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(column_name, length_limit, too_long) per column; nothing is truncated."""
    counted = df.agg(*[F.count_if(F.length(c) > limit).alias(c) for c, limit in limits.items()])
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return as_long(counted, "column_name", "too_long").select(
        "column_name", limit[F.col("column_name")].alias("length_limit"), "too_long"
    )


def redundant_columns(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """One row: rows compared and rows in which the two expressions differ."""
    return df.agg(
        F.count_if(left.isNotNull() & right.isNotNull()).alias("compared_rows"),
        F.count_if(left != right).alias("different_rows"),
    )


def value_distribution(df: DataFrame, value: str, rows: str, distinct: dict[str, str]) -> DataFrame:
    """Rows and distinct counts per value."""
    return df.groupBy(value).agg(
        F.count("*").alias(rows), *[F.count_distinct(c).alias(name) for name, c in distinct.items()]
    )


def share_of_total(df: DataFrame, measure: str, name: str) -> DataFrame:
    """Adds each row's percentage of the column total; the total is a one-value subquery."""
    total = df.agg(F.sum(measure)).scalar()
    return df.withColumn(name, percent(F.col(measure), total))


def materiality(
    df: DataFrame, part: str, whole: str, threshold: float = MATERIALITY_THRESHOLD
) -> DataFrame:
    """Adds the percentage ``part`` is of ``whole`` and whether it reaches the threshold."""
    share, limit = F.col(part), Decimal(str(threshold))
    return df.withColumns(
        {
            "pct": percent(share, F.col(whole), 4),
            "is_material": share >= F.col(whole) * F.lit(limit),
        }
    )


def majority_value(
    df: DataFrame, key: str, value: str, tokens: tuple[str, ...], name: str
) -> DataFrame:
    """The most frequent real value per key, NULL only for keys without any.

    Equal counts are settled by the smaller text. Rows are counted per
    (key, value) first; the choice is then a minimum, which combines partially.
    """
    counted = df.groupBy(key, null_tokens(value, tokens).alias("kept")).count()
    preference = F.struct(
        F.col("kept").isNull().alias("missing"), (-F.col("count")).alias("rank"), F.col("kept")
    )
    return counted.groupBy(key).agg(F.min(preference)["kept"].alias(name))


def wholly_matching_groups(
    df: DataFrame, key: str, unit: str, test: Column, total: str, matching: str
) -> DataFrame:
    """Per key: its distinct units, and those with at least one row that meets ``test``."""
    units = df.groupBy(key, unit).agg(F.bool_or(test).alias("meets"))
    return units.groupBy(key).agg(
        F.count(unit).alias(total), F.count_if(F.col("meets") & F.col(unit).isNotNull()).alias(matching)
    )


def within(left: Column, right: Column, tolerance: str = "0.01") -> Column:
    return F.abs(left - right) <= F.lit(Decimal(tolerance))
