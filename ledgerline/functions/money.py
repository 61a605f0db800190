"""Column expressions for amounts, quantities and exact percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import column

MONEY = T.DecimalType(18, 4)
EXACT = T.DecimalType(38, 20)


def money(c: Column | str) -> Column:
    """Amount from numeric text, NULL where the text is no number."""
    return column(c).try_cast(MONEY)


def whole_number(c: Column | str) -> Column:
    return column(c).try_cast(T.IntegerType())


def clean_money(c: Column | str) -> Column:
    """Amount from padded text with thousands commas, where a lone dash is zero."""
    bare = F.trim(F.replace(column(c), F.lit(","), F.lit("")))
    return F.when(bare == "-", F.lit(0).cast(MONEY)).otherwise(bare.try_cast(MONEY))


def gross_value(price: Column | str, quantity: Column | str) -> Column:
    """Price times quantity of parsed columns, before any discount.

    The product keeps its own, wider type: no price and quantity can be too large for it.
    """
    return column(price) * column(quantity)


def loses_digits(c: Column | str) -> Column:
    """True for text that is an amount with more decimals than ``money`` keeps."""
    return F.coalesce(column(c).try_cast(EXACT) != money(c), F.lit(False))


WIDE = "decimal(24,4)"


def _divide(part: Column, whole: Column, digits: int) -> Column:
    zero = F.lit(0).cast(WIDE)
    return F.round(part / F.nullif(whole.cast(WIDE), zero), digits).cast("double")


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in decimals, half away from zero; NULL for a zero whole."""
    return _divide(part.cast(WIDE), whole, digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole in decimals, half away from zero; NULL for a zero whole."""
    return _divide(part.cast(WIDE) * 100, whole, digits)
