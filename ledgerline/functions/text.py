"""Column expressions for raw text: missing-value tokens, patterns, dates, test SKUs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that stand for a missing value in the raw export.
BLANK = ""
BACKSLASH_N = "\\N"
SPREADSHEET_NA = "#N/A"
MISSING_TOKENS = (BACKSLASH_N, BLANK, SPREADSHEET_NA)

# Genuine products whose name happens to hold "test".
GENUINE_TEST_SKUS = (
    "SKMT_Blood Test",
    "Aladdin_Test Star Cricket Ball - Red & White",
    "sst_Vous Deteste-Regular fit-Medium",
)

# ``$`` would also match before a final line break in Java, so patterns end in \z.
NUMERIC_TEXT = r"^-?[0-9]+(\.[0-9]+)?\z"
INTEGER_TEXT = r"^-?[0-9]+\z"
DIGITS_TEXT = r"^[0-9]+\z"
# What a cast to a number accepts: padding, sign, exponent, but no thousands commas.
CASTABLE_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
YEAR_MONTH_TEXT = r"^[0-9]{4}-[0-9]{1,2}\z"

# One-letter fields accept padded and unpadded months and days.
ORDER_DATE_FORMAT = "M/d/yyyy"
SINCE_FORMAT = "yyyy-M"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_populated(c: Column | str) -> Column:
    """True where the value is neither NULL nor blank."""
    c = column(c)
    return c.isNotNull() & (c != BLANK)


def null_tokens(c: Column | str, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    """The value, or NULL where it is one of ``tokens``."""
    c = column(c)
    return F.when(~c.isin(*tokens), c)


def not_matching(c: Column | str, pattern: str) -> Column:
    return ~column(c).rlike(pattern)


def parse_date(c: Column | str, pattern: str) -> Column:
    """Date from text, NULL where it does not parse."""
    return F.try_to_date(column(c), pattern)


def is_test_sku(c: Column | str, genuine: tuple[str, ...] = GENUINE_TEST_SKUS) -> Column:
    """True for a SKU that names test data; NULL stays NULL."""
    c = column(c)
    return c.ilike("%test%") & ~c.isin(*genuine)


def is_regular_sku(c: Column | str, genuine: tuple[str, ...] = GENUINE_TEST_SKUS) -> Column:
    return ~is_test_sku(c, genuine)
