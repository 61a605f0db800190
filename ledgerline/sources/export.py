"""The raw export: its columns, its CSV reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header of the export and the name each column gets here.
RAW_COLUMNS = {
    "item_id": "item_id",
    "status": "status",
    "created_at": "created_at",
    "sku": "sku",
    "price": "price",
    "qty_ordered": "qty_ordered",
    "grand_total": "grand_total",
    "increment_id": "increment_id",
    "category_name_1": "category_name_1",
    "sales_commission_code": "sales_commission_code",
    "discount_amount": "discount_amount",
    "payment_method": "payment_method",
    "Working Date": "working_date",
    "BI Status": "bi_status",
    " MV ": "mv",
    "Year": "year",
    "Month": "month",
    "Customer Since": "customer_since",
    "M-Y": "m_y",
    "FY": "fy",
    "Customer ID": "customer_id",
}

STAGING_COLUMNS = tuple(RAW_COLUMNS.values())

# Everything lands as text, so no row can fail on typing.
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])
STAGING_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in STAGING_COLUMNS])


DAMAGE = "damaged_row"


def read_fields(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Rows by position, with the text of rows of another number of fields in ``damaged_row``."""
    schema = T.StructType(list(RAW_SCHEMA.fields)).add(DAMAGE, T.StringType())
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", DAMAGE)
        .option("escape", '"')
        # Fields are counted only if all of them are parsed.
        .option("columnPruning", False)
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Staging rows from CSV with a header; columns are taken by position.

    Blanks, which the reader returns as NULL, become empty text again, because
    the audit tells a blank from other missing-value tokens. Rows with too few or
    too many fields are filled up or cut; ``malformed_rows`` finds them. ``multi_line``
    allows line breaks inside quoted fields but keeps each file in one task. Landing keeps the
    damaged rows instead (``sources/landing.py``).
    """
    return read_fields(spark, path, multi_line).drop(DAMAGE).toDF(*STAGING_COLUMNS).na.fill("")


def malformed_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row: all rows, rows of another number of fields, lines with an open quote.

    A quoted field that goes on in the next line leaves a quote open in both lines, unless
    ``multi_line`` reads them as one.
    """
    # Spark reads the text of damaged rows beside another column only.
    beside = F.concat(F.col(DAMAGE), F.coalesce(F.col(RAW_SCHEMA.names[0]), F.lit("")))
    fields = read_fields(spark, path, multi_line).agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.length(beside) >= 0).alias("wrong_field_count"),
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    is_open = quotes % 2 == 1 if not multi_line else F.lit(False)
    lines = spark.read.text(path).agg(F.count_if(is_open).alias("open_quotes"))
    # Two tables of one row each, side by side.
    return fields.select(
        "total_rows", "wrong_field_count", lines.scalar().alias("open_quotes")
    )


class MalformedExportError(ValueError):
    """An export has rows that do not fit its header."""


def write_csv(staging: DataFrame, path: str) -> None:
    """Staging rows as CSV in the layout of the export."""
    (
        staging.select(*STAGING_COLUMNS)
        .toDF(*RAW_COLUMNS)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


# Item ids divisible by these lose a field, have one more, or open a quote.
FIELD_LOST, FIELD_MORE, QUOTE_OPEN = 97, 89, 83


def write_damaged_csv(staging: DataFrame, path: str) -> None:
    """Staging rows as lines of the export, damaged by the item id, to try a landing on."""
    names = list(RAW_COLUMNS)
    rows = staging.select(*STAGING_COLUMNS).toDF(*names)
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    item = F.col(names[0]).try_cast("bigint")
    line = F.col("line")
    damaged = (
        F.when(item % FIELD_LOST == 0, F.regexp_replace(line, ",[^,]*$", ""))
        .when(item % FIELD_MORE == 0, F.concat(line, F.lit(",more")))
        .when(item % QUOTE_OPEN == 0, F.regexp_replace(line, ",([^,]*)$", ',"$1'))
        .otherwise(line)
    )
    text = rows.withColumn("line", F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]), options | {"emptyValue": ""}))
    header = staging.sparkSession.range(1).select(F.lit(",".join(names)).alias("value"))
    header.unionByName(text.select(damaged.alias("value"))).write.mode("overwrite").text(path)
