"""Bounded samples of labelled rows, and the split into learned and held-out documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HASHES = 1 << 31


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def per_label(rows: DataFrame, label: str, count: int) -> DataFrame:
    """``doc_id`` and label of at most ``count`` documents per label, those with the least hashes.

    The sizes of the labels in different documents, one number each, say which hashes are
    small enough, so that only about twice the documents wanted are ranked; repeated rows
    count once. NULL ids and labels are left out.
    """
    known = (
        rows.select("doc_id", label)
        .where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .distinct()
    )
    sizes = known.groupBy(label).count().collect()
    if not sizes:
        return known.limit(0)
    limits = {size[0]: int(_HASHES * min(1.0, (2 * count + 64) / size[1])) for size in sizes}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col(label)]
    hashed = known.withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)))
    first = Window.partitionBy(label).orderBy("hash", "doc_id")
    return (
        hashed.where(F.col("hash") < limit)
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= count)
        .select("doc_id", label)
    )


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` with the text of each document, one text also for a repeated row.

    ``chosen`` is bounded by its sampling, so it is sent to all tasks.
    """
    keys = chosen.columns
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy(*keys)
        .agg(F.min("text").alias("text"))
    )
