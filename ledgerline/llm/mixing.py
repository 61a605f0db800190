"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is its weight's share of the words wanted, at most a multiple of its
size; what a capped source cannot take is shared among the others by weight, until no
target is above its cap. Targets are reached in complete epochs first: every document
as often as the whole source fits into the target. The rest is a fraction of an epoch,
selected after Efraimidis and Spirakis: every document draws an exponential key divided
by its quality weight, documents are sorted by key within their source, and are taken as
far as the prefix sum of their sizes stays within the rest. The document at the edge is
cut. Keys are hashes of the document, so reruns agree.

The quality weight of a document is the share of letters in it, squared, at least
``LEAST_QUALITY``: text full of digits and signs comes late.

A source may hold most of all documents: rows are spread over range partitions of (source,
key), sums per partition and source come first, and only these are added up in order.

Defined results: a NULL or wordless text has size 0 and is not taken; NULL is a source of
its own, last in order; a source without words has target 0; repeated rows are documents
of their own; an empty table gives no rows; other columns pass through ``mix`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.llm.text import LEADING, SEPARATOR, bound_batches, slices, text_buffers, words_of
from ledgerline.operators.numbering import global_row_number
from ledgerline.sources.workspace import Workspace

SOURCE_WEIGHTS = (3, 1, 2)
SHARE_OF_ALL = 1.5
MOST_EPOCHS = 2
LEAST_QUALITY = 0.05

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[0xC0:] = True  # the first byte of a code point beyond ASCII

_SIZE, _QUALITY = "mix_size", "mix_quality"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "text"):
            data, bounds = text_buffers(some.column("text"))
            sizes = words_of(data, bounds).counts
            sums = [np.concatenate([[0], np.cumsum(f)]) for f in (_LETTER[data], LEADING[data] & ~SEPARATOR[data])]
            letters, characters = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
            quality = np.maximum((letters / np.maximum(characters, 1)) ** 2, LEAST_QUALITY)
            columns = [some.column(i) for i in range(some.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes.astype(np.int64)), pa.array(quality)],
                names=[*some.schema.names, _SIZE, _QUALITY],
            )


def _sized(docs: DataFrame) -> DataFrame:
    """Rows of ``row``, ``text``, ``source``, ``doc_id`` with their size and quality weight."""
    bound_batches(docs.sparkSession)
    schema = StructType(list(docs.schema.fields)).add(_SIZE, "long").add(_QUALITY, "double")
    return docs.mapInArrow(_measured, schema)


def targets(sizes: DataFrame, workspace: Workspace) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row per source.

    The weights go round by the order of the sources, NULL last. Sharing the excess again
    and again ends where every target is the lesser of cap and weight times one factor;
    each round finds the factor from one aggregate over the sources.
    """
    ordered = sizes.withColumn("no_name", F.isnull("source"))
    numbered = global_row_number(ordered, ["no_name", "source"], workspace, "sources")
    weights = F.array(*[F.lit(float(w)) for w in SOURCE_WEIGHTS])
    turn = (F.pmod(F.col("row_number") - 1, F.lit(len(SOURCE_WEIGHTS))) + 1).cast("int")
    weighed = workspace.table(
        "weighed_sources",
        lambda: numbered.select("source", "source_size", F.element_at(weights, turn).alias("weight")),
    )
    cap = MOST_EPOCHS * F.col("source_size")
    factor, wanted = 0.0, None
    while True:
        capped = (cap <= F.lit(factor) * F.col("weight")) if wanted is not None else F.lit(False)
        row = weighed.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(capped, cap)).alias("capped"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).first()
        wanted = SHARE_OF_ALL * (row.words or 0)
        # Without an open source all are capped; otherwise the open ones share the rest.
        now = (wanted - (row.capped or 0)) / row.weight if row.weight else factor
        if now <= factor:
            break
        factor = now
    return weighed.select(
        "source", "source_size", F.least(cap.cast("double"), F.lit(factor) * F.col("weight")).alias("target")
    )


def _key() -> Column:
    """An exponential draw divided by the quality weight; a function of the document."""
    hashed = F.xxhash64(F.lit("mix"), "doc_id", F.xxhash64("text"))
    uniform = (F.shiftrightunsigned(hashed, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.col(_QUALITY)


def mix(docs: DataFrame, workspace: Workspace, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` words.

    ``docs`` has ``doc_id``, ``text`` and ``source``; ``keep`` names columns of ``docs`` that
    are returned in the struct ``row``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    sized = _sized(docs.select(row.alias("row"), "doc_id", "text", "source"))
    order = ["source", "key", "doc_id"]
    drawn = sized.select("row", "doc_id", "source", F.col(_SIZE).alias("size"), _key().alias("key"))
    # Writing settles which partition a row is in, also for tasks that run again.
    ranged = workspace.table(
        "drawn",
        lambda: drawn.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()),
    )
    pieces = ranged.groupBy("range_no", "source").agg(F.sum("size").alias("words"))
    sizes = pieces.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, workspace)
    earlier = Window.partitionBy("source").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "range_no",
        F.col("source").alias("piece_source"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"),
    ).join(plan, F.col("piece_source").eqNullSafe(F.col("source")))
    starts = starts.select(
        F.col("range_no").alias("piece_no"), "piece_source", "before", "source_size", "target"
    )
    inside = (
        Window.partitionBy("range_no", "source")
        .orderBy("key", "doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same_piece = (F.col("range_no") == F.col("piece_no")) & F.col("source").eqNullSafe(F.col("piece_source"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    selected = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return placed.join(starts, same_piece).select(
        "row",
        "doc_id",
        F.col("size").cast("long").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (epochs * F.col("size") + selected).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """``doc_id`` and how many of its words the mix takes, for every document."""
    return mix(docs, workspace).drop("row")


def mixed(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """The documents of the mix, as often as it takes them, with their own columns.

    Only whole documents are kept: the one that a budget cuts counts if half of it is taken.
    """
    drawn = mix(docs, workspace, tuple(docs.columns))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)
    copies = drawn.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("one"))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
