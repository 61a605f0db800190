"""Document fingerprints by one-permutation MinHash, and the likeness they estimate.

The shingles of a text (five words, A-Z folded) are hashed once. The top bits of a hash
choose one of ``BINS`` bins, and every bin keeps its least hash. An empty bin borrows
the value of a full one, which a fixed sequence of hashes of its number picks (optimal
densification): equal for all texts, so that borrowed bins agree as often as full ones.
Stored are the low ``BITS`` bits of each bin. Two unlike bins agree in them by chance,
once in 2**BITS, which the estimate takes out.

Defined results: a NULL text is empty; a text of fewer than five words is one shingle; a
text without words has an empty fingerprint, which is like (1.0) another empty one and
unlike (0.0) all others. Repeated rows and other columns are kept apart and ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.text import bound_batches, mix, shingle_hashes, slices, text_buffers, words_of

SHINGLE_WORDS = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4

_EMPTY = np.uint64((1 << 64) - 1)


@cache
def _borrowing(rounds: int = 64) -> np.ndarray:
    """For each round, the bin that every bin looks into next."""
    numbers = np.arange(BINS, dtype=np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    return np.array(
        [
            mix((numbers + np.uint64(1)) * step + np.uint64((r + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
            >> np.uint64(64 - BIN_BITS)
            for r in range(rounds)
        ],
        dtype=np.int64,
    )


def densified(least: np.ndarray) -> np.ndarray:
    """Rows of bins with every empty bin filled; rows without any full bin stay empty."""
    out = least.copy()
    rows, bins = np.nonzero((least == _EMPTY) & (least != _EMPTY).any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        if attempt < 64:
            source = _borrowing()[attempt][bins]
        else:  # after that, the next bins in turn, which ends for certain
            source = (bins + attempt - 63) % BINS
        values = least[rows, source]
        full = values != _EMPTY
        out[rows[full], bins[full]] = values[full]
        rows, bins = rows[~full], bins[~full]
        attempt += 1
    return out


def signatures(column: pa.Array) -> np.ndarray:
    """Low bits of the filled bins of each text, one row per text; 255 where a text has no words."""
    data, bounds = text_buffers(column)
    words = words_of(data, bounds)
    least = np.full((len(bounds) - 1, BINS), _EMPTY, np.uint64)
    for row, shingles in enumerate(shingle_hashes(words, SHINGLE_WORDS, fold_case=True)):
        if len(shingles):
            bins = (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)
            np.minimum.at(least[row], bins, shingles)
    filled = densified(least)
    low = (filled & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[(filled == _EMPTY).all(axis=1)] = 255
    return low


def packed(low: np.ndarray) -> list[str]:
    """Fingerprints as text: two bins a byte, in base 64."""
    pairs = (low[:, 0::2] << np.uint8(4)) | (low[:, 1::2] & np.uint8(15))
    return [
        "" if row[0] == 255 else base64.b64encode(pair.tobytes()).decode()
        for row, pair in zip(low, pairs, strict=True)
    ]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the texts behind rows of low bits."""
    chance = 1.0 / (1 << BITS)
    corrected = ((a == b).mean(axis=1) - chance) / (1 - chance)
    empty = (a[:, 0] == 255) | (b[:, 0] == 255)
    both = (a[:, 0] == 255) & (b[:, 0] == 255)
    return np.where(both, 1.0, np.where(empty, 0.0, np.clip(corrected, 0.0, 1.0)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "text"):
            prints = packed(signatures(some.column("text")))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(prints, pa.string())],
                names=[batch.schema[0].name, "fingerprint"],
            )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` of every document."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], docs[text].alias("text")).mapInArrow(
        _fingerprints, f"`{key}` {kind}, fingerprint string"
    )


# --- each document, its edited text and the next document ---------------------


def _in_following_order(docs: DataFrame) -> DataFrame:
    """Range partitions by falling ``doc_id``, NULL last; equal ids by their texts' hashes.

    The number of partitions is given, so that it is the same wherever the shuffle is read.
    """
    spark = docs.sparkSession
    order = [F.desc_nulls_last("doc_id"), F.asc("text_hash")]
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return hashed.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _rows(
    ids: list, texts: list[str], following: list[str], low: np.ndarray, low_next: np.ndarray
) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    low_changed = signatures(pa.array(changed, pa.large_string()))
    columns = [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
        packed(low),
        packed(low_changed),
        likeness(low, low_changed),
        likeness(low, low_next),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _COMPARED, strict=True)], schema=_COMPARED
    )


def _inside_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row with the row after it; the last of the partition is left out."""
    ids: list = []
    texts: list[str] = []
    for batch in batches:
        for some in slices(batch, "text", 2 << 20):
            ids += some.column("doc_id").to_pylist()
            texts += [t or "" for t in some.column("text").to_pylist()]
            if len(texts) > 1:
                low = signatures(pa.array(texts, pa.large_string()))
                yield _rows(ids[:-1], texts[:-1], texts[1:], low[:-1], low[1:])
                ids, texts = ids[-1:], texts[-1:]


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares rows with the text that each holds as its next one."""
    for batch in batches:
        for some in slices(batch, "text"):
            texts, following = (
                [t or "" for t in some.column(c).to_pylist()] for c in ("text", "next_text")
            )
            low, low_next = (signatures(pa.array(t, pa.large_string())) for t in (texts, following))
            yield _rows(some.column("doc_id").to_pylist(), texts, following, low, low_next)


_COMPARED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_COMPARED_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and what they are like.

    The edited text has the last third of its code points replaced by the beginning of the
    next document by falling ``doc_id`` (NULL last, equal ids by text), the first after the
    last. Texts are shuffled once, into ranges; both readers share that shuffle. All rows
    but one per range find their next one in their task. For the last ones, a table of the
    first and last document of each range, two rows per range, gives the next document.
    """
    bound_batches(docs.sparkSession)
    ordered = _in_following_order(docs.select(F.col("doc_id").cast("long"), "text"))
    inside = ordered.select("doc_id", "text").mapInArrow(_inside_ranges, _COMPARED_DDL)

    # Rises as the order above goes on: the complement of an id falls as the id rises.
    falling = F.struct(
        F.isnull("doc_id").alias("last"), F.bitwise_not("doc_id").alias("place"), "text_hash", "text", "doc_id"
    )
    ends = (
        ordered.groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(falling).alias("first"), F.max(falling).alias("last"))
        .select("part", "first.text", F.col("last").alias("last"))
    )
    in_order = Window.orderBy("part")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = ends.select(
        F.col("last.doc_id").alias("doc_id"),
        F.col("last.text").alias("text"),
        F.when(F.lead("part").over(in_order).isNull(), F.first("text").over(whole))
        .otherwise(F.lead("text").over(in_order))
        .alias("next_text"),
    )
    return inside.unionByName(last.mapInArrow(_at_ends, _COMPARED_DDL))
