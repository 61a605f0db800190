"""Packing of documents into windows of equal capacity by multiway differencing.

Every document is encoded whole, an end id follows it, and the ids are cut into pieces.
A document's full windows stand alone. What is left of it is cut into short pieces, and
the pieces of many documents share windows: Karmarkar and Karp's differencing starts
with one partial partition per piece and merges the two whose sums differ most, the
largest sum of one with the smallest of the other, until one partition is left. Its
windows are near equal. The number of windows is the least that could hold the pieces
and rises by one as long as a window exceeds the capacity.

The work is one pass without a shuffle: each task packs its own documents, in rounds of
``ROUND_PIECES`` pieces, so its memory does not grow with its input.

Defined results: a NULL or empty text is the end id alone; repeated rows are packed as
often as they occur; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StringType

from ledgerline.llm.text import bound_batches, slices
from ledgerline.llm.tokens import encoder, tokenizer_path

CAPACITY = 1024
END_ID = 0
# Left-over ids of a document are cut to this length: more pieces, more even windows.
PIECE_IDS = 256
ROUND_PIECES = 1024
ENCODED_BYTES = 1 << 18


class _Partial:
    """A partial partition: its non-empty windows by falling sum, with the ends of their piece lists."""

    __slots__ = ("sums", "heads", "tails")

    def __init__(self, sums: np.ndarray, heads: np.ndarray, tails: np.ndarray):
        order = np.argsort(-sums, kind="stable")
        self.sums, self.heads, self.tails = sums[order], heads[order], tails[order]

    def spread(self, windows: int) -> int:
        least = self.sums[-1] if len(self.sums) == windows else 0
        return int(self.sums[0] - least)


def _merged(a: _Partial, b: _Partial, windows: int, after: np.ndarray) -> _Partial:
    """Joins the largest windows of ``a`` with the smallest of ``b``; empty ones count as smallest."""
    shared = max(0, len(a.sums) + len(b.sums) - windows)
    kept = len(a.sums) - shared
    low, rest = slice(kept, None), slice(len(b.sums) - shared, None)
    # Both lists fall, so the last windows of one meet those of the other in reverse.
    other = slice(None, None, -1)
    after[a.tails[low]] = b.heads[rest][other]
    free = slice(0, len(b.sums) - shared)
    return _Partial(
        np.concatenate([a.sums[:kept], a.sums[low] + b.sums[rest][other], b.sums[free]]),
        np.concatenate([a.heads, b.heads[free]]),
        np.concatenate([a.tails[:kept], b.tails[rest][other], b.tails[free]]),
    )


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, for ``windows`` windows of near-equal sums."""
    n = len(sizes)
    after = np.full(n, -1, np.int64)
    parts = {
        i: _Partial(sizes[i : i + 1].astype(np.int64), np.array([i]), np.array([i]))
        for i in range(n)
    }
    heap = [(-p.spread(windows), i) for i, p in parts.items()]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        a, b = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        parts[fresh] = merged = _merged(a, b, windows, after)
        heapq.heappush(heap, (-merged.spread(windows), fresh))
        fresh += 1
    window = np.zeros(n, np.int64)
    following = after.tolist()
    for number, head in enumerate(parts[heap[0][1]].heads.tolist()):
        while head >= 0:
            window[head] = number
            head = following[head]
    return window


def windows_for(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; as few windows as differencing fills within ``capacity``."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, windows)
        if np.bincount(window, sizes).max() <= capacity:
            return window
        windows += 1


def cut(length: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows first, then pieces of ``piece`` ids."""
    full = length // capacity * capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [
        (s, min(piece, length - s)) for s in range(full, length, piece)
    ]


class _Packer:
    """Packs the documents of one task."""

    def __init__(self, task: int, capacity: int, piece: int, with_ids: bool, schema: pa.Schema):
        self.capacity, self.piece, self.with_ids, self.schema = capacity, piece, with_ids, schema
        self.next_sequence = task << 33
        self.waiting: list[tuple] = []
        self.done: list[tuple] = []

    def add(self, key: object, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        for start, length in cut(len(ids), self.capacity, self.piece):
            content = raw[4 * start : 4 * (start + length)]
            row = (key, start, length, zlib.crc32(content), len(ids))
            row += (content,) if self.with_ids else ()
            if length == self.capacity:
                self.done.append((*row, self.next_sequence, 0))
                self.next_sequence += 1
            else:
                self.waiting.append(row)
        if len(self.waiting) >= ROUND_PIECES:
            self.share()

    def share(self) -> None:
        """Packs the waiting pieces."""
        if not self.waiting:
            return
        sizes = np.array([row[2] for row in self.waiting], np.int64)
        window = windows_for(sizes, self.capacity)
        filled = [0] * (int(window.max()) + 1)
        for row, number in zip(self.waiting, window.tolist(), strict=True):
            self.done.append((*row, self.next_sequence + number, filled[number]))
            filled[number] += row[2]
        self.next_sequence += len(filled)
        self.waiting = []

    def finished(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [[] for _ in self.schema]
        self.done = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)],
            schema=self.schema,
        )


def _packed(
    batches: Iterator[pa.RecordBatch],
    path: str,
    capacity: int,
    piece: int,
    end_id: int,
    with_ids: bool,
) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    end = np.array([end_id], np.uint32)
    packer = None
    for batch in batches:
        if packer is None:
            names = ["start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
            schema = pa.schema(
                [(batch.schema[0].name, batch.schema[0].type)]
                + [(n, pa.binary() if n == "ids" else pa.int64()) for n in names]
                + [("sequence_id", pa.int64()), ("offset", pa.int64())]
            )
            packer = _Packer(TaskContext.get().partitionId(), capacity, piece, with_ids, schema)
        for some in slices(batch, "text", ENCODED_BYTES):
            texts = [t or "" for t in some.column("text").to_pylist()]
            for key, ids in zip(some.column(0).to_pylist(), encode(texts), strict=True):
                packer.add(key, np.concatenate([ids, end]))
            yield packer.finished()
    if packer is not None:
        packer.share()
        yield packer.finished()


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE_IDS,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of each document of ``docs``.

    ``start`` counts the ids of the document before the piece, ``offset`` those of its
    sequence; ``with_ids`` adds the ids themselves as little-endian unsigned 32-bit numbers.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    if not isinstance(kind, (IntegerType, LongType, StringType)):
        raise TypeError(f"{key} is {kind.simpleString()}; int, bigint or string is needed")
    run = partial(
        _packed, path=tokenizer or tokenizer_path(), capacity=capacity, piece=piece,
        end_id=end_id, with_ids=with_ids,
    )
    content = "ids binary, " if with_ids else ""
    return docs.select(docs[key], docs[text].alias("text")).mapInArrow(
        run,
        f"`{key}` {kind.simpleString()}, start long, length long, ids_crc32 long, "
        f"doc_tokens long, {content}sequence_id long, offset long",
    )
