"""Token counts of the sections of documents, from one encoding of each whole document.

Encoding sections for themselves would give other tokens than the document has, so the
document is encoded once. Every token covers a span of its characters; sections are
spans, too, and an interval join attributes tokens to sections. A token that crosses a
boundary goes to the section that holds most of its bytes, to the earlier one if two
hold equally many. So the counts of a document's sections add up to its tokens.

Sections are lines, by default: a line break belongs to the line that it ends, so that
sections cover the text. ``sections`` takes any other spans, by first character.

Defined results: a NULL or empty text has one empty section with no tokens; repeated rows
give repeated sections; an empty table gives none; other columns are not read. A text of
any length is handled alone, in memory of some ten times its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StringType

from ledgerline.llm.text import bound_batches, slices
from ledgerline.llm.tokens import encoder, tokenizer_path

ENCODED_BYTES = 1 << 18
LINE_BREAK = 0x0A

Sections = Callable[[np.ndarray], np.ndarray]


def lines(data: np.ndarray) -> np.ndarray:
    """Byte positions where the lines of a text begin."""
    breaks = np.flatnonzero(data == LINE_BREAK) + 1
    return np.concatenate([[0], breaks[breaks < len(data)]])


def attribute(token_bytes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(tokens, tokens that cross a boundary of it and count for it) of each section.

    ``token_bytes`` are the lengths of a text's tokens in a row, ``starts`` the first
    bytes of its sections, the first of them 0.
    """
    ends = np.append(starts[1:], size)
    last = np.cumsum(token_bytes)
    first = last - token_bytes
    # A token meets the sections from that of its first byte to that of its last one.
    low = np.searchsorted(starts, first, "right") - 1
    high = np.searchsorted(starts, last - 1, "right") - 1
    owner = low.copy()
    crossing = np.flatnonzero(high > low)
    for t in crossing.tolist():
        met = np.arange(low[t], high[t] + 1)
        held = np.minimum(ends[met], last[t]) - np.maximum(starts[met], first[t])
        owner[t] = met[np.argmax(held)]
    tokens = np.bincount(owner, minlength=len(starts))
    shared = np.bincount(owner[crossing], minlength=len(starts))
    return tokens, shared


def _counted(
    batches: Iterator[pa.RecordBatch], path: str, sections: Sections
) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        for some in slices(batch, "text", ENCODED_BYTES):
            texts = [t or "" for t in some.column("text").to_pylist()]
            found = []
            for text, ids in zip(texts, encode.encode(texts), strict=True):
                data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                starts = sections(data)
                tokens, shared = attribute(encode.id_bytes[ids], starts, len(data))
                # Characters before a byte are the leading bytes before it.
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                bounds = chars[np.append(starts, len(data))]
                found.append((bounds[:-1], bounds[1:], tokens, shared, len(ids)))
            sizes = [len(f[0]) for f in found]
            row = np.repeat(np.arange(len(found)), sizes)
            columns = [some.column(0).take(pa.array(row))]
            columns.append(np.concatenate([np.arange(n) for n in sizes]))
            columns += [np.concatenate([f[i] for f in found]) for i in range(4)]
            columns.append(np.repeat([f[4] for f in found], sizes))
            names = ["section", "start_char", "end_char", "tokens", "crossing_tokens", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [columns[0]] + [pa.array(c, pa.int64()) for c in columns[1:]],
                names=[batch.schema[0].name, *names],
            )


def count_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sections: Sections = lines,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per section of each document: its characters, its tokens, those of the document.

    ``crossing_tokens`` are those of ``tokens`` that also cover characters of another section.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    if not isinstance(kind, (IntegerType, LongType, StringType)):
        raise TypeError(f"{key} is {kind.simpleString()}; int, bigint or string is needed")
    run = partial(_counted, path=tokenizer or tokenizer_path(), sections=sections)
    return docs.select(docs[key], docs[text].alias("text")).mapInArrow(
        run,
        f"`{key}` {kind.simpleString()}, section long, start_char long, end_char long, "
        "tokens long, crossing_tokens long, doc_tokens long",
    )
