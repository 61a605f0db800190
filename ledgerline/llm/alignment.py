"""Alignment of two tokenizers over the same texts, by the bytes that their tokens cover.

A is a byte-level BPE over a blank and the text, B a SentencePiece BPE over the text, before
which it puts that blank itself. Both cut the same bytes. Where tokens of both end together
they cut the text into groups; a token of A and one of B are linked if their bytes overlap.

A task works on Arrow arrays: ids are lists per document, flattened with the numbers of
their documents; cumulative sums of token lengths within documents give the ends of tokens.
A full outer hash join of the ends of A and of B, keyed by document and end, has one row per
different end. Each such row is one link, for between two neighbouring ends lies exactly one
token of either side, and two tokens that overlap share exactly one such stretch; its tokens
are the next ones that end there or later. Rows that both sides have end a group.

Links are counted per pair of ids and document, then per pair over many documents, both by
``Table.group_by``; Spark adds up the partial counts. The aligned documents are written once,
so texts are encoded once. Counts and documents meet in a merge join at every size, for the
number of different pairs has no useful bound; documents come with one row per different pair,
and Spark splits the partitions of pairs that most documents hold.

Defined results: a text that is NULL or empty, or that either tokenizer does not give back
byte for byte (one with the character U+2581, which B takes for a blank), has no tokens; so
have all rows in an empty table. Repeated rows, and rows with equal or NULL ids, count each
for itself. Other columns are not read. A text of any length is handled alone, in memory of
some forty times its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.piece_tokens import DEFAULT_PIECES, piece_encoder
from ledgerline.llm.text import bound_batches, slices, text_buffers
from ledgerline.llm.tokens import encoder, tokenizer_path
from ledgerline.sources.workspace import Workspace

# Text aligned at once; a longer text is alone.
ALIGNED_BYTES = 1 << 19
# Different pairs that a task adds up before it hands them on.
HELD_PAIRS = 200_000

_ROW_BITS = 40
_END_BITS = 32
_ALIGNED = pa.schema(
    [("row_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64())]
    + [("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))]
)
_ALIGNED_DDL = (
    "row_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, links array<long>"
)
_GROUPS_DDL = "group_no long, start_byte long, end_byte long, a_ids array<int>, b_ids array<int>"


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves; the other bytes follow from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    values = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return values | {chr(0x100 + n): b for n, b in enumerate(others)}


@dataclass(frozen=True)
class _Side:
    """What the ids of one tokenizer stand for, and their numbers as text before a separator."""

    spelled: pa.Array
    lengths: pa.Array

    @classmethod
    def of(cls, spelled: list[bytes]) -> _Side:
        return cls(pa.array(spelled, pa.binary()), pa.array([len(s) for s in spelled], pa.int64()))


@cache
def _sides(path_a: str, path_b: str) -> tuple[_Side, _Side]:
    tokenizer = encoder(path_a).tokenizer
    values = _byte_values()
    spelled: list[bytes] = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        spelled[i] = bytes(values[c] for c in token)
    return _Side.of(spelled), _Side.of(piece_encoder(path_b).piece_bytes)


@cache
def _numbers(size: int, separators: str) -> pa.Array:
    """The numbers below ``size`` followed by each separator in turn, those of one after another."""
    return pa.array([f"{i}{s}" for s in (*separators, "") for i in range(size)])


@dataclass
class Tokens:
    """The tokens of one tokenizer over some documents."""

    ids: pa.ListArray
    flat: pa.Array
    doc: pa.Array
    end: pa.Array  # within the document
    key: pa.Array  # document and end

    @classmethod
    def of(cls, ids: pa.ListArray, side: _Side) -> Tokens:
        flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
        reached = pc.cumulative_sum(side.lengths.take(flat))
        # What the documents before reach; the first of them begins at 0.
        firsts = pa.concat_arrays([pa.array([0], pa.int64()), reached]).take(ids.offsets[:-1])
        end = pc.subtract(reached, firsts.take(doc))
        return cls(ids, flat, doc, end, pc.add(pc.shift_left(doc, _END_BITS), end))


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _spelled(ids: pa.ListArray, side: _Side) -> pa.Array:
    """The bytes that each document's tokens join to."""
    parts = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), side.spelled.take(ids.values))
    return pc.binary_join(parts, b"")


def tokens_of(texts: pa.Array, path_a: str, path_b: str) -> tuple[np.ndarray, Tokens, Tokens]:
    """(numbers of the texts that have tokens, their tokens of A, those of B)."""
    side_a, side_b = _sides(path_a, path_b)
    filled = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
    spaced = pc.binary_join_element_wise(" ", texts.take(pa.array(filled)), "")
    found = encoder(path_a).encode(spaced.to_pylist())
    counts = np.array([len(f) for f in found], np.int64)
    ids_a = _lists(np.concatenate(found) if found else np.zeros(0, np.uint32), counts)
    ids_b = _lists(*piece_encoder(path_b).encode_spaced(*text_buffers(spaced)))
    whole = spaced.cast(pa.binary())
    same = pc.and_(pc.equal(_spelled(ids_a, side_a), whole), pc.equal(_spelled(ids_b, side_b), whole))
    kept = filled[same.to_numpy(zero_copy_only=False).astype(bool)]
    return kept, Tokens.of(_only(ids_a, same), side_a), Tokens.of(_only(ids_b, same), side_b)


def _only(ids: pa.ListArray, keep: pa.Array) -> pa.ListArray:
    """The lists to keep, with offsets from 0 on."""
    return pa.concat_arrays([ids.filter(keep)])


def links_of(a: Tokens, b: Tokens) -> pa.Table:
    """One row per link, in text order: ``doc``, ids ``a`` and ``b``, whether a group ends here."""
    left = pa.table({"key": a.key, "a": a.flat, "of_a": a.doc})
    right = pa.table({"key": b.key, "b": b.flat, "of_b": b.doc})
    met = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key")
    met = met.combine_chunks()
    both = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"]))
    return pa.table({
        "key": met["key"],
        "doc": pc.coalesce(met["of_a"], met["of_b"]),
        # The last ends of a document are common, so no id is taken from the next document.
        "a": pc.fill_null_backward(met["a"]),
        "b": pc.fill_null_backward(met["b"]),
        "ends_group": both,
    })


def _grouped_counts(table: pa.Table, keys: list[str], aggregates: list) -> pa.Table:
    return table.group_by(keys, use_threads=False).aggregate(aggregates)


def _group_numbers(links: pa.Table, tokens: Tokens) -> np.ndarray:
    """The group of each token, numbered over all documents."""
    ends = links["key"].filter(links["ends_group"]).to_numpy()
    return np.searchsorted(ends, tokens.key.to_numpy())


def written_groups(links: pa.Table, a: Tokens, b: Tokens, sizes: tuple[int, int]) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of each document: ids of A and of B per group, in order."""
    group_a, group_b = _group_numbers(links, a), _group_numbers(links, b)
    n = pc.sum(links["ends_group"]).as_py() or 0
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n))])
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))])
    place_a = np.arange(len(group_a)) + before_b[group_a]
    place_b = np.arange(len(group_b)) + before_a[group_b + 1]
    # Separators follow a token: within a side, behind a side or a group, behind a document.
    mark_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)].astype(np.int64)
    mark_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)].astype(np.int64)
    counts_b = pc.list_value_length(b.ids).to_numpy()
    if len(counts_b):
        mark_b[np.cumsum(counts_b) - 1] = 2
    which = np.empty(len(group_a) + len(group_b), np.int64)
    which[place_a] = a.flat.to_numpy() + sizes[0] * mark_a
    which[place_b] = b.flat.to_numpy() + sizes[1] * mark_b + 3 * sizes[0]
    words = pa.concat_arrays([_numbers(sizes[0], ",|"), _numbers(sizes[1], ",;")])
    counts = counts_b + pc.list_value_length(a.ids).to_numpy()
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, words.take(pa.array(which))), "")


class _PairCounts:
    """Counts of pairs over many documents, handed on when there are many of them."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, counts: pa.Table) -> None:
        some = _grouped_counts(counts, ["pair"], [("links", "sum")])
        self.tables.append(some.rename_columns({"links_sum": "links"}))
        self.rows += some.num_rows

    def merged(self) -> pa.Table:
        whole = _grouped_counts(pa.concat_tables(self.tables), ["pair"], [("links", "sum")])
        self.tables = [whole.rename_columns({"links_sum": "links"})]
        self.rows = whole.num_rows
        return self.tables[0]

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        """One row with all counts, if there are more than ``least`` different ones."""
        if self.rows <= 2 * least or not self.tables or self.merged().num_rows <= least:
            return
        whole = self.tables[0].combine_chunks()
        self.tables, self.rows = [], 0
        columns = [pa.nulls(1, field.type) for field in _ALIGNED][:-2]
        for name in ("pair", "links"):
            values = whole[name].combine_chunks()
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        yield columns


def _aligned(
    batches: Iterator[pa.RecordBatch], path_a: str, path_b: str
) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and rows without a ``row_id`` that hold counts of pairs."""
    side_a, side_b = _sides(path_a, path_b)
    sizes = (len(side_a.lengths), len(side_b.lengths))
    row_id = TaskContext.get().partitionId() << _ROW_BITS
    counts = _PairCounts()
    key = None
    for batch in batches:
        key = batch.schema.field(0)
        for some in slices(batch, "text", ALIGNED_BYTES):
            columns, pairs = _aligned_rows(some, path_a, path_b, sizes, row_id)
            row_id += some.num_rows
            counts.add(pairs)
            yield _batch(key, some.column(0), columns)
            for row in counts.take(HELD_PAIRS):
                yield _batch(key, pa.nulls(1, key.type), row)
    if key is not None:
        for row in counts.take(0):
            yield _batch(key, pa.nulls(1, key.type), row)


def _batch(key: pa.Field, keys: pa.Array, columns: list) -> pa.RecordBatch:
    schema = pa.schema([key, *_ALIGNED])
    return pa.RecordBatch.from_arrays([keys, *columns], schema=schema)


def _aligned_rows(
    some: pa.RecordBatch, path_a: str, path_b: str, sizes: tuple[int, int], row_id: int
) -> tuple[list, pa.Table]:
    n = some.num_rows
    kept, a, b = tokens_of(some.column("text"), path_a, path_b)
    links = links_of(a, b)
    pair = pc.add(pc.multiply(links["a"].cast(pa.int64()), sizes[1]), links["b"].cast(pa.int64()))
    links = links.append_column("pair", pair)
    per_pair = _grouped_counts(links, ["doc", "pair"], [([], "count_all")]).sort_by("doc")
    per_pair = per_pair.rename_columns({"count_all": "links"})
    doc = links["doc"].to_numpy()
    ends = links["ends_group"].to_numpy().astype(bool)
    texts = written_groups(links, a, b, sizes)

    def spread(values: np.ndarray) -> pa.Array:
        whole = np.zeros(n, np.int64)
        whole[kept] = values
        return pa.array(whole)

    digests = [""] * n
    for row, text in zip(kept.tolist(), texts, strict=True):
        digests[row] = hashlib.sha256(text.as_py().encode()).hexdigest()
    offsets = np.zeros(n + 1, np.int32)
    offsets[kept + 1] = np.bincount(per_pair["doc"].to_numpy(), minlength=len(kept))
    offsets = pa.array(np.cumsum(offsets, dtype=np.int32))
    lists = [
        pa.ListArray.from_arrays(offsets, per_pair[name].combine_chunks()) for name in ("pair", "links")
    ]
    columns = [
        pa.array(np.arange(row_id, row_id + n)),
        spread(pc.list_value_length(a.ids).to_numpy()),
        spread(pc.list_value_length(b.ids).to_numpy()),
        spread(np.bincount(doc[ends], minlength=len(kept))),
        spread(np.bincount(doc, minlength=len(kept))),
        pa.array(digests),
        *lists,
    ]
    return columns, per_pair


def _spans(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "text", ALIGNED_BYTES):
            kept, a, b = tokens_of(some.column("text"), path_a, path_b)
            links = links_of(a, b)
            last = links.filter(links["ends_group"])
            doc = last["doc"].to_numpy()
            end = last["key"].to_numpy() - (doc << _END_BITS)
            first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
            start = np.where(first, 0, np.append(0, end[:-1])[: len(end)])
            number = np.arange(len(doc))
            number = number - np.maximum.accumulate(np.where(first, number, 0))
            lists = [
                _lists(t.flat.to_numpy(), np.bincount(_group_numbers(links, t), minlength=len(doc)))
                for t in (a, b)
            ]
            keys = some.column(0).take(pa.array(kept[doc]))
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(c, pa.int64()) for c in (number, start, end)), *lists],
                names=[batch.schema[0].name, "group_no", "start_byte", "end_byte", "a_ids", "b_ids"],
            )


class Alignment:
    """Two tokenizers over the texts of ``docs``; bytes are those of a blank and the text."""

    def __init__(
        self,
        docs: DataFrame,
        workspace: Workspace,
        key: str = "doc_id",
        text: str = "text",
        tokenizer_a: str | None = None,
        tokenizer_b: str | None = None,
    ):
        bound_batches(docs.sparkSession)
        self.key = key
        self.workspace = workspace
        self.paths = (tokenizer_a or tokenizer_path(), tokenizer_b or tokenizer_path(DEFAULT_PIECES))
        self.texts = docs.select(docs[key].alias("id"), docs[text].alias("text"))
        self.kind = docs.schema[key].dataType.simpleString()

    def _mapped(self, run, ddl: str) -> DataFrame:
        function = partial(run, path_a=self.paths[0], path_b=self.paths[1])
        return self.texts.mapInArrow(function, f"id {self.kind}, {ddl}")

    def groups(self) -> DataFrame:
        """One row per group of each document: its bytes, its ids of A and of B."""
        return self._mapped(_spans, _GROUPS_DDL).withColumnRenamed("id", self.key)

    def _written(self) -> DataFrame:
        return self.workspace.table(
            "aligned", lambda: self._mapped(_aligned, _ALIGNED_DDL), {"compression": "zstd"}
        )

    def pair_counts(self) -> DataFrame:
        """``pair`` (id of A times size of B plus id of B), its ``pair_links`` over all documents,
        and whether no other pair of that id of B has more. A window holds the pairs of one
        id of B, at most as many as A has ids."""

        def build() -> DataFrame:
            size = len(_sides(*self.paths)[1].lengths)
            partial_counts = self._written().where(F.col("row_id").isNull())
            rows = partial_counts.select(F.inline(F.arrays_zip("pairs", "links")))
            whole = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("links").alias("pair_links"))
            of_b = Window.partitionBy(F.col("pair") % size)
            return whole.withColumn("best", F.col("pair_links") == F.max("pair_links").over(of_b))

        return self.workspace.table("pair_counts", build)

    def digests(self) -> DataFrame:
        """One row per document: numbers of tokens, groups and links, how many links are of the
        best pair of their id of B, the summed counts of all links, the digest of the groups."""
        rows = self._written().where(F.col("row_id").isNotNull())
        links = rows.select("row_id", F.inline(F.arrays_zip("pairs", "links")))
        counted = links.join(self.pair_counts().hint("merge"), F.col("pairs") == F.col("pair"))
        sums = counted.groupBy("row_id").agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("pair_links")).alias("count_sum"),
        )
        plain = rows.select(
            "row_id", F.col("id").alias(self.key), "n_a", "n_b", "n_groups", "n_links", "groups_sha256"
        )
        return plain.join(sums, "row_id", "left").select(
            self.key, "n_a", "n_b", "n_groups", "n_links",
            F.coalesce("n_best", F.lit(0)).alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
            "groups_sha256",
        )
