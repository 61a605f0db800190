"""Hard negatives: rows of another label that are like an anchor, but less than its positives.

The positives of an anchor are the rows of its label with the largest inner products; for each
of them, the negatives are the rows of other labels with the largest products within a window
given in percent of the positive's. Both are searches for the largest products in a window.

All rows are dealt to cells: the upper level of a cover tree, whose centres are spread over a
sample of ``SAMPLE_ROWS`` rows (those with the least hashes of their ids). Cells are at most
``MOST_CELLS``, so their centres and radii go to every task; a cell with more than
``BLOCK_ROWS`` rows, such as one around a vector that a third of all rows repeat, is split by
ids into blocks. Each block builds a cover tree over its own rows. An anchor goes to the
cells whose bounds meet its windows; the sample, whose rows are rows like all others, already
gives each window a number of verified rows, hence a lower end. The results of blocks are cut
to the best of each window by Spark. Everything is exact: sample, cells and bounds only decide
what need not be looked at.

Defined results: a row with a NULL id, label or vector, or with a NULL or non-finite
component, takes no part. Components become whole numbers by ``floor(scale * x)``; shorter
vectors count as zero beyond their end; if products could exceed 64 bits, an error says so.
Repeated rows (same id, label and vector) count once; a row with the anchor's id is never its
positive or negative; different rows of one id count each for itself. Ties go to smaller ids.
An anchor without positives, or a positive without a row in its window, gives no row; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import cover_tree
from ledgerline.llm.cover_tree import CoverTree, exact_type, spread_centers
from ledgerline.sources.workspace import Workspace

SAMPLE_ROWS = 4096
MOST_CELLS = 1024
BLOCK_ROWS = 8192
# Anchors that meet a block in one task; more of them come in parts.
PART_ANCHORS = 16_384
MOST_PARTITIONS = 20_000
_ROUTED_ROWS = 256

_FOUND_DDL = "anchor long, anchor_id long, w long, positive_id long, positive_score long, id long, score long"
_FOUND = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND_DDL.split(", ")])
_ROUTED_DDL = (
    "anchor long, anchor_id long, label string, vector binary, positive_ids array<long>, "
    "positive_scores array<long>, lows array<double>, highs array<double>, cell int"
)


@dataclass(frozen=True)
class Rule:
    """How many positives, how many negatives for each, and their window in percent."""

    positives: int = 5
    negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90


@dataclass
class Space:
    """What all tasks know: the form of vectors, a bounded sample of rows, the cells."""

    dimensions: int
    stored: np.dtype
    exact: np.dtype
    norm: float
    sample_ids: np.ndarray
    sample_labels: np.ndarray
    sample: np.ndarray
    centers: np.ndarray
    radii: np.ndarray

    def vectors(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        whole = b"".join(column.to_pylist())
        return np.frombuffer(whole, self.stored).reshape(-1, self.dimensions)


def whole_numbers(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of all components; NULL if one of them is NULL or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.when(finite, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _packed(batches: Iterator[pa.RecordBatch], dimensions: int, stored: str) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, filled up with zeros."""
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        flat = lists.flatten().to_numpy()
        matrix = np.zeros((len(sizes), dimensions), stored)
        matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        vectors = pa.array([v.tobytes() for v in matrix], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], names=["id", "label", "vector"])


def _placed(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """The cell of each row: that of the nearest centre, and the distance from it."""
    centers = cover_tree.augmented(space.centers, space.norm)
    for batch in batches:
        cells, reached = [], []
        for at in range(0, batch.num_rows, 4 * _ROUTED_ROWS):
            part = batch.column(2).slice(at, 4 * _ROUTED_ROWS)
            points = cover_tree.augmented(space.vectors(part), space.norm)
            cell = np.argmax(points @ centers.T, axis=1)
            cells.append(cell)
            reached.append(cover_tree.distances(points, centers[cell]))
        columns = [pa.array(np.concatenate(cells or [[]]), pa.int32()), pa.array(np.concatenate(reached or [[]]))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["id", "label", "vector", "cell", "distance"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.array(values, np.float64) for values in column.to_pylist()]


def _routed(
    batches: Iterator[pa.RecordBatch], space: Space, count: int, same_label: bool
) -> Iterator[pa.RecordBatch]:
    """A row per anchor and cell that may hold a row for one of its windows.

    Lower ends of windows rise to what the sample verifies; windows that end below it go.
    """
    sample = space.sample.astype(space.exact)
    centers = space.centers.astype(space.exact)
    for whole in batches:
        for at in range(0, whole.num_rows, _ROUTED_ROWS):
            batch = whole.slice(at, _ROUTED_ROWS)
            anchors = space.vectors(batch.column("vector")).astype(space.exact)
            ids = batch.column("anchor_id").to_numpy()
            labels = np.array(batch.column("label").to_pylist(), object)
            lows, highs = _lists(batch.column("lows")), _lists(batch.column("highs"))
            scores = anchors @ sample.T
            alike = labels[:, None] == space.sample_labels[None, :]
            allowed = (alike if same_label else ~alike) & (ids[:, None] != space.sample_ids[None, :])
            norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
            least, largest = cover_tree.bounds(
                (anchors @ centers.T).astype(np.float64), space.radii, norms, space.norm
            )
            rows, cells = [], []
            for i in range(batch.num_rows):
                mine = scores[i][allowed[i]]
                for w in range(len(lows[i])):
                    inside = mine[(mine >= lows[i][w]) & (mine <= highs[i][w])]
                    if len(inside) >= count:
                        lows[i][w] = np.partition(inside, len(inside) - count)[len(inside) - count]
                meets = (largest[i] >= lows[i][:, None]) & (least[i] <= highs[i][:, None])
                found = np.flatnonzero(meets.any(axis=0))
                rows.append(np.full(len(found), i))
                cells.append(found)
            taken = pa.array(np.concatenate(rows))
            raised = pa.array([x.tolist() for x in lows], pa.list_(pa.float64()))
            batch = batch.set_column(batch.schema.get_field_index("lows"), "lows", raised).take(taken)
            yield batch.append_column("cell", pa.array(np.concatenate(cells), pa.int32()))


def _searched(block: pa.Table, anchors: pa.Table, space: Space, count: int, same_label: bool) -> pa.Table:
    """The best rows of a block for each window of its anchors."""
    if not block.num_rows or not anchors.num_rows:
        return _FOUND.empty_table()
    block = block.select(["id", "label", "vector"])
    block = block.group_by(["id", "label", "vector"], use_threads=False).aggregate([])
    ids = block["id"].to_numpy()
    labels, codes = np.unique(np.array(block["label"].to_pylist(), object), return_inverse=True)
    code_of = {label: code for code, label in enumerate(labels.tolist())}
    tree = CoverTree(space.vectors(block["vector"]), space.norm, space.exact)
    queries = space.vectors(anchors["vector"])
    lows, highs = _lists(anchors["lows"]), _lists(anchors["highs"])
    low = np.array([x.min(initial=np.inf) for x in lows])
    high = np.array([x.max(initial=-np.inf) for x in highs])
    anchor_ids = anchors["anchor_id"].to_pylist()
    anchor_codes = [code_of.get(label, -1) for label in anchors["label"].to_pylist()]
    found = []
    for at in range(0, len(queries), _ROUTED_ROWS):
        here = slice(at, at + _ROUTED_ROWS)
        leaves = tree.leaves(queries[here], low[here], high[here])
        for q, seen in enumerate(leaves, at):
            allowed = (codes == anchor_codes[q]) == same_label
            allowed[ids == anchor_ids[q]] = False
            windows = [
                cover_tree.Window(count, a, b, allowed, ids) for a, b in zip(lows[q], highs[q], strict=True)
            ]
            if windows and allowed.any():
                tree.verified(queries[q], seen, windows)
            found += [(q, w, window) for w, window in enumerate(windows) if len(window.rows)]
    sizes = [len(window.rows) for _, _, window in found]
    row = np.repeat(np.array([q for q, _, _ in found], np.int64), sizes)
    tags = []
    for name in ("positive_ids", "positive_scores"):
        values = anchors[name].to_pylist()
        each = [values[q][w] if values[q] else None for q, w, _ in found]
        tags.append(pa.array(each, pa.int64()).take(pa.array(np.repeat(np.arange(len(found)), sizes))))
    best = np.concatenate([window.rows for _, _, window in found] or [np.zeros(0, np.int64)])
    scores = np.concatenate([window.scores for _, _, window in found] or [np.zeros(0, np.int64)])
    window_no = np.repeat(np.array([w for _, w, _ in found], np.int64), sizes)
    taken = anchors.select(["anchor", "anchor_id"]).take(pa.array(row))
    columns = [taken["anchor"], taken["anchor_id"], pa.array(window_no), *tags]
    return pa.table([*columns, pa.array(ids[best]), pa.array(scores)], schema=_FOUND)


class HardNegatives:
    """Hard negatives among the rows of ``table`` for those that ``is_anchor`` says."""

    def __init__(
        self,
        table: DataFrame,
        workspace: Workspace,
        is_anchor: Column,
        rule: Rule | None = None,
        key: str = "vec_id",
        label: str = "label",
        vector: str = "embedding",
        scale: float = 256.0,
    ):
        self.workspace = workspace
        self.rule = rule or Rule()
        self.rows = table.select(
            table[key].cast("long").alias("id"),
            table[label].cast("string").alias("label"),
            whole_numbers(table[vector], scale).alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    def _space(self) -> Space | None:
        squares = F.aggregate(
            "vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
        )
        largest = F.greatest(
            F.abs(F.coalesce(F.array_max("vector"), F.lit(0))), F.abs(F.coalesce(F.array_min("vector"), F.lit(0)))
        )
        sizes = self.rows.agg(
            F.count("*").alias("n"), F.max(F.size("vector")).alias("dimensions"),
            F.max(largest).alias("largest"), F.max(squares).alias("square"),
        ).first()
        if not sizes.n:
            return None
        dimensions = max(sizes.dimensions, 1)
        exact = exact_type(dimensions, sizes.largest)
        stored = next(t for t in ("<i2", "<i4", "<i8") if sizes.largest <= np.iinfo(t).max)
        norm = float(np.sqrt(sizes.square) * (1 + 1e-9) + 1.0)
        hashed = self.rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
        # Repeated rows count once here, too.
        some = sorted({(r.id, r.label, tuple(r.vector)) for r in hashed})
        sample = np.zeros((len(some), dimensions), stored)
        for i, (_, _, values) in enumerate(some):
            sample[i, : len(values)] = values
        cells = int(min(MOST_CELLS, -(-sizes.n // BLOCK_ROWS)))
        centers, _ = spread_centers(cover_tree.augmented(sample, norm), 0, cells, 0.0)
        return Space(
            dimensions, np.dtype(stored), exact, norm, np.array([s[0] for s in some]),
            np.array([s[1] for s in some], object), sample, sample[centers], np.zeros(len(centers)),
        )

    def _place(self, space: Space) -> DataFrame:
        """All rows with their cells, written; fills in the radii of the cells."""

        def build() -> DataFrame:
            packed = self.rows.select("id", "label", "vector").mapInArrow(
                partial(_packed, dimensions=space.dimensions, stored=space.stored.str),
                "id long, label string, vector binary",
            )
            return packed.mapInArrow(
                partial(_placed, space=space), "id long, label string, vector binary, cell int, distance double"
            )

        placed = self.workspace.table("placed", build)
        cells = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
        blocks = self.workspace.table(
            "cells", lambda: cells.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
        )
        # At most MOST_CELLS rows.
        for row in blocks.collect():
            space.radii[row.cell] = row.radius
        return placed

    def _anchors(self, space: Space) -> DataFrame:
        def build() -> DataFrame:
            chosen = self.rows.where("is_anchor").select("id", "label", "vector").distinct()
            packed = chosen.mapInArrow(
                partial(_packed, dimensions=space.dimensions, stored=space.stored.str),
                "id long, label string, vector binary",
            )
            return packed.select(
                F.monotonically_increasing_id().alias("anchor"), F.col("id").alias("anchor_id"), "label", "vector"
            )

        return self.workspace.table("anchors", build)

    def _search(
        self, space: Space, placed: DataFrame, windows: DataFrame, count: int, same_label: bool
    ) -> DataFrame:
        """The ``count`` best rows for each window."""
        cells = self.workspace.table("cells", lambda: placed).select("cell", "blocks")
        blocks = cells.agg(F.sum("blocks")).first()[0]
        parts = max(1, -(-self._anchors(space).count() // PART_ANCHORS))
        width = min(MOST_PARTITIONS, 4 * blocks * parts)
        routed = windows.mapInArrow(
            partial(_routed, space=space, count=count, same_label=same_label), _ROUTED_DDL
        )
        keys = ("cell", "block", "part")
        asked = (
            routed.join(cells, "cell")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
            .drop("blocks").repartition(width, *keys)
        )
        dealt = (
            placed.join(cells, "cell")
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            .select("id", "label", "vector", *keys).repartition(width, *keys)
        )
        run = partial(_searched, space=space, count=count, same_label=same_label)

        def search(block: pa.Table, anchors: pa.Table) -> pa.Table:
            return run(block, anchors)

        found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, _FOUND_DDL)
        of_window = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(of_window)).where(F.col("rank") <= count)

    def positives(self) -> DataFrame:
        """``anchor``, ``anchor_id``, ``rank``, ``id`` and ``score`` of the positives of each anchor."""
        return self._found()[0]

    def _found(self) -> tuple[DataFrame, Space | None, DataFrame | None]:
        space = self._space()
        if space is None:
            empty = self.rows.sparkSession.createDataFrame([], f"{_FOUND_DDL}, rank int")
            return empty, None, None
        placed = self._place(space)
        whole = self._anchors(space).select(
            "*", F.expr("CAST(NULL AS array<long>)").alias("positive_ids"),
            F.expr("CAST(NULL AS array<long>)").alias("positive_scores"),
            F.array(F.lit(float("-inf"))).alias("lows"), F.array(F.lit(float("inf"))).alias("highs"),
        )
        found = self.workspace.table(
            "positives", lambda: self._search(space, placed, whole, self.rule.positives, True)
        )
        return found, space, placed

    def negatives(self) -> DataFrame:
        """One row per anchor, positive and negative, by rank among those of that positive."""
        found, space, placed = self._found()
        names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        if space is None:
            return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                                "positive_score", F.col("score").alias("negative_score"))
        low = F.ceil(F.col("score") * self.rule.low_percent / F.lit(100).cast("decimal(3,0)"))
        high = F.floor(F.col("score") * self.rule.high_percent / F.lit(100).cast("decimal(3,0)"))
        ranged = found.select("anchor", "id", "score", low.cast("double").alias("low"), high.cast("double").alias("high"))
        each = F.sort_array(F.collect_list(F.struct("id", "score", "low", "high")))
        # At most ``positives`` rows of an anchor.
        windows = ranged.where("low <= high").groupBy("anchor").agg(each.alias("w")).select(
            "anchor", F.col("w.id").alias("positive_ids"), F.col("w.score").alias("positive_scores"),
            F.col("w.low").alias("lows"), F.col("w.high").alias("highs"),
        )
        asked = self._anchors(space).join(windows, "anchor").select(
            "anchor", "anchor_id", "label", "vector", "positive_ids", "positive_scores", "lows", "highs"
        )
        best = self._search(space, placed, asked, self.rule.negatives, False)
        return best.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).select(*names)
