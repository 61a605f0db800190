"""Exact Jaccard join of documents' word n-grams by pivots, windows and regions.

The distance of two sets is the size of their symmetric difference. Documents are linked if
their Jaccard similarity reaches ``percent``; for sizes m and n that is a distance of at
most (100 - percent) / (100 + percent) * (m + n). Everything below follows from the triangle
inequality of this distance, restricted to parts of the universe of n-grams where needed,
so that no link is lost:

1. Pivots are single n-grams, in one order for all documents: those frequent in a sample
   last, otherwise by hash. The region of a pivot holds the documents with it. Restricted
   to the pivots before the k-th of a document, two documents that share none of them are
   as far apart as these are many. So a document need be replicated only to the window of
   its first n - ceil(percent * n / 100) + 1 pivots: linked documents meet in one of them.
2. Documents also know their distances to ``CLASSES`` sets that part the universe, as counts
   per class. The distance of two documents is at least the sum of the differences, which
   rules out nearly all pairs of unlike documents without a look at their sets.
3. Regions of up to ``SMALL_REGION`` documents propose their pairs. A larger one first links
   its members with its smallest document as pivot, then with some more, so that a large
   group of copies gives links to its pivots, not all pairs. Only members that are not
   connected by then are compared with each other.
4. Such a region is joined recursively: its members are replicated to the regions of the
   pivots that come after its own, in a window that is longer by one. Two documents that share
   the first k pivots of a chain and are linked share the next one there, by the bound of
   step 1. This goes on while the windows are fewer rows than the region's blocks.
5. Members of a region that is not split further are compared: regions with the same drawn
   member are one region around that document, its blocks meet pairwise, and none but pairs
   within the distance of step 2 leave a block.
6. Proposed pairs are verified on the sets. Components of the links are classes.

Documents themselves make no useful first pivots: nearly all distances between texts are
the largest possible, so every document would lie in every window.

Documents with equal sets are one member from the beginning; tasks send a set they have
sent before no second time. N-grams are 64-bit hashes of words with A-Z folded.

Defined results: NULL, empty and wordless texts have the empty set and are linked with
nothing; a text with fewer words than an n-gram has its whole sequence as one; repeated rows
are answered each; a class of NULL ids alone has the id NULL; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.text import bound_batches, shingle_hashes, slices, text_buffers, words_of
from ledgerline.sources.workspace import Workspace

WORDS = 5
PERCENT = 80
CLASSES = 256
SMALL_REGION = 8
BLOCK = 512
# Rounds in which large regions are linked with one more pivot before they are compared by blocks.
MORE_PIVOTS = 2
# Pivots in the chain of a region that is split no further.
DEEPEST = 4
# Which n-grams are frequent is read off a sample; it only orders the pivots.
SAMPLED_DOCUMENTS = 8192
LEAST_FREQUENT = 3
MOST_FREQUENT = 100_000
# Sets that a task remembers to have sent.
REMEMBERED = 50_000
# N-grams that are compared at once; larger sets are cut into ranges of hashes.
SLICE = 8192


@dataclass(frozen=True)
class Rule:
    """N-gram length and the similarity, in percent, that links."""

    words: int = WORDS
    percent: int = PERCENT

    def window(self, size: int, depth: int = 1) -> int:
        """In how many of its first pivots a set of this size shares ``depth`` with each linked set."""
        return min(size, size - (self.percent * size + 99) // 100 + depth)

    def least_common(self, size: Column) -> Column:
        """How many n-grams a set of this size shares at least with each linked set."""
        return F.ceil(self.percent * size / F.lit(100).cast("decimal(3,0)")).cast("long")

    @property
    def least_size(self) -> int:
        """Smaller sets are linked with equal ones only."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 62

    def sizes_allow(self, m: Column, n: Column) -> Column:
        return 100 * F.least(m, n) >= self.percent * F.greatest(m, n)


def _sets(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows with the sorted set of n-grams of each."""
    for some in slices(batch, "text"):
        words = words_of(*text_buffers(some.column("text")))
        yield some, [np.unique(h) for h in shingle_hashes(words, rule.words, fold_case=True)]


def _set_id(ngrams: np.ndarray) -> int:
    digest = hashlib.blake2b(ngrams.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _profile(ngrams: np.ndarray) -> bytes:
    counts = np.bincount((ngrams % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
    # A cut count only lowers the distances that are concluded from it.
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _members(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some, sets in _sets(batch, rule):
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"),
                    some.column("text_key"),
                    pa.array([_set_id(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_profile(s) for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_key", "set_id", "n", "profile"],
            )


def _sampled(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _sets(batch, rule):
            ngrams, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ngrams.view(np.int64)), pa.array(counts.astype(np.int64))], names=["ngram", "n"]
            )


def _replicated(
    batches: Iterator[pa.RecordBatch], rule: Rule, frequent: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """(pivot, set, size) for the window of each set, once per set and task."""
    sent: set[int] = set()
    for batch in batches:
        for _, sets in _sets(batch, rule):
            pivots, ids, sizes = [], [], []
            for ngrams in sets:
                n = len(ngrams)
                if n < rule.least_size:
                    continue
                set_id = _set_id(ngrams)
                if set_id in sent:
                    continue
                if len(sent) == REMEMBERED:
                    sent.clear()
                sent.add(set_id)
                window = _window(ngrams, rule, frequent)
                pivots.append(window)
                ids.append(np.full(len(window), set_id, np.int64))
                sizes.append(np.full(len(window), n, np.int64))
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*pivots, np.zeros(0, np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([*ids, empty])),
                    pa.array(np.concatenate([*sizes, empty])),
                ],
                names=["pivot", "set_id", "n"],
            )


class _Regions:
    """Proposals from rows sorted by (pivot, n, set_id), which arrive batch by batch."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.waiting = np.zeros((0, 3), np.int64)  # the last region, as far as it is known
        self.large: tuple[int, int, int] | None = None  # (pivot, set, size) that leads a large region

    def proposals(self, rows: np.ndarray, last: bool) -> np.ndarray:
        """Rows (pivot, set a, set b, large): pairs, and members of large regions as set b."""
        out = [np.zeros((0, 4), np.int64)]
        if self.large is not None:
            out.append(self._of_large(rows[rows[:, 0] == self.large[0]]))
            if not (rows[:, 0] == self.large[0]).all():
                rows = rows[rows[:, 0] != self.large[0]]
                self.large = None
            else:
                rows = rows[:0]
        rows = np.concatenate([self.waiting, rows])
        if len(rows):
            same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
            rows = rows[np.concatenate([[True], ~same])]
        edges = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, int)
        sizes = np.diff(np.append(edges, len(rows)))
        if len(edges) and not last:
            begin, size = int(edges[-1]), int(sizes[-1])
            self.waiting = rows[begin:]
            edges, sizes = edges[:-1], sizes[:-1]
            if size > SMALL_REGION:
                self.large = tuple(self.waiting[0].tolist())
                out.append(self._of_large(self.waiting))
                self.waiting = self.waiting[:0]
        elif last:
            self.waiting = rows[:0]
        for size in np.unique(sizes[sizes > 1]).tolist():
            begins = edges[sizes == size]
            if size > SMALL_REGION:
                for begin in begins.tolist():
                    region = rows[begin : begin + size]
                    self.large = tuple(region[0].tolist())
                    out.append(self._of_large(region))
                    self.large = None
                continue
            i, j = np.triu_indices(size, 1)
            a, b = rows[(begins[:, None] + i).ravel()], rows[(begins[:, None] + j).ravel()]
            fits = 100 * a[:, 2] >= self.rule.percent * b[:, 2]  # sizes rise within a region
            out.append(np.column_stack([a[fits, 0], a[fits, 1], b[fits, 1], np.zeros(fits.sum(), np.int64)]))
        return np.concatenate(out)

    def _of_large(self, members: np.ndarray) -> np.ndarray:
        pivot, leader, size = self.large
        fits = (100 * size >= self.rule.percent * members[:, 2]) & (members[:, 1] != leader)
        star = np.column_stack(
            [np.full(len(members), pivot), np.full(len(members), leader), members[:, 1], np.zeros(len(members), np.int64)]
        )[fits]
        each = np.column_stack([members[:, 0], members[:, 2], members[:, 1], np.ones(len(members), np.int64)])
        return np.concatenate([star, each])


def _proposed(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    regions = _Regions(rule)

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(rows[:, 3] == 1)], names=["pivot", "a", "b", "large"]
        )

    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        yield batch_of(regions.proposals(rows, last=False))
    yield batch_of(regions.proposals(np.zeros((0, 3), np.int64), last=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)


def _cuts(sizes: np.ndarray) -> np.ndarray:
    """How often sets of these sizes are halved by hash until a part has about ``SLICE`` n-grams."""
    return np.ceil(np.log2(np.maximum(sizes / SLICE, 1))).astype(np.int32)


def _near_enough(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs whose class counts do not rule a link out, and how often to cut their sets."""
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            some = batch.slice(first, 4096)
            apart = np.abs(_matrix(some.column("profile_a")) - _matrix(some.column("profile_b"))).sum(axis=1)
            total = some.column("n_a").to_numpy() + some.column("n_b").to_numpy()
            kept = (100 + rule.percent) * apart <= (100 - rule.percent) * total
            larger = np.maximum(some.column("n_a").to_numpy(), some.column("n_b").to_numpy())
            near = some.select(["a", "b"]).append_column("cuts", pa.array(_cuts(larger)))
            yield near.filter(pa.array(kept))


def _across_blocks(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs of one region's block with another that may be linked and are not yet connected.

    Rows are sorted by (pivot, block pair); a block pair has at most twice ``BLOCK`` rows.
    """
    waiting = None
    names = ["pivot", "low", "high", "block", "set_id", "n", "label", "profile"]

    def compared(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = rows.column("block").to_numpy()
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        ids, n, label = (rows.column(c).to_numpy() for c in ("set_id", "n", "label"))
        profile = _matrix(rows.column("profile"))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a, b, cuts = [], [], []
        for i in left.tolist():
            others = right[right > i] if low == high else right
            others = others[label[others] != label[i]]
            apart = np.abs(profile[others] - profile[i]).sum(axis=1)
            others = others[(100 + rule.percent) * apart <= (100 - rule.percent) * (n[others] + n[i])]
            a.append(np.full(len(others), ids[i]))
            b.append(ids[others])
            cuts.append(_cuts(np.maximum(n[others], n[i])))
        a, b, cuts = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b, cuts))
        columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cuts, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "cuts"])

    for batch in batches:
        batch = batch.select(names)
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        group = np.column_stack([batch.column(c).to_numpy() for c in ("pivot", "low", "high")])
        edges = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1 if len(group) else np.zeros(0, int)
        begin = 0
        for end in edges.tolist():
            yield from compared(batch.slice(begin, end - begin))
            begin = end
        waiting = batch.slice(begin)
    if waiting is not None and waiting.num_rows:
        yield from compared(waiting)


def _chosen_sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """The parts of each set, by ranges of hashes, cut as often as pairs with it may ask for."""
    for batch in batches:
        for _, sets in _sets(batch, rule):
            rows: list[tuple] = []
            for ngrams in sets:
                set_id, n = _set_id(ngrams), len(ngrams)
                # A partner may be larger, and then decides.
                most = _cuts(np.array([n, 100 * n / rule.percent]))
                for cuts in range(int(most[0]), int(most[1]) + 1):
                    edges = np.arange(1, 1 << cuts, dtype=np.uint64) << np.uint64(64 - cuts) if cuts else []
                    parts = np.split(ngrams, np.searchsorted(ngrams, edges))
                    rows += [(set_id, cuts, part, found.view(np.int64)) for part, found in enumerate(parts)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                names=["set_id", "cuts", "part", "ngrams"],
            )


def _windows(
    batches: Iterator[pa.RecordBatch], rule: Rule, frequent: np.ndarray, depth: int
) -> Iterator[pa.RecordBatch]:
    """The first pivots of each set, in which it shares ``depth`` with each linked set."""
    for batch in batches:
        for _, sets in _sets(batch, rule):
            pivots = [_window(s, rule, frequent, depth).view(np.int64) for s in sets]
            columns = [pa.array([_set_id(s) for s in sets], pa.int64()), pa.array(pivots, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["set_id", "pivots"])


def _window(ngrams: np.ndarray, rule: Rule, frequent: np.ndarray, depth: int = 1) -> np.ndarray:
    """The pivots that a set is replicated to, in order."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, ngrams), len(frequent) - 1)
        late = frequent[at] == ngrams
        ngrams = np.concatenate([ngrams[~late], ngrams[late]])
    return ngrams[: rule.window(len(ngrams), depth)]


class JaccardJoin:
    """The join of one table of documents; its steps are written tables of a workspace."""

    def __init__(self, docs: DataFrame, workspace: Workspace, rule: Rule | None = None):
        bound_batches(docs.sparkSession)
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        self.space, self.rule = workspace, rule or Rule()

    def members(self) -> DataFrame:
        """Per document its id and text hash, and id, size ``n`` and class counts of its set."""
        kind = dict(self.docs.dtypes)["doc_id"]
        run = partial(_members, rule=self.rule)
        return self.space.table(
            "members",
            lambda: self.docs.mapInArrow(run, f"doc_id {kind}, text_key long, set_id long, n long, profile binary"),
        )

    @cached_property
    def frequent(self) -> np.ndarray:
        """Sorted n-grams that several documents of a sample hold, ``MOST_FREQUENT`` at most."""
        docs = self.members().count()
        share = int((1 << 31) * min(1.0, SAMPLED_DOCUMENTS / max(docs, 1)))
        hashed = F.pmod(F.xxhash64(F.lit("sample"), "text_key"), F.lit(1 << 31))
        found = (
            self.docs.where(hashed < share)
            .dropDuplicates(["text_key"])
            .select("text")
            .mapInArrow(partial(_sampled, rule=self.rule), "ngram long, n long")
            .groupBy("ngram")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_FREQUENT)
            .orderBy(F.desc("n"), "ngram")
            .limit(MOST_FREQUENT)
            .select("ngram")
            .toArrow()
        )
        return np.sort(found.column(0).to_numpy().view(np.uint64))

    def proposals(self) -> DataFrame:
        run = partial(_replicated, rule=self.rule, frequent=self.frequent)
        windows = self.docs.select("text").mapInArrow(run, "pivot long, set_id long, n long")
        regions = windows.repartition("pivot").sortWithinPartitions("pivot", "n", "set_id")
        return self.space.table(
            "proposals",
            lambda: regions.mapInArrow(
                partial(_proposed, rule=self.rule), "pivot long, a long, b long, large boolean"
            ),
        )

    def sets(self) -> DataFrame:
        """One row per different set: ``set_id``, ``n``, ``profile`` and the hash of one text with it."""
        return self.space.table(
            "sets",
            lambda: self.members()
            .where(F.col("n") >= self.rule.least_size)
            .groupBy("set_id")
            .agg(
                F.first("n").alias("n"),
                F.first("profile").alias("profile"),
                F.min("text_key").alias("wanted_key"),
            ),
        )

    def _texts_of(self, ids: DataFrame, name: str) -> DataFrame:
        """The texts of the sets in ``ids(set_id)``."""
        wanted = self.space.table(
            f"{name}_wanted", lambda: self.sets().join(ids, "set_id", "left_semi").select("wanted_key")
        )
        same = F.col("text_key") == F.col("wanted_key")
        return self.docs.join(wanted, same, "left_semi").select("text")

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that the class counts allow to be linked."""
        profiles = self.sets()
        for side in ("a", "b"):
            own = profiles.select(
                F.col("set_id").alias(f"id_{side}"),
                F.col("n").alias(f"n_{side}"),
                F.col("profile").alias(f"profile_{side}"),
            )
            pairs = pairs.join(own, F.col(side) == F.col(f"id_{side}"))
        possible = pairs.where(self.rule.sizes_allow(F.col("n_a"), F.col("n_b")))
        return possible.select("a", "b", "n_a", "n_b", "profile_a", "profile_b").mapInArrow(
            partial(_near_enough, rule=self.rule), "a long, b long, cuts int"
        )

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose sets are linked."""
        pairs = self.space.table(f"{name}_near", lambda: pairs)
        ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        run = partial(_chosen_sets, rule=self.rule)
        sets = self.space.table(
            f"{name}_sets",
            lambda: self._texts_of(ids, name)
            .mapInArrow(run, "set_id long, cuts int, part int, ngrams array<long>")
            .dropDuplicates(["set_id", "cuts", "part"]),
        )
        asked = pairs.withColumn("part", F.explode(F.expr("sequence(0, shiftleft(1, cuts) - 1)")))
        for side in ("a", "b"):
            own = sets.select(F.col("set_id").alias(side), "cuts", "part", F.col("ngrams").alias(f"set_{side}"))
            asked = asked.join(own, [side, "cuts", "part"])
        counted = asked.select(
            "a", "b", "cuts",
            F.size(F.array_intersect("set_a", "set_b")).alias("common"),
            (F.size("set_a") + F.size("set_b")).alias("total"),
        )
        # Pairs of sets that are not cut need no grouping.
        whole = counted.where("cuts = 0").select("a", "b", "common", "total")
        parts = counted.where("cuts > 0").groupBy("a", "b").agg(
            F.sum("common").alias("common"), F.sum("total").alias("total")
        )
        linked = (100 + self.rule.percent) * F.col("common") >= self.rule.percent * F.col("total")
        return self.space.table(
            f"{name}_links", lambda: whole.unionByName(parts).where(linked).select("a", "b")
        )

    @staticmethod
    def _labelled(large: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of large regions with the label of what they are connected to."""
        return large.join(labels, F.col("set_id") == F.col("node"), "left").select(
            "pivot", "set_id", "size", F.coalesce("label", "set_id").alias("label")
        )

    def _star(self, large: DataFrame, labels: DataFrame, round_no: int) -> DataFrame:
        """Pairs of one more pivot of each large region with members that it may be linked with.

        The pivot is the member with the least hash, another one in every round, and for all
        regions with much the same members the same.
        """
        labelled = self._labelled(large, labels)
        drawn = F.struct(F.xxhash64("set_id", F.lit(round_no)).alias("hash"), "set_id", "label", "size")
        leaders = labelled.groupBy("pivot").agg(F.min(drawn).alias("leader"))
        apart = labelled.join(leaders, "pivot").where(
            (F.col("label") != F.col("leader.label"))
            & self.rule.sizes_allow(F.col("size"), F.col("leader.size"))
        )
        return apart.select(
            F.least("set_id", "leader.set_id").alias("a"), F.greatest("set_id", "leader.set_id").alias("b")
        ).distinct()

    def links(self) -> DataFrame:
        """Links (``a``, ``b``) between different sets; those of one class connect it."""
        proposed = self.proposals()
        pairs = (
            proposed.where("NOT large")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        links = self._verified(self._near(pairs), "first")
        labels = components(links, self.space, "first")

        # Members of large regions are linked with a few more pivots, as long as that connects any.
        large = self.space.table(
            "large",
            lambda: proposed.where("large")
            .select("pivot", F.col("b").alias("set_id"), F.col("a").alias("size"))
            .distinct(),
        )
        for round_no in range(MORE_PIVOTS):
            more = self._verified(self._near(self._star(large, labels, round_no)), f"star_{round_no}")
            if more.isEmpty():
                break
            links = links.unionByName(more)
            labels = components(links, self.space, f"star_{round_no}")

        regions = self._labelled(large, labels).withColumnRenamed("pivot", "region")
        return links.unionByName(self._verified(self._unconnected(regions), "rest"))

    def _deeper(self, regions: DataFrame, depth: int) -> DataFrame:
        """Members of the regions by chains of ``depth`` pivots: one more than that of ``regions``."""
        run = partial(_windows, rule=self.rule, frequent=self.frequent, depth=depth)
        name = f"windows_{depth}"
        windows = self.space.table(
            name,
            lambda: self._texts_of(regions.select("set_id").distinct(), name)
            .mapInArrow(run, "set_id long, pivots array<long>")
            .dropDuplicates(["set_id"]),
        )
        # Where the last pivot of the chain is among the member's own.
        last = F.col("place") if depth > 2 else (F.array_position("pivots", F.col("region")) - 1).cast("int")
        found = regions.join(windows, "set_id").withColumn("last", last)
        columns = ["set_id", "size", "label"]
        split = found.select("region", *columns, "last", F.posexplode("pivots").alias("place", "pivot")).where(
            "place > last"
        )
        # Small sets may share no more pivots than their chain has.
        short = found.where(self.rule.least_common(F.col("size")) < depth)
        return split.select(F.xxhash64("region", "pivot").alias("region"), *columns, "place").unionByName(
            short.select(F.xxhash64("region").alias("region"), *columns, F.col("last").alias("place"))
        )

    def _unconnected(self, regions: DataFrame) -> DataFrame:
        """Pairs of one region (``region``, ``set_id``, ``size``, ``label``) that may be linked and are not connected."""
        several = F.min("label") != F.max("label")
        drawn = F.struct(F.xxhash64("set_id").alias("hash"), "set_id")
        met = []
        for depth in range(1, DEEPEST + 1):
            open_regions = (
                regions.groupBy("region")
                .agg(F.min(drawn)["set_id"].alias("leader"), several.alias("open"))
                .where("open")
                .select("region", "leader")
            )
            led = regions.join(open_regions, "region")
            # Regions with the same member drawn are compared as one, so a pair that shares
            # many pivots is proposed about once. With the rows of each member's next windows.
            window = F.col("size") - self.rule.least_common(F.col("size")) + depth + 1
            members = self.space.table(
                f"open_members_{depth}",
                lambda led=led, window=window: led.groupBy("leader", "set_id", "label").agg(
                    F.sum(window).alias("replicas")
                ),
            )
            sizes = members.groupBy("leader").agg(
                F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
                F.count("*").alias("members"),
                F.sum("replicas").alias("of_all"),
            )
            fewer = (F.col("of_all") < F.col("members") * F.col("blocks")) & F.lit(depth < DEEPEST)
            split = self.space.table(
                f"split_{depth}", lambda sizes=sizes, fewer=fewer: sizes.where(fewer).select("leader")
            )
            met.append(self._blocks(members.join(split, "leader", "left_anti"), sizes, depth))
            if split.isEmpty():
                break
            wide = led.join(split, "leader", "left_semi").drop("leader")
            regions = self.space.table(
                f"regions_{depth + 1}", lambda wide=wide, depth=depth: self._deeper(wide, depth + 1)
            )
        full = reduce(DataFrame.unionByName, met).join(self.sets(), "set_id")
        sorted_rows = full.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")
        return sorted_rows.select(
            "pivot", "low", "high", "block", "set_id", "n", "label", "profile"
        ).mapInArrow(partial(_across_blocks, rule=self.rule), "a long, b long, cuts int").distinct()

    @staticmethod
    def _blocks(members: DataFrame, sizes: DataFrame, depth: int) -> DataFrame:
        """A row per member and pair of blocks of its region (``pivot``) that it takes part in."""
        # A member goes to one of its region's blocks, and that block meets every other one.
        placed = members.join(sizes, "leader").withColumn(
            "block", F.pmod(F.xxhash64("set_id", "leader"), F.col("blocks")).cast("int")
        )
        return placed.select(
            "leader", "set_id", "label", "block",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
        ).select(
            F.xxhash64("leader", F.lit(depth)).alias("pivot"), "set_id", "label", "block",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )

    def classes(self) -> DataFrame:
        """``doc_id``, ``n_shingles`` and ``component_id`` of every document."""
        labels = components(self.links(), self.space, "final")
        members = self.members()
        named = members.join(labels, F.col("set_id") == F.col("node"), "left").select(
            "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "set_id")).alias("class")
        )
        least = named.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
        return named.join(least, "class", "left").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        )


def without_copies(docs: DataFrame, workspace: Workspace, rule: Rule | None = None) -> DataFrame:
    """One row of each class, that with the least id, with its own columns.

    Rows are told apart by id and text, so of rows that repeat an id only those that are
    copies go; of rows that repeat both, one stays. Rows without an id or without words stay.
    """
    join = JaccardJoin(docs, workspace, rule)
    labels = components(join.links(), workspace, "kept")
    rows = (
        join.members()
        .where("n > 0 AND doc_id IS NOT NULL")
        .join(labels, F.col("set_id") == F.col("node"), "left")
        .select("doc_id", "text_key", F.coalesce("label", "set_id").alias("class"))
    )
    first = rows.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    judged = workspace.table(
        "judged",
        lambda: rows.join(first, "class")
        .groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        .agg(
            F.first(F.struct("doc_id", "text_key") == F.col("first")).alias("stays"),
            F.count("*").alias("times"),
        )
        .where("NOT stays OR times > 1"),
    )
    same = (docs["doc_id"] == F.col("id")) & (F.xxhash64(docs["text"]) == F.col("key"))
    once = docs.join(judged, same, "left_anti")
    repeated = docs.join(judged.where("stays"), same, "left_semi")
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
