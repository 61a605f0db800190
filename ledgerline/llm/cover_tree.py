"""A cover tree over integer vectors for exact searches by inner product.

Vectors are augmented by one component so that all have the same norm: then an inner
product with a query depends on the angle only, and the largest one belongs to the nearest
vector. Every node has a member as centre and a covering radius, the largest distance of its
members from that centre; children are spread far apart within a node until half of its
radius covers its members. By the triangle inequality for angles, centre and radius bound
the inner products of all members from above and from below.

A search descends level by level, leaving out nodes whose bounds lie outside all windows, and
verifies the leaves that remain best first, in rounds: what a round finds raises the lower
ends of windows, and leaves that cannot reach them are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF_ROWS = 64
MOST_CHILDREN = 16
# Leaves verified in the first round; each later round takes four times as many.
FIRST_ROUND = 4


def exact_type(dimensions: int, largest: int) -> np.dtype:
    """The fastest type in which inner products of such vectors are exact."""
    bound = dimensions * largest * largest
    if bound < 1 << 24:
        return np.dtype(np.float32)
    if bound < 1 << 53:
        return np.dtype(np.float64)
    if bound < 1 << 62:
        return np.dtype(np.int64)
    raise ValueError(f"inner products of {dimensions} components up to {largest} exceed 64 bits")


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    """``vectors`` with a further component that brings each to ``norm``."""
    vectors = vectors.astype(np.float64)
    rest = norm * norm - np.einsum("ij,ij->i", vectors, vectors)
    return np.column_stack([vectors, np.sqrt(np.maximum(rest, 0.0))])


def distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    difference = points - center
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def spread_centers(points: np.ndarray, first: int, most: int, until: float) -> tuple[list[int], np.ndarray]:
    """Farthest-first centres, until all points lie within ``until`` of one, and the nearest of each."""
    centers = [first]
    near = distances(points, points[first])
    owner = np.zeros(len(points), np.int64)
    while len(centers) < most:
        far = int(np.argmax(near))
        if near[far] <= until:
            break
        d = distances(points, points[far])
        closer = d < near
        owner[closer] = len(centers)
        near[closer] = d[closer]
        centers.append(far)
    return centers, owner


def bounds(
    products: np.ndarray, radii: np.ndarray, query_norms: np.ndarray, norm: float
) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) inner product of queries with the members of nodes.

    ``products`` are those of queries (rows) with centres, ``radii`` covering radii of
    augmented vectors of length ``norm``.
    """
    scale = query_norms[:, None] * norm
    cosine = np.divide(products, scale, out=np.zeros(products.shape), where=scale > 0)
    angle = np.arccos(np.clip(cosine, -1.0, 1.0))
    reach = 2 * np.arcsin(np.clip(radii / (2 * norm), 0.0, 1.0))
    slack = 1e-7 * scale + 0.5  # rounding of angles; inner products are whole numbers
    least = scale * np.cos(np.minimum(angle + reach, np.pi)) - slack
    return least, scale * np.cos(np.maximum(angle - reach, 0.0)) + slack


@dataclass
class _Level:
    """Nodes of one depth: centre rows, radii, members, numbers of the nodes above."""

    centers: np.ndarray
    radii: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray


class CoverTree:
    """``vectors`` hold whole numbers; ``norm`` is at least the largest of their norms."""

    def __init__(self, vectors: np.ndarray, norm: float, kind: np.dtype):
        points = augmented(vectors, norm)
        self.norm = norm
        order = np.arange(len(vectors))
        self.levels: list[_Level] = []
        nodes = [(0, len(vectors), 0, -1)] if len(vectors) else []
        while nodes:
            below = []
            rows = []
            for number, (begin, end, center, parent) in enumerate(nodes):
                members = order[begin:end].copy()
                radius = float(distances(points[members], points[center]).max())
                leaf = end - begin <= LEAF_ROWS or radius == 0.0
                rows.append((center, radius, begin, end, parent, leaf))
                if leaf:
                    continue
                first = int(np.flatnonzero(members == center)[0])
                centers, owner = spread_centers(points[members], first, MOST_CHILDREN, radius / 2)
                sizes = np.bincount(owner, minlength=len(centers))
                order[begin:end] = members[np.argsort(owner, kind="stable")]
                ends = begin + np.cumsum(sizes)
                for child, (at, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                    below.append((at - size, at, int(members[centers[child]]), number))
            columns = list(zip(*rows, strict=True))
            self.levels.append(_Level(*(np.array(c) for c in columns)))
            nodes = below
        self.order = order
        # In the order of the leaves, so that a leaf is one slice.
        self.rows = vectors[order].astype(kind)
        self.centers = [vectors[level.centers].astype(kind) for level in self.levels]

    def leaves(
        self, queries: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first rows, ends, largest possible products) of the leaves that each query must see.

        A row of ``queries`` must see all products from ``low`` to ``high``.
        """
        kind = self.rows.dtype
        norms = np.sqrt(np.einsum("ij,ij->i", queries.astype(np.float64), queries.astype(np.float64)))
        alive = None
        found = []
        for level, centers in zip(self.levels, self.centers, strict=True):
            products = (queries.astype(kind) @ centers.T).astype(np.float64)
            least, largest = bounds(products, level.radii, norms, self.norm)
            here = (largest >= low[:, None]) & (least <= high[:, None])
            if alive is not None:
                here &= alive[:, level.parent]
            alive = here
            found.append((here & level.leaf, largest, level))
        out = []
        for q in range(len(queries)):
            parts = [(np.flatnonzero(mask[q]), largest[q], level) for mask, largest, level in found]
            begin = np.concatenate([level.begin[at] for at, _, level in parts])
            end = np.concatenate([level.end[at] for at, _, level in parts])
            most = np.concatenate([largest[at] for at, largest, _ in parts])
            best = np.argsort(-most, kind="stable")
            out.append((begin[best], end[best], most[best]))
        return out

    def verified(
        self, query: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], windows: list[Window]
    ) -> None:
        """Offers the rows of the leaves, best first, to the windows of one query."""
        begin, end, most = found
        query = query.astype(self.rows.dtype)
        at, size = 0, FIRST_ROUND
        while at < len(begin):
            wanted = min(w.low for w in windows)
            here = slice(at, at + size)
            if most[at] < wanted:
                return
            ranges = [(b, e) for b, e, m in zip(begin[here], end[here], most[here], strict=True) if m >= wanted]
            scores = np.concatenate([self.rows[b:e] @ query for b, e in ranges])
            rows = np.concatenate([self.order[b:e] for b, e in ranges])
            for window in windows:
                window.offer(scores, rows)
            at, size = at + size, 4 * size


class Window:
    """The ``count`` largest products from ``low`` to ``high``; of equal ones the smallest ids."""

    def __init__(self, count: int, low: float, high: float, allowed: np.ndarray, ids: np.ndarray):
        self.count, self.low, self.high = count, low, high
        self.allowed, self.ids = allowed, ids
        self.scores = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, rows: np.ndarray) -> None:
        inside = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        inside = inside[self.allowed[rows[inside]]]
        if not len(inside):
            return
        scores = np.concatenate([self.scores, scores[inside].astype(np.int64)])
        rows = np.concatenate([self.rows, rows[inside]])
        best = np.lexsort((rows, self.ids[rows], -scores))[: self.count]
        self.scores, self.rows = scores[best], rows[best]
        if len(best) == self.count:
            self.low = max(self.low, self.scores[-1])
