from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import cover_tree, hard_negatives
from ledgerline.llm.cover_tree import CoverTree, exact_type
from ledgerline.llm.hard_negatives import HardNegatives, Rule
from ledgerline.llm.queries import ORACLE_SQL, QUERIES
from ledgerline.sources.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, rule=Rule(), every=10) -> Counter:  # noqa: B008
    """All products of all rows, from (vec_id, embedding, label)."""
    taken = set()
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if all(x is not None and math.isfinite(x) for x in vector):
            taken.add((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = Counter()
    for a, own, q in taken:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, label) for i, label, v in taken if i != a)
        positives = [(i, -s) for s, i, label in scored if label == own][: rule.positives]
        for p, ps in positives:
            fits = [
                (i, -s) for s, i, label in scored
                if label != own and rule.low_percent * ps <= -100 * s <= rule.high_percent * ps
            ]
            for rank, (i, s) in enumerate(fits[: rule.negatives], 1):
                out[a, p, rank, i, ps, s] += 1
    return out


def mined(spark, rows, **options) -> Counter:
    table = spark.createDataFrame(rows, SCHEMA)
    found = HardNegatives(table, Workspace(spark, "t"), F.col("vec_id") % 10 == 0, **options).negatives()
    return Counter(tuple(r[n] for n in NAMES) for r in found.collect())


def random_rows(count, seed=1):
    """A third of the rows repeat one vector under different ids."""
    chance = np.random.default_rng(seed)
    vectors = chance.normal(size=(count, 8)) / 3
    vectors[::3] = vectors[0]
    return [(n, [float(x) for x in v], int(chance.integers(4))) for n, v in enumerate(vectors)]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    twin = con.sql(f"SELECT {', '.join(NAMES)} FROM ({ORACLE_SQL['op13_hard_negatives']})").fetchall()
    got = QUERIES["op13_hard_negatives"](spark, FOLDER)
    assert Counter(tuple(r[n] for n in NAMES) for r in got.collect()) == Counter(twin) != Counter()


def test_many_cells_blocks_and_parts(spark, monkeypatch):
    """Cells split into blocks, blocks that meet anchors in parts, and a hot vector."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "PART_ANCHORS", 20)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 50)
    rows = random_rows(400)
    assert mined(spark, rows) == brute(rows) != Counter()


def test_odd_rows(spark):
    rows = random_rows(60, 2)
    rows += [rows[10], rows[10], (20, [0.5] * 8, 9), (20, [0.25] * 8, 1)]
    rows += [(None, [1.0] * 8, 1), (70, None, 1), (71, [1.0] * 8, None), (72, [1.0, None] * 4, 1)]
    rows += [(73, [float("nan")] * 8, 1), (74, [float("inf")] * 8, 1), (80, [], 1), (90, [0.3, 0.4], 2), (100, [0.0] * 8, 2)]
    expected = brute(rows)
    assert mined(spark, rows) == expected
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS anchor", "2 AS cell", "3 AS score", "4 AS rank")
    found = HardNegatives(table, Workspace(spark, "t"), F.col("vec_id") % 10 == 0).negatives().collect()
    assert Counter(tuple(r[n] for n in NAMES) for r in found) == expected
    assert mined(spark, []) == Counter() == mined(spark, [(5, [1.0], 1)])


def test_cover_tree_searches_against_brute_force():
    rng = random.Random(3)
    vectors = np.array([[rng.randrange(-90, 90) for _ in range(6)] for _ in range(900)], np.int16)
    vectors[::4] = vectors[0]
    norm = float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max())) + 1
    tree = CoverTree(vectors, norm, exact_type(6, 90))
    assert sorted(tree.order.tolist()) == list(range(900))
    ids = np.arange(900)[::-1].copy()
    queries = vectors[:40]
    for low, high in ((-np.inf, np.inf), (500.0, 5000.0), (1e9, 1e9)):
        leaves = tree.leaves(queries, np.full(40, low), np.full(40, high))
        for q, seen in zip(queries, leaves, strict=True):
            window = cover_tree.Window(7, low, high, np.ones(900, bool), ids)
            tree.verified(q, seen, [window])
            scores = vectors.astype(int) @ q.astype(int)
            best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if low <= s <= high)[:7]
            assert [(-s, ids[r]) for s, r in zip(window.scores.tolist(), window.rows.tolist(), strict=True)] == best


def test_products_are_exact_or_refused():
    assert exact_type(64, 300) == np.float32 and exact_type(64, 10**6) == np.float64
    assert exact_type(64, 10**8) == np.int64
    with pytest.raises(ValueError, match="64 bits"):
        exact_type(64, 10**9)
