from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import mixing
from ledgerline.llm.queries import QUERIES
from ledgerline.sources.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    """Shares by weight; what is above a cap is shared again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in open_)
        for s in [s for s in open_ if target[s] >= 2 * sizes[s]]:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
    return target


def check(rows, docs: list[tuple]) -> None:
    """``docs`` are (doc_id, text, source)."""
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    source_of = {d: s for d, _, s in docs}
    expected = Counter((d, len(WORD.findall(t or "")), sizes[s]) for d, t, s in docs)
    assert Counter((r.doc_id, r.size, r.source_size) for r in rows) == expected
    target = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(target[source_of[r.doc_id]], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[source_of[r.doc_id]] += r.taken
    for source in sizes:
        assert taken[source] == int(target[source] + 1e-6)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    first = QUERIES["op3_mixing"](spark, FOLDER).collect()
    check(first, docs)
    assert sorted(first) == sorted(QUERIES["op3_mixing"](spark, FOLDER).collect())


def test_epochs_come_before_selection(spark, documents):
    random.seed(3)
    docs = [(i, "w " * random.randint(1, 30), random.choice(["a"] * 8 + ["b", "c", None])) for i in range(400)]
    rows = mixing.mix_documents(documents([(i, t, None, s) for i, t, s in docs]), Workspace(spark, "t")).collect()
    check(rows, docs)
    for r in rows:
        epochs = int(r.target // r.source_size)
        assert epochs * r.size <= r.taken <= (epochs + 1) * r.size
    partial = [r for r in rows if r.taken % r.size]
    assert len(partial) <= 4  # one cut document per source


def test_better_documents_come_first(spark, documents):
    docs = [(i, "12 34 " * 5 if i % 2 else "ab cd " * 5, None, "b") for i in range(600)]
    docs += [(1000 + i, "word " * 40, None, "a") for i in range(1000)]
    rows = mixing.mix_documents(documents(docs), Workspace(spark, "t")).collect()
    extra = Counter(r.doc_id % 2 for r in rows if r.doc_id < 1000 and r.taken > r.target // r.source_size * r.size)
    b = next(r for r in rows if r.doc_id < 1000)
    assert b.target < 2 * b.source_size or not extra
    keys = mixing._sized(documents(docs).select("doc_id", "text", "source")).groupBy("text").agg({"mix_quality": "max"}).collect()
    weights = {r[0][:2]: r[1] for r in keys}
    assert weights["ab"] == weights["wo"] == 1.0 and weights["12"] == mixing.LEAST_QUALITY


def test_odd_documents(spark, documents):
    rows = [(1, None, None, "a"), (2, "", None, None), (3, "x " * 50_000, None, "b"), (3, "x " * 50_000, None, "b"), (None, "a b c", None, "")]
    docs = documents(rows).selectExpr("*", "1 AS size", "2 AS target", "'x' AS mix_size", "3 AS `row`")
    got = mixing.mix_documents(docs, Workspace(spark, "t")).collect()
    check(got, [(d, t, s) for d, t, _, s in rows])
    out = mixing.mixed(docs, Workspace(spark, "t"))
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.collect())
    assert set(copies) <= {3, None} and copies[3] >= 2
    empty = documents([])
    assert mixing.mix_documents(empty, Workspace(spark, "t")).count() == 0
    assert mixing.mixed(empty, Workspace(spark, "t")).count() == 0


def test_mixed_documents_follow_the_words_taken(spark, small):
    taken = {r.doc_id: r for r in mixing.mix_documents(small, Workspace(spark, "t")).collect()}
    copies = Counter(r.doc_id for r in mixing.mixed(small, Workspace(spark, "t")).collect())
    for doc_id, r in taken.items():
        assert abs(copies[doc_id] - r.taken / max(r.size, 1)) <= 0.5
