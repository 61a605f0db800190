from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerline.llm import jaccard_join
from ledgerline.llm.jaccard_join import JaccardJoin, Rule, without_copies
from ledgerline.llm.queries import ORACLE_SQL, QUERIES
from ledgerline.sources.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"
RULE = Rule(words=4, percent=85)


def shingles(text: str | None, size: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, rule: Rule) -> Counter:
    """(doc_id, set size, least id of the class), from all pairs of (doc_id, text) rows."""
    sets = [shingles(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= rule.percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter(
        (d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)
    )


def joined(docs, spark, rule=RULE) -> Counter:
    rows = JaccardJoin(docs, Workspace(spark, "t"), rule).classes().collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def prose(rng, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(rng, words: list[str], times: int) -> list[str]:
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_query_against_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(
        (r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op7_jaccard_join"](spark, FOLDER).collect()
    )
    assert got == brute(rows, RULE)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    assert got == Counter(con.sql(ORACLE_SQL["op7_jaccard_join"]).fetchall())
    assert any(c != d for d, _, c in got)


@pytest.mark.parametrize("rule", [RULE, Rule(), Rule(2, 60)])
def test_groups_around_the_limit(spark, documents, rule):
    """Chains of edits, so that similarities lie on both sides of the limit."""
    rng = random.Random(7)
    rows = []
    for _ in range(25):
        words = prose(rng, rng.randrange(3, 120))
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), " ".join(words)))
            words = changed(rng, words, rng.randrange(0, 3))
    got = joined(documents(rows), spark, rule)
    assert got == brute(rows, rule)


def test_large_regions(spark, documents):
    """Near copies, a passage many documents share, and two groups near the limit that share it."""
    rng = random.Random(3)
    passage, base = prose(rng, 60, 10**6), prose(rng, 200, 10**6)
    rows = [(i, " ".join(changed(rng, base, rng.randrange(0, 3)))) for i in range(250)]
    rows += [(1000 + i, " ".join(passage + prose(rng, rng.randrange(5, 60), 10**6))) for i in range(700)]
    rows += [(3000 + i, " ".join(changed(rng, passage, rng.randrange(0, 5)))) for i in range(120)]
    rows += [(5000 + i, "the same text in many documents again and again") for i in range(60)]
    got = joined(documents(rows), spark)
    assert got == brute(rows, RULE)


def test_odd_documents(spark, documents):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, long), (8, long + " tail"),
        (8, long + " tail"), (None, long), (None, "a b c d e"), (11, "é è ê ë"), (12, "É è ê ë"),
    ]
    docs = documents(rows).selectExpr("*", "1 AS n", "2 AS label", "3 AS set_id", "4 AS text_key", "5 AS gone")
    assert joined(docs, spark) == brute(rows, RULE)
    kept = without_copies(docs, Workspace(spark, "t"))
    assert kept.columns == docs.columns
    # Row 11 and 12 differ in a letter beyond A-Z.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, None, None, 11, 12]))
    empty = documents([])
    assert joined(empty, spark) == Counter()
    assert without_copies(empty, Workspace(spark, "t")).count() == 0


def test_windows_hold_a_common_pivot():
    """Sets that just reach the limit share one of their first pivots, wherever they differ."""
    for rule in (RULE, Rule(), Rule(3, 50)):
        for n in range(1, 300):
            least_common = -(-rule.percent * n // 100)
            assert rule.window(n) == n - least_common + 1
            if n < rule.least_size:
                assert 100 * n < rule.percent * (n + 1)


def test_unlike_texts_of_one_id_are_not_lost(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, b + " more"), (3, b + " more"), (None, a), (4, ""), (4, "")]
    kept = without_copies(documents(rows), Workspace(spark, "t"), Rule()).collect()
    found = Counter((r.doc_id, r.text) for r in kept)
    assert found == Counter({(1, a): 1, (2, b): 1, (3, c): 1, (None, a): 1, (4, ""): 2})


def test_large_sets_are_compared_in_parts(spark, documents, monkeypatch):
    """Parts by ranges of hashes add up, also where one set is cut more often than the other."""
    from ledgerline.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "SLICE", 8)
    base = [f"w{i}" for i in range(600)]
    rows = [(n, " ".join(base[: 600 - 7 * n])) for n in range(40)] + [(100, "x " * 30), (101, "some few words here")]
    assert joined(documents(rows), spark) == brute(rows, RULE)
    sizes = jaccard_join._cuts(np.array([8, 9, 16, 17, 600]))
    assert sizes.tolist() == [0, 1, 1, 2, 7]


def test_windows_hold_as_many_common_pivots_as_they_are_deep():
    """Linked sets share that many of their first pivots, wherever they differ."""
    rng = random.Random(11)
    for rule in (RULE, Rule(), Rule(3, 50)):
        for _ in range(2000):
            universe = np.array(rng.sample(range(10**6), rng.randrange(2, 90)), np.uint64)
            common = set(universe[: rng.randrange(1, len(universe) + 1)].tolist())
            rest = [x for x in universe.tolist() if x not in common]
            a, b = (common | {x for x in rest if rng.random() < share} for share in (0.5, 0.3))
            if 100 * len(a & b) < rule.percent * len(a | b):
                continue
            frequent = np.sort(np.array(rng.sample(sorted(a | b), len(a | b) // 3), np.uint64))
            for depth in range(1, min(jaccard_join.DEEPEST, len(a & b)) + 1):
                x, y = (
                    jaccard_join._window(np.array(sorted(s), np.uint64), rule, frequent, depth).tolist() for s in (a, b)
                )
                assert len(set(x) & set(y)) >= depth


@pytest.mark.parametrize("rule", [RULE, Rule(2, 60)])
def test_large_regions_are_split_recursively(spark, documents, monkeypatch, rule):
    """Unlike members of one region part by their next pivots; all links are found all the same."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "SAMPLED_DOCUMENTS", 0)
    monkeypatch.setattr(jaccard_join, "MORE_PIVOTS", 0)
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(8)]
    rows = [(i, " ".join(shared + prose(rng, rng.randrange(8, 40), 10**6))) for i in range(260)]
    rows += [(1000 + i, " ".join(changed(rng, rows[i % 30][1].split(), rng.randrange(0, 3)))) for i in range(120)]
    rows += [(2000 + i, " ".join(changed(rng, shared, i % 3) + ["end"] * (i % 2))) for i in range(40)]
    space = Workspace(spark, "t")
    found = JaccardJoin(documents(rows), space, rule).classes().collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, rule)
    assert spark.read.parquet(space.path("split_1")).count() > 0
    assert spark.read.parquet(space.path("regions_2")).count() > 0
