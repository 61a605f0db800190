from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import fingerprint
from ledgerline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingles(text: str) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def near(a: str, b: str):
    """The exact similarity; few shingles fill few bins, which widens the error."""
    size = len(shingles(a) | shingles(b))
    return pytest.approx(jaccard(a, b), abs=0.13 if size > 150 else 0.3 if size > 10 else 0.5)


def check(rows, texts: list[tuple]) -> None:
    """Against the documents in falling order of id, next after each other."""
    by_id = {r.doc_id: r for r in rows}
    assert len(by_id) == len(rows) == len(texts)
    for (doc_id, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        text, after, row = text or "", after or "", by_id[doc_id]
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.near_edited == near(text, changed)
        assert row.near_next == near(text, after)


def test_query_against_exact_similarity(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = QUERIES["op2_fingerprint"](spark, FOLDER).collect()
    check(rows, sorted([(r.doc_id, r.text) for r in docs], reverse=True))
    by_text = {}
    for r in rows:
        text = next(d.text for d in docs if d.doc_id == r.doc_id)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    errors = [r.near_edited for r in rows]
    assert len(set(errors)) > 20


def test_odd_documents(documents):
    texts = [(9, None), (8, "a b c"), (7, "A b C"), (5, ""), (3, "x" * 40_000), (2, "é\n" * 900), (-4, "a b c")]
    rows = fingerprint.compare_with_edits(documents(texts)).collect()
    check(rows, texts)
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[8] == prints[7] == prints[-4] and prints[9] == prints[5] == ""
    assert fingerprint.compare_with_edits(documents([])).count() == 0
    (only,) = fingerprint.compare_with_edits(documents([(1, "abc def")])).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and only.near_next == 1.0


def test_repeated_rows_and_null_ids(documents):
    rows = [(1, "a a"), (1, "a a"), (None, "b b b"), (1, "c")]
    clashing = documents(rows).selectExpr("*", "1 AS fingerprint", "2 AS part", "'x' AS place")
    got = fingerprint.compare_with_edits(clashing).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None"]


def test_general_fingerprints(documents):
    rows = fingerprint.fingerprints(documents([(1, "a b c d e f"), (2, "A B C D E F"), (3, None)])).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] != "" and prints[3] == ""


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    for shared in (40, 120, 400, 1500):
        wide = [f"w{i}" for i in rng.integers(0, 10**9, 4000)]
        pairs = []
        for k in range(12):
            words = [f"v{k}_{i}" for i in range(2000)]
            pairs += [" ".join(words), " ".join(words[:shared] + wide[: 2000 - shared])]
        low = fingerprint.signatures(pa.array(pairs))
        exact = [jaccard(a, b) for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        estimate = fingerprint.likeness(low[::2], low[1::2])
        assert estimate.mean() == pytest.approx(np.mean(exact), abs=0.02)


def test_borrowed_bins_are_unbiased_on_short_texts():
    texts = [f"a{k} b{k} c{k} d{k} e{k} f{k} {last}" for k in range(150) for last in "gh"]
    low = fingerprint.signatures(pa.array(texts))
    # Three shingles each, of which two are shared: 2 of 4.
    assert fingerprint.likeness(low[::2], low[1::2]).mean() == pytest.approx(0.5, abs=0.06)
    assert fingerprint.likeness(low[:-2], low[2:]).mean() < 0.05
