from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm import toxicity
from ledgerline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
INSULTS = ["blockhead", "nitwit", "fathead"]
CALM = "river stone garden window letter morning paper bridge yellow answer".split()


def sentence(rng, insult=None) -> str:
    words = [str(w) for w in rng.choice(CALM, 40)]
    if insult:
        for _ in range(3):
            words.insert(int(rng.integers(0, 40)), insult)
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    texts = [sentence(rng, INSULTS[i % 3] if i < 60 else None) for i in range(300)]
    return toxicity.fit(texts, [i < 60 for i in range(300)], 0.2)


def test_held_out_labels_are_met(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"](spark, FOLDER).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = sum(p and t for p, t in out)
    assert caught >= 0.5 * sum(t for _, t in out) and caught >= 0.7 * sum(p for p, _ in out)


def test_gapped_and_inserted_characters(model):
    calm = model.score(["the river and the garden", "a stone bridge in the morning", ""])
    assert (calm < 0.3).all()
    for said in ("you nitwit there", "you nit*wit there", "you n.i.t.w.i.t there", "n i t w i t", "a nitXwit", "NITWIT", "n1tw1t"):
        assert model.score([said])[0] >= 0.3, said


def test_position_values_are_the_kernel(model):
    """The weights of sequences against the kernel, summed over all index sets."""

    def phi(s):
        out = defaultdict(float)
        for at in itertools.combinations(range(len(s)), toxicity.LENGTH):
            gaps = at[-1] - at[0] + 1 - toxicity.LENGTH
            if gaps <= toxicity.MOST_GAPS:
                out[tuple(s[i] for i in at)] += toxicity.DECAY**gaps
        return out

    def code(u):
        return sum(x << (5 * (len(u) - 1 - i)) for i, x in enumerate(u))

    s = toxicity.symbols("nit wit")
    weights = np.random.default_rng(0).normal(size=1 << 20).astype(np.float32)
    slow = sum(v * weights[code(u)] for u, v in phi(s.tolist()).items())
    assert toxicity.position_values(s, weights).sum() == pytest.approx(slow, rel=1e-4)
    codes, values = toxicity.sequences(s)
    assert dict(zip(codes.tolist(), values.tolist(), strict=True)) == {code(u): v for u, v in phi(s.tolist()).items()}


def test_symbols():
    name = lambda t: "".join(" abcdefghijklmnopqrstuvwxyz?#"[i] for i in toxicity.symbols(t))
    assert name("Été, l0ser  x!") == " ete loser x "
    assert name("i.d-i o t yes 42") == " idiot yes ## "
    assert name("日本") == " ?? " and name("") == " "


def test_odd_documents(documents, spark):
    rng = np.random.default_rng(4)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, sentence(rng, INSULTS[i % 3] if i % 5 == 0 else None)) for i in ids]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in ids] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    odd = [(1000, None), (1001, ""), (1002, "stone " * 30_000), (1003, "you nitwit"), (1003, "you nitwit"), (None, "a stone")]
    docs = documents(rows + odd).selectExpr("*", "'x' AS score", "1 AS predicted", "2 AS toxic")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1003] >= 0.3 > max(scores[1000], scores[1001], scores[1002], scores[None])
    assert scores[1000] == scores[1001]


def test_nothing_to_learn_from(documents, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    (row,) = toxicity.score_documents(documents([(1, "a")]), empty).collect()
    assert (row.score, row.predicted) == (0.0, 0)
    one_kind = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(documents([(1, "a")]), one_kind).first().score == 0.0
    assert toxicity.score_documents(documents([]), empty).count() == 0
