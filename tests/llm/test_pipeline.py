from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_packing import check_pieces, plain  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, by name."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs.collect()}
    folder = spark.conf.get("spark.checkpoint.dir")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/stages/{name}"
        stage(spark, docs, FOLDER).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def ids(rows) -> Counter:
    return Counter(r.doc_id for r in rows)


def test_stages_return_documents(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == list(kept)[1:]
    for name in list(kept)[1:-1]:
        assert kept[name][0].__fields__ == COLUMNS
        assert set(kept[name]) <= set(kept["documents"])


def test_clean_documents_pass_the_filters(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(kept["language_id"]) >= 0.98 * len(kept["documents"])
    good = [r for r in kept["language_id"] if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 10]
    passed = ids(kept["quality_rules"])
    assert sum(r.doc_id in passed for r in good) >= 0.97 * len(good)
    assert len(kept["quality_rules"]) < len(kept["language_id"])


def test_one_document_of_each_group_stays(kept):
    rows = kept["quality_rules"]
    sets = {r.doc_id: shingles(r.text, 5) for r in rows}
    group = {r.doc_id: r.doc_id for r in rows}
    linked = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    while any(group[a] != group[b] for a, b in linked):
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    assert linked and ids(kept["near_duplicates"]) == Counter(set(group.values()))


def test_mix_follows_the_targets(spark, kept):
    from ledgerline.llm import mixing
    from ledgerline.sources.workspace import Workspace

    docs = [(r.doc_id, r.text, r.source) for r in kept["near_duplicates"]]
    table = spark.createDataFrame(kept["near_duplicates"])
    taken = mixing.mix_documents(table, Workspace(spark, "t")).collect()
    check_mix(taken, docs)
    copies = ids(kept["source_mix"])
    assert all(copies[r.doc_id] == round(r.taken / r.size) or abs(copies[r.doc_id] - r.taken / r.size) == 0.5 for r in taken)


def test_packing_holds_every_copy(kept, plain):  # noqa: F811
    copies = ids(kept["source_mix"])
    tokens = {r.doc_id: len(plain(r.text)) + 1 for r in kept["source_mix"]}
    total = Counter()
    for p in kept["packing"]:
        total[p.doc_id] += p.length
    assert total == Counter({d: n * tokens[d] for d, n in copies.items()})
    ends: dict = {}
    for p in sorted(kept["packing"], key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 1024 and len(ends) * 1024 <= 1.03 * sum(ends.values()) + 1024


def test_run_is_the_chain_of_stages(spark, kept):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    total = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows)
    assert total(got).keys() == total(kept["packing"]).keys()
    assert sum(r.length for r in got) == sum(r.length for r in kept["packing"]) and key(got[0])


@pytest.mark.parametrize("number", range(5))
def test_odd_tables(spark, number):
    """Empty tables, NULLs and clashing columns in every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, `row` string, n long"
    name, stage = corpus_pipeline.STAGES[number]
    rows = [(1, None, None, None, None, None, None, None), (None, "a b c", "en", None, 5, 0.1, "x", 1), (2, "", "en", "s", 0, 0.2, "y", 2), (2, "", "en", "s", 0, 0.2, "y", 2)]
    for some in ([], rows):
        out = stage(spark, spark.createDataFrame(some, schema), FOLDER)
        found = out.collect()
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "row", "n"]
        assert found or not some or name in ("language_id", "quality_rules", "source_mix")
