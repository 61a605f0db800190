from __future__ import annotations

import zlib

import numpy as np

from ledgerline.llm import langid
from ledgerline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_held_out_languages_are_found(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op1_language_id"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert len(out) > 30
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.95 * len(out)


def test_labels_and_ids_do_not_reach_predictions(spark, documents):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the one and the other", "en"), ("der eine und das andere", "de")] * 4)]
    train = [(i, *r[1:]) for i, r in zip((1, 2, 3, 4, 5, 7, 8, 10), train, strict=True)]
    train = [r for r in train if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    probe = [(100, "the other one", None), (101, "das eine andere", "en")]
    first = {r.doc_id: r.lang_pred for r in langid.predict_languages(documents(train + probe)).collect()}
    assert first[100] == "en" and first[101] == "de"


def test_odd_documents(documents):
    rows = [
        (1, "the and of that", "en"), (3, "der und die das", "de"), (4, None, "en"), (5, "", "en"),
        (6, "123 --- 456", "de"), (7, "the " * 20_000, "en"), (7, "the " * 20_000, "en"),
        (None, "die der", None), (9, "日本語", None),
    ]
    clashing = documents(rows).selectExpr("*", "'x' AS lang_pred", "0.5 AS score", "1 AS held_out")
    got = langid.predict_languages(clashing).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert found[4] == found[5] == found[6] == ("und", 0.0)
    assert found[7][0] == "en" and found[None][0] == "de"
    kept = langid.accepted(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "7", "7", "None"]


def test_nothing_to_learn_from(documents):
    (row,) = langid.predict_languages(documents([(1, "some text", None)])).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert langid.predict_languages(documents([])).count() == 0
    assert langid.accepted(documents([])).count() == 0


def test_bundles_are_sums_of_bound_vectors():
    """Against vectors bound and summed one by one."""
    (fast,), sizes = langid.document_vectors(["Ab a"])
    letters = {c: langid._letter_vector(ord(c)).astype(int) for c in "ab "}
    slow = np.zeros(langid.DIMENSIONS, int)
    for x, y, z in (" ab", "ab ", " a "):
        slow += np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z]
    assert (fast == slow).all() and sizes.tolist() == [3]


def test_what_is_in_no_learned_language_goes(spark):
    """Of languages in learned numbers, clean documents stay; other languages and repeated words go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dutch = "De hond loopt door het bos en de kat zit op het dak van het oude huis, waar de zon elke dag schijnt en de kinderen buiten spelen met een bal. "
    italian = "Il cane corre nel bosco e il gatto siede sul tetto della vecchia casa, dove il sole splende ogni giorno e i bambini giocano fuori con una palla. "
    added = [(-1, dutch * 2, None), (-2, italian * 2, None), (-3, "To " * 300, None), (-4, dutch, None)]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(added, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in langid.accepted(table).collect()}
    assert not kept & {-1, -2, -3, -4}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    clean = {r.doc_id for r in docs.join(labels, "doc_id").select("doc_id").collect()}
    print("kept", len([i for i in kept if i >= 0]), docs.count(), "clean", len(clean & kept), len(clean))
    assert len(clean) > 100 and len(clean & kept) >= 0.98 * len(clean)


def test_predictions_against_brute_force(spark, documents):
    """Vectors bound, bundled and compared one by one, for the beginnings of given documents."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [(r.doc_id, (r.text or "")[:80], r.lang) for r in given]

    def slow(text):
        codes, total = [], np.zeros(langid.DIMENSIONS)
        for c in f" {text} ":
            low = c.lower() if len(c.lower()) == 1 else c
            letter = low if c.isalpha() else " "
            if letter != " " or not codes or codes[-1] != " ":
                codes.append(letter)
        for x, y, z in zip(codes, codes[1:], codes[2:], strict=False):
            if y != " ":
                a, b, c = (langid._letter_vector(ord(v)).astype(float) for v in (x, y, z))
                total += np.roll(a, 2) * np.roll(b, 1) * c
        return total

    def unit(v):
        return v / (np.linalg.norm(v) or 1)

    sums = {}
    for doc_id, text, lang in rows:
        if zlib.crc32(str(doc_id).encode()) % 4 != 2 and lang is not None:
            sums[lang] = sums.get(lang, 0) + unit(slow(text))
    expected = {}
    for doc_id, text, _ in rows:
        vector = unit(slow(text))
        cosines = {lang: float(vector @ unit(total)) for lang, total in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        expected[doc_id] = (best, max(cosines[best], 0)) if vector.any() else ("und", 0.0)
    for r in langid.predict_languages(documents(rows)).collect():
        assert r.lang_pred == expected[r.doc_id][0]
        assert abs(r.score - expected[r.doc_id][1]) < 1e-4


def test_limits_do_not_jump_with_a_document():
    """A language with few documents has nearly the limit of all, one with many its own."""
    common = [0.5 + 0.001 * i for i in range(400)]
    few = [langid._low([0.2] * n, common) for n in range(60)]
    assert few[0] == common[3] and langid._low([0.9] * 3000, common) > 0.89
    assert all(x >= y for x, y in zip(few, few[1:], strict=False))


def test_limits_are_learned_from_all_documents(spark, documents, monkeypatch):
    """Against quantiles of cosines of every labelled document, with far more than a sample holds."""
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    rows = [
        (r.doc_id, (r.text or "")[:150], r.lang)
        for r in given.orderBy("doc_id").limit(300).collect()
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2
    ]
    unit = {}
    for doc_id, text, _ in rows:
        (vector,), _ = langid.document_vectors([text])
        unit[doc_id] = vector.astype(float) / (np.linalg.norm(vector) or 1)
    sums = {}
    for doc_id, _, lang in rows:
        sums[lang] = sums.get(lang, 0) + unit[doc_id]
    table = documents(rows).repartition(3)
    got = langid._sums(table)
    assert sorted(got) == sorted(sums)
    assert all(np.abs(got[lang] - sums[lang]).max() < 1e-6 for lang in sums)

    own, common = {}, {}
    for doc_id, text, lang in rows:
        others = sums[lang] - unit[doc_id]
        cuts = [text, *(text[: 1 << k] for k in range(2, 9) if 1 << k < len(text))]
        vectors, sizes = langid.document_vectors(cuts)
        powers = {}
        for vector, size in zip(vectors.astype(float), sizes.tolist(), strict=True):
            if size:
                cosine = vector @ others / np.linalg.norm(vector) / np.linalg.norm(others)
                powers.setdefault(size.bit_length() - 1, cosine)
        for power, cosine in powers.items():
            own.setdefault((lang, power), []).append(cosine)
            common.setdefault(power, []).append(cosine)
    limits = langid._limits(table, got)
    for lang in sums:
        limit = langid.CHANCE
        for power, found in enumerate(limits[lang]):
            if power in common:
                limit = max(limit, langid._low(own.get((lang, power), []), common[power]))
            assert abs(found - limit) < 2 / langid.STEPS

    # The judge is the sum of all, not of a few of each language.
    seen = []
    given_sums = langid._sums
    monkeypatch.setattr(langid, "_sums", lambda some: seen.append(some.count()) or given_sums(some))
    langid.accepted(table).count()
    assert seen == [len(rows)]
