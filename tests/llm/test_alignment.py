from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.alignment import Alignment, _byte_values
from ledgerline.llm.piece_tokens import DEFAULT_PIECES, piece_encoder
from ledgerline.llm.tokens import tokenizer_path
from ledgerline.sources.workspace import Workspace

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """Every pair of tokens of every document compared, by the tokenizers' own whole encodings."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    values = _byte_values()
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(DEFAULT_PIECES))

    def spelled_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(parts):
        at, out = 0, []
        for part in parts:
            out.append((at, at + len(part)))
            at += len(part)
        return out

    links, found = {}, {}
    for n, (_, text) in enumerate(rows):
        links[n], found[n] = [], (0, 0, 0, "")
        if not text:
            continue
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(values[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [spelled_b(i) for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links[n] = [
            (i, j) for i, (s, e) in zip(ids_a, at_a, strict=True)
            for j, (t, f) in zip(ids_b, at_b, strict=True) if s < f and t < e
        ]
        common = sorted({e for _, e in at_a} & {f for _, f in at_b})
        groups, start = [], 0
        for end in common:
            left = [str(i) for i, (s, e) in zip(ids_a, at_a, strict=True) if start <= s and e <= end]
            right = [str(j) for j, (s, e) in zip(ids_b, at_b, strict=True) if start <= s and e <= end]
            groups.append(f"{','.join(left)}|{','.join(right)}")
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        found[n] = (len(ids_a), len(ids_b), len(common), digest)
    counts = Counter(link for some in links.values() for link in some)
    best = Counter()
    for (_, j), count in counts.items():
        best[j] = max(best[j], count)
    return Counter(
        (doc_id, n_a, n_b, groups, len(links[n]), sum(counts[x] == best[x[1]] for x in links[n]),
         sum(counts[x] for x in links[n]), digest)
        for n, (doc_id, _) in enumerate(rows) for n_a, n_b, groups, digest in [found[n]]
    )


ROWS = [
    (1, "The quick brown fox's den, isn't it?"), (2, None), (3, ""), (4, " "), (5, "a  b   "),
    (6, "x▁y"), (7, "<s> <|endoftext|> <0x41> [UNK]"), (8, "naïve café straße 日本語 🎉 \x00 \t\r\n end"),
    (9, "The quick brown fox's den, isn't it?"), (9, "The quick brown fox's den, isn't it?"),
    (None, "no id here"), (10, "word " * 300), (11, "ab" * 400), (12, "1234567890 3.14159 　 x"),
    (13, "\n\n\n"), (14, "  leading blanks"), (15, "don't  can't\n\n\nwon't"),
]


def digests(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return Alignment(docs, Workspace(spark, "alignment"), **options).digests()


def test_against_brute_force(spark):
    got = digests(spark, ROWS).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute(ROWS)


def test_given_documents(spark, small):
    rows = [(r.doc_id, r.text[:1500]) for r in small.select("doc_id", "text").limit(60).collect()]
    got = digests(spark, rows).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)


def test_counts_are_never_broadcast(spark):
    plan = digests(spark, ROWS)._jdf.queryExecution().executedPlan().toString()
    counted = plan[plan.index("Generate inline"):]
    assert "SortMergeJoin [pairs" in plan and "BroadcastExchange" not in counted


def test_counts_handed_on_early(monkeypatch):
    import pyarrow as pa

    from ledgerline.llm.alignment import _PairCounts

    counts = _PairCounts()
    handed = Counter()
    for n in range(6):
        counts.add(pa.table({"pair": [1, 2, 3 + n], "links": [1, 2, 3]}))
        for row in counts.take(2):
            handed.update(dict(zip(row[-2][0].as_py(), row[-1][0].as_py(), strict=True)))
    for row in counts.take(0):
        handed.update(dict(zip(row[-2][0].as_py(), row[-1][0].as_py(), strict=True)))
    assert handed == {1: 6, 2: 12, **{3 + n: 3 for n in range(6)}}


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Alignment(docs, Workspace(spark, "alignment")).digests().collect() == []
    clashing = spark.createDataFrame(
        [("u", "some text", 7, "x", 1)], "id string, body string, pairs long, links string, row_id int"
    )
    found = Alignment(clashing, Workspace(spark, "alignment"), key="id", text="body").digests().collect()
    assert [(r.id, r.n_groups) for r in found] == [("u", 2)]


def test_groups_cover_the_text(spark, small):
    docs = small.select("doc_id", "text").where("length(text) > 0").limit(20)
    groups = Alignment(docs, Workspace(spark, "alignment")).groups()
    ends = groups.groupBy("doc_id").agg(
        F.max("end_byte").alias("end"), F.sum(F.expr("end_byte - start_byte")).alias("covered")
    )
    sizes = docs.select("doc_id", F.expr("octet_length(text) + 1").alias("size"))
    rows = sizes.join(ends, "doc_id").collect()
    assert len(rows) == docs.count() and all(r.end == r.covered == r.size for r in rows)


def test_very_long_text(spark):
    text = "long words and longer sentences without end, " * 60_000
    row = digests(spark, [(1, text), (2, "short")]).orderBy("doc_id").first()
    assert row.n_a > 400_000 and row.n_links >= row.n_a


@pytest.mark.parametrize("text", ["a b", "  a", "a ", "é  ▁ x\ty", "z" * 300 + "  " + "ab " * 200])
def test_segments_encode_as_the_whole(text):
    import numpy as np

    encode = piece_encoder(tokenizer_path(DEFAULT_PIECES))
    data = np.frombuffer((" " + text).encode(), np.uint8)
    ids, counts = encode.encode_spaced(data, np.array([0, len(data)]))
    assert ids.tolist() == encode.processor.encode(text) and counts.tolist() == [len(ids)]
