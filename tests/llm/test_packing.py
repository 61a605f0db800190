from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm.packing import cut, differencing, pack, windows_for
from ledgerline.llm.queries import QUERIES
from ledgerline.llm.tokens import Encoder, tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def check_pieces(pieces, texts, plain, capacity=1024):
    """Every id in exactly one piece, sequences gapless and within capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array([*plain(texts[doc] or ""), 0], "<u4")
        position = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == position and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            position += p.length
        assert position == len(ids)
    for own in by_sequence.values():
        position = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == position
            position += p.length
        assert position <= capacity
    return len(by_sequence)


def test_query_holds_every_id_once_with_little_padding(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pieces = QUERIES["op9_packing"](spark, FOLDER).collect()
    sequences = check_pieces(pieces, texts, plain)
    tokens = sum(p.length for p in pieces)
    assert sequences * 1024 <= 1.02 * tokens + 1024


def test_odd_documents(spark, documents, plain):
    texts = {1: None, 2: "", 3: "x" * 50_000, 4: "<|endoftext|>", 5: "été 中文 'll", 6: " \n "}
    docs = documents(list(texts.items()))
    clashing = docs.selectExpr("*", "1 AS start", "'a' AS sequence_id", "2 AS length")
    for table in (docs, clashing):
        check_pieces(pack(table).collect(), texts, plain)
    assert pack(documents([])).count() == 0
    twice = pack(documents([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert Counter(p.doc_id for p in twice) == {1: 2, None: 1}
    assert len({(p.sequence_id, p.offset) for p in twice}) == 3


def test_ids_are_returned_on_request(documents, plain):
    row = pack(documents([(1, "hello there")]), with_ids=True).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*plain("hello there"), 0]


def test_differencing_is_even_and_window_count_rises():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 257, 600)
    window = differencing(sizes, 100)
    sums = np.bincount(window, sizes, 100)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 8
    # Three pieces of 600 would fill two windows by volume, but need three.
    assert len(set(windows_for(np.array([600, 600, 600]), 1024).tolist())) == 3
    assert differencing(np.array([5]), 4).tolist() == [0]
    assert cut(1024, 1024, 256) == [(0, 1024)]
    assert cut(1300, 1024, 256) == [(0, 1024), (1024, 256), (1280, 20)]


def test_pieces_give_the_ids_of_the_tokenizer():
    random.seed(1)
    alphabet = "ab'srtvemld  \n\t1!é-.\x85L\xa0́中"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(5000)]
    own = Encoder(tokenizer_path())
    for part in (texts[:2500], texts[2500:], texts):
        for mine, theirs in zip(own.encode(part), own._direct(part), strict=True):
            assert mine.tolist() == theirs.tolist()
