from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm.queries import QUERIES
from ledgerline.llm.token_spans import attribute, count_tokens
from ledgerline.llm.tokens import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


def brute(text: str, tokenizer) -> list[tuple]:
    """(start, end, tokens) of each line, byte by byte."""
    spans, start = [], 0
    for line in text.splitlines(keepends=True) if "\n" in text else [text]:
        spans.append((start, start + len(line)))
        start += len(line)
    owner_of_byte = [i for i, (a, b) in enumerate(spans) for _ in text[a:b].encode()]
    counts, position = [0] * len(spans), 0
    sizes = {i: len(t) for t, i in tokenizer.get_vocab().items()}
    for i in tokenizer.encode(text, add_special_tokens=False).ids:
        held = owner_of_byte[position : position + sizes[i]]
        counts[max(sorted(set(held)), key=held.count)] += 1
        position += sizes[i]
    return [(*span, n) for span, n in zip(spans, counts, strict=True)]


def check(rows, texts, tokenizer):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.section)):
        found[r.doc_id].append((r.start_char, r.end_char, r.tokens))
        assert r.section == len(found[r.doc_id]) - 1 and r.crossing_tokens <= r.tokens
        assert r.doc_tokens == len(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
    assert {k: brute(t or "", tokenizer) for k, t in texts.items()} == found


def test_query_counts_every_token_once(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    # Other line breaks are no section ends; the data has none.
    assert not any(c in t for t in texts.values() for c in "\r\x0b\x0c\x85 ")
    check(QUERIES["op8_token_spans"](spark, FOLDER).collect(), texts, tokenizer)


def test_odd_documents(documents, tokenizer):
    texts = {1: None, 2: "", 3: "\n", 4: "a\n\n\n\nb", 5: "é中\nxx  \n  y", 6: "q" * 30_000, 7: "a\n"}
    check(count_tokens(documents(list(texts.items()))).collect(), texts, tokenizer)
    clashing = documents([(1, "a\nb")]).selectExpr("*", "1 AS tokens", "2 AS section")
    assert [r.tokens for r in count_tokens(clashing).collect()] == [2, 1]
    assert count_tokens(documents([])).count() == 0
    assert count_tokens(documents([(1, "a"), (1, "a"), (None, "a")])).count() == 3


def test_crossing_tokens_go_to_the_larger_part_then_the_earlier():
    # Sections [0, 4), [4, 6), [6, 10).
    starts = np.array([0, 4, 6])
    tokens, shared = attribute(np.array([3, 2, 5]), starts, 10)
    assert tokens.tolist() == [2, 0, 1] and shared.tolist() == [1, 0, 1]
    tokens, shared = attribute(np.array([10]), starts, 10)
    assert tokens.tolist() == [1, 0, 0] and shared.tolist() == [1, 0, 0]


def test_other_sections(documents):
    halves = lambda data: np.array([0, len(data) // 2]) if len(data) > 1 else np.array([0])
    rows = count_tokens(documents([(1, "one two three four")]), sections=halves).collect()
    assert [(r.start_char, r.end_char) for r in rows] == [(0, 9), (9, 18)]
    assert sum(r.tokens for r in rows) == rows[0].doc_tokens == 4
