from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows."""

    def build(rows, schema: str = DOCUMENTS):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest folder."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
