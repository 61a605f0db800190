"""Quality rules: counts with fixed limits, and divergence from what a language looks like.

Two histograms of a document are compared with those of every language: classes of
characters, and the most common words of the language with one bin for all other words.
The distance is Jensen and Shannon's (root of the divergence in bits, 0 to 1), to the
nearest language. Short texts stray from any reference by chance: a histogram counts only
from a least length on, and the distance that so many draws from the reference would have
on average is granted on top of the limit.

References are sums over all documents with a language. A task sends one row per
language and different word of a batch, and only the top words of each language go on.

Defined results: a NULL text has no words; without any reference, or below the least
lengths, only the fixed limits decide; repeated rows are judged alike; an empty table
gives no rows; columns other than ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.llm.text import (
    LEADING,
    SEPARATOR,
    bound_batches,
    byte_span_hashes,
    mix,
    slices,
    text_buffers,
    windows_of,
    words_of,
)

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW_WORDS = 5

COMMON_WORDS = 64
CHARACTER_LIMIT = 0.3
WORD_LIMIT = 0.265
LEAST_CHARACTERS = 200
LEAST_COMPARED_WORDS = 50

# Classes of characters: lower case, upper case, digits, blanks, other separators, common
# punctuation, other ASCII, all beyond ASCII (counted by their first byte), rest.
CLASSES = 9
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[0x20] = 3
_CLASS[0x09 : 0x0D + 1] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[0x80:0xC0] = 8
_CLASS[0xC0:] = 7

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER_OR_DIGIT = np.isin(_CLASS, (0, 1, 2, 7, 8))


@dataclass
class References:
    """Histograms of each language, as shares; word bins are the hashes in ``vocabulary``."""

    languages: list[str]
    characters: np.ndarray
    vocabulary: np.ndarray  # sorted
    words: list[tuple[np.ndarray, np.ndarray]]  # per language: places in vocabulary, shares


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _class_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    texts = len(bounds) - 1
    row = np.repeat(np.arange(texts) * CLASSES, np.diff(bounds))
    counts = np.bincount(row + _CLASS[data], minlength=texts * CLASSES)
    return counts.reshape(texts, CLASSES)[:, : CLASSES - 1]


def _bare_word_hashes(words) -> np.ndarray:
    """Hashes of words with A-Z folded and without ASCII marks at their ends."""
    data = words.data
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    # Nearest letter or digit at or after each start, and before each end.
    spots = np.flatnonzero(_LETTER_OR_DIGIT[data])
    spots = np.append(spots, len(data))
    starts = np.minimum(spots[np.searchsorted(spots, words.starts)], words.ends)
    before = np.searchsorted(spots, words.ends) - 1
    ends = np.where(before >= 0, spots[np.maximum(before, 0)] + 1, 0)
    ends = np.maximum(np.minimum(ends, words.ends), starts)
    return byte_span_hashes(data, starts, ends, fold_case=True)


def _reference_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word hash or class, count) of each batch; the last class holds the number of words."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = {name: i for i, name in enumerate(names)}
        classes = np.zeros((len(names), CLASSES), np.int64)
        found: list[list[np.ndarray]] = [[] for _ in names]
        row = 0
        for some in slices(batch, "text"):
            data, bounds = text_buffers(some.column("text"))
            of = np.array([number[x] for x in langs[row : row + some.num_rows]])
            row += some.num_rows
            words = words_of(data, bounds)
            hashes = _bare_word_hashes(words)
            np.add.at(classes[:, :-1], of, _class_counts(data, bounds))
            np.add.at(classes[:, -1], of, words.counts)
            lang_of_word = np.repeat(of, words.counts)
            for i in range(len(names)):
                found[i].append(hashes[lang_of_word == i])
        for i, name in enumerate(names):
            keys, counts = np.unique(np.concatenate(found[i]), return_counts=True)
            keys = np.concatenate([keys.view(np.int64), np.arange(CLASSES)])
            kinds = np.concatenate([np.ones(len(counts), bool), np.zeros(CLASSES, bool)])
            counts = np.concatenate([counts, classes[i]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(keys), pa.string()),
                    pa.array(kinds),
                    pa.array(keys),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["lang", "is_word", "bin", "n"],
            )


def references(docs: DataFrame, common_words: int = COMMON_WORDS) -> References:
    """The histograms of all documents of each language.

    ``common_words`` + 9 rows per language come to the driver.
    """
    bound_batches(docs.sparkSession)
    counted = (
        docs.where(F.col("lang").isNotNull())
        .select("lang", "text")
        .mapInArrow(_reference_counts, "lang string, is_word boolean, bin long, n long")
        .groupBy("lang", "is_word", "bin")
        .agg(F.sum("n").alias("n"))
    )
    top = Window.partitionBy("lang", "is_word").orderBy(F.desc("n"), "bin")
    kept = counted.withColumn("place", F.row_number().over(top)).where(
        F.col("place") <= max(common_words, CLASSES)
    )
    rows = kept.where(~F.col("is_word") | (F.col("place") <= common_words)).collect()
    languages = sorted({r.lang for r in rows})
    classes = np.zeros((len(languages), CLASSES))
    words: list[dict[int, int]] = [{} for _ in languages]
    for r in rows:
        i = languages.index(r.lang)
        if r.is_word:
            words[i][r.bin] = r.n
        else:
            classes[i, r.bin] = r.n
    usable = [i for i in range(len(languages)) if classes[i, :-1].sum() and classes[i, -1]]
    vocabulary = np.unique(np.array([w for i in usable for w in words[i]], np.int64).view(np.uint64))
    shares = []
    for i in usable:
        own = sorted(words[i].items())
        places = np.searchsorted(vocabulary, np.array([w for w, _ in own], np.int64).view(np.uint64))
        shares.append((places, np.array([n for _, n in own]) / classes[i, -1]))
    characters = classes[usable][:, :-1]
    characters = characters / characters.sum(axis=1, keepdims=True)
    return References([languages[i] for i in usable], characters, vocabulary, shares)


def _entropy(p: np.ndarray) -> np.ndarray:
    return -np.sum(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0), axis=-1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of shares ``p`` to the shares ``q``."""
    divergence = _entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2
    return np.sqrt(np.clip(divergence, 0, 1))


def granted(bins: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Mean divergence, in bits, of ``draws`` draws from a histogram with ``bins`` bins to itself."""
    return (bins - 1) / (8 * np.log(2) * np.maximum(draws, 1))


def _nearest(counts: list[np.ndarray], shares: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distance to the nearest language, number of its bins) of each text."""
    total = counts[0].sum(axis=1)
    p = [c / np.maximum(total, 1)[:, None] for c in counts]
    apart = np.array([distance(a, q) for a, q in zip(p, shares, strict=True)])
    bins = np.array([c.shape[1] for c in counts])
    return apart.min(axis=0), bins[apart.argmin(axis=0)]


def _word_bins(words, vocabulary: np.ndarray) -> np.ndarray:
    """For each text, how often each word of the vocabulary occurs."""
    texts = len(words.bounds) - 1
    hashes = _bare_word_hashes(words)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    row = np.repeat(np.arange(texts), words.counts)[known]
    counts = np.bincount(row * len(vocabulary) + at[known], minlength=texts * len(vocabulary))
    return counts.reshape(texts, -1)


def _repeated_lines(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = data == 0x0A
    inside = np.flatnonzero(breaks)
    # A line begins at its text's begin and behind a break, and ends at a break or the text's end.
    starts = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], inside + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(len(bounds) - 1, np.int64)
    ends = np.append(starts[1:], len(data))
    ends = ends - breaks[ends - 1]
    text = np.searchsorted(bounds, starts, "right") - 1
    wordy = np.concatenate([[0], np.cumsum(~SEPARATOR[data])])
    kept = wordy[ends] > wordy[starts]
    starts, ends, text = starts[kept], ends[kept], text[kept]
    keys = byte_span_hashes(data, starts, ends) ^ mix(text.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    repeated = np.ones(len(keys), dtype=bool)
    repeated[first] = False
    return np.bincount(text[repeated], minlength=len(bounds) - 1)


def _repeated_words(words) -> np.ndarray:
    """Words in runs of ``WINDOW_WORDS`` that the text holds twice or more."""
    n = len(words.starts)
    text = np.repeat(np.arange(len(words.bounds) - 1), words.counts)
    windows = windows_of(words.hashes(), WINDOW_WORDS)
    if not len(windows):
        return np.zeros(len(words.bounds) - 1, np.int64)
    begin = np.flatnonzero(text[: len(windows)] == text[WINDOW_WORDS - 1 :])
    keys = windows[begin] ^ mix(text[begin].astype(np.uint64))
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = begin[count[which] > 1]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW_WORDS, -1)
    return np.bincount(text[np.cumsum(edges[:-1]) > 0], minlength=len(words.bounds) - 1)


def measure(column: pa.Array, refs: References) -> dict[str, np.ndarray]:
    """The counts, distances and verdicts of a column of texts."""
    data, bounds = text_buffers(column)
    words = words_of(data, bounds)
    n_words = words.counts
    out = {
        "n_words": n_words,
        "word_chars": _per_text(LEADING[data] & ~SEPARATOR[data], bounds),
        "n_symbols": _per_text(SYMBOL[data], bounds),
        "n_dup_lines": _repeated_lines(data, bounds),
        "n_repeat_words": _repeated_words(words),
    }
    failed = (n_words < LEAST_WORDS) | (
        100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * n_words
    )
    strange = np.zeros(len(n_words), dtype=bool)
    nothing = np.full(len(n_words), np.nan)
    by_character, by_word = nothing, nothing
    if refs.languages:
        classes = _class_counts(data, bounds)
        characters = classes.sum(axis=1)
        by_character, bins = _nearest([classes] * len(refs.languages), list(refs.characters))
        limit = CHARACTER_LIMIT**2 + granted(bins, characters)
        strange |= (characters >= LEAST_CHARACTERS) & (by_character**2 > limit)

        found = _word_bins(words, refs.vocabulary)
        counts, shares = [], []
        for places, share in refs.words:
            own = found[:, places]
            counts.append(np.column_stack([own, n_words - own.sum(axis=1)]))
            shares.append(np.append(share, max(0.0, 1 - share.sum())))
        by_word, bins = _nearest(counts, shares)
        limit = WORD_LIMIT**2 + granted(bins, n_words)
        strange |= (n_words >= LEAST_COMPARED_WORDS) & (by_word**2 > limit)
        by_character = np.where(characters > 0, by_character, np.nan)
        by_word = np.where(n_words > 0, by_word, np.nan)
    return out | {
        "base_failed": failed,
        "kept": ~failed & ~strange,
        "character_distance": by_character,
        "word_distance": by_word,
    }


MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean",
    "character_distance": "double", "word_distance": "double",
}


def _judged(batches: Iterator[pa.RecordBatch], refs: References) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "text"):
            found = measure(some.column("text"), refs)
            columns = [some.column(i) for i in range(some.num_columns)]
            columns += [pa.array(found[name], from_pandas=True) for name in MEASURES]
            yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names, *MEASURES])


def judge(docs: DataFrame, refs: References) -> DataFrame:
    """``docs`` with the columns of ``MEASURES``; columns of these names are replaced.

    A distance is NULL if there is nothing to compare.
    """
    bound_batches(docs.sparkSession)
    kept = docs.drop(*MEASURES)
    schema = StructType(list(kept.schema.fields))
    for name, kind in MEASURES.items():
        schema.add(name, kind)
    return kept.mapInArrow(partial(_judged, refs=refs), schema)


def judge_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all measures of every document, against references from all of them."""
    judged = judge(docs.select("doc_id", "text"), references(docs.select("lang", "text")))
    return judged.select("doc_id", *MEASURES)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    others = [F.col(f"`{name}`") for name in docs.columns if name != "text"]
    judged = judge(
        docs.select(F.struct(*others).alias("row"), "text"), references(docs.select("lang", "text"))
    )
    return judged.where("kept").select(
        *[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
