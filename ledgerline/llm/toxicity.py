"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel of two strings sums over all sequences of ``LENGTH`` symbols that both hold, also
with gaps: an occurrence with k other symbols inside counts DECAY**k, up to ``MOST_GAPS``.
So an insult with inserted, doubled or starred characters still shares most of its
sequences with the plain one. Symbols are letters without case and accents, common digit
and sign substitutes as the letters they stand for, and one blank for all that lies
between words; letters set apart one by one are joined.

Nyström's method maps a string to its kernel values with ``LANDMARKS`` words of the
training texts, whitened by the landmarks' own kernel: words typical of toxic texts, up to
three quarters of them, and frequent words of the others. A linear machine on that map is
a sum of one weight per sequence, so scoring a text takes a look-up per gap pattern and
position, no landmark.

Labels are given per document, but a few words make it toxic: the machine is trained in
rounds on the highest windows, of ``WINDOW`` positions, of toxic and of other documents
(multiple-instance learning). A logistic curve over the values of a document's
``TOP_WINDOWS`` highest windows, fitted on documents kept apart, gives its score.

Training reads at most ``PER_LABEL`` documents of either label, those with the least
hashes of their ids, and of these only texts of up to ``LONGEST_TRAINING_TEXT`` characters;
they are fitted on the driver. Every document is scored, over its whole text.

Defined results: a NULL or empty text has the score of a text without any sequence; if the
labels do not show both kinds, all scores are 0; repeated rows are scored alike; an empty
table gives none; of the documents only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.llm.sampling import held_out, per_label, texts_of
from ledgerline.llm.text import bound_batches, slices

LENGTH = 4
MOST_GAPS = 2
DECAY = 0.5
WINDOW = 8
TOP_WINDOWS = 3
LANDMARKS = 320
ROUNDS = 4
# A landmark typical of toxic texts is in so many of them, and in so many standard
# deviations more than its share of all texts would give.
LEAST_SUPPORT = 3
LEAST_SURPLUS = 4.0
PER_LABEL = 1500
LONGEST_TRAINING_TEXT = 20_000
THRESHOLD = 0.3

_BITS = 5
_CODES = 1 << (_BITS * LENGTH)
_BLANK, _OTHER_LETTER, _DIGIT = 0, 27, 28
# Signs that stand for letters inside words (fixed values).
_SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@cache
def _symbols_of_codes() -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each code point, symbol it stands for between letters or 0)."""
    table = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()
            table[code] = ord(base) - ord("a") + 1 if "a" <= base <= "z" else _OTHER_LETTER
        elif c.isdigit():
            table[code] = _DIGIT
    inside = np.zeros(0x10000, np.uint8)
    for sign, letter in _SUBSTITUTES.items():
        inside[ord(sign)] = ord(letter) - ord("a") + 1
    return table, inside


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, with a blank at either end."""
    codes = np.frombuffer(f" {text} ".encode("utf-16-le", "replace"), np.uint16)
    table, inside = _symbols_of_codes()
    found = table[codes]
    letter = (found > 0) & (found != _DIGIT)
    between = np.zeros(len(found), dtype=bool)
    between[1:-1] = letter[:-2] & letter[2:]
    stands = inside[codes]
    found = np.where(between & (stands > 0), stands, found)
    blank = found == _BLANK
    found = found[~(blank & np.concatenate([[False], blank[:-1]]))]
    # Single letters in a row are one word: their blanks go.
    blank = found == _BLANK
    alone = np.zeros(len(found), dtype=bool)
    alone[1:-1] = ~blank[1:-1] & blank[:-2] & blank[2:]
    joint = np.zeros(len(found), dtype=bool)
    joint[1:-1] = blank[1:-1] & alone[:-2] & alone[2:]
    return found[~joint].astype(np.int32)


def gap_patterns() -> list[tuple[tuple[int, ...], float]]:
    """(distances between neighbours, weight) of every way to place up to ``MOST_GAPS`` gaps."""
    found = [
        (a, b, c)
        for a in range(1, MOST_GAPS + 2)
        for b in range(1, MOST_GAPS + 2)
        for c in range(1, MOST_GAPS + 2)
        if a + b + c <= LENGTH - 1 + MOST_GAPS
    ]
    return [(steps, DECAY ** (sum(steps) - LENGTH + 1)) for steps in found]


def _codes(s: np.ndarray, steps: tuple[int, ...], pairs: dict[int, np.ndarray]) -> np.ndarray:
    """The code of the sequence that begins at each position, as far as the string reaches."""
    a, b, c = steps
    for step in (a, c):
        if step not in pairs:
            pairs[step] = (s[: len(s) - step] << _BITS) | s[step:]
    n = len(s) - a - b - c
    return (pairs[a][:n] << (2 * _BITS)) | pairs[c][a + b : a + b + n]


def sequences(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of all sequences of a short string, summed by code."""
    codes, weights, pairs = [], [], {}
    for steps, weight in gap_patterns():
        if len(s) > sum(steps):
            found = _codes(s, steps, pairs)
            codes.append(found)
            weights.append(np.full(len(found), weight))
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0)
    different, which = np.unique(np.concatenate(codes), return_inverse=True)
    return different, np.bincount(which, np.concatenate(weights))


def position_values(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each position, the summed weights of the sequences that begin there."""
    total = np.zeros(len(s), np.float32)
    pairs: dict[int, np.ndarray] = {}
    for steps, weight in gap_patterns():
        if len(s) > sum(steps):
            found = weights[_codes(s, steps, pairs)]
            total[: len(found)] += np.float32(weight) * found
    return total


def window_values(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of position values over the window that begins at each position."""
    sums = np.concatenate([[0.0], np.cumsum(position_values(s, weights), dtype=np.float64)])
    ends = np.minimum(np.arange(len(s)) + WINDOW, len(s))
    return sums[ends] - sums[:-1]


def highest(values: np.ndarray, count: int) -> tuple[list[int], np.ndarray]:
    """(begins, values) of the highest windows that do not overlap and differ from each other.

    Values below 0 count as 0, and so do missing ones; equal values are one repeated window.
    """
    left = values.copy()
    begins, found = [], np.zeros(count)
    for i in range(count):
        at = int(left.argmax())
        value = left[at]
        if value == -np.inf:
            break
        begins.append(at)
        found[i] = max(0.0, value)
        left[max(0, at - WINDOW) : at + WINDOW] = -np.inf
        left[np.abs(left - value) < 1e-6] = -np.inf
    return begins, found


def document_values(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What a document is judged by: the values of its highest windows."""
    return highest(window_values(s, weights), TOP_WINDOWS)[1]


# --- training -------------------------------------------------------------------


@dataclass
class Curve:
    """From the values of the highest windows to a score.

    Either all of them together are as in toxic documents, by a logistic curve, or the
    first alone is clearly higher than in any clean document of the training.
    """

    slopes: np.ndarray
    offset: float
    high: float
    steepness: float

    def __call__(self, values: np.ndarray) -> np.ndarray:
        together = values @ self.slopes + self.offset
        alone = (values[:, 0] - self.high) * self.steepness
        return 1 / (1 + np.exp(-np.clip(np.maximum(together, alone), -50, 50)))


@dataclass
class Model:
    """One weight per sequence, and the curve from window values to scores."""

    weights: np.ndarray
    curve: Curve

    def score(self, texts: list[str]) -> np.ndarray:
        values = [document_values(symbols(t), self.weights) for t in texts]
        return self.curve(np.array(values).reshape(len(texts), TOP_WINDOWS))


class _Landmarks:
    """The landmark words, and the map from sequences to their whitened kernel values."""

    def __init__(self, words: list[tuple[int, ...]]):
        parts = [sequences(np.array(w, np.int32)) for w in words]
        self.codes = np.unique(np.concatenate([c for c, _ in parts]))
        self.values = np.zeros((len(self.codes), len(words)))
        self.norms = np.array([np.linalg.norm(weights) for _, weights in parts])
        for j, (codes, weights) in enumerate(parts):
            self.values[np.searchsorted(self.codes, codes), j] = weights / self.norms[j]
        roots, vectors = np.linalg.eigh(self.values.T @ self.values)
        kept = roots > 1e-6 * roots.max()
        self.whitening = vectors[:, kept] / np.sqrt(roots[kept])

    def features(self, strings: list[np.ndarray]) -> np.ndarray:
        kernel = np.zeros((len(strings), self.values.shape[1]))
        for i, s in enumerate(strings):
            codes, weights = sequences(s)
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            known = self.codes[at] == codes
            kernel[i] = weights[known] @ self.values[at[known]]
        return kernel @ self.whitening

    def weights_of_sequences(self, machine: np.ndarray) -> np.ndarray:
        """The linear machine on features, as a weight for every code."""
        table = np.zeros(_CODES, np.float32)
        table[self.codes] = self.values @ (self.whitening @ machine)
        return table


def _words(s: np.ndarray) -> set[tuple[int, ...]]:
    """Words of at least three letters, with their blanks."""
    at = np.flatnonzero(s == _BLANK)
    ends = zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
    return {tuple(s[a : b + 1].tolist()) for a, b in ends if b - a > 3}


def _landmark_words(
    toxic: list[np.ndarray], clean: list[np.ndarray]
) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """(landmarks, how typical of toxic documents each is).

    First the words that more toxic documents hold than chance would have it, by their
    surplus in standard deviations, then the most frequent words of the others, with 0.
    """
    found = [Counter(w for s in texts for w in _words(s)) for texts in (toxic, clean)]
    rates = [len(toxic), len(clean)]

    def surplus(word: tuple[int, ...]) -> float:
        p, q = (found[i][word] / rates[i] for i in (0, 1))
        mean = (found[0][word] + found[1][word] + 1) / (sum(rates) + 2)
        return (p - q) / np.sqrt(mean * (1 - mean) * (1 / rates[0] + 1 / rates[1]))

    scored = sorted((-surplus(w), w) for w, n in found[0].items() if n >= LEAST_SUPPORT)
    typical: dict[tuple[int, ...], float] = {}
    for negative, word in scored:
        if len(typical) == 3 * LANDMARKS // 4 or -negative < LEAST_SURPLUS:
            break
        typical[word] = -negative
    usual = [w for _, w in sorted((-n, w) for w, n in found[1].items()) if w not in typical]
    words = [*typical, *usual][:LANDMARKS]
    return words, np.array([typical.get(w, 0.0) for w in words])


def _machine(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; the last one is the bias.

    The classes' costs are halfway, as roots, between equal examples and equal classes.
    Newton's method: each step solves for the examples inside the margin.
    """
    x = np.column_stack([x, np.ones(len(x))])
    cost = np.sqrt(np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())))
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    inside = np.ones(len(y), dtype=bool)
    for _ in range(30):
        weighted = x[inside] * cost[inside, None]
        w = np.linalg.solve(ridge + weighted.T @ x[inside], weighted.T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def _curve(values: np.ndarray, toxic: np.ndarray, share: float) -> Curve:
    slopes, offset = _logistic(values, toxic, share)
    clean = values[~toxic, 0]
    # From the highest clean value, a quarter of the way to the usual toxic one, if that is higher.
    way = max(0.0, float(np.median(values[toxic, 0]) - clean.max()))
    width = 0.1 * float(clean.std()) + 0.05 * way
    return Curve(slopes, offset, float(clean.max()) + way / 4, 1 / max(width, 1e-6))


def _logistic(values: np.ndarray, toxic: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Slopes and offset of P(toxic | values), for toxic documents being ``share`` of all."""
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    # Targets a little inside 0 and 1 keep the curve finite if the labels can be parted.
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    scale = max(values.std(), 1e-9)
    x = np.column_stack([values / scale, np.ones(len(values))])
    ridge = np.diag([1e-2] * values.shape[1] + [1e-4])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (weight * (p - target)) + ridge @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 3 / max(np.abs(step).max(), 1e-9))
    return w[:-1] / scale, float(w[-1])


def _windows(s: np.ndarray, weights: np.ndarray, count: int, least: float) -> list[np.ndarray]:
    """The highest windows of a text, the first in any case, others from a value of ``least`` on."""
    begins, values = highest(window_values(s, weights), count)
    return [
        s[at : at + WINDOW + LENGTH - 1 + MOST_GAPS]
        for i, at in enumerate(begins)
        if i == 0 or values[i] >= least
    ]


def _with_insertion(window: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The window with some symbol inserted between two of its letters, if it has a pair of them."""
    letters = window != _BLANK
    pairs = np.flatnonzero(letters[1:] & letters[:-1]) + 1
    if not len(pairs):
        return window
    return np.insert(window, rng.choice(pairs), rng.integers(0, _OTHER_LETTER))


def fit(texts: list[str], toxic: list[bool], share: float) -> Model:
    """The model of labelled texts; ``share`` of all documents are toxic."""
    strings = [symbols(t) for t in texts]
    labels = np.array(toxic, dtype=bool)
    # Every fourth text of either label shapes the curve only, if there are enough.
    apart = np.zeros(len(labels), dtype=bool)
    if min(labels.sum(), (~labels).sum()) >= 80:
        for kind in (labels, ~labels):
            apart[np.flatnonzero(kind)[::4]] = True
    bad = [s for s, t, a in zip(strings, labels, apart, strict=True) if t and not a]
    good = [s for s, t, a in zip(strings, labels, apart, strict=True) if not t and not a]
    words, typical = _landmark_words(bad, good)
    if not words:
        flat = Curve(np.zeros(TOP_WINDOWS), float(np.log(share / (1 - share))), 1.0, 1.0)
        return Model(np.zeros(_CODES, np.float32), flat)
    landmarks = _Landmarks(words)
    weights = np.zeros(_CODES, np.float32)
    # To begin with, a window is worth its likeness to the typical words.
    weights[landmarks.codes] = landmarks.values @ (typical / landmarks.norms)
    against: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    for s in good:
        for at in rng.integers(0, max(1, len(s) - WINDOW), 3):
            against.append(s[at : at + WINDOW + LENGTH - 1 + MOST_GAPS])
    least = 0.5 * typical.max()
    for _ in range(ROUNDS):
        against += [w for s in good for w in _windows(s, weights, 2, -np.inf)]
        pro = [w for s in bad for w in _windows(s, weights, 5, least)]
        pro += [_with_insertion(w, rng) for w in pro]
        x = landmarks.features(pro + against)
        y = np.concatenate([np.ones(len(pro)), -np.ones(len(against))])
        machine = _machine(x, y)
        weights = landmarks.weights_of_sequences(machine[:-1])
        least = -machine[-1]  # the boundary
    used = apart if apart.any() else np.ones(len(labels), dtype=bool)
    values = np.array([document_values(s, weights) for s, u in zip(strings, used, strict=True) if u])
    return Model(weights, _curve(values, labels[used], share))


# --- Spark ----------------------------------------------------------------------


def learn(docs: DataFrame, labels: DataFrame, per_label_count: int = PER_LABEL) -> Model | None:
    """The model of a bounded sample of labelled documents; None without both labels."""
    known = labels.where(F.col("toxic").isin(0, 1))
    counts = dict(known.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    short = docs.where(F.length("text") <= LONGEST_TRAINING_TEXT)
    sample = texts_of(short, per_label(known, "toxic", per_label_count)).collect()
    rows = sorted((r.doc_id, r.text, r.toxic == 1) for r in sample)
    marks = [t for _, _, t in rows]
    if all(marks) or not any(marks):
        return None
    return fit([t for _, t, _ in rows], marks, counts[1] / (counts[0] + counts[1]))


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "text"):
            scores = np.zeros(some.num_rows)
            if model is not None:
                scores = model.score([t or "" for t in some.column("text").to_pylist()])
            columns = [some.column(i) for i in range(some.num_columns)]
            columns += [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names, "score", "predicted"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    bound_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    schema = StructType(list(kept.schema.fields)).add("score", "double").add("predicted", "integer")
    return kept.mapInArrow(partial(_scored, model=model), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
