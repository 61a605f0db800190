"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of ``DIMENSIONS`` signs. A run of three letters is
the product of its letters' vectors, each rotated by its place, so that order counts. A
document is the sum (bundle) of its runs, a language the sum of its documents' unit
vectors, and a document has the language whose prototype is nearest by cosine. Letters
are lower case; everything between words is one blank, which counts as a letter.

Predictions learn prototypes from a bounded sample: of every language, the ``PER_LANGUAGE``
documents with the least hashes of their ids. Vectors are summed in the tasks and by Spark,
as whole numbers, so that their order does not matter.

What a language accepts is learned from all labelled documents that are not held out, and so
are the prototypes it is judged by: each document, and beginnings of it of doubling length, is
compared with the sum of the others, and the low quantile of these cosines is the limit of
its length, by powers of two of the letter triples. Cosines are counted by steps of
1 / ``STEPS``, and a limit is the lower end of its step. Limits do not
fall with length; lengths that too few documents reach have the limit of the next shorter
one, or none.

Defined results: a text that is NULL or has no letter is ``und`` with score 0, as are all
if nothing could be learned; equal cosines go to the first language by code point;
repeated rows are answered alike; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.llm.sampling import held_out, per_label, texts_of
from ledgerline.llm.text import bound_batches, slices

DIMENSIONS = 1024
PER_LANGUAGE = 400
UNDETERMINED = "und"
# A text is in a language if its cosine is not below this quantile of what documents of the
# language have at its length. That of all languages at the length weighs as much as so many
# documents of its own, so a language with few documents has much the limit of the others.
LOW_QUANTILE = 0.01
COMMON_WEIGHT = 20
# Three standard deviations of the cosine of unrelated vectors: below, a text tells nothing.
CHANCE = 3 / DIMENSIONS**0.5
# Cosines are counted in steps of one of so many parts.
STEPS = 1 << 16
_STEPS_OF_RANGE = 1 << 8
# Components of unit vectors are summed in whole numbers of one of so many parts, which leaves
# room for 2^31 documents; those of a bounded sample in finer ones.
_PARTS_OF_ONE = 1 << 32
_PARTS_IN_SAMPLE = 1 << 44

_ROWS = 256
_GRAMS = 2048
_BLANK = 0x20


@cache
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is none."""
    table = np.full(0x110000, _BLANK, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


# A kilobyte each; vectors follow from their letters, so forgetting one costs time only.
@lru_cache(maxsize=8192)
def _letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Vectors of letter triples: two rotations of the first, one of the second, the third."""
    letters, at = np.unique(
        np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]), return_inverse=True
    )
    vectors = np.stack([_letter_vector(int(c)) for c in letters])
    a, b, c = at.reshape(3, -1)
    bound = np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]
    return bound.astype(np.float32)


def _grams(text: str) -> np.ndarray:
    """The letter triples of a text, those with a letter in the middle."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    letters = _lower_letters()[codes].astype(np.int64)
    blank = letters == _BLANK
    letters = letters[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(letters) < 3:
        return np.zeros(0, np.int64)
    grams = (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]
    return grams[letters[1:-1] != _BLANK]


def document_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the bundle of each text, as a row, and how many runs it sums); zero without a letter."""
    runs = [_grams(t) for t in texts]
    sizes = np.array([len(r) for r in runs], np.int64)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not sizes.any():
        return out, sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    grams, which = np.unique(np.concatenate(runs), return_inverse=True)
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    for first in range(0, len(grams), _GRAMS):
        some = grams[first : first + _GRAMS]
        a, b = np.searchsorted(which, [first, first + len(some)])
        place = row[a:b] * len(some) + which[a:b] - first
        counts = np.bincount(place, minlength=len(texts) * len(some)).reshape(len(texts), -1)
        out += counts.astype(np.float32) @ _gram_vectors(some)
    return out, sizes


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for some in slices(batch, "text"):
        for first in range(0, some.num_rows, _ROWS):
            yield some.slice(first, _ROWS)


def _whole(vectors: np.ndarray, parts: int) -> np.ndarray:
    return np.rint(_unit(vectors).astype(np.float64) * parts).astype(np.int64)


def _bundled(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The sum of unit vectors per language, one row per task and language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for some in _parts(batch):
            vectors, _ = document_vectors([t or "" for t in some.column("text").to_pylist()])
            langs = some.column("lang").to_pylist()
            whole = _whole(vectors, parts)
            for lang in set(langs):
                total = whole[[x == lang for x in langs]].sum(axis=0)
                sums[lang] = sums.get(lang, 0) + total
    for lang, total in sums.items():
        yield pa.RecordBatch.from_pydict(
            {"lang": [lang], "bundle": [total]},
            pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.int64()))]),
        )


def _sums(labelled: DataFrame, parts: int = _PARTS_OF_ONE) -> dict[str, np.ndarray]:
    """The sum of unit vectors of each language; Spark adds those of the tasks by component."""
    rows = (
        labelled.select("text", "lang")
        .mapInArrow(partial(_bundled, parts=parts), "lang string, bundle array<bigint>")
        .select("lang", F.posexplode("bundle").alias("place", "part"))
        .groupBy("lang", "place")
        .agg(F.sum("part").alias("total"))
        .collect()
    )
    sums: dict[str, np.ndarray] = {}
    for lang, place, total in rows:
        sums.setdefault(lang, np.zeros(DIMENSIONS))[place] = total / parts
    return sums


def _prototypes(sums: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    languages = sorted(sums)
    prototypes = np.array([sums[x] for x in languages]).reshape(len(languages), DIMENSIONS)
    return languages, _unit(prototypes).astype(np.float32)


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from ``doc_id``, ``text`` and ``lang``."""
    bound_batches(labelled.sparkSession)
    sample = texts_of(labelled, per_label(labelled, "lang", per_language))
    return _prototypes(_sums(sample, _PARTS_IN_SAMPLE))


def _compared(batches: Iterator[pa.RecordBatch], sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Power of two of the triples, and cosine with the other documents, of texts and their beginnings."""
    for batch in batches:
        found: list[tuple[str, int, float]] = []
        for some in _parts(batch):
            texts = some.column("text").to_pylist()
            for lang, text in zip(some.column("lang").to_pylist(), texts, strict=True):
                text = text or ""
                cuts = [text, *(text[: 1 << k] for k in range(2, len(text).bit_length()) if 1 << k < len(text))]
                vectors, sizes = document_vectors(cuts)
                others = sums[lang] - _whole(vectors[:1], _PARTS_OF_ONE)[0] / _PARTS_OF_ONE
                vectors = _unit(vectors.astype(np.float64))
                if np.linalg.norm(others) < 1e-6:
                    continue  # the only document of its language
                cosines = vectors @ _unit(others)
                powers: dict[int, float] = {}
                # One value of a document per length, that of the text itself before beginnings.
                for size, cosine in zip(sizes.tolist(), cosines.tolist(), strict=True):
                    if size:
                        powers.setdefault(size.bit_length() - 1, cosine)
                found += [(lang, *pair) for pair in powers.items()]
        lang, power, cosine = zip(*found, strict=True) if found else ((), (), ())
        schema = pa.schema([("lang", pa.string()), ("power", pa.int32()), ("cosine", pa.float64())])
        yield pa.RecordBatch.from_pydict({"lang": lang, "power": power, "cosine": cosine}, schema)


def _limits(labelled: DataFrame, sums: dict[str, np.ndarray]) -> dict[str, list[float]]:
    """The least cosine that each language accepts, by the power of two of the triples.

    All documents are counted; a few steps per language and power come to the driver.
    """
    compared = labelled.select("text", "lang").mapInArrow(
        partial(_compared, sums=sums), "lang string, power int, cosine double"
    )
    step = F.floor(F.col("cosine") * STEPS).cast("int")
    # Each language for itself, and all together, without a name.
    counted = (
        compared.groupBy("lang", "power", step.alias("step"))
        .agg(F.count("*").alias("documents"))
        .withColumn("lang", F.explode(F.array("lang", F.lit(None).cast("string"))))
        .groupBy("lang", "power", "step")
        .agg(F.sum("documents").alias("documents"))
    )
    # Steps are kept in the row of their range, so that few rows per length are put in order.
    ranges = counted.groupBy("lang", "power", F.floor(F.col("step") / _STEPS_OF_RANGE).alias("range")).agg(
        F.sum("documents").alias("documents"),
        F.array_sort(F.collect_list(F.struct("step", "documents"))).alias("steps"),
    )
    group = Window.partitionBy("lang", "power")
    place = F.lit(LOW_QUANTILE) * (F.col("size") - 1)
    lowest = (
        ranges.withColumn("reached", F.sum("documents").over(group.orderBy("range")))
        .withColumn("size", F.sum("documents").over(group))
        .where((F.col("reached") > place) & (F.col("reached") - F.col("documents") <= place))
        .select("lang", "power", "size", place.alias("place"), (F.col("reached") - F.col("documents")).alias("before"), "steps")
    )
    found: dict[tuple[str | None, int], tuple[int, float]] = {}
    for lang, power, size, wanted, reached, steps in lowest.collect():
        for low, documents in steps:
            reached += documents
            if reached > wanted:
                found[lang, power] = size, low / STEPS
                break
    most = max((power for _, power in found), default=0)
    limits: dict[str, list[float]] = {}
    for lang in sums:
        limits[lang], limit = [], CHANCE
        for power in range(most + 1):
            if (None, power) in found:
                size, of_own = found.get((lang, power), (0, 0.0))
                limit = max(limit, _drawn(size, of_own, found[None, power][1]))
            limits[lang].append(limit)
    return limits


def _drawn(size: int, of_own: float, of_all: float) -> float:
    return float((size * of_own + COMMON_WEIGHT * of_all) / (size + COMMON_WEIGHT))


def _low(own: list[float], common: list[float]) -> float:
    """The low quantile of a language's cosines, drawn towards that of all languages if they are few."""
    of_all = np.quantile(common, LOW_QUANTILE, method="lower")
    of_own = np.quantile(own, LOW_QUANTILE, method="lower") if own else 0.0
    return _drawn(len(own), of_own, of_all)


def _identified(
    batches: Iterator[pa.RecordBatch], languages: list[str], prototypes: np.ndarray
) -> Iterator[pa.RecordBatch]:
    names = np.array([*languages, UNDETERMINED], dtype=object)
    for batch in batches:
        for some in _parts(batch):
            vectors, sizes = document_vectors([t or "" for t in some.column("text").to_pylist()])
            cosines = _unit(vectors) @ prototypes.T
            if languages:
                best = cosines.argmax(axis=1)
                score = np.clip(cosines.max(axis=1), 0, 1).astype(np.float64)
            else:
                best = score = np.zeros(len(vectors))
            letterless = (sizes == 0) | (not languages)
            found = names[np.where(letterless, len(languages), best).astype(int)]
            columns = [some.column(i) for i in range(some.num_columns)]
            columns += [pa.array(found, pa.string()), pa.array(np.where(letterless, 0.0, score))]
            columns.append(pa.array(sizes))
            yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names, *_ADDED])


_ADDED = ("lang_pred", "score", "n_grams")


def identify(
    docs: DataFrame, languages: list[str], prototypes: np.ndarray, text: str = "text"
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``n_grams``; columns of these names are replaced."""
    bound_batches(docs.sparkSession)
    kept = docs.drop(*_ADDED)
    if text != "text":
        kept = kept.withColumn("text", F.col(text))
    schema = StructType(list(kept.schema.fields))
    for name, kind in zip(_ADDED, ("string", "double", "long"), strict=True):
        schema.add(name, kind)
    run = partial(_identified, languages=languages, prototypes=prototypes)
    return kept.mapInArrow(run, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """The prediction for every document, with ``held_out`` for those not learned from."""
    model = learn(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), *model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_grams"
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents in some language that could be learned, with their own columns.

    Short texts have low limits, since a few letters tell little.
    """
    bound_batches(docs.sparkSession)
    learned = F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    labelled = docs.where(learned).select("text", "lang")
    sums = _sums(labelled)
    others = [F.col(f"`{name}`") for name in docs.columns if name != "text"]
    judged = identify(docs.select(F.struct(*others).alias("row"), "text"), *_prototypes(sums))
    power = F.length(F.bin("n_grams")) - 1
    near = F.lit(False)
    for lang, limits in (_limits(labelled, sums) if sums else {}).items():
        of_length = F.array(*map(F.lit, limits))[F.least(power, F.lit(len(limits) - 1))]
        near = near | ((F.col("lang_pred") == lang) & (F.col("score") >= of_length))
    return judged.where((F.col("n_grams") > 0) & near).select(
        *[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
