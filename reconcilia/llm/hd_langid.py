"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector. A trigram is bound from its letters as
``perm(perm(a)) * perm(b) * c`` (perm rotates a vector by one place), a text is the sum (bundle) of
its trigrams, a language is the sum of its training texts, and a text gets the language whose
prototype has the largest cosine. Ties go to the first language by name.

Texts are lower-cased; every run of non-letters is one boundary symbol. Scripts share 63 letter
symbols: a-z have their own, other letters are dealt to the rest by code point.

Training is one pass: each task adds up the vectors of its training texts and emits one row for each
language and dimension, so what reaches the driver is (languages * dimensions) whole numbers. Sums of
whole numbers don't depend on the order, so reruns agree.

Null texts and texts without a letter are ``und`` with score 0; so is every text if there is nothing
to learn from. Score: the cosine, at least 0. Repeated rows get equal results, and empty tables give empty ones.
Texts of any length are read whole. Further columns are handed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcilia.llm.common import columns_of, fresh

DIMENSIONS = 512
SYMBOL_BITS = 6
SEED = 20
UNKNOWN = "und"
#: Texts that are worked on together, and the bytes after which a group is cut.
TEXTS, CHARACTERS = 256, 1_000_000


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of every code point: 0 for non-letters, 1-26 for a-z, 27-63 for the other letters."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.fromiter((c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()), np.int64)
    table[letters] = 27 + letters % 37
    table[97:123] = np.arange(1, 27)
    return table


@lru_cache(maxsize=2)
def letter_vectors(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (1 << SYMBOL_BITS, dimensions))


def bound(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of trigrams."""
    base, mask = letter_vectors(dimensions), (1 << SYMBOL_BITS) - 1
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    return (first[grams >> 2 * SYMBOL_BITS] * second[grams >> SYMBOL_BITS & mask] * base[grams & mask]).astype(np.float32)


def trigrams(text: str | None) -> np.ndarray:
    """Trigrams of a text with a boundary at each end; empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = symbols()[points]
    if not marks.any():
        return np.zeros(0, np.int32)
    marks = np.concatenate(([0], marks, [0])).astype(np.int32)
    marks = marks[(marks != 0) | np.concatenate(([True], marks[:-1] != 0))]
    return marks[:-2] << 2 * SYMBOL_BITS | marks[1:-1] << SYMBOL_BITS | marks[2:]


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One bundled vector for each text, zero without a letter. Counts are multiplied in one product."""
    grams, counts = zip(*(np.unique(trigrams(t), return_counts=True) for t in texts), strict=True)
    owner, flat = np.repeat(np.arange(len(texts)), list(map(len, grams))), np.concatenate(grams)
    known, column = np.unique(flat, return_inverse=True)
    table = np.zeros((len(texts), len(known)), np.float32)
    table[owner, column] = np.concatenate(counts)
    return table @ bound(known, dimensions)


def portions(texts: pa.Array) -> Iterator[slice]:
    """Places of texts that are worked on together; only these become Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= TEXTS or held > CHARACTERS):
            yield slice(start, i)
            start, held = i, 0
        held += int(size)
    if len(texts) > start:
        yield slice(start, len(texts))


def _learn(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part in portions(batch.column(1)):
                vectors = bundles(batch.column(1)[part].to_pylist(), dimensions)
                names = np.array(langs[part], object)
                for lang in set(langs[part]):
                    sums[lang] = sums.get(lang, 0) + vectors[names == lang].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "place": list(range(dimensions)), "value": v.astype(np.int64)}, pa.schema([("lang", pa.string()), ("place", pa.int32()), ("value", pa.int64())]))

    return run


def learn(training: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Prototypes from (lang, text) rows: languages by name, and a unit vector for each."""
    rows = training.select("lang", F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(_learn(dimensions), "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()
    langs = sorted(sums["lang"].unique())
    vectors = np.zeros((len(langs), dimensions))
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        vectors[i, own["place"].to_numpy()] = own["value"]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return langs, vectors / np.where(norms > 0, norms, 1)


def guess(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> Column:
    """A struct of lang and score for each text."""
    langs, prototypes = model
    dimensions = prototypes.shape[1]

    schema = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        vectors = bundles(texts, dimensions)
        norms = np.linalg.norm(vectors, axis=1)
        if not langs:
            return [(UNKNOWN, 0.0)] * len(vectors)
        cosines = vectors @ prototypes.T / np.where(norms > 0, norms, 1)[:, None]
        best = cosines.argmax(axis=1)
        return [(langs[b], float(min(1, max(0, c[b])))) if n else (UNKNOWN, 0.0) for b, c, n in zip(best, cosines, norms, strict=True)]

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [x for part in portions(batch) for x in predict(batch[part].to_pylist())]
            yield pa.array([{"lang": lang, "score": score} for lang, score in found], schema)

    return F.arrow_udf(each, "lang string, score double")(columns_of(docs, text)[0].cast("string"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; input columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (taken,) = fresh(docs, "_guess")
    guessed = docs.withColumn(taken, guess(docs, model, text))
    return guessed.select(*columns_of(docs, *own), F.col(f"{taken}.lang").alias("lang_pred"), F.col(f"{taken}.score").alias("score"))


def recognised(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a letter whose best cosine is above 0, all columns as they are."""
    (taken,) = fresh(docs, "_guess")
    guessed = docs.withColumn(taken, guess(docs, model, text))
    return guessed.where((F.col(f"{taken}.lang") != UNKNOWN) & (F.col(f"{taken}.score") > 0)).select(*columns_of(docs, *docs.columns))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out. Null ids: crc32 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3
