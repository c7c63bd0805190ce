"""Language identification with hyperdimensional profiles.

Each letter code has a random vector of +1 and -1. A letter trigram is bound as the
product of its letters' vectors, each rotated by its place; a document is the bundle (sum)
of its trigrams and a language the bundle of its documents, each weighing 1. A document
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spanloom.llm.common import aside, code_points, forget_with, small_batches, table, take_turn, text_slices, train_fold

UNKNOWN = "und"
NEW = ("lang_pred", "score", "similarity")
CODES = 64  # 0: no letter; 1-26: a-z; 27-63: other letters by code point
GRAMS = CODES**3
SLICE = 200_000  # characters that a task turns into vectors at once


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Letter code of each code point, case folded."""
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            out[point] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return out


@lru_cache(maxsize=2)
def _letters(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CODES, dims))


forget_with(_codes.cache_clear)
forget_with(_letters.cache_clear)


def gram_vectors(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A bound vector for each trigram number."""
    letters = _letters(dims, seed)
    first = np.roll(letters, 2, axis=1)[grams >> 12]
    return first * np.roll(letters, 1, axis=1)[grams >> 6 & 63] * letters[grams & 63]


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of all texts, and a count for each text and trigram.

    A trigram has a letter in its middle; what is no letter, and a text's ends, count as
    one and the same code.
    """
    points, lengths = code_points([f" {t} " for t in texts])
    codes = _codes()[points]
    owner = np.repeat(np.arange(len(texts)), lengths)
    grams = np.zeros(len(codes), np.int32)
    grams[1:-1] = codes[:-2].astype(np.int32) << 12 | codes[1:-1].astype(np.int32) << 6 | codes[2:]
    kept = codes != 0
    kept[0] = kept[-1] = False
    grams, owner = grams[kept], owner[kept]
    known = np.flatnonzero(np.bincount(grams, minlength=GRAMS))
    place = np.zeros(GRAMS, np.int32)
    place[known] = np.arange(len(known))
    at = owner * len(known) + place[grams]
    counts = np.bincount(at, minlength=len(texts) * len(known)).astype(np.float32)
    return known, counts.reshape(len(texts), len(known))


def learn_prototypes(
    docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = 512, seed: int = 3
) -> dict[str, list[float]]:
    """A prototype vector per language, from all rows with a text and a language.

    Each document is scaled to weight 1 before it is bundled. Tasks bundle what they
    read, so dims numbers per task and language are shuffled; the result has dims numbers
    per language. No usable row: no prototype.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        take_turn("language")
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, texts in text_slices(batch.column(0), SLICE):
                grams, counts = count_grams(texts)
                total = counts.sum(axis=1)
                own = langs[start : start + len(texts)]
                for name in set(own):
                    rows = np.array([x == name for x in own]) & (total > 0)
                    weight = (counts[rows] / total[rows, None]).sum(axis=0)
                    vector = weight @ gram_vectors(grams, dims, seed).astype(np.float32)
                    held[name] = held.get(name, 0) + vector.astype(np.float64)
        for name, vector in held.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "vector": [vector.tolist()]})

    usable = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    sums = (
        usable.mapInArrow(bundle, "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("at", "value"))
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    )
    return {r.lang: [x["value"] for x in r.v] for r in sums.collect()}


def identify(
    docs: DataFrame,
    prototypes: dict[str, list[float]],
    text: str = "text",
    seed: int = 3,
    sharpness: float = 40.0,
) -> DataFrame:
    """All rows of docs with lang_pred, score (0 to 1) and similarity (the best cosine).

    The score is the softmax of the cosines times `sharpness`. A text that is null or has
    no letter gets "und" with score and similarity 0, as does every text if there is no
    prototype. Of equal cosines the language first in the alphabet wins. Letters beyond a-z fold
    into 37 codes, so languages that are written with thousands of letters are told apart less
    well from each other. Columns named as the new ones are replaced; rows are judged one by one
    and whole, however long, so repeated rows agree; an empty table gives an empty table.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64)
    dims = matrix.shape[1] if names else 0
    if names:
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("cos", pa.float64())])

    @arrow_udf("lang string, score double, cos double")
    def predict(column: pa.Array) -> pa.Array:
        take_turn("language")
        lang = np.full(len(column), UNKNOWN, object)
        score, best = np.zeros(len(column)), np.zeros(len(column))
        for start, texts in text_slices(column, SLICE) if names else ():
            grams, counts = count_grams(texts)
            vectors = counts @ gram_vectors(grams, dims, seed).astype(np.float32)
            norm = np.linalg.norm(vectors, axis=1)
            seen = np.flatnonzero(norm > 0)
            if not len(seen):
                continue
            cosines = vectors[seen].astype(np.float64) @ matrix.T / norm[seen, None]
            top = cosines.argmax(axis=1)
            high = cosines[np.arange(len(seen)), top]
            odds = np.exp(sharpness * (cosines - high[:, None]))
            lang[start + seen] = np.array(names, object)[top]
            score[start + seen] = 1 / odds.sum(axis=1)
            best[start + seen] = high
        parts = [pa.array(lang, pa.string()), pa.array(score), pa.array(best)]
        return pa.StructArray.from_arrays(parts, fields=list(kind))

    kept = docs.drop(*(c for c in docs.columns if c.lower() in NEW))
    found = kept.withColumn("__found", predict(F.col(f"`{text}`")))
    return found.select(
        *(F.col(f"`{c}`") for c in kept.columns),
        F.col("__found.lang").alias("lang_pred"),
        F.col("__found.score").alias("score"),
        F.col("__found.cos").alias("similarity"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    prototypes = learn_prototypes(docs.where(train_fold()).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", (~train_fold()).alias("held_out"), "lang_pred", "score"
    )


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that resemble no language (cosine <= 0).

    Null and empty texts have no letters. Where no row has a language nothing is known and
    all documents go. Rows are judged one by one and whole: repeated rows share their fate,
    and an empty table gives an empty table. Columns named as the predictions keep their values.
    """
    small_batches(spark)
    prototypes = learn_prototypes(docs.where(train_fold()))
    docs, columns = aside(docs, NEW)
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("similarity") > 0)
    return identify(docs, prototypes).where(kept).select(*columns)
