"""Toxicity of restored text.

Texts are restored (see deobfuscation), cut into words, and each word and word beginning of
4 to 7 letters falls into one of 2**20 hashed cells. A cell's weight is the shrunk log-odds of
toxic documents that use it; a document's score is a logistic function of a few statistics
of the weights of its cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spanloom.llm.common import aside, code_points, forget_with, small_batches, table, take_turn, text_slices, train_fold, written
from spanloom.llm.counting import dense_sums
from spanloom.llm.deobfuscation import Restorer, letter_model
from spanloom.llm.hashing import BASE, INVERSE, folded, mixed, power

CELLS = 1 << 20
BEGINNINGS = (4, 5, 6, 7)
SHRINK = 4.0  # documents of the average rate that a cell's own are mixed with
SAMPLE = 30_000  # labelled rows that the model is fitted on, at most
TOXIC = 0.7
NEW = ("score", "predicted")


def cells(texts: list[str]) -> list[np.ndarray]:
    """The distinct cells of each text's words and word beginnings."""
    points, lengths = code_points([t + " " for t in texts])
    chars = folded(letters=True)[points].astype(np.uint64)
    inside = chars > 0
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * power(BASE, len(chars)))])
    back = power(INVERSE, len(chars))[starts]
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    found, owners = [mixed((total[ends] - total[starts]) * back)], [owner]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        begin = starts[longer]
        found.append(mixed((total[begin + size] - total[begin]) * back[longer] + np.uint64(size)))
        owners.append(owner[longer])
    cell = (np.concatenate(found) >> np.uint64(44)).astype(np.int64)
    keys = np.unique(np.concatenate(owners).astype(np.int64) * CELLS + cell)
    cuts = np.searchsorted(keys, np.arange(1, len(texts)) * CELLS)
    return [k % CELLS for k in np.split(keys, cuts)]


def _log_odds(toxic: np.ndarray, seen: np.ndarray, rate: float) -> np.ndarray:
    share = (toxic + SHRINK * rate) / (seen + SHRINK)
    return np.log(share / (1 - share)) - np.log(rate / (1 - rate))


def statistics(weights: np.ndarray) -> np.ndarray:
    """Of one document's weights: the 1st, 2nd, 4th, 8th and 16th largest, the excess over 1
    in all and a cell, the number of cells, and the mean of the negative ones."""
    top = np.sort(np.partition(weights, len(weights) - 16)[-16:])[::-1] if len(weights) > 16 else (
        np.pad(np.sort(weights)[::-1], (0, 16 - len(weights)))
    )
    over = np.maximum(weights - 1, 0).sum()
    size = max(1, len(weights))
    low = np.minimum(weights, 0).sum() / size
    return np.array(
        [*top[[0, 1, 3, 7, 15]], np.log1p(over), 10 * over / size, np.log1p(len(weights)), low]
    )


def _terms(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((stats - mean) / spread, -4, 4)
    ones = np.ones((len(z), 1))
    return np.hstack([ones, z, z**2 / 4, z[:, :1] * z[:, 1:2] / 2, z[:, 7:8] * z[:, :6] / 2])


def _logistic(terms: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    theta = np.zeros(terms.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(terms @ theta, -30, 30)))
        slope = terms.T @ (p - labels) + theta
        curve = (terms * (p * (1 - p))[:, None]).T @ terms + np.eye(len(theta))
        theta -= np.linalg.solve(curve, slope)
    return theta


@dataclass(frozen=True)
class ToxicityModel:
    """letters: the letter model. rate: share of toxic rows. weights: by cell. The rest is
    None where the labels do not hold both classes, and the score then is the rate."""

    letters: np.ndarray
    rate: float
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    theta: np.ndarray | None = None

    def score(self, weights: np.ndarray) -> float:
        if self.theta is None or not len(weights):
            return self.rate
        terms = _terms(statistics(weights)[None], self.mean, self.spread)
        return float(1 / (1 + np.exp(-np.clip(terms @ self.theta, -30, 30)))[0])


def _restored(letters: np.ndarray, spark: SparkSession) -> Callable:
    shared = spark.sparkContext.broadcast(letters)  # 27**4 numbers

    @arrow_udf("string")
    def restore(column: pa.Array) -> pa.Array:
        take_turn("toxicity")
        restorer = _restorer(shared.value)
        return pa.array([restorer.restore(t or "") for t in column.to_pylist()], pa.string())

    return restore


_restorers: dict[int, Restorer] = {}
forget_with(_restorers.clear)


def _restorer(letters: np.ndarray) -> Restorer:
    """The worker's restorer of a letter model, with what it remembers from earlier batches."""
    key = hash(letters.tobytes())
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(letters)
    return _restorers[key]


def restore(docs: DataFrame, letters: np.ndarray, text: str = "text") -> DataFrame:
    """All rows of docs with `restored`: the text with disguised words read (null: empty)."""
    run = _restored(letters, docs.sparkSession)
    return docs.withColumn("restored", run(F.col(f"`{text}`")))


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text"
) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    The letter model counts all of docs. Cell weights and the logistic fit use the labelled
    rows, or of more than `sample` of them those with the lowest hash of their id. A
    document's own label is taken out of the cells before its statistics are fitted.
    """
    letters = letter_model(docs, text)
    drawn = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    known = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")
    known = written(restore(known, letters).select("toxic", "restored"), "labelled")

    def add(held: np.ndarray, batch: pa.RecordBatch) -> None:
        take_turn("toxicity")
        toxic = batch.column(0).to_numpy()
        for start, texts in text_slices(batch.column(1)):
            for i, found in enumerate(cells(texts)):
                held[found] += 1
                held[-1] += 1
                if toxic[start + i]:
                    held[CELLS + found] += 1
                    held[-2] += 1

    width = 2 * CELLS + 4096
    counts = dense_sums(known, add, width)
    rows, hits = int(counts[-1]), int(counts[-2])
    rate = hits / rows if rows else 0.0
    if not 0 < hits < rows:
        return ToxicityModel(letters, rate)
    seen, toxic = counts[:CELLS].astype(np.int32), counts[CELLS : 2 * CELLS].astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((seen, toxic))

    @arrow_udf("array<double>")
    def describe(label: pa.Array, column: pa.Array) -> pa.Array:
        take_turn("toxicity")
        own, (seen, toxic), out = label.to_numpy(), shared.value, []
        for start, texts in text_slices(column):
            for i, found in enumerate(cells(texts)):
                y = int(own[start + i])
                out.append(statistics(_log_odds(toxic[found] - y, seen[found] - 1, rate)))
        return pa.array([x.tolist() for x in out], pa.list_(pa.float64()))

    got = known.select("toxic", describe("toxic", "restored").alias("stats")).toArrow()  # `sample` rows
    stats = got.column("stats").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    mean, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-9
    theta = _logistic(_terms(stats, mean, spread), (got.column("toxic").to_numpy() > 0).astype(float))
    weights = _log_odds(toxic, seen, rate).astype(np.float32)
    return ToxicityModel(letters, rate, weights, mean, spread, theta)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All rows of docs with score (0 to 1) and predicted (1 if it is 0.7 or more).

    Null and empty texts, and texts without letters, get the share of toxic rows among the
    labels (0 without labels). Rows are scored one by one and whole, so repeated rows have one
    score, and a disguised word is one lattice, however long; an empty table gives an empty
    table; columns named as the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        take_turn("toxicity")
        model, out = shared.value, []
        restorer = _restorer(model.letters)
        for _, texts in text_slices(column):
            for found in cells([restorer.restore(t) for t in texts]):
                known = model.weights[found] if model.weights is not None else found
                out.append(model.score(known.astype(np.float64)))
        return pa.array(out, pa.float64())

    kept = docs.drop(*(c for c in docs.columns if c.lower() in NEW))
    scored = kept.withColumn("score", score.asNondeterministic()(F.col(f"`{text}`")))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(train_fold())
    return score_toxicity(docs, learn_toxicity(docs, labels)).select(
        "doc_id", (~train_fold()).alias("held_out"), "score", "predicted"
    )


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that are predicted toxic.

    Null and empty texts get the labels' average rate and stay, as that is under 0.7. Rows
    are judged one by one and whole, so repeated rows share their fate; without labels all
    stay, and an empty table gives an empty table. Columns named as the scores keep their values.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(train_fold())
    docs, columns = aside(docs, NEW)
    return score_toxicity(docs, learn_toxicity(docs, labels)).where("predicted = 0").select(*columns)
