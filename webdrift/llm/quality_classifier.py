"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0, 1, ..., K-1 are ordered: ``P(grade <= k) = sigmoid(threshold[k] - score)``.  One weight
vector over hashed features of the text gives the score for all grades; thresholds ascend.  The model
gives a text's expected grade and the probability of a grade or better, by which texts are selected.

Features are sets: words (letters and digits, in lower case), the shapes of words (letters,
capitals, digits and signs, runs drawn together), and the share of repeated words, in tenths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift.llm.bytewise import Prefix, mixed, slices, words
from webdrift.llm.common import documents

BITS = 17
SAMPLE = 12_000  # rated texts to fit on
STEPS = 400
RATE = 0.03
SPARSITY = 4e-4  # of the absolute weights; a word must pay for its weight in likelihood
MIN_TEXTS = 8  # of the sample that a feature must be in to get a weight
SELECT = 0.4  # least probability of the top grade

_SHAPE = np.full(256, ord("x"), np.uint8)
_SHAPE[[*range(ord("A"), ord("Z") + 1)]] = ord("X")
_SHAPE[[*range(ord("0"), ord("9") + 1)]] = ord("0")
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_SHAPE[_SIGNS] = _SIGNS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(ord("A"), ord("Z") + 1)]] += 32
_LOWER[_SIGNS] = 0x20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, border): the hashed features of each text, without repeats."""
    n = len(offsets) - 1
    plain = _LOWER[data]
    start, end, border = words(plain, offsets)
    word = Prefix(plain).of(start, end)
    owner = [np.repeat(np.arange(n), np.diff(border))]
    value = [word]
    # shapes: a byte counts if it differs in kind from the one before in its word
    start, end, edge = words(data, offsets)
    shape = _SHAPE[data]
    turn = np.ones(len(data), bool)
    turn[1:] = shape[1:] != shape[:-1]
    turn[start] = True
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    turn &= np.cumsum(inside[:-1]) > 0
    kept = np.append(0, np.cumsum(turn))
    drawn = shape[turn]
    value.append(Prefix(drawn).of(kept[start], kept[end]) + np.uint64(1))
    owner.append(np.repeat(np.arange(n), np.diff(edge)))
    owner, value = np.concatenate(owner), np.concatenate(value)
    place = (mixed(value) >> np.uint64(64 - BITS)).astype(np.int64)
    code = np.unique((owner.astype(np.int64) << BITS) | place)
    # words per different feature, in tenths
    different = np.bincount(code >> BITS, minlength=n)
    tenths = np.minimum(10 * different // np.maximum(np.diff(border) + 1, 1), 20)
    share = (mixed(tenths.astype(np.uint64) + np.uint64(977)) >> np.uint64(64 - BITS)).astype(np.int64)
    code = np.unique(np.concatenate([code, (np.arange(n) << BITS) | share]))
    return code & ((1 << BITS) - 1), np.searchsorted(code >> BITS, np.arange(n + 1))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, places: np.ndarray, border: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(self.weights[places], dtype=float))
        return total[border[1:]] - total[border[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """(texts, K - 1): probability of grade k + 1 or better."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit_ordinal(places: np.ndarray, border: np.ndarray, grades: np.ndarray, levels: int,
                steps: int = STEPS, rate: float = RATE, sparsity: float = SPARSITY) -> Model:
    """Maximum likelihood with sparse weights by proximal gradient steps (Adam); each grade weighs the same."""
    weights, free = np.zeros(1 << BITS), np.append(-1.0, np.zeros(levels - 2))
    text = np.repeat(np.arange(len(grades)), np.diff(border))
    common = np.bincount(places, minlength=1 << BITS) >= min(MIN_TEXTS, len(grades))
    text, places = text[common[places]], places[common[places]]
    count = np.bincount(grades, minlength=levels)
    importance = (len(grades) / np.maximum(count, 1) / np.maximum((count > 0).sum(), 1))[grades]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, free)]
    rows = np.arange(len(grades))
    for step in range(1, steps + 1):
        thresholds = free[0] + np.append(0.0, np.cumsum(np.exp(free[1:])))
        score = np.bincount(text, weights[places], minlength=len(grades))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - thresholds[None, :], -40, 40)))
        full = np.column_stack([np.zeros(len(grades)), below, np.ones(len(grades))])
        slope = full * (1 - full)
        high, low = full[rows, grades + 1], full[rows, grades]
        likely = np.maximum(high - low, 1e-9)
        up, down = slope[rows, grades + 1] / likely, slope[rows, grades] / likely
        by_score = importance * (up - down) / len(grades)  # of the negative log-likelihood
        gradient = np.bincount(places, by_score[text], minlength=1 << BITS)
        edge = np.zeros(levels + 1)
        np.add.at(edge, grades + 1, -importance * up / len(grades))
        np.add.at(edge, grades, importance * down / len(grades))
        edge = edge[1:-1]
        of_free = np.append(edge.sum(), np.exp(free[1:]) * np.cumsum(edge[::-1])[::-1][1:])
        for value, slope_, (first, second) in zip((weights, free), (gradient, of_free), state):
            first += 0.1 * (slope_ - first)
            second += 0.001 * (slope_ * slope_ - second)
            pace = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            value -= pace * first / (1 - 0.9**step)
            if value is weights:
                value[:] = np.sign(value) * np.maximum(np.abs(value) - pace * sparsity, 0)
    return Model(weights.astype(np.float32), free[0] + np.append(0.0, np.cumsum(np.exp(free[1:]))))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch, "text"):
            places, border = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                 pa.array([places[a:b].astype(np.int32).tobytes() for a, b in zip(border[:-1], border[1:])], pa.binary())],
                names=["at", "grade", "places"],
            )


def fit(docs: DataFrame, ratings: DataFrame, levels: int, rows: int = SAMPLE) -> Model | None:
    """A model from docs (doc_id, text) and ratings (doc_id, grade); None if none of these is rated.

    Learns from ``rows`` ratings at most, the first by a hash of doc_id and grade; only the hashed
    features of their texts come to the driver.  Ratings that are null or not of 0..levels-1 are
    not used.
    """
    good = ratings.filter("doc_id is not null and grade between 0 and %d" % (levels - 1))
    at = F.xxhash64(F.lit("rated"), "doc_id", "grade").alias("at")
    chosen = good.select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int").alias("grade"), at).orderBy("at").limit(rows)
    rated = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("rated_id")).select("at", "grade", "text")
    table = rated.mapInArrow(_places, "at bigint, grade int, places binary").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by([("at", "ascending"), ("grade", "ascending")])
    found = [np.frombuffer(b, np.int32) for b in table.column("places").to_pylist()]
    border = np.append(0, np.cumsum([len(x) for x in found]))
    return fit_ordinal(np.concatenate(found).astype(np.int64), border, table.column("grade").to_numpy().astype(int), levels)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, expected_grade, tail (probability of the top grade).

    Null text is empty; it and texts without words are scored by the features they have, the share of
    repeated words.  Without a model both columns are null.  Rows are scored by themselves; an empty
    table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch, "text"):
                if model:
                    tails = model.tails(model.scores(*features(data, offsets)))
                    grade, top = pa.array(tails.sum(1)), pa.array(tails[:, -1])
                else:
                    grade = top = pa.nulls(high - low, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), grade, top], names=["doc_id", "expected_grade", "tail"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail double")


def op3_quality_classifier(spark, folder: str) -> DataFrame:
    """Expected grade of every document, and whether it is kept.

    Grades from the labels: 0 toxic, 1 not toxic and of low quality, 2 neither.
    """
    docs = documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    model = fit(docs, labels.select("doc_id", grade.alias("grade")), 3)
    return predict(docs, model).withColumn("kept", F.col("tail") >= SELECT)
