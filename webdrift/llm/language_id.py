"""Language of a text: blended-spectrum presence kernel, Nystroem landmarks, kernel ridge regression.

A text is the set of its byte n-grams of lengths 1 to 3, hashed to ``FEATURES`` places; the kernel
of two texts is the number of common places over the geometric mean of their numbers.  A bounded
sample of labelled texts is fitted one language against the rest in the space of ``LANDMARKS``
of them; all texts are then scored by products of a matrix of texts with that of the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdrift.llm.bytewise import slices
from webdrift.llm.common import documents

FEATURES = 1 << 14
LANDMARKS = 192
SAMPLE = 4000  # labelled texts to fit on, shared by the languages
RIDGE = 1e-3
ROWS = 64  # texts per matrix product
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) of 0 and 1."""
    out = np.zeros((len(offsets) - 1, FEATURES), np.uint8)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    value = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        whole = len(data) - n + 1
        if whole <= 0:
            break
        value = (value[:whole] << np.uint32(8)) | data[n - 1 :]
        place = ((value + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
        inside = text[:whole] == text[n - 1 :]
        out[text[:whole][inside], place[inside]] = 1
    return out


def has_letter(texts: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = np.append(0, np.cumsum(_LETTER[data]))
    plain = found[offsets[1:]] > found[offsets[:-1]]
    for i in np.flatnonzero(~plain):
        plain[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    return plain


@dataclass
class Model:
    """Packed landmarks, the square roots of their numbers of n-grams, weights by landmark and language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: np.ndarray) -> np.ndarray:
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return kernel(texts, marks) @ self.weights


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float32), b.astype(np.float32)
    common = a @ b.T
    return common / np.sqrt(np.maximum(a.sum(1), 1)[:, None] * np.maximum(b.sum(1), 1)[None, :])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch, "text"):
            ok = has_letter(batch, data, offsets)
            bits = np.packbits(presence(data, offsets), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                 pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(ok)],
                names=["lang", "at", "bits", "ok"],
            )


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of (lang, text), as many of each language, by a hash of the row."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return labelled.withColumn("at", F.lit(0).cast("bigint"))
    share = F.lit(1.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, min(1.0, rows / len(counts) / n)).otherwise(share)
    at = F.xxhash64(F.lit("sample"), "text")
    return labelled.withColumn("at", at).filter(F.col("at") / 2.0**64 + 0.5 < share).limit(2 * rows)


def fit(labelled: DataFrame, rows: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of the languages of labelled (lang, text); None if no text with a letter has one.

    Learns from about ``rows`` texts; only their n-gram sets come to the driver.
    """
    found = sample(labelled.filter("lang is not null and text is not null").select("lang", "text"), rows)
    table = found.select("lang", "at", "text").mapInArrow(_features, "lang string, at bigint, bits binary, ok boolean").filter("ok").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by([("at", "ascending"), ("lang", "ascending")])
    names = np.array(table.column("lang").to_pylist())
    packed = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(names), -1)
    texts = np.unpackbits(packed, axis=1)
    languages = sorted(set(names))
    # the languages take turns to give a landmark
    turn = np.zeros(len(names), int)
    for language in languages:
        turn[names == language] = np.arange((names == language).sum())
    picked = np.argsort(turn, kind="stable")[:landmarks]
    values, vectors = np.linalg.eigh(kernel(texts[picked], texts[picked]).astype(float))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = np.concatenate([kernel(texts[i : i + 512], texts[picked]) for i in range(0, len(texts), 512)]) @ root
    target = np.where(names[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(mapped.T @ mapped + ridge * len(mapped) * np.eye(mapped.shape[1]), mapped.T @ target)
    return Model(languages, packed[picked], (root @ solved).astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of docs: its columns but ``text``, and lang_pred, score.

    Null texts and those without a letter, and all if there is no model, are ``und`` with score 0.
    The score is the share of the language among exponentials of the regressions' values.  Every row
    is judged by itself; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, scores = [], []
            for _, _, data, offsets in slices(batch, "text", 1 << 18):
                ok = has_letter(batch, data, offsets) if model else np.zeros(len(offsets) - 1, bool)
                for low in range(0, len(ok), ROWS):
                    some = offsets[low : low + ROWS + 1]
                    good = ok[low : low + ROWS]
                    if good.any():
                        value = np.exp(4 * model.scores(presence(data[some[0] : some[-1]], some - some[0])))
                        best = value.argmax(1)
                        share = value.max(1) / value.sum(1)
                        kinds += [model.languages[b] if g else UNDETERMINED for b, g in zip(best, good)]
                        scores += np.where(good, share, 0.0).tolist()
                    else:
                        kinds += [UNDETERMINED] * len(good)
                        scores += [0.0] * len(good)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(kinds, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    schema = ", ".join([f"`{n}` {dict(docs.dtypes)[n]}" for n in names] + ["lang_pred string", "score double"])
    return docs.select(*names, "text").mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def op6_language_id(spark, folder: str) -> DataFrame:
    """Language of every document, learned from those outside fold 0."""
    docs = documents(spark, folder)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    model = fit(docs.filter(fold(F.col("doc_id")) != 0).select("lang", "text"))
    return predict(docs.select("doc_id", held_out, "text"), model)
