"""Exact k-nearest-neighbour search of many query vectors among a base of any size.

A base (labelled rows) of up to ``block_bytes`` is sent to the tasks and the queries stay where they
are: no query vector is shuffled or copied.  A larger base stays in Spark: base and queries
are cut into blocks of about that size, every pair of blocks meets in a task and gives k rows per query,
and only these are merged.  The cost per query is that of the base.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20  # a worker holds a block some ten times over: as rows, matrix, sorted copy, on its axes
VARIANCE = 0.999  # share of the base's variance that the leading axes of the lower bound hold
CELLS = 1 << 20  # (query, base row) entries held at once


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def prepare(vectors: np.ndarray, ids: np.ndarray, values: dict[str, np.ndarray], k: int) -> dict:
    """A base block ready for search: equal vectors cut to their k smallest ids, rows on principal axes.

    Of equal vectors only the k with the smallest ids can be neighbours of any query, so ties
    never hold more than k rows of a block.  The rotation is orthogonal, so the distance over its
    leading axes is a lower bound of the full distance; the axes kept hold ``VARIANCE`` of the
    base's spread (all 64 for the given embeddings, whose spectrum is nearly flat).
    """
    if len(vectors):
        _, group = np.unique(vectors, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.lexsort((ids, group))
        first = np.searchsorted(group[order], group[order])
        keep = np.sort(order[np.arange(len(order)) - first < k])
        vectors, ids, values = vectors[keep], ids[keep], {c: v[keep] for c, v in values.items()}
    mean = vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1])
    centred = vectors - mean
    spread, axes = np.linalg.eigh(centred.T @ centred)
    spread, axes = np.maximum(spread[::-1], 0.0), axes[:, ::-1]
    # as many leading axes as hold VARIANCE of the spread: few for a steep spectrum, all for an even one
    held = np.cumsum(spread) / max(float(spread.sum()), 1e-300)
    axes = axes[:, : max(1, int(np.searchsorted(held, VARIANCE)) + 1)]
    rotated = centred @ axes
    return {"vectors": vectors, "ids": ids, "values": values, "mean": mean, "axes": axes, "rotated": rotated,
            "lengths": (rotated * rotated).sum(1)}


def _nearest(queries: np.ndarray, base: dict, k: int, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest base rows per query, nearest first, ties by id.

    A first guess (the rows nearest on the leading axes, measured exactly) bounds each query's
    k-th distance from above; only rows whose distance on the leading axes is within that bound
    are measured exactly, from their differences, and the k best kept.
    """
    vectors, ids, rotated, lengths = base["vectors"], base["ids"], base["rotated"], base["lengths"]
    n, width = vectors.shape
    k = min(k, n)
    guess_k = min(n, max(2 * k, 16))
    chunk = max(1, min(CELLS // max(1, n), CELLS // (guess_k * max(1, width))))
    found, distances = [], []
    for start in range(0, len(queries), chunk):
        q = queries[start:start + chunk]
        zq = (q - base["mean"]) @ base["axes"]
        own = (zq * zq).sum(1)
        lower = np.maximum(own[:, None] + lengths[None, :] - 2.0 * (zq @ rotated.T), 0.0)
        guess = np.argpartition(lower, guess_k - 1, axis=1)[:, :guess_k] if guess_k < n else np.tile(np.arange(n), (len(q), 1))
        measured = np.sqrt(((vectors[guess] - q[:, None, :]) ** 2).sum(2))
        bound = np.partition(measured, k - 1, axis=1)[:, k - 1]
        limit = bound * bound + 1e-9 * (own + lengths.max()) + 1e-12
        at, near = np.nonzero(lower <= limit[:, None])
        if stats is not None:
            stats["pairs"] = stats.get("pairs", 0) + len(q) * n
            stats["measured"] = stats.get("measured", 0) + len(at) + guess.size
        exact = np.empty(len(at))
        step = max(1, CELLS // max(1, width))
        for s in range(0, len(at), step):
            exact[s:s + step] = np.sqrt(((vectors[near[s:s + step]] - q[at[s:s + step]]) ** 2).sum(1))
        order = np.lexsort((ids[near], exact, at))
        at, near, exact = at[order], near[order], exact[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        found.append(near[rank < k].reshape(len(q), k))
        distances.append(exact[rank < k].reshape(len(q), k))
    if not found:
        return np.zeros((0, k), dtype=np.int64), np.zeros((0, k))
    return np.concatenate(found), np.concatenate(distances)


def knn(
    queries: DataFrame,
    base: DataFrame,
    query_id: str,
    base_id: str,
    vector: str,
    k: int,
    carry: str | None = None,
    max_base: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, neighbour, rank, distance[, carry]) of the k nearest base rows per query.

    Euclidean distance, ties by id.  ``carry`` is a base column to bring along (a label).  A base
    of more than ``max_base`` rows, if given, is refused.
    """
    n_base = base.count()
    if n_base == 0:
        raise ValueError("no base rows")
    if max_base is not None and n_base > max_base:
        raise ValueError(f"{n_base} base rows; at most {max_base}, draw a sample")
    carried = {c: dict(base.dtypes)[c] for c in [carry] if c}
    id_type, query_type = dict(base.dtypes)[base_id], dict(queries.dtypes)[query_id]
    plain = base.select(F.col(base_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), *carried)
    width = plain.select(F.size("v")).first()[0]
    blocks = math.ceil(n_base * width * 8 / block_bytes)
    extra = "".join(f", {c} {t}" for c, t in carried.items())
    schema = f"q {query_type}, id {id_type}, rank int, distance double{extra}"
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"))

    def nearest(batch: pd.DataFrame, prepared: dict) -> pd.DataFrame:
        near, distance = _nearest(_matrix(batch["v"]), prepared, k)
        n = near.shape[1]
        hit = near.ravel()
        return pd.DataFrame({
            "q": np.repeat(batch["q"].to_numpy(), n), "id": prepared["ids"][hit], "rank": np.tile(np.arange(1, n + 1), len(batch)),
            "distance": distance.ravel(), **{c: v[hit] for c, v in prepared["values"].items()},
        })

    def parts(block: pd.DataFrame) -> dict:
        return prepare(_matrix(block["v"]), block["id"].to_numpy(), {c: block[c].to_numpy() for c in carried}, k)

    if blocks <= 1:
        # one block of at most block_bytes: sent to the tasks once, prepared once per worker
        sent = queries.sparkSession.sparkContext.broadcast(plain.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            prepared = None
            for batch in batches:
                if len(batch):
                    prepared = prepared or parts(sent.value)
                    yield nearest(batch, prepared)

        found = asked.mapInPandas(run, schema)
    else:
        query_blocks = max(1, math.ceil(asked.count() * width * 8 / block_bytes))

        def meet(batch: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if not len(batch) or not len(block):
                return pd.DataFrame(columns=["q", "id", "rank", "distance", *carried])
            return nearest(batch, parts(block))

        def block(of: str, count: int):
            return F.pmod(F.xxhash64(of), F.lit(count))

        pair = "_pair"
        own, first = block("q", query_blocks), block("id", blocks) * query_blocks
        left = asked.withColumn(pair, F.explode(F.sequence(own, own + (blocks - 1) * query_blocks, F.lit(query_blocks).cast("bigint"))))
        right = plain.withColumn(pair, F.explode(F.sequence(first, first + (query_blocks - 1))))
        met = left.groupBy(pair).cogroup(right.groupBy(pair)).applyInPandas(meet, schema)
        order = Window.partitionBy("q").orderBy("distance", "id")
        found = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias(query_id), F.col("id").alias("neighbour"), "rank", "distance", *carried)


def knn_classify(
    test: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 2
) -> DataFrame:
    """(key, pred): majority label of the k nearest training rows; a tie goes to the smaller label."""
    near = knn(test, train, key, key, vector, k, carry=label)
    votes = near.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label")))
    return votes.groupBy(key).agg(best.alias("best")).select(key, F.col("best.label").alias("pred"))
