"""Quadratic discriminant analysis on Spark moments.

Means, deviations and correlations come from Spark's distributed statistics (one tree
aggregation per class); only class count x d x d numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SIZE = 4096


def class_moments(df: DataFrame, vector: str, label: str, value: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and sample covariance (n - 1) of the vectors of one class."""
    rows = df.where(F.col(label) == value).select(array_to_vector(F.col(vector)).alias("v"))
    stats = rows.agg(Summarizer.metrics("count", "mean", "std").summary(F.col("v")).alias("s")).select("s.*").first()
    if stats["count"] < 2:
        raise ValueError(f"class {value} has fewer than two rows")
    if len(stats["mean"]) > MAX_SIZE:
        raise ValueError(f"covariances of more than {MAX_SIZE} dimensions do not fit the driver")
    std = stats["std"].toArray()
    correlation = Correlation.corr(rows, "v").first()[0].toArray()
    # a constant component has no correlation; its covariances are 0
    covariance = np.nan_to_num(correlation) * np.outer(std, std)
    np.fill_diagonal(covariance, std**2)
    return int(stats["count"]), stats["mean"].toArray(), covariance


def moment_table(df: DataFrame, vector: str, label: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """(label, i, j, mean_i, covariance) per class, upper triangle with the diagonal."""
    parts = []
    for value in classes:
        _, mean, covariance = class_moments(df, vector, label, value)
        i, j = np.triu_indices(len(mean))
        parts.append(pd.DataFrame({
            "label": np.int32(value), "i": i.astype("int32"), "j": j.astype("int32"),
            "mean_i": mean[i], "covariance": covariance[i, j],
        }))
    return df.sparkSession.createDataFrame(
        pd.concat(parts), "label int, i int, j int, mean_i double, covariance double"
    )


@dataclass(frozen=True)
class QdaModel:
    vector: str
    classes: tuple[int, ...]
    log_priors: tuple[float, ...]
    means: tuple[np.ndarray, ...]
    whiteners: tuple[np.ndarray, ...]
    log_determinants: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``pred`` and ``proba`` (probability of the last class)."""
        parts = list(zip(self.log_priors, self.means, self.whiteners, self.log_determinants))
        classes = np.array(self.classes)

        @F.pandas_udf("pred int, proba double")
        def score(vectors: pd.Series) -> pd.DataFrame:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
            logs = np.column_stack([
                prior - 0.5 * (((x - mean) @ whiten) ** 2).sum(1) - 0.5 * log_det
                for prior, mean, whiten, log_det in parts
            ])
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            return pd.DataFrame({"pred": classes[logs.argmax(axis=1)].astype("int32"), "proba": odds[:, -1]})

        return df.withColumn("_score", score(F.col(self.vector))).select(*df.columns, "_score.*")


def fit_qda(df: DataFrame, vector: str, label: str, classes: Sequence[int] = (0, 1)) -> QdaModel:
    """One Gaussian per class; directions without variance are left out of the distance."""
    counts, means, whiteners, determinants = [], [], [], []
    for value in classes:
        n, mean, covariance = class_moments(df, vector, label, value)
        values, directions = np.linalg.eigh(covariance)
        keep = values > 1e-12 * max(values.max(), 1e-300)
        counts.append(n)
        means.append(mean)
        whiteners.append(directions[:, keep] / np.sqrt(values[keep]))
        determinants.append(float(np.log(values[keep]).sum()))
    log_priors = tuple(float(np.log(n / sum(counts))) for n in counts)
    return QdaModel(vector, tuple(classes), log_priors, tuple(means), tuple(whiteners), tuple(determinants))
