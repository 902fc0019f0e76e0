"""Sentence scores -> company decisions, score buckets, cluster review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdrift import constants as C
from webdrift.functions import vectors as V
from webdrift.operators import metrics
from webdrift.operators import similarity


# centroids that are sent to all tasks: 8 MB at 1,000 components
MOST_CENTROIDS = 1_000


def rollup_company(
    scored: DataFrame, company: str, truth: str = "innov", prediction: str = "rf_pred_lab", proba: str = "rf_proba"
) -> DataFrame:
    """Mean label, mean predicted label and mean probability per company, and their row count."""
    return scored.groupBy(company).agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.avg(truth).alias("mean_innov"),
        F.avg(prediction).alias("mean_pred"),
        F.avg(proba).alias("mean_proba"),
    )


def decide(companies: DataFrame, thresholds: Sequence[float] = C.COMPANY_THRESHOLDS) -> DataFrame:
    """One row per company and rule: mean label above 0.5, mean probability above each threshold.

    All rules come from one roll-up; a mean equal to the threshold is negative.
    """
    rules = [F.struct(F.lit("label").alias("rule"), F.lit(0.5).alias("threshold"),
                      (F.col("mean_pred") > 0.5).cast("int").alias("decision"))]
    rules += [F.struct(F.lit("probability").alias("rule"), F.lit(float(t)).alias("threshold"),
                       (F.col("mean_proba") > t).cast("int").alias("decision")) for t in thresholds]
    others = companies.columns
    return companies.select(*others, F.explode(F.array(*rules)).alias("_r")).select(*others, "_r.*")


def threshold_reports(
    scored: DataFrame,
    company: str,
    truth: str = "innov",
    prediction: str = "rf_pred_lab",
    proba: str = "rf_proba",
    thresholds: Sequence[float] = C.COMPANY_THRESHOLDS,
) -> DataFrame:
    """Company-level classification report for every decision rule."""
    decided = decide(rollup_company(scored, company, truth, prediction, proba), thresholds)
    return metrics.classification_report(decided, "mean_innov", "decision", by=["rule", "threshold"])


def score_bucket(
    truth: str = "innov",
    prediction: str = "rf_pred_lab",
    proba: str = "rf_proba",
    high: float = C.HIGH_PROBABILITY,
    low: float = C.LOW_PROBABILITY,
) -> Column:
    """Score x label bucket of a sentence, null when it falls in none: one pass for all five."""
    t, p, s = F.col(truth), F.col(prediction), F.col(proba)
    return (
        F.when((t == 1) & (p == 1) & (s >= high), "correct_high")
        .when((t == 0) & (p == 1) & (s >= high), "wrong_high")
        .when((t == 0) & (p == 0) & (s <= low), "correct_low")
        .when((t == 1) & (p == 0) & (s <= low), "wrong_low")
        .when((s > low) & (s < high), "middle")
    )


def centroid_distance(
    rows: DataFrame, centroids: DataFrame, keys: Sequence[str], vector: str, centroid: str = "centroid",
    how: str = "inner",
) -> DataFrame:
    """Cosine distance of each row to the centroid of its cluster.

    There are few centroids, far fewer than rows: if they are (checked here, by one run of
    their query), they go to the rows; otherwise the rows move.
    """
    centroids = centroids.persist()
    if centroids.limit(MOST_CENTROIDS + 1).count() <= MOST_CENTROIDS:
        centroids = F.broadcast(centroids)
    return rows.join(centroids, list(keys), how).withColumn(
        "distance_from_centroid", V.cosine_distance(F.col(vector), F.col(centroid))
    ).drop(centroid)


def mean_centroids(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Centroid of every cluster as the mean of its rows."""
    return similarity.mean_vectors(rows, keys, vector, "centroid")


def extreme_rows(
    rows: DataFrame, keys: Sequence[str], distance: str, tie: str, n: int = C.REVIEW_ROWS, farthest: bool = False
) -> DataFrame:
    """The n nearest (or farthest) rows per cluster, with their rank.

    The rank limit is applied in each task before the shuffle (WindowGroupLimit), so
    a large cluster sends at most n rows per task.
    """
    order = F.col(distance).desc() if farthest else F.col(distance).asc()
    window = Window.partitionBy(*keys).orderBy(order, F.col(tie).asc())
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def cluster_review(
    rows: DataFrame, keys: Sequence[str], distance: str, tie: str, n: int = C.REVIEW_ROWS
) -> DataFrame:
    """Nearest and farthest rows of every cluster for reading."""
    near = extreme_rows(rows, keys, distance, tie, n).withColumn("side", F.lit("nearest"))
    far = extreme_rows(rows, keys, distance, tie, n, farthest=True).withColumn("side", F.lit("farthest"))
    return near.unionByName(far)
