"""Cosine k-means over buckets of scored sentences."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift import constants as C
from webdrift.functions import vectors as V
from webdrift.operators.decisions import centroid_distance


def cosine_kmeans(
    df: DataFrame, vector: str, k: int, repeats: int = C.CLUSTER_REPEATS, seed: int = C.SEED
) -> tuple[DataFrame, DataFrame]:
    """Assignments and centroids of the best of ``repeats`` fits (lowest cost).

    Returns (rows with ``cluster``, table (cluster, centroid)).  Rows whose vector has
    no length belong to no direction: their cluster is null.
    """
    spark = df.sparkSession
    has_length = V.norm(F.col(vector)) > 0
    data = df.where(has_length).withColumn("_v", array_to_vector(F.col(vector)))
    points = data.select("_v").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = None
        for repeat in range(repeats):
            model = KMeans(
                k=k, distanceMeasure="cosine", initMode="k-means||", seed=seed + repeat,
                featuresCol="_v", predictionCol="cluster",
            ).fit(points)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
    finally:
        points.unpersist()
    centers = [(i, [float(x) for x in center]) for i, center in enumerate(best.clusterCenters())]
    centroids = spark.createDataFrame(centers, "cluster int, centroid array<double>")
    rows = best.transform(data).drop("_v")
    others = df.where(~has_length | F.col(vector).isNull()).withColumn("cluster", F.lit(None).cast("int"))
    return rows.unionByName(others), centroids


def cluster_buckets(
    scored: DataFrame,
    vector: str,
    bucket: str = "bucket",
    clusters: Mapping[str, int] = C.CLUSTERS_PER_BUCKET,
    repeats: int = C.CLUSTER_REPEATS,
    seed: int = C.SEED,
) -> DataFrame:
    """Cluster each bucket on its own and add ``cluster`` and ``distance_from_centroid``.

    Buckets are a fixed handful; each fit is a distributed job.  A bucket without rows gives
    none; rows in no bucket keep a null cluster and distance.
    """
    outside = scored.where(F.col(bucket).isNull() | ~F.col(bucket).isin(*clusters))
    parts = [outside.withColumn("cluster", F.lit(None).cast("int")).withColumn(
        "distance_from_centroid", F.lit(None).cast("double"))]
    for name, k in clusters.items():
        rows = scored.where(F.col(bucket) == name)
        if rows.isEmpty():
            continue
        assigned, centroids = cosine_kmeans(rows, vector, k, repeats, seed)
        parts.append(centroid_distance(assigned, centroids, ["cluster"], vector, how="left").select(*parts[0].columns))
    return reduce(DataFrame.unionByName, parts)
