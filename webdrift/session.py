"""Session settings the package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # plan again from run-time sizes: broadcast only what turned out small, split hot keys
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # vector means keep one buffer per company; sort only when a task sees very many
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(app: str = "webdrift", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` (dots as ``__``) override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
