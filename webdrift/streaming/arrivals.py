"""Pages of a later scrape, handled as they arrive.

Text extraction, normalisation, sentence splitting, encoding and scoring look at one
row at a time, so the batch functions take a streaming frame as it is: no state, no
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from webdrift import constants as C
from webdrift.operators import classifiers, encode
from webdrift.plans.studies import page_sentences


def read_page_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Page tables as Parquet files, each file once."""
    return spark.readStream.schema(schema).parquet(folder)


def score_pages(pages: DataFrame, key: str, model, size: int = C.EMBEDDING_SIZE) -> DataFrame:
    """Sentence scores of arriving pages under a fitted model."""
    return classifiers.score(model, encode.embed(page_sentences(pages, [key]), size=size), "embedding").drop("embedding")


def append_scores(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table; the checkpoint makes it exactly once."""
    writer = scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
