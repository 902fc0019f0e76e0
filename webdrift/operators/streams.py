"""A large table read by every task of another one, without a shuffle, a broadcast or the driver.

``against(blobs, held)`` gives each partition of ``held`` all rows of ``blobs``, one after the other from
the shared folder (a Cartesian product whose streamed side is one partition), so what a task holds is
its own part of ``held`` and one piece of ``blobs``.  Nothing is copied on disk; ``blobs`` is read once per
partition of ``held``.  Rows should be binary pieces of some ``BLOB_BYTES``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdrift.sources.files import work_folder

BLOB_BYTES = 1 << 21
GROUP_BYTES = 1 << 24  # of a Parquet row group, which a reader holds at once


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a new file in the shared folder, in row groups a task can hold beside its work."""
    path = work_folder(df.sparkSession)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def against(blobs: DataFrame, held: DataFrame, on: Column | None = None) -> DataFrame:
    """Rows of ``blobs`` x ``held`` (where ``on`` holds), partitioned as ``held``, in the order of ``blobs``."""
    replicated = held.hint("shuffle_replicate_nl")
    return blobs.coalesce(1).crossJoin(replicated) if on is None else blobs.coalesce(1).join(replicated, on)


def tasks(spark, n: int, name: str) -> DataFrame:
    """The numbers 0..n-1, each in a task of its own."""
    return spark.range(0, n, 1, max(1, n)).withColumnRenamed("id", name)


def array(cell: pa.Scalar, dtype) -> np.ndarray:
    """The values of a binary cell, without a copy."""
    buffer = cell.as_buffer()
    return np.frombuffer(buffer, dtype) if buffer is not None and buffer.size else np.empty(0, dtype)
