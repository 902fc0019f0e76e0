"""Text -> dense vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from webdrift import constants as C
from webdrift.functions import text as X

Encoder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame,
    text: str = "text",
    out: str = "embedding",
    size: int = C.EMBEDDING_SIZE,
    make_encoder: Callable[[], Encoder] | None = None,
    batch: int = C.ENCODE_BATCH,
) -> DataFrame:
    """Add a vector column of the given size; the vector stays in the row of its text.

    ``make_encoder`` returns a function from texts to an (n, size) array, such as a
    sentence model's ``encode``; it is called once per task, and texts come in chunks
    of at most ``batch``.  Only the texts go to Python, the other columns stay in the
    JVM.  Without an encoder, words are hashed into ``size`` counts and the
    vector is scaled to length 1: a deterministic default that needs no model files and
    runs in the JVM.
    """
    if make_encoder is None:
        words = df.withColumn("_words", F.coalesce(X.word_tokens(F.col(text), 1), F.array().cast("array<string>")))
        counted = HashingTF(numFeatures=size, inputCol="_words", outputCol="_counts").transform(words)
        scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_vector").transform(counted)
        return scaled.withColumn(out, vector_to_array("_vector", "float32")).drop("_words", "_counts", "_vector")

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for column in columns:
            vectors = [encode_chunk(encoder, column.iloc[i:i + batch]) for i in range(0, len(column), batch)]
            yield pd.Series([row for chunk in vectors for row in chunk])

    def encode_chunk(encoder: Encoder, texts: pd.Series) -> np.ndarray:
        vectors = np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float32)
        if vectors.shape != (len(texts), size):
            raise ValueError(f"the encoder gave {vectors.shape}, expected {(len(texts), size)}")
        return vectors

    return df.withColumn(out, encode(F.col(text)))
