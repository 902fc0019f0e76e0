"""How much a company's text changed between two scrapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift.functions import text as X
from webdrift.functions import vectors as V


def pair_scrapes(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per company seen in both scrapes; columns get ``_old`` and ``_new``."""
    a = old.select(key, *[F.col(c).alias(f"{c}_old") for c in columns])
    b = new.select(key, *[F.col(c).alias(f"{c}_new") for c in columns])
    return a.join(b, key)


def word_overlap(pairs: DataFrame, old: str = "text_old", new: str = "text_new") -> DataFrame:
    """Share of common words: words in both texts / words in either.

    Null when both texts are empty.  Word sets are built once per row, and the union
    size follows from the other three sizes.
    """
    sets = pairs.withColumn("_a", X.word_set(F.col(old))).withColumn("_b", X.word_set(F.col(new)))
    common = F.size(F.array_intersect("_a", "_b"))
    counted = sets.select(
        *pairs.columns,
        F.size("_a").alias("_n_a"), F.size("_b").alias("_n_b"), common.alias("n_common"),
    )
    return counted.select(
        *pairs.columns,
        (F.col("_n_a") - F.col("n_common")).alias("n_only_old"),
        (F.col("_n_b") - F.col("n_common")).alias("n_only_new"),
        "n_common",
    ).withColumn(
        "word_similarity",
        F.try_divide(F.col("n_common"), F.col("n_only_old") + F.col("n_only_new") + F.col("n_common")),
    )


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, out: str = "mean_vector") -> DataFrame:
    """Mean vector per key.

    The sum runs in the executors with partial aggregation: a key with many rows sends
    one partial vector per task, and no vector is ever exploded into components.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.groupBy(*keys).agg(vector_to_array(mean).alias(out))


def cosine_by_key(
    old: DataFrame, new: DataFrame, key: str, vector: str, out: str = "cosine_similarity"
) -> DataFrame:
    """Cosine similarity of the same company at two times.

    Companies are matched by key, so only the n pairs that are wanted are computed, not
    an n x n matrix.  Both times are averaged in one pass, and only means are shuffled;
    companies without a partner are dropped behind it.
    """
    both = old.select(key, F.lit(0).alias("_time"), vector).unionByName(new.select(key, F.lit(1).alias("_time"), vector))
    means = mean_vectors(both.where(F.col(key).isNotNull()), [key, "_time"], vector, "_mean")
    sides = means.groupBy(key).agg(*[
        F.first(F.when(F.col("_time") == time, F.col("_mean")), True).alias(name) for time, name in ((0, "_old"), (1, "_new"))
    ])
    paired = sides.where(F.col("_old").isNotNull() & F.col("_new").isNotNull())
    return paired.withColumn(out, V.cosine_similarity(F.col("_old"), F.col("_new"))).drop("_old", "_new")
