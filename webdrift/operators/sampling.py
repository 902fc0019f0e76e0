"""Repeatable samples and splits by a hash of the row id.

A row's place depends on its id and the seed only: not on the partitioning, the order
of the input, or a task that is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdrift import constants as C

_PREFIX = 4


def hash_of(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))


def nth_smallest_hash(df: DataFrame, key: str, seed: int, n: Column) -> DataFrame:
    """The n-th smallest hash of the keys, in one row; ``n`` may use the row count ``total``.

    No global sort: rows are counted per hash prefix (65,536 counts), and only the
    prefix that holds the n-th row is ranked, about one row in 65,536.
    """
    hashes = df.select(hash_of(key, seed).alias("h")).withColumn("p", F.substring("h", 1, _PREFIX))
    counts = hashes.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    every = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counts.select(
        "p", "c", F.sum("c").over(Window.orderBy("p")).alias("upto"), F.sum("c").over(every).alias("total")
    ).withColumn("target", F.least(n.cast("long"), F.col("total")))
    rest = F.col("target") - F.col("upto") + F.col("c")
    place = F.min(F.when(F.col("upto") >= F.col("target"), F.struct("p", rest.alias("rest"))))
    edge = ranked.agg(place.alias("place"))
    inside = hashes.withColumn("place", edge.scalar()).where(F.col("p") == F.col("place.p"))
    # equal hashes (a repeated key) are one row here, so they cannot swell the window
    counted = inside.groupBy("place", "p", "h").agg(F.count(F.lit(1)).alias("c"))
    order = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("p").orderBy("h")))
    return order.agg(F.min(F.when(F.col("upto") >= F.col("place.rest"), F.col("h"))).alias("h"))


def up_to_hash(df: DataFrame, key: str, seed: int, n: Column) -> Column:
    """Condition for the n rows with the smallest hashes.

    The threshold, one string, is computed here and now: the condition is then a plain
    comparison, and a frame that is read many times (a training set) does not find its
    threshold anew in each pass.
    """
    limit = nth_smallest_hash(df, key, seed, n).first()["h"]
    return F.lit(False) if limit is None else hash_of(key, seed) <= F.lit(limit)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = C.SEED) -> DataFrame:
    """Exactly n rows (or all, if there are fewer), without replacement; ``key`` must be unique."""
    return df.where(up_to_hash(df, key, seed, F.lit(n)))


def mark_split(
    df: DataFrame, key: str, test_share: float = C.TEST_SHARE, seed: int = C.SEED, out: str = "is_test"
) -> DataFrame:
    """Mark exactly ceil(share * n) rows as test rows.

    The rows themselves are not moved: they are compared with one threshold hash.  With
    a company column as ``key`` whole companies go to one side; the share is then met
    approximately, because rows of one company share a hash; ``split`` takes a ``group``.
    """
    return df.withColumn(out, up_to_hash(df, key, seed, F.ceil(F.col("total") * test_share)))


def split(
    df: DataFrame, key: str, test_share: float = C.TEST_SHARE, seed: int = C.SEED, group: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames; ``group`` keeps all rows of a company on one side."""
    unit, units = (key, df) if group is None else (group, df.select(group).distinct())
    is_test = up_to_hash(units, unit, seed, F.ceil(F.col("total") * test_share))
    return df.where(~is_test), df.where(is_test)


def sample_with_extra(
    base: DataFrame, extra: DataFrame, key: str, n: int = C.REGISTER_SAMPLE, seed: int = C.SEED
) -> DataFrame:
    """n rows of the base population plus the extra rows whose key was not sampled."""
    sample = sample_rows(base, key, n, seed)
    rest = extra.join(sample.select(key), key, "left_anti")
    joined = sample.unionByName(rest, allowMissingColumns=True)
    return joined.select(*sorted(joined.columns))
