"""Joins with checks, set operations, keyed de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_blank(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls of text columns become one blank."""
    names = list(columns) if columns else [n for n, kind in df.dtypes if kind == "string"]
    return df.na.fill(" ", subset=names)


def require_unique(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """The same rows; the job fails when a key occurs twice.

    Only the key columns are counted (partial aggregation takes care of hot keys) and
    only the largest count, a single value, is handed to the rows.  The payload, which
    may be whole texts, is not shuffled for the check.
    """
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    message = F.lit(f"{side} side: key {', '.join(keys)} is not unique")
    unique = F.coalesce(largest.scalar(), F.lit(0)) <= 1
    return df.where(F.assert_true(unique, message).isNull())


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails when a key is repeated on either side."""
    keys = list(keys)
    return require_unique(left, keys, "left").join(require_unique(right, keys, "right"), keys)


def join_with_suffixes(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Inner join on differently named keys; names on both sides get a suffix."""
    shared = set(left.columns) & set(right.columns)
    a = left.select([F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns])
    b = right.select([F.col(c).alias(c + suffixes[1] if c in shared else c) for c in right.columns])
    left_name = left_key + suffixes[0] if left_key in shared else left_key
    right_name = right_key + suffixes[1] if right_key in shared else right_key
    return a.join(b, a[left_name] == b[right_name])


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``.

    Keys are made distinct first (in each task, then once more after the shuffle the
    join needs anyway), so a key with many rows on the right sends one row per task.
    """
    keys = right.select(F.col(right_key or left_key).alias(left_key)).distinct()
    return left.join(keys, left_key, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``; null keys are kept."""
    keys = right.select(F.col(right_key or left_key).alias(left_key)).distinct()
    return left.join(keys, left_key, "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    The rank limit is applied before the shuffle too (WindowGroupLimit), so a hot key
    sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def union_all(*frames: DataFrame, fill_missing: bool = False) -> DataFrame:
    """Rows of all frames by column name; with ``fill_missing`` columns are sorted, gaps null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=fill_missing)
    return result.select(*sorted(result.columns)) if fill_missing else result


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both frames, only in the left, only in the right: one row.

    A tagged union with one aggregation per key instead of a join of key lists.
    """
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    seen = tagged.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("in_both"),
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
    )
