"""Vocabularies as tables: terms numbered in Spark, sparse vectors assembled from the long form.

Nothing of a vocabulary goes through the driver but its size and the sizes of its partitions:
terms are range-partitioned, sorted inside each partition and numbered there, and the sizes of the
partitions give each one its offset.  A vector is the aggregate of its (index, value) rows, so a
vocabulary of any size works; no word is dropped for want of room.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdrift import constants as C
from webdrift.operators import terms
from webdrift.sources.files import work_folder

POSITION_BITS = 33  # monotonically_increasing_id: partition above these bits, position below


def number(df: DataFrame, order: list[str], out: str = "index", parts: int | None = None) -> DataFrame:
    """``df`` with ``out`` = 0, 1, ... in the order of ``order`` (which should be unique).

    Range partitions hold contiguous stretches of the order; inside each, rows are sorted and
    get their position, and each partition's offset is the sum of the sizes before it.  The
    result is written once to the shared folder, so that its numbers stay fixed.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id())
    path = work_folder(spark)
    ranged.write.parquet(path)
    written = spark.read.parquet(path)
    part = F.shiftright("_pos", POSITION_BITS)
    sizes = sorted((r["p"], r["n"]) for r in written.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return written.drop("_pos").withColumn(out, F.lit(None).cast("bigint"))
    starts = [0, *accumulate(n for _, n in sizes)][:-1]
    offsets = F.create_map(*[x for (p, _), s in zip(sizes, starts) for x in (F.lit(p), F.lit(s))])
    position = F.col("_pos").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return written.select(*df.columns, (F.element_at(offsets, part) + position).cast("bigint").alias(out))


@dataclass(frozen=True)
class Vocabulary:
    """(term, df, idf, index) in alphabetical order, and its size."""

    table: DataFrame
    size: int


def fit_vocabulary(
    docs: DataFrame, text: str = "text", min_chars: int = 3, min_df: int = C.MIN_DOCUMENT_FREQUENCY,
) -> Vocabulary:
    """Words in at least ``min_df`` texts, numbered alphabetically, with their smooth idf."""
    n_docs = docs.count()
    frequency = terms.document_frequency(docs, text, min_chars, min_df).withColumn(
        "idf", terms.smooth_idf(F.lit(float(n_docs)), F.col("df")))
    table = number(frequency, ["term"])
    size = table.count()
    if size == 0:
        raise ValueError(f"no word occurs in {min_df} texts")
    return Vocabulary(table, size)


def known_counts(docs: DataFrame, key: str, vocabulary: Vocabulary, text: str = "text", min_chars: int = 3) -> DataFrame:
    """(key, term, index, idf, n): counts of the known words of each text, from the long form."""
    counted = terms.term_counts(docs.withColumn(text, F.coalesce(F.col(text), F.lit(" "))), key, text, min_chars)
    return counted.join(vocabulary.table.select("term", "index", "idf"), "term")


@F.pandas_udf(VectorUDT())
def _as_vector(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of a sparse vector, retyped; Spark SQL has no cast for it."""
    return parts


def sparse(entries: Column, size: int) -> Column:
    """A sparse vector of ``size`` from an array of (index, value) structs sorted by index."""
    return _as_vector(F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
        F.transform(entries, lambda e: e["index"].cast("int")).alias("indices"),
        F.transform(entries, lambda e: e["value"].cast("double")).alias("values"),
    ))


def vectors(docs: DataFrame, key: str, long_form: DataFrame, value: str, size: int, out: str, l2: bool = False) -> DataFrame:
    """``docs`` with ``out``: the sparse vector of their (key, index, value) rows; empty where they have none."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("index").cast("bigint").alias("index"), F.col(value).cast("double").alias("value"))))
    grouped = long_form.groupBy(key).agg(entries.alias("_e"))
    if l2:  # squares summed in index order, as a normaliser of the vector does
        norm = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["value"] * e["value"]))
        grouped = grouped.withColumn("_norm", norm)
    none = F.array().cast("array<struct<index:bigint,value:double>>")
    joined = docs.join(grouped, key, "left").withColumn("_e", F.coalesce(F.col("_e"), none))
    if l2:  # divided above the join: below it the norm would be computed anew for every entry, inside the lambda
        scaled = F.transform("_e", lambda e: F.struct(e["index"].alias("index"), (e["value"] / F.col("_norm")).alias("value")))
        joined = joined.withColumn("_e", scaled).drop("_norm")
    return joined.withColumn(out, sparse(F.col("_e"), size)).drop("_e")
