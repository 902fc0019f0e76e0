"""From documents to shards: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (session, documents, data folder) and returns documents; the last one adds where
each goes.  ``run`` writes every stage's result to the shared folder and reads it again.

A stage works on all rows of its input; what its operator's docstring says of nulls, empty and
long texts, ties, repeated rows and empty tables holds for it.  Columns of documents that have
the name of a measure are kept: measures are made beside the row, not in it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdrift.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from webdrift.llm.common import checkpoint_folder, documents, n_words


def keep_good_text(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep."""
    nested = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality_rules.judged(nested).filter("kept").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal or near-equal texts: the one with the smallest doc_id."""
    return jaccard_join.one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item.  Those alike in doc_id and text go together."""
    items = spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet")
    return decontamination.without_leaks(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    The mix takes whole rounds of a source and then a part of the next, so only the document in
    which that part ends is taken in part; it counts if at least half of it is.  Rows that share
    a doc_id are taken alike, by what the mix takes of all of them.  Documents without words are
    not taken.
    """
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    taken = mixing.mix(sizes)[1].groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = taken.filter("size > 0").select(
        F.col("doc_id").alias("taken_id"), F.round(F.col("taken") / F.col("size")).cast("int").alias("times")
    ).filter("times > 0")
    nested = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"))
    return (
        nested.join(times, F.col("row_id").eqNullSafe(F.col("taken_id")))
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select("row.*")
    )


def put_in_shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, size, shard, slot): where each row goes; sizes of shards differ by one row at most."""
    text = F.col("text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"))
    return sharding.shard(rows, 16, ("doc_id",), ("size",))


STAGES = [
    ("quality rules", keep_good_text),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", put_in_shards),
]

#: The suffix array and the MinHash forest have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    base = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return docs
