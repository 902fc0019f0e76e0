"""Tables derived from the given ones; the SQL of the same tables is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdrift.operators import decisions, pages
from webdrift.functions import text as X
from webdrift.sources.files import read_table


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled texts."""
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("innov"))
    texts = read_table(spark, folder, "documents", "doc_id").select("doc_id", "text", "lang", "source")
    return texts.join(labels, "doc_id")


def id_map(spark: SparkSession, folder: str) -> DataFrame:
    """Two id systems of one company; several ``id_nhr`` share a ``beid``."""
    doc = F.col("doc_id")
    return read_table(spark, folder, "documents").select(
        doc.alias("id_nhr"), F.floor(doc / 2).cast("bigint").alias("beid")
    )


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the same entity at two times: every turn of a conversation and the next one."""
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    old = turns.select("conv_id", "turn", F.col("text").alias("text_old"))
    new = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_new"))
    return old.join(new, ["conv_id", "turn"])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence vectors with company, label, scrape and a given cluster."""
    vec, label = F.col("vec_id"), F.col("label")
    return read_table(spark, folder, "embeddings").select(
        "vec_id", "embedding", "label",
        (label % 2).alias("innov"),
        (label * 10 + vec % 10).alias("company"),
        F.when(F.floor(vec / 10) % 2 == 0, 3).otherwise(12).alias("scrape"),
        (vec % 20).cast("int").alias("cluster"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a probability and a predicted label."""
    first = F.col("embedding")[0].cast("double")
    proba = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-6.0) * first))
    rows = vectors(spark, folder).withColumn("rf_proba", proba)
    rows = rows.withColumn("rf_pred_lab", (F.col("rf_proba") > 0.5).cast("int"))
    return rows.withColumn("bucket", decisions.score_bucket())


def raw_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Page text with tags taken out and nothing else, where glued sentences remain."""
    html = read_table(spark, folder, "pages", "page_id").select("page_id", "html")
    return html.select("page_id", X.strip_markup(X.transliterate(F.col("html"))).alias("text"))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_text(read_table(spark, folder, "pages", "page_id").select("page_id", "html"))
