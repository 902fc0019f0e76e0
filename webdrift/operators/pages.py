"""Page -> clean text: one projection, no shuffle.

Each step is a ``withColumn`` of its own: where a later step reads the column more
than once the optimiser keeps the two apart instead of computing it twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdrift.functions import text as X


def filter_computed(df: DataFrame, column: str, keep: Callable[[Column], Column]) -> DataFrame:
    """Filter on a column that is costly to compute.

    A plain filter would be pushed below the projection and the column computed twice
    (nested guards many times over).  Exploding an array of one or no value keeps the
    filter behind the computation; it is a narrow step inside the same stage.
    """
    kept = F.explode(F.filter(F.array(F.col(column)), keep)).alias(column)
    return df.select(*[c for c in df.columns if c != column], kept).select(*df.columns)


def visible_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the text a reader of the page sees, with line breaks turned into sentence ends.

    The page description, where there is one, is put in front.
    """
    columns = [c for c in pages.columns if c != text]
    return (
        pages.withColumn("_body", X.drop_hidden(F.col(html)))
        .withColumn("_body", X.drop_tags(X.break_list_items(F.col("_body"))))
        .withColumn("_body", X.decode_entities(F.col("_body")))
        .withColumn("_body", X.transliterate(F.col("_body")))
        .withColumn("_body", X.strip_markup(F.col("_body")))
        .withColumn("_body", X.normalize_lines(F.col("_body")))
        .withColumn("_body", X.newline_to_sentence(F.col("_body")))
        .withColumn("_about", X.meta_description(F.col(html)))
        .withColumn("_about", X.decode_entities(F.col("_about")))
        .withColumn(text, X.prefix_description(F.col("_about"), F.col("_body")))
        .select(*columns, text)
    )


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Transliterate, remove left-over markup, trim, and drop texts with nothing left."""
    cleaned = df.withColumn(text, X.transliterate(F.col(text)))
    cleaned = cleaned.withColumn(text, X.strip(X.strip_markup_repeated(F.col(text))))
    return filter_computed(cleaned, text, lambda t: t != "")


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    """For stored texts: the filter reaches the scan.  ``clean_text`` does it for computed ones."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != ""))


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Page table -> company text table."""
    readable = pages.where(F.col(html).isNotNull())
    return clean_text(visible_text(readable, html, text), text).drop(html)


def page_status(pages: DataFrame, html: str = "html") -> DataFrame:
    """Why a page gives no text: ``unreadable``, ``empty``; ``ok`` for the others."""
    texts = visible_text(pages.withColumn(html, F.coalesce(F.col(html), F.lit(""))), html, "_text")
    texts = texts.withColumn("_text", X.strip(X.strip_markup_repeated(F.col("_text"))))
    missing = F.col(html) == ""
    return texts.withColumn(
        "status", F.when(missing, "unreadable").when(F.col("_text") == "", "empty").otherwise("ok")
    ).drop("_text")


def rejects(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages that give no text, with the reason."""
    return filter_computed(page_status(pages, html), "status", lambda s: s != "ok").drop(html)


def normalize(df: DataFrame, text: str = "text") -> DataFrame:
    """Mask phone numbers and addresses, repair sentence borders."""
    return df.withColumn(text, X.normalize_text(F.col(text)))
