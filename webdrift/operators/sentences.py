"""Language vote and sentence table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift import constants as C
from webdrift.functions import text as X


def detect_language(
    df: DataFrame,
    text: str = "text",
    code: str = "lang_code",
    name: str = "language",
    words: Mapping[str, Iterable[str]] | None = None,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Language by a vote of function words, counted inside the row: no join, no shuffle.

    ``code`` is null when no word is known; equal votes go to the language listed
    first.  ``name`` is ``dutch`` or ``english``; any other language counts as english.
    """
    words = dict(words or C.FUNCTION_WORDS)
    names = dict(names or C.LANGUAGE_NAMES)
    votes = X.language_votes(F.col("_tokens"), words)
    counted = df.withColumn("_tokens", X.letter_tokens(F.col(text), sorted({w for listed in words.values() for w in listed}))).withColumn(
        "_votes", F.struct(*[v.alias(k) for k, v in votes.items()])
    )
    best = F.greatest(*[F.col(f"_votes.{lang}") for lang in words])
    winner = F.lit(None).cast("string")
    for lang in reversed(list(words)):
        winner = F.when(F.col(f"_votes.{lang}") == F.col("_best"), lang).otherwise(winner)
    language = F.lit(C.DEFAULT_LANGUAGE)
    for lang, label in names.items():
        language = F.when(F.col(code) == lang, label).otherwise(language)
    return (
        counted.withColumn("_best", best)
        .withColumn(code, F.when(F.col("_best") > 0, winner))
        .withColumn(name, language)
        .drop("_tokens", "_votes", "_best")
    )


def explode_sentences(
    df: DataFrame,
    text: str = "text",
    abbreviations: Iterable[str] = C.ABBREVIATIONS,
    position: str = "sent_pos",
    end_marks: str = C.SENTENCE_END,
) -> DataFrame:
    """One row per sentence; the other columns of the text row go along."""
    others = [c for c in df.columns if c != text]
    sentences = X.split_sentences(F.col(text), abbreviations, end_marks)
    return df.select(*others, F.posexplode(sentences).alias(position, text))


def with_letters(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop sentences of digits and signs only."""
    return df.where(X.has_letter(F.col(text)))


def abbreviation_dictionary(
    lists: DataFrame, cell: str, order: Iterable[str]
) -> DataFrame:
    """Dotted abbreviations from cells such as ``AA of A.A.`` or ``Dep(t) / dept.``.

    One row per abbreviation with the place it is first seen, given by ``order`` and
    the position within the cell.  Works on any number of lists in one table.
    """
    order = list(order)
    pieces = lists.select(
        *order, F.posexplode(F.split(F.col(cell), C.ABBREVIATION_SPLIT)).alias("piece_pos", "piece")
    ).withColumn("piece", F.regexp_replace("piece", C.ABBREVIATION_GLOSS, ""))
    dotted = pieces.where(F.col("piece").rlike(C.ABBREVIATION_KEEP)).withColumn(
        "abbreviation", F.regexp_replace("piece", C.ABBREVIATION_NOTE, "")
    )
    first = F.min(F.struct(*order, "piece_pos"))
    return (
        dotted.groupBy("abbreviation").agg(first.alias("first"))
        .select("abbreviation", *[f"first.{c}" for c in [*order, "piece_pos"]])
    )


def abbreviation_list(dictionary: DataFrame, limit: int = 20_000) -> list[str]:
    """The dictionary as a driver list for ``explode_sentences``.

    The list becomes one pattern, so its size is checked and not cut.
    """
    rows = dictionary.select("abbreviation").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} abbreviations; filter the dictionary first")
    return [r.abbreviation for r in rows]
