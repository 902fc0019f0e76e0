"""Readers and writers.  Every reader states its schema; nothing is inferred."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from webdrift.functions import text as X

TEXT_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_table(spark: SparkSession, folder: str, name: str, spread_by: str | None = None) -> DataFrame:
    """One Parquet table of a folder; ``spread_by`` see ``spread``."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return rows if spread_by is None else spread(rows, spread_by)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a table that comes in fewer pieces than there are cores.

    Text work is costly per byte, so a small table in one file would keep one core busy.
    Tables with enough splits, as any large one, are returned as they are, unshuffled.
    Rows are dealt by a hash of the key, not by the key, so that later steps shuffle as they
    would on a large table.  Meant for plain scans.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, F.xxhash64(key))


def read_html_folder(spark: SparkSession, folder: str, suffix: str = ".html") -> DataFrame:
    """One row per page file: ``id`` from the file name, ``html``, ``readable``.

    Undecodable files stay in the table with ``readable = false`` and no html, so a
    bad file costs a row and not the job; see ``operators.pages.rejects``.  Set
    ``spark.sql.files.ignoreCorruptFiles`` / ``ignoreMissingFiles`` on the session to
    also pass over files that cannot be opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select(
        X.id_from_name(F.col("_metadata.file_name"), suffix).alias("id"),
        F.when(readable, F.col("content").cast("string")).alias("html"),
        readable.alias("readable"),
    )


def read_text_folder(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """One row per text file: ``id`` from the file name and the whole ``text``."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return files.select(
        X.id_from_name(F.col("_metadata.file_name"), suffix).alias("id"), F.col("value").alias("text")
    )


def flatten_lines(df: DataFrame, text: str = "text", count: str = "line_count") -> DataFrame:
    """Newlines to blanks, with the number of lines the text had."""
    lines = F.size(F.split(F.col(text), "\n"))
    unfinished = F.when(F.col(text).endswith("\n") | (F.col(text) == ""), 1).otherwise(0)
    return df.withColumn(count, lines - unfinished).withColumn(
        text, F.translate(F.col(text), "\n", " ")
    )


def texts_for_keys(texts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Flattened texts of the companies that occur in ``keys``: one scan, not one read per key."""
    return flatten_lines(texts.join(keys.select(key), key, "left_semi"))


def string_schema(*names: str) -> StructType:
    """All columns as strings, as keys with leading zeros or the value ``NA`` need it."""
    return StructType([StructField(name, StringType()) for name in names])


def read_csv(
    spark: SparkSession, path: str, schema: StructType, sep: str = ",", empty_as_null: bool = True
) -> DataFrame:
    """Texts hold quotes and newlines, so records span lines and quotes are doubled.

    An empty cell is null, as it is for the tools that write these files; with
    ``empty_as_null=False`` it is the empty text.  The cell ``NA`` is text either way.
    A record that spans lines makes a file unsplittable; write many files (one per
    task, as ``write_csv`` does), not one large file.
    """
    rows = spark.read.options(**TEXT_CSV, sep=sep, multiLine=True).schema(schema).csv(path)
    return rows if empty_as_null else rows.na.fill("")


def read_abbreviation_lists(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All cells of any number of abbreviation lists: (list, row, cell), in the given order.

    Feed it to ``abbreviation_dictionary(cells, "cell", ["list", "row"])``.
    """
    schema = string_schema("cell", "meaning")
    lists = [
        read_csv(spark, path, schema, empty_as_null=False).select(
            F.lit(number).alias("list"), F.monotonically_increasing_id().alias("row"), "cell"
        )
        for number, path in enumerate(paths)
    ]
    return reduce(DataFrame.unionByName, lists)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Without an index column; blanks at the ends of a text are data and stay."""
    options = {"sep": sep, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**TEXT_CSV, **options).csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: str | None = None, mode: str = "errorifexists"
) -> None:
    """Parquet, by scrape if asked, so that later reads of one scrape skip the others."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session in one process may go without the setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="webdrift-")
    return f"{base.rstrip('/')}/webdrift-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a new file in the shared folder, computed once."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
