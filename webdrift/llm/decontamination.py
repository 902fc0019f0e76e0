"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search.

1. Windows.  A window of an item's length that is to be verified must share five-word shingles
   with that item, and a shared shingle says where the item would begin.  So the windows to
   look at are those that a shingle of the benchmark points to; all others have similarity 0 with
   every item and are left out without loss.  Windows are cut off at the ends of a document.
2. Fingerprints.  A window and an item have 64-bit SimHash fingerprints of their words, each
   counted as often as it occurs.
3. Search.  Fingerprints are cut into ``BLOCKS`` bands.  Two that differ in at most ``RADIUS``
   bits differ in at most ``NEAR`` bits in one band, so each item is filed under all values within
   ``NEAR`` bits of each band and a window looks up its own bands: none within the radius is missed.
4. Verification.  Similarity of a window and an item: the shingles that both have, each counted as
   often as in both, over those of the item.

The radius is a filter before the exact check and has to be wide: a window of similarity 0.8 is 9 to 12
bits away on average.  Words are runs of letters and digits of the lower-case text.  An item of fewer than
five words is one shingle of all its words: it is found where these words follow each other (distance 0).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdrift.llm.common import checkpointed, documents

SHINGLE = 5
BLOCKS = 5  # bands of 13, 13, 13, 13 and 12 bits
NEAR = 4  # up to 5,166 band values an item
RADIUS = BLOCKS * (NEAR + 1) - 1
WIDTHS = [13, 13, 13, 13, 12]
BROADCAST_ROWS = 1_000_000  # shingles sent to every task at once: 16 MB


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _shingle(listed: str, at: str) -> Column:
    return F.xxhash64(*[F.expr(f"get({listed}, {at} + {i})") for i in range(SHINGLE)])


def numbered(df: DataFrame, listed: str, name: str) -> DataFrame:
    """Adds ``name``: the shingles of ``listed`` as a set in which repeats are told apart."""
    parts = ", ".join(f"get({listed}, i + {k})" for k in range(SHINGLE))
    plain = df.withColumn(name, F.expr(
        f"if(size({listed}) < {SHINGLE}, array(), transform(sequence(0, size({listed}) - {SHINGLE}), i -> xxhash64({parts})))"
    ))
    return plain.withColumn(name, F.expr(
        f"transform({name}, (h, i) -> xxhash64(h, size(filter(slice({name}, 1, i), x -> x = h))))"
    ))


def fingerprint(hashes: str) -> Column:
    """SimHash of an array of word hashes: bit b is set if it is set in more than half of them."""
    return F.expr(f"""
        aggregate(sequence(0, 63), 0L, (f, b) -> f | if(
          2 * aggregate({hashes}, 0L, (n, h) -> n + (shiftrightunsigned(h, b) & 1)) > size({hashes}), shiftleft(1L, b), 0L))
    """)


def _bands(name: str) -> list[Column]:
    """The bands of a fingerprint, each with its number in front."""
    found, low = [], 0
    for number, width in enumerate(WIDTHS):
        value = F.shiftrightunsigned(F.col(name), low).bitwiseAND((1 << width) - 1)
        found.append(F.lit(number << 16) + value)
        low += width
    return found


def _neighbours(name: str) -> Column:
    """All band values within NEAR bits of each band of ``name``."""
    found, low = [], 0
    for number, width in enumerate(WIDTHS):
        masks = [0] + [sum(1 << b for b in bits) for n in range(1, NEAR + 1) for bits in combinations(range(width), n)]
        band = f"({number << 16}L + (shiftrightunsigned({name}, {low}) & {(1 << width) - 1}))"
        found.append(f"transform(array({', '.join(map(str, masks))}), m -> {band} ^ m)")
        low += width
    return F.expr(f"concat({', '.join(found)})")


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per document and benchmark item it holds: the most similar window.

    docs (doc_id, text), items (item_id, text) -> doc_id, item_id, similarity, first_word,
    n_words of the window, hamming.  Ties go to the earlier window.

    Null and empty texts match nothing.  Documents with equal doc_id and text give the same rows
    once; items with equal text are each reported, and null item_ids as null.  Other columns are not looked at.
    Empty tables give an empty result.
    """
    listed = items.select("item_id", words(F.col("text")).alias("item_words"))
    short = checkpointed(listed.filter((F.size("item_words") < SHINGLE) & (F.col("item_words")[0] != "")))
    items = checkpointed(numbered(
        listed.filter(F.size("item_words") >= SHINGLE)
        .withColumn("item", F.monotonically_increasing_id()),
        "item_words", "item_shingles",
    ).withColumn("hashes", F.expr("transform(item_words, w -> xxhash64(w))"))
     .withColumn("item_print", fingerprint("hashes"))
     .select("item", "item_id", F.size("item_words").alias("item_n"), "item_words", "item_shingles", "item_print"))

    # where an item of which length would begin, given one of its shingles
    anchors = checkpointed(
        items.select("item_n", "item_words", F.explode(F.sequence(F.lit(0), F.col("item_n") - SHINGLE)).alias("offset"))
        .select(_shingle("item_words", "offset").alias("shingle"), "offset", "item_n").distinct()
    )
    # a benchmark too large to be sent to every task is sent in parts
    parts = max(1, -(-anchors.count() // BROADCAST_ROWS))
    split = docs.select("doc_id", words(F.col("text")).alias("doc_words")).select(
        "doc_id", "doc_words", F.when(F.size("doc_words") >= SHINGLE, F.size("doc_words")).alias("doc_n"),
    )
    # explode_outer: the optimiser would otherwise filter by the generator's input, splitting the text twice
    places = split.select("doc_id", "doc_words", "doc_n", F.explode_outer(F.when(
        F.col("doc_n").isNotNull(), F.sequence(F.lit(0), F.col("doc_n") - SHINGLE))).alias("at"))
    places = places.withColumn("shingle", _shingle("doc_words", "at"))
    found = None
    for part in range(parts):
        some = anchors.filter(F.pmod("shingle", F.lit(parts)) == part)
        start = F.col("at") - F.col("offset")
        hits = places.join(F.broadcast(some), "shingle").select(
            "doc_id", F.greatest(start, F.lit(0)).alias("first_word"), "doc_words",
            F.least(start + F.col("item_n"), F.col("doc_n")).alias("end"),
        )
        found = hits if found is None else found.unionByName(hits)
    windows = found.filter(F.col("end") - F.col("first_word") >= SHINGLE).select(
        "doc_id", "first_word", F.expr("slice(doc_words, first_word + 1, end - first_word)").alias("window")
    )
    windows = windows.groupBy("doc_id", "first_word", F.size("window").alias("n_words"), F.xxhash64("window").alias("same")).agg(
        F.first("window").alias("window")
    )
    windows = checkpointed(
        windows.withColumn("hashes", F.expr("transform(window, w -> xxhash64(w))"))
        .withColumn("print", fingerprint("hashes"))
        .select("doc_id", "first_word", "n_words", "window", "print")
    )
    # search distinct fingerprints: a passage in many documents is looked up once
    prints = windows.select("print").distinct().withColumn("band", F.explode(F.array(*_bands("print"))))
    filed = items.select("item", "item_print", F.explode(_neighbours("item_print")).alias("band"))
    hamming = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = (
        prints.join(filed, "band").withColumn("hamming", hamming).filter(F.col("hamming") <= RADIUS)
        .select("print", "item", "hamming").distinct()
    )
    shared = F.size(F.array_intersect("window_shingles", "item_shingles")) / F.size("item_shingles")
    pairs = (
        numbered(windows, "window", "window_shingles").join(near, "print")
        .join(items.select("item", "item_id", "item_shingles"), "item")
        .withColumn("similarity", shared).filter(F.col("similarity") >= similarity)
    )
    best = F.max_by(
        F.struct("similarity", "first_word", "n_words", "hamming"),
        F.struct("similarity", -F.col("first_word"), -F.col("n_words"), -F.col("hamming")),
    )
    pairs = pairs.select("doc_id", "item_id", "similarity", "first_word", "n_words", "hamming")
    pairs = pairs.unionByName(_short_leaks(split, short))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def _short_leaks(split: DataFrame, short: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, hamming): where all words of an item under SHINGLE words follow each other."""
    sizes = {r["n"]: r["count"] for r in short.groupBy(F.size("item_words").alias("n")).count().collect()}
    found = short.sparkSession.createDataFrame([], "first_word int, similarity double, n_words int, hamming int").join(
        split.select("doc_id").limit(0), F.lit(True)).join(short.select("item_id").limit(0), F.lit(True))
    for n, count in sorted(sizes.items()):
        some = short.filter(F.size("item_words") == n).select("item_id", "item_words", F.xxhash64("item_words").alias("same"))
        # explode_outer as above
        places = split.select("doc_id", "doc_words", F.explode_outer(F.when(
            F.size("doc_words") >= n, F.sequence(F.lit(0), F.size("doc_words") - n))).alias("first_word"))
        window = F.slice("doc_words", F.col("first_word") + 1, n)
        places = places.select("doc_id", "first_word", window.alias("window")).withColumn("same", F.xxhash64("window"))
        hits = places.join(F.broadcast(some) if count <= BROADCAST_ROWS else some, "same").filter(F.col("window") == F.col("item_words"))
        found = found.unionByName(hits.select(
            "doc_id", "item_id", F.lit(1.0).alias("similarity"), "first_word", F.lit(n).alias("n_words"), F.lit(0).alias("hamming")))
    return found


def without_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` (any columns) less those in which an item is found; rows alike in doc_id and text go together."""
    found = leaks(docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("doc_id"), "text"), items, similarity)
    leaked = found.select(F.col("doc_id.doc_id").alias("leaked_id"), F.col("doc_id.text").alias("leaked_text")).distinct()
    nested = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_text"))
    alike = F.col("row_id").eqNullSafe(F.col("leaked_id")) & (F.col("row_text") == F.col("leaked_text"))
    return nested.join(leaked, alike, "left_anti").select("row.*")


def op10_decontamination(spark, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the window."""
    items = spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    return leaks(documents(spark, folder).select("doc_id", "text"), items)
