"""Mixing sources to target weights by a low-discrepancy schedule.

A schedule has one slot per block of ``block_words`` words.  Slot t stands at the van der Corput
point of t, and the source whose share of the unit interval holds that point fills the slot, so
every stretch of the schedule has the target shares within a few blocks.  The rank of a slot
among those of its source has a closed form: the points before t are unions of arithmetic
progressions, one per binary digit of t, so they are counted per interval without a shuffle.

Each source's documents stand in an order given by a hash, end to end and repeated up to
``max_repeats`` times, and are cut into blocks of equal size.  The slot of rank r takes block r
of its source; the join gives the words that each slot takes of each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webdrift.llm.common import checkpointed, documents, n_words

BITS = 48  # of the points
CELL_BITS = 12  # the unit interval is cut into so many cells to find a point's source
BUCKETS = 1024  # parts of a source that are put in order separately


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeats: float) -> DataFrame:
    """(source, source_size, low, high, target) from rows (source, size).

    Sources in code point order, null last, weigh ``weights``, repeating, and share
    ``share`` times the total size by weight.  No target exceeds ``max_repeats`` times its
    source's size; the excess goes to the others by weight until none is above, so the targets
    are ``min(cap, level * weight)`` for one level.  low, high: the part of the unit interval,
    in 1 / 2**BITS.  One row per source; sources are few, as each has a weight of its own.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(order) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    caps = ranked.withColumn("weight", F.get(listed, F.col("place") % len(weights))).withColumn(
        "cap", F.col("source_size") * float(max_repeats)
    )
    # from the source that is full first on; those before it are at their caps
    full = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    levels = (
        caps.withColumn("wanted", F.sum("source_size").over(everything) * float(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("left"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        # the first level that overfills no source; if the total is above all caps, all are full
        .withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(
            F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("place")))).over(everything))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    )
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    share_of = F.sum("target").over(upto) / F.sum("target").over(everything)
    edge = F.coalesce(F.round(share_of * float(1 << BITS)), F.lit(0.0)).cast("bigint")
    return (
        levels.withColumn("high", edge)
        .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0)).cast("bigint"))
        .select("source", "place", "source_size", "low", "high", "target")
    )


def _point(slot: Column) -> Column:
    """The binary digits of ``slot`` mirrored: its van der Corput point in 1 / 2**BITS."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), BITS, "0")), 2, 10).cast("bigint")


def _points_below(edge: str) -> Column:
    """How many slots before ``slot`` (with ``point``) have a point below ``edge``.

    For each binary digit k that is set, the 2**k slots that share the higher digits and have
    this one clear stand in steps of 2**(BITS - k) from an offset, which is the point's low part.
    """
    return F.expr(f"""
        aggregate(sequence(0, {BITS - 2}), 0L, (n, k) -> if((shiftright(slot, k) & 1) = 0, n,
          n + least(shiftleft(1L, k), greatest(0L,
            shiftright({edge} - (point & (shiftleft(1L, {BITS - 1} - k) - 1)) + shiftleft(1L, {BITS} - k) - 1, {BITS} - k)))))
    """)


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, place, rank): which source fills each slot, and with which of its blocks."""
    width = BITS - CELL_BITS
    # cells a source touches; at most 2**CELL_BITS and one per source
    cells = targets.filter("low < high").select("place", "low", "high", F.explode(F.sequence(
        F.shiftright("low", width), F.shiftright(F.col("high") - 1, width))).alias("cell"))
    points = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
    return (
        points.withColumn("cell", F.shiftright("point", width))
        .join(F.broadcast(cells), "cell")
        .filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .select("slot", "place", (_points_below("high") - _points_below("low")).alias("rank"))
    )


def mix(
    rows: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
    max_repeats: int = 2, block_words: int = 128,
) -> tuple[DataFrame, DataFrame]:
    """(spans, per row): the mix of ``rows`` (doc_id, source, size), and what it takes of each.

    spans: (slot, place, rank, doc_id, item, first, words): slot ``slot`` takes ``words`` words
    from word ``first`` on of a document, in the order of ``first``-s stream.  Per row: doc_id,
    size, source_size, target and ``taken``, the words all slots take of it, repeats counted.

    No document gives more than ``max_repeats`` times its size.  A source's words come to its
    target within about two blocks; it takes whole rounds of its stream, then a prefix of it.
    Null sources are one source, the last; null sizes count as 0; rows of size 0 stay and give
    nothing; rows with equal doc_id are separate documents, ordered by size; equal rows are
    interchangeable.  An empty table or one without words gives an empty schedule.
    """
    rows = rows.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"))
    rows = checkpointed(rows.withColumn("at", F.xxhash64(F.lit("mix"), "doc_id", "size")))
    targets = checkpointed(source_targets(rows, weights, share, max_repeats))
    slots = -(-round(targets.agg(F.sum("target")).first()[0] or 0) // block_words)
    plan = schedule(targets, slots).withColumnRenamed("rank", "block")

    placed = rows.join(F.broadcast(targets), rows.source.eqNullSafe(targets.source)).select(
        "doc_id", "size", "at", "place", "source_size", "target", F.pmod("at", F.lit(BUCKETS)).cast("int").alias("bucket")
    )
    part = ["place", "bucket"]
    sums = placed.groupBy(*part).agg(F.sum("size").alias("words"))  # BUCKETS rows per source at most
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*part, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy(*part).orderBy("at", "doc_id", "size")
    streams = (
        placed.withColumn("item", F.row_number().over(order))
        .withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(starts, part)
        .withColumn("start", F.col("start") + F.col("before"))
    )
    # a row per block that a repeat of a document reaches into; rows without words keep one
    per_round = F.expr(f"""
        if(size = 0, array(), flatten(transform(sequence(0, {max_repeats - 1}), r -> transform(
          sequence((start + r * source_size) div {block_words}, (start + r * source_size + size - 1) div {block_words}),
          b -> named_struct('block', b, 'from', start + r * source_size)))))
    """)
    pieces = streams.withColumn("piece", F.explode_outer(per_round)).select(
        "doc_id", "size", "source_size", "target", *part, "item", "piece.block", "piece.from"
    )
    begin = F.greatest(F.col("from"), F.col("block") * block_words)
    end = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block_words)
    joined = pieces.join(plan, ["place", "block"], "left").select(
        "slot", "place", F.col("block").alias("rank"), "doc_id", "bucket", "item", "size", "source_size", "target",
        (begin - F.col("from")).alias("first"), F.when(F.col("slot").isNotNull(), end - begin).alias("words"),
    )
    taken = joined.groupBy("place", "bucket", "item").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.coalesce(F.sum("words"), F.lit(0)).alias("taken"),
    )
    spans = joined.filter("slot is not null").select("slot", "place", "rank", "doc_id", "bucket", "item", "first", "words")
    return spans, taken.select("doc_id", "size", "source_size", "target", "taken")


def op8_mixing(spark, folder: str) -> DataFrame:
    """What the mix takes of each document: sources weigh 3, 1, 2, 150% of all words, two rounds at most."""
    rows = documents(spark, folder).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(rows)[1]
