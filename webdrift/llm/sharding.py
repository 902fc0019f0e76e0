"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``RING_SLOTS`` slots.  Every shard owns the slots up to each of its virtual nodes;
a key belongs to the first virtual node at or after its slot.  Shards have capacities, and keys
that find their shard full continue clockwise to the next virtual node whose shard has room.
With capacities that add up to the number of keys (``slack=0``) counts differ by one at most.

Keys are taken in the order of the ring, those that overflowed first, and what is left after one
turn goes on with a second one, by which all find room.  In this order the keys that one virtual
node gets are always the next ones of one sequence, so the whole placement is a list of at most
two ranges per virtual node, computed from counts per slot alone: a table whose size depends on
the ring and not on the data.  The keys themselves are shuffled once, by slot, to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webdrift.llm.common import documents, n_bytes

RING_SLOTS = 1 << 13
VIRTUAL_NODES = 64


def _slot(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(RING_SLOTS)).cast("int")


def ring(spark, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(slot, node, node_shard): the virtual node each ring slot belongs to and its shard.

    A slot that two virtual nodes hash to goes to the lower shard.
    """
    nodes = (
        spark.range(shards * virtual_nodes)
        .select((F.col("id") % shards).cast("int").alias("node_shard"), F.floor(F.col("id") / shards).alias("replica"))
        .select("node_shard", _slot(F.lit("node"), "node_shard", "replica").alias("node"))
        .groupBy("node").agg(F.min("node_shard").alias("node_shard"))
    )
    slots = spark.range(RING_SLOTS).select(F.col("id").cast("int").alias("slot"))
    around = Window.orderBy("slot").rowsBetween(0, Window.unboundedFollowing)
    owner = F.struct("node", "node_shard")
    first = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        slots.join(nodes, F.col("slot") == F.col("node"), "left")
        .select("slot", F.when(F.col("node").isNotNull(), owner).alias("own"))
        .select(
            "slot",
            F.coalesce(F.first("own", True).over(around), F.first("own", True).over(first)).alias("own"),
        )
        .select("slot", "own.node", "own.node_shard")
    )


def _ranges(counts: DataFrame, shards: int, slack: float) -> DataFrame:
    """Where the keys of each slot go: (slot, ahead, low, high, shard, base).

    ``ahead``: keys of earlier slots.  Keys numbered low..high-1 of the whole ring go to ``shard``,
    the first of them to position ``base`` of it.
    """
    before = Window.orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    # slots behind the last virtual node belong to the first one and open the ring
    ordered = (
        counts.withColumn("turn", F.when(F.col("slot") > F.col("node"), 0).otherwise(1))
        .withColumn("ahead", F.coalesce(F.sum("keys").over(before), F.lit(0)))
    )
    nodes = (
        ordered.groupBy("node", "node_shard")
        .agg(F.min("ahead").alias("from"), F.max(F.col("ahead") + F.col("keys")).alias("upto"))
        .groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("node", "node_shard", "from", "upto"))).alias("nodes"))
        .withColumn("keys", F.array_max("nodes.upto"))
    )
    # capacity of shard s; without slack the first keys % shards shards take one more
    room = (
        "transform(sequence(0, {k} - 1), s -> cast(if({e} > 0, ceil((1 + {e}) * keys / {k}), "
        "keys div {k} + if(s < keys % {k}, 1, 0)) as bigint))"
    ).format(k=shards, e=float(slack))
    walk = f"""
        aggregate(
          concat(nodes, transform(nodes, n -> named_struct('node', n.node, 'node_shard', n.node_shard, 'from', n.`from`, 'upto', keys))),
          named_struct('room', {room}, 'used', transform(sequence(1, {shards}), s -> 0L), 'placed', 0L,
            'found', cast(array() as array<struct<low:bigint,high:bigint,shard:int,base:bigint>>)),
          (state, n) -> named_struct(
            'room', transform(state.room, (r, s) -> if(s = n.node_shard, r - least(r, n.upto - state.placed), r)),
            'used', transform(state.used, (u, s) -> if(s = n.node_shard,
                      u + least(state.room[s], n.upto - state.placed), u)),
            'placed', state.placed + least(state.room[n.node_shard], n.upto - state.placed),
            'found', if(least(state.room[n.node_shard], n.upto - state.placed) > 0,
                        concat(state.found, array(named_struct(
                          'low', state.placed,
                          'high', state.placed + least(state.room[n.node_shard], n.upto - state.placed),
                          'shard', n.node_shard, 'base', state.used[n.node_shard]))),
                        state.found)),
          state -> state.found)
    """
    found = nodes.select("nodes", F.expr(walk).alias("found"))
    # the ranges that the keys of a node fall into, then those of each of its slots
    per_node = found.select(F.explode("nodes").alias("n"), "found").select(
        "n.node", F.explode(F.filter("found", lambda r: (r.low < F.col("n.upto")) & (r.high > F.col("n.from")))).alias("r")
    )
    return (
        ordered.filter("keys > 0").join(per_node, "node")
        .filter((F.col("r.low") < F.col("ahead") + F.col("keys")) & (F.col("r.high") > F.col("ahead")))
        .select("slot", "ahead", "r.*")
    )


def shard(
    rows: DataFrame, shards: int, key: tuple[str, ...], ties: tuple[str, ...] = (),
    slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """``rows`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    ``slack`` 0: numbers of rows differ by one at most.  Above 0: no shard has more than
    ``ceil((1 + slack) * rows / shards)`` rows and fewer rows leave their own virtual node.

    Null keys are a key like any other.  Rows with one key lie next to each other on the ring;
    ``ties`` (columns) makes their order, and so the result, independent of how rows are stored;
    rows equal in key and ties are interchangeable.  An empty table stays empty.  Carries the
    columns of ``rows`` through one shuffle, so give it narrow rows; columns named ``shard`` and
    ``slot`` are replaced.
    """
    if shards < 1 or virtual_nodes < 1:
        raise ValueError("at least one shard and one virtual node")
    rows = rows.drop("shard", "slot")
    names = rows.columns
    placed = rows.select(F.struct(*names).alias("row"), _slot(*key).alias("slot"), F.xxhash64(*key).alias("at"))
    counts = (
        ring(rows.sparkSession, shards, virtual_nodes)
        .join(placed.groupBy("slot").agg(F.count("*").alias("keys")), "slot", "left")
        .na.fill(0, ["keys"])
    )
    order = Window.partitionBy("slot").orderBy("at", *[f"row.{c}" for c in (*key, *ties)])
    numbered = placed.withColumn("rank", F.row_number().over(order) - 1)
    ranges = _ranges(counts, shards, slack)  # at most RING_SLOTS + 2 * shards * virtual_nodes rows
    number = F.col("ahead") + F.col("rank")
    return (
        numbered.join(F.broadcast(ranges), "slot")
        .filter((number >= F.col("low")) & (number < F.col("high")))
        .select("row.*", F.col("shard").alias("shard"), (F.col("base") + number - F.col("low")).alias("slot"))
    )


def op1_sharding(spark, folder: str) -> DataFrame:
    """All documents in 16 shards whose numbers of rows differ by one at most (law ``rows``).

    Ring key: doc_id.  Equal texts are not kept together: they may be a third of all rows.
    """
    text = F.col("text")
    narrow = documents(spark, folder).select(
        "doc_id", (n_bytes(text) + 1).alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard(narrow, 16, ("doc_id",), ("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
