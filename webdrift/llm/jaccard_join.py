"""Near-duplicate texts: n-gram Jaccard join by a MinHash LSH forest, verified exactly.

Texts are sets of five-word shingles (a text of fewer words: one shingle of all of them).
Equal texts are one class from the start; all that follows is about different texts.

Forest.  A text has ``TREES`` labels of ``DEPTH`` MinHash values each.  In each tree the texts,
sorted by label, form a prefix trie.  The matched prefix starts at the full label and is
shortened until a pair at the threshold meets in some tree with the target probability,
``1 - (1 - s**depth)**trees``; texts under one node at that depth are candidates of each other.
Nodes of more than ``BLOCK`` texts are cut into blocks, and every two blocks meet in a task of
their own.  Inside a node, pairs whose sketches (4 bits of each MinHash value) make a similarity
of ``threshold - MARGIN`` plausible are joined, and a node gives a forest of such links, not pairs.

Verification.  The components of these links are small; their texts are brought together, again
block by block, and the Jaccard similarity of all their pairs is computed exactly as a product of
incidence matrices.  A task returns per text the number of its links and a forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift.llm.bytewise import Prefix, mixed, shingles, slices, words
from webdrift.llm.common import checkpointed, documents
from webdrift.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
TARGET = 0.999
MARGIN = 0.25
BLOCK = 256
VALUES = TREES * DEPTH
_FACTORS = np.random.default_rng(11).integers(1, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(12).integers(0, 1 << 32, VALUES, dtype=np.uint64)


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix at which a pair at the threshold is met with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, border): the set of shingles of each text, sorted inside it."""
    start, end, border = words(data, offsets)
    word = Prefix(data).of(start, end)
    count = np.diff(border)
    many = np.maximum(count - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(count)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + border[:-1][text]
    grams = shingles(word, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    short = [mixed(np.bitwise_xor.reduce(mixed(word[border[i] : border[i + 1]] + np.arange(count[i], dtype=np.uint64)))[None]) for i in few]
    hashes, text = np.concatenate([grams, *short]), np.concatenate([text, few])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(count) + 1))


def signatures(hashes: np.ndarray, border: np.ndarray) -> np.ndarray:
    """MinHash values (text, VALUES) of shingle sets, none of them empty."""
    out = np.empty((len(border) - 1, VALUES), np.uint32)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(VALUES):
        value = (low * np.uint32(_FACTORS[k])) ^ (high + np.uint32(_SHIFTS[k]))
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(value, border[:-1])
    return out


def _forest_rows(depth: int):
    """Batches (key, text) -> (tree, label, key, sketch): one row per tree; texts without words give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for low, high, data, offsets in slices(batch, "text"):
                hashes, border = text_shingles(data, offsets)
                some = np.flatnonzero(np.diff(border))
                if not len(some):
                    continue
                signature = signatures(hashes, border[np.append(some, some[-1] + 1)])
                nibbles = (mixed(signature.astype(np.uint64)) >> np.uint64(60)).astype(np.uint8)
                sketch = (nibbles[:, ::2] << 4) | nibbles[:, 1::2]
                sketches = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(VALUES // 2), len(some), [None, pa.py_buffer(np.ascontiguousarray(sketch))]
                ).cast(pa.binary())
                own = keys.take(pa.array(some + low))
                for tree in range(TREES):
                    label = np.full(len(some), tree, np.uint64)
                    for k in range(tree * DEPTH, tree * DEPTH + depth):
                        label = mixed(label * np.uint64(0x9E3779B97F4A7C15) + signature[:, k].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), tree, np.int32)), pa.array(label.view(np.int64)), own, sketches],
                        names=["tree", "label", "key", "sketch"],
                    )

    return run


def grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Whole groups, several at a time, of rows sorted by their first ``by`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.num_rows - 1
        tail = [batch.column(c)[last] for c in range(by)]
        cut = last
        # rows of the last group stay; groups are bounded, so the walk back is short
        while cut > 0 and all(batch.column(c)[cut - 1] == tail[c] for c in range(by)):
            cut -= 1
        if cut:
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, by: int) -> np.ndarray:
    """Borders of the groups of a sorted table."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for c in range(by):
        values = table.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _roots(linked: np.ndarray) -> np.ndarray:
    """(groups, n, n) links -> (groups, n): the first member of each member's component."""
    n = linked.shape[1]
    reach = linked | np.eye(n, dtype=bool)
    root = np.argmax(reach, axis=2)
    while True:
        least = np.where(reach, root[:, None, :], n).min(axis=2)
        if (least == root).all():
            return root
        root = least


def _plausible(threshold: float):
    """Batches (tree, label, one, two, key, sketch) sorted by the first four -> links (u, v)."""
    needed = (threshold - MARGIN) + (1 - threshold + MARGIN) / 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 4):
            border = _runs(table, 4)
            size = np.diff(border)
            keys = table.column("key").combine_chunks()
            packed = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES // 2)
            for n in np.unique(size[size > 1]):
                begin = border[:-1][size == n]
                for part in range(0, len(begin), step := max(1, (1 << 22) // int(n * n * VALUES))):
                    rows = begin[part : part + step, None] + np.arange(n)
                    s = packed[rows]
                    same = np.zeros((len(rows), n, n), np.int16)
                    for k in range(0, VALUES // 2, 8):
                        x = s[:, :, None, k : k + 8] ^ s[:, None, :, k : k + 8]
                        same += ((x & 0xF0) == 0).sum(3, dtype=np.int16) + ((x & 0x0F) == 0).sum(3, dtype=np.int16)
                    root = _roots(same >= needed * VALUES)
                    g, i = np.nonzero(root != np.arange(n))
                    if len(g):
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(rows[g, i])), keys.take(pa.array(rows[g, root[g, i]]))], names=["u", "v"]
                        )

    return run


def _verified(threshold: float):
    """Batches (root, one, two, block, key, text) sorted by the first three -> (key, links, to)."""
    top = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            border = _runs(table, 3)
            table = table.combine_chunks()
            one, two, block = (table.column(c).to_numpy() for c in ("one", "two", "block"))
            keys = table.column("key").combine_chunks()
            found: list[tuple] = []
            for low, high in zip(border[:-1], border[1:]):
                # a text that stands in several rows of its document counts once
                own = keys.slice(low, high - low).to_pylist()
                rows = low + np.flatnonzero([i == 0 or own[i] != own[i - 1] for i in range(len(own))])
                if len(rows) < 2:
                    continue
                sets = []
                texts = table.select(["text"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
                for _, _, data, offsets in slices(texts, "text"):
                    hashes, edge = text_shingles(data, offsets)
                    sets += np.split(hashes, edge[1:-1])
                linked = _links(sets, top)
                if one[low] != two[low]:  # pairs inside a block belong to the task of that block alone
                    linked &= block[rows][:, None] != block[rows][None, :]
                links = linked.sum(1)
                root = _roots(linked[None])[0]
                some = np.flatnonzero(links)
                found.append((rows[some], links[some], rows[root[some]]))
            if found:
                at, links, to = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), pa.array(links.astype(np.int64)), keys.take(pa.array(to))],
                    names=["key", "links", "to"],
                )

    return run


def _links(sets: list[np.ndarray], top: int) -> np.ndarray:
    """Which pairs of sets have at least top / 1000 of their union in common."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    count = np.bincount(column)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        width = 4096
        edge = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for low, high in zip(edge[:-1], edge[1:]):
            matrix = np.zeros((n, width), np.float32)
            matrix[owner[low:high], column[low:high] % width] = 1
            common += matrix @ matrix.T
    common = common.astype(np.int64)
    linked = 1000 * common >= top * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    return linked


def _blocks(rows: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (``by``..., key, ...) once per pair of blocks (one <= two) that their own block is in.

    sizes: ``by``... and n for groups over BLOCK; all others are one block.
    """
    parts = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    return (
        rows.join(sizes, by, "left")
        .withColumn("parts", parts)
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
        .drop("n", "parts", "other")
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> one row per text key: key, first_id, n_rows, links, class_id, root.

    key: md5 of the text (null: as the empty text); first_id: smallest doc_id with it; links: different
    texts of at least the threshold's similarity; class_id: smallest doc_id of all texts that are
    connected by links; root: a key of one of these.

    A text without words has no links.  doc_ids that are null come last; if all of a class are
    null, so is class_id.  Repeated rows are copies.  An empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.unhex(F.md5("text")))
    firsts = checkpointed(keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")))

    depth = matched_depth(threshold)
    rows = keyed.select("key", "text").mapInArrow(_forest_rows(depth), "tree int, label bigint, key binary, sketch binary")
    forest = checkpointed(rows.dropDuplicates(["tree", "label", "key"]))
    large = forest.groupBy("tree", "label").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    order = ["tree", "label", "one", "two"]
    parts = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = (
        _blocks(forest, large, ["tree", "label"])
        .select(*order, "key", "sketch").repartition(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(_plausible(threshold), "u binary, v binary")
    )
    groups = components(links)

    large = groups.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    members = groups.join(firsts.select(F.col("key").alias("node"), "first_id"), "node").withColumnRenamed("node", "key")
    # the text of each candidate, from a document that has it
    held = keyed.withColumnRenamed("key", "text_key")
    with_text = members.join(
        held, (F.col("key") == F.col("text_key")) & F.col("first_id").eqNullSafe(F.col("doc_id"))
    ).select("root", "key", "text")
    order = ["root", "one", "two"]
    checked = checkpointed(
        _blocks(with_text, large, ["root"])
        .select(*order, "block", "key", "text").repartition(parts, *order).sortWithinPartitions(*order, "key")
        .mapInArrow(_verified(threshold), "key binary, links bigint, to binary")
    )
    counts = checked.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("key").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "key")
    told = firsts.join(counts, "key", "left").join(classes, "key", "left").na.fill(0, ["links"])
    told = told.withColumn("root", F.coalesce("root", "key"))
    smallest = told.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return told.join(smallest, "root").select("key", "first_id", "n_rows", "links", "class_id", "root")


def labelled(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id, n_links, n_copies."""
    found = near_duplicates(docs, threshold)
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key")
    return docs.select("doc_id", key).join(found, "key").select(
        "doc_id", "class_id", F.col("links").alias("n_links"), F.col("n_rows").alias("n_copies")
    )


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` (any columns) that stay: one per group of texts connected by links.

    It is the one with the smallest doc_id of the group; of rows that share that and the text, one.
    Groups whose doc_ids are all null keep the text with the smallest key.
    """
    names = docs.columns
    found = near_duplicates(docs.select("doc_id", "text"), threshold)
    order = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("key"))
    kept = found.groupBy("root").agg(F.min_by(F.struct("key", "first_id"), order).alias("kept")).select("kept.*")
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.select(F.struct(*names).alias("row"), "doc_id", key.alias("key"))
    rows = kept.select(F.col("key").alias("kept_key"), "first_id").join(
        keyed, (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    )
    # rows alike in doc_id and text are rare and the only ones to be brought together
    times = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    single = rows.join(times, "key", "left_anti")
    double = rows.join(times, "key", "left_semi").dropDuplicates(["key"])
    return single.unionByName(double).select("row.*").select(*names)


def op2_jaccard_join(spark, folder: str) -> DataFrame:
    """Class and number of links of every document."""
    return labelled(documents(spark, folder).select("doc_id", "text"))
