"""Random forests grown in the workers: no node of a tree and no row goes to the driver.

The rules are those of Spark's forest, which ``classifiers.random_forest`` fits: at most 32 bins per feature,
Poisson(1) bootstrap weights, a new subset of features at every node, the split with the largest
decrease of Gini impurity, sides of at least ``min_leaf`` weighted rows, a leaf where no split
decreases it, sibling leaves of one class merged, and a vote that averages the class shares of the leaves.
Spark keeps all nodes of all trees on the driver; full-grown trees have nodes in proportion to the rows.

* Bin limits come from quantiles of all rows: each task reduces the rows it has to ``POINTS`` weighted values
  per feature, the driver merges these.
* Rows are binned (a byte a value) and written once.  Every growing task reads all of them
  (``operators/streams.py``) and grows its own trees, level by level, on numpy arrays.  A matrix of more than
  ``MATRIX_BYTES`` goes to a temporary file of the task and is read in pieces once per level.
* A tree draws from (seed, number of the tree) alone, so the first t trees of a forest are the forest of t trees.
* Trees are written by the tasks; to score, every task reads them in pieces and adds their votes up.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from webdrift.operators import streams
from webdrift.operators.streams import array

BINS = 32
POINTS = 256  # weighted values a feature of a task's rows is reduced to
PART_ROWS = 50_000  # rows a task reduces and bins
MATRIX_BYTES = 1 << 27  # of binned rows a growing task holds in memory
INSTANCES = 1 << 18  # (row, tree) pairs grown at once, in several trees where rows are few
CELLS = 1 << 20  # cells of the histograms held at once
VOTE = 1 << 40  # a whole vote: votes are whole numbers, so that their sum does not depend on the order
TASKS = 24  # growing tasks of a forest at most: each reads all rows
TREES = "pos int, roots int, feature binary, bin binary, left binary, share binary"


# --- bins -----------------------------------------------------------------------------


def _reduced(values: np.ndarray, weights: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values with their weights, or ``points`` quantiles of equal weight."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    values, weights = values[first], np.add.reduceat(weights, first)
    if len(values) <= points:
        return values, weights
    total = weights.sum()
    heavy = weights >= total / points  # kept as they are
    rest = max(1, points - int(heavy.sum()))
    light, weight = values[~heavy], weights[~heavy]
    at = np.searchsorted(np.cumsum(weight), (np.arange(rest) + 0.5) * weight.sum() / rest)
    return (np.concatenate([values[heavy], light[np.minimum(at, len(light) - 1)]]),
            np.concatenate([weights[heavy], np.full(rest, weight.sum() / rest)]))


def _limits(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """At most 31 limits: between all distinct values, or each nearest to the next share of the weight, as Spark puts them."""
    values, weights = _reduced(values, weights, len(values))
    middle = (values[1:] + values[:-1]) / 2
    if len(values) <= BINS:
        return middle
    stride = weights.sum() / BINS
    target, kept = stride, []
    upto = np.cumsum(weights).tolist()
    for i in range(1, len(upto)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            kept.append(middle[i - 1])
            target += stride
            if len(kept) == BINS - 1:
                break
    return np.array(kept)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows x values of a list column."""
    if column.null_count:
        raise ValueError("a row without a vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, feature values, weights) of a task's rows, reduced."""
    held: dict[int, list] = {}
    for batch in batches:
        x, fold = _matrix(batch.column("x")), batch.column("fold").to_numpy(zero_copy_only=False)
        for f in np.unique(fold):
            rows = x[fold == f]
            old = held.get(f)
            held[f] = [
                _reduced(np.concatenate([old[j][0], rows[:, j]]) if old else rows[:, j],
                         np.concatenate([old[j][1], np.ones(len(rows))]) if old else np.ones(len(rows)))
                for j in range(x.shape[1])
            ]
    for f, features in held.items():
        yield pa.RecordBatch.from_pydict({
            "fold": [int(f)], "n": [[len(v) for v, _ in features]],
            "value": [np.concatenate([v for v, _ in features]).astype("f8").tobytes()], "weight": [np.concatenate([w for _, w in features]).tobytes()],
        }, schema=pa.schema([("fold", pa.int32()), ("n", pa.list_(pa.int32())), ("value", pa.binary()), ("weight", pa.binary())]))


@dataclass(frozen=True)
class Rows:
    """Training rows (key, x, y, fold), dealt by key and sorted inside their parts, with what the driver knows of them."""

    table: DataFrame
    n: int
    classes: int
    sketches: list  # (fold, [(values, weights) per feature])

    def limits(self, without: int | None = None) -> list[np.ndarray]:
        """Bin limits of every feature from the rows of all folds, or all but one."""
        used = [features for fold, features in self.sketches if fold != without]
        return [_limits(np.concatenate([f[j][0] for f in used]), np.concatenate([f[j][1] for f in used])) for j in range(len(used[0]))]


def prepare(df: DataFrame, vector: str, label: str, key: str, n: int, fold=None) -> Rows:
    x, y = F.col(vector), F.col(label).cast("int")
    rows = df.select(F.col(key).alias("key"), x.alias("x"), y.alias("y"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    parts = max(12, -(-n // PART_ROWS))
    # equal rows apart, the order is the same however the rows came
    table = streams.stored(rows.repartition(parts, "key").sortWithinPartitions("key", "y", "x"))
    n, known, low, high = table.agg(F.count(F.lit(1)), F.count("y"), F.min("y"), F.max("y")).first()
    if known < n or (n and low < 0):
        raise ValueError("labels must be 0, 1, ...")
    sketches = []
    for r in table.select("x", "fold").mapInArrow(_sketch, "fold int, n array<int>, value binary, weight binary").collect():
        ends = np.cumsum(r["n"])[:-1]
        sketches.append((r["fold"], list(zip(*(np.split(np.frombuffer(r[c], "f8"), ends) for c in ("value", "weight"))))))
    if not sketches:
        raise ValueError("no rows to grow trees on")
    return Rows(table, n, high + 1, sketches)


def _binned(x: np.ndarray, limits: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, limit in enumerate(limits):
        out[:, j] = np.searchsorted(limit, x[:, j], side="left")
    return out


def _pieces(limits: list[np.ndarray]):
    """Task function: binned rows in pieces of some megabytes, numbered inside their part."""
    size = max(1, streams.BLOB_BYTES // max(1, len(limits)))

    def run(batches):
        seq, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            x = _binned(_matrix(batch.column("x")), limits)
            y, fold = (batch.column(c).to_numpy().astype(np.int32) for c in ("y", "fold"))
            for s in range(0, len(x), size):
                e = min(s + size, len(x))
                yield pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n": [e - s], "x": [x[s:e].tobytes()], "y": [y[s:e].tobytes()], "fold": [fold[s:e].tobytes()]},
                                                 schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("fold", pa.binary())]))
                seq += 1

    return run


def binned(rows: Rows, limits: list[np.ndarray]) -> tuple[DataFrame, dict]:
    """The binned rows in pieces, and the place of each piece's first row: (part, seq) -> place."""
    pieces = streams.stored(rows.table.mapInArrow(_pieces(limits), "part int, seq int, n int, x binary, y binary, fold binary"))
    starts, at = {}, 0
    for r in sorted(pieces.select("part", "seq", "n").collect()):
        starts[(r["part"], r["seq"])] = at
        at += r["n"]
    return pieces, starts


class Matrix:
    """Binned rows of one task: in memory, or in a temporary file that is read in pieces."""

    def __init__(self, n: int, width: int):
        self.n, self.width, self.y, self.fold = n, width, np.empty(n, np.int32), np.empty(n, np.int32)
        self.file = tempfile.TemporaryFile() if n * width > MATRIX_BYTES else None
        self.x = None if self.file else np.empty((n, width), np.uint8)

    def put(self, start: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        end = start + len(y)
        self.y[start:end], self.fold[start:end] = y, fold
        if self.file:
            self.file.seek(start * self.width)
            self.file.write(x.tobytes())
        else:
            self.x[start:end] = x.reshape(-1, self.width)

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first row, rows): the matrix, or some megabytes of its file at a time."""
        if not self.file:
            yield 0, self.x
            return
        size = max(1, streams.BLOB_BYTES * 8 // self.width)
        for s in range(0, self.n, size):
            self.file.seek(s * self.width)
            yield s, np.frombuffer(self.file.read(min(size, self.n - s) * self.width), np.uint8).reshape(-1, self.width)

    def gather(self, row: np.ndarray, node: np.ndarray, features: np.ndarray | None) -> np.ndarray:
        """The values of rows in the features of their nodes (None: all).  ``row`` ascends if the matrix is in a file."""
        width = self.width if features is None else features.shape[1]
        out = np.empty((len(row), width), np.uint8)
        step = max(1, CELLS // width)
        for s, x in self.pieces():
            a, b = (np.searchsorted(row, s), np.searchsorted(row, s + len(x))) if self.file else (0, len(row))
            for i in range(a, b, step):
                j = min(i + step, b)
                at = row[i:j] - s
                out[i:j] = x[at] if features is None else x[at[:, None], features[node[i:j]]]
        return out


# --- growing --------------------------------------------------------------------------


@dataclass
class Trees:
    """Trees in one array of nodes; node i < roots is the root of tree i, a node's right child follows its left one."""

    roots: int
    feature: np.ndarray  # -1: leaf
    bin: np.ndarray  # values in bins up to it go left
    left: np.ndarray
    share: np.ndarray  # nodes x classes


def _subsets(nodes: int, width: int, k: int, rng) -> np.ndarray:
    out = np.empty((nodes, k), np.int32)
    step = max(1, CELLS // width)
    for s in range(0, nodes, step):
        e = min(s + step, nodes)
        out[s:e] = np.argpartition(rng.random((e - s, width), dtype=np.float32), k - 1, axis=1)[:, :k]
    return out


def _splits(bins: np.ndarray, local: np.ndarray, y: np.ndarray, w: np.ndarray, counts: np.ndarray, min_leaf: int):
    """Per node: (splits at all, place of the feature, bin, class counts on the left).  Rows are in the order of ``local``."""
    nodes, classes = counts.shape
    k = bins.shape[1]
    found, slot, cut, left_counts = np.zeros(nodes, bool), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros((nodes, classes))
    starts = np.searchsorted(local, np.arange(nodes + 1))
    step, most = max(1, CELLS // (k * BINS * classes)), max(1, CELLS // k)
    place = np.arange(k) * BINS
    for a in range(0, nodes, step):
        b = min(a + step, nodes)
        cells = (b - a) * k * BINS * classes
        hist = np.zeros(cells)
        for s in range(starts[a], starts[b], most):
            e = min(s + most, starts[b])
            code = ((local[s:e] - a) * (k * BINS))[:, None] + place + bins[s:e]
            code = code * classes + y[s:e, None]
            hist += np.bincount(code.ravel(), np.repeat(w[s:e], k), cells)
        left = hist.reshape(b - a, k, BINS, classes).cumsum(axis=2)[:, :, :-1]
        total = counts[a:b]
        right = total[:, None, None, :] - left
        n_left, n_right, n = left.sum(-1), right.sum(-1), total.sum(1)
        allowed = (n_left >= min_leaf) & (n_right >= min_leaf)
        score = (left * left).sum(-1) / np.maximum(n_left, 1) + (right * right).sum(-1) / np.maximum(n_right, 1)
        score = np.where(allowed, score, -1.0).reshape(b - a, -1)
        best = score.argmax(1)
        top = score[np.arange(b - a), best]
        found[a:b] = top / n > (total * total).sum(1) / (n * n) + 1e-12 if b > a else False
        slot[a:b], cut[a:b] = best // (BINS - 1), best % (BINS - 1)
        left_counts[a:b] = left[np.arange(b - a), slot[a:b], cut[a:b]]
    return found, slot, cut, left_counts


def grow(matrix: Matrix, classes: int, numbers: Sequence[int], seed: int, k: int, depth: int, min_leaf: int, without: int | None = None) -> Trees:
    """The trees of these numbers, on all rows or all but those of one fold."""
    inside = np.arange(matrix.n) if without is None else np.flatnonzero(matrix.fold != without)
    draws = [np.random.default_rng([seed, t]) for t in numbers]
    row, node, weight = [], [], []
    for i, rng in enumerate(draws):
        w = rng.poisson(1.0, len(inside))
        w = w if w.any() else np.ones_like(w)
        kept = np.flatnonzero(w)
        row.append(inside[kept])
        node.append(np.full(len(kept), i))
        weight.append(w[kept].astype("f8"))
    row, node, weight = np.concatenate(row), np.concatenate(node), np.concatenate(weight)
    y = matrix.y[row]
    tree = np.arange(len(draws))
    counts = np.bincount(node * classes + y, weight, len(draws) * classes).reshape(-1, classes)
    levels, made = [], 0
    for level in range(depth + 1):
        size = len(counts)
        feature, cut, left = np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size, np.int32)
        levels.append([made, feature, cut, left, counts])
        open_ = ((counts > 0).sum(1) > 1) & (counts.sum(1) >= 2 * min_leaf)
        active = np.flatnonzero(open_)
        if level == depth or not len(active):
            break
        local = np.full(size, -1)
        local[active] = np.arange(len(active))
        at = local[node]
        rows = np.flatnonzero(at >= 0)
        row, at, y, weight = row[rows], at[rows], y[rows], weight[rows]
        features = None
        if k < matrix.width:  # nodes of a level are in the order of their trees
            of = tree[active]
            features = np.concatenate([_subsets(int((of == t).sum()), matrix.width, k, draws[t]) for t in np.unique(of)])
        bins = matrix.gather(row, at, features)
        order = np.argsort(at, kind="stable")
        found, slot, best, left_counts = _splits(bins[order], at[order], y[order], weight[order], counts[active], min_leaf)
        split = active[found]
        feature[split] = slot[found] if features is None else features[np.flatnonzero(found), slot[found]]
        cut[split] = best[found]
        left[split] = made + size + 2 * np.arange(len(split))
        new = np.empty((2 * len(split), classes))
        new[0::2], new[1::2] = left_counts[found], counts[split] - left_counts[found]
        child = np.full(len(active), -1)
        child[found] = 2 * np.arange(len(split))
        rows = np.flatnonzero(found[at])
        row, at, y, weight, bins = row[rows], at[rows], y[rows], weight[rows], bins[rows]
        node = child[at] + (bins[np.arange(len(at)), slot[at]] > best[at])
        made += size
        tree, counts = np.repeat(tree[split], 2), new
        if not len(split):
            break
    return _merged(levels, len(draws))


def _merged(levels: list, roots: int) -> Trees:
    """One array of nodes, sibling leaves of one class made one leaf."""
    starts = [level[0] for level in levels]
    feature, cut, left, counts = (np.concatenate([level[i] for level in levels]) for i in (1, 2, 3, 4))
    pred = counts.argmax(1)
    ends = [*starts[1:], len(feature)]
    for s, e in reversed(list(zip(starts, ends))):
        inner = s + np.flatnonzero(feature[s:e] >= 0)
        a = left[inner]
        feature[inner[(feature[a] < 0) & (feature[a + 1] < 0) & (pred[a] == pred[a + 1])]] = -1
    kept = np.zeros(len(feature), bool)
    kept[:roots] = True
    for s, e in zip(starts, ends):
        inner = s + np.flatnonzero(kept[s:e] & (feature[s:e] >= 0))
        kept[left[inner]] = kept[left[inner] + 1] = True
    number = np.cumsum(kept) - 1
    left = np.where(feature >= 0, number[left], 0).astype(np.int32)
    counts = counts[kept]
    return Trees(roots, feature[kept], cut[kept], left[kept], counts / counts.sum(1, keepdims=True))


def votes(trees: Trees, x: np.ndarray) -> np.ndarray:
    """rows x classes: the class shares of the leaves of all trees, added up, in parts of a ``VOTE``."""
    share = np.rint(trees.share * VOTE).astype(np.int64)
    out = np.zeros((len(x), share.shape[1]), np.int64)
    step = max(1, INSTANCES // trees.roots)
    for s in range(0, len(x), step):
        part = x[s:s + step]
        node = np.tile(np.arange(trees.roots), len(part))
        row = np.repeat(np.arange(len(part)), trees.roots)
        on = np.flatnonzero(trees.feature[node] >= 0)
        while len(on):
            at = node[on]
            node[on] = at = trees.left[at] + (part[row[on], trees.feature[at]] > trees.bin[at])
            on = on[trees.feature[at] >= 0]
        out[s:s + step] = share[node].reshape(len(part), trees.roots, -1).sum(1)
    return out


def per_node(setting: str | int, width: int) -> int:
    """Features drawn at a node."""
    return int(np.ceil(np.sqrt(width))) if setting == "sqrt" else min(int(setting), width)


def _together(n: int, in_file: bool) -> int:
    return 1 if in_file else max(1, INSTANCES // max(1, n))


def _read(batches, starts: dict, n: int, width: int):
    """(task number or None, Matrix) from the pieces a task gets."""
    matrix, task = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            matrix = matrix or Matrix(n, width)
            task = batch.column("task")[i].as_py()
            start = starts[(batch.column("part")[i].as_py(), batch.column("seq")[i].as_py())]
            matrix.put(start, array(batch.column("x")[i], np.uint8), array(batch.column("y")[i], np.int32), array(batch.column("fold")[i], np.int32))
    return task, matrix


# --- a forest -------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """A fitted forest: its trees are a table, the driver knows the bin limits only."""

    trees: DataFrame
    limits: list
    classes: int

    def score(self, df: DataFrame, vector: str) -> DataFrame:
        """``df`` with ``pred`` and ``proba``; rows keep their columns, nothing is matched by position."""
        limits, classes, schema = self.limits, self.classes, df.schema
        out = StructType([*schema.fields, StructField("pred", IntegerType()), StructField("proba", DoubleType())])
        total = self.trees.agg(F.sum("roots")).first()[0]

        def pack(batches):
            seq = 0
            for batch in batches:
                for s in range(0, batch.num_rows, 4096):
                    part = batch.slice(s, 4096)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    x = _binned(_matrix(part.column(vector)), limits) if part.num_rows else np.empty((0, len(limits)), np.uint8)
                    yield pa.RecordBatch.from_pydict({"seq": [seq], "rows": [sink.getvalue().to_pybytes()], "x": [x.tobytes()]},
                                                     schema=pa.schema([("seq", pa.int32()), ("rows", pa.binary()), ("x", pa.binary())]))
                    seq += 1

        def add(batches):
            seen: dict[int, tuple] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    cells = {c: batch.column(c)[i] for c in batch.schema.names}
                    trees = Trees(cells["roots"].as_py(), array(cells["feature"], np.int32), array(cells["bin"], np.uint8),
                                  array(cells["left"], np.int32), array(cells["share"], "f8").reshape(-1, classes))
                    seq = cells["seq"].as_py()
                    vote = votes(trees, array(cells["x"], np.uint8).reshape(-1, len(limits)))
                    counted, before = seen.pop(seq, (0, 0))
                    counted, vote = counted + trees.roots, before + vote
                    if counted < total:
                        seen[seq] = counted, vote
                    else:
                        rows = pa.ipc.open_stream(cells["rows"].as_buffer()).read_next_batch()
                        pred, proba = vote.argmax(1).astype(np.int32), vote[:, 1] / (total * VOTE) if classes > 1 else np.zeros(len(vote))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pred), pa.array(proba)], names=[*rows.schema.names, "pred", "proba"])

        packed = df.mapInArrow(pack, "seq int, rows binary, x binary")
        return streams.against(self.trees, packed).mapInArrow(add, out)

    def save(self, path: str) -> None:
        spark = self.trees.sparkSession
        self.trees.write.mode("overwrite").option("parquet.block.size", streams.GROUP_BYTES).parquet(f"{path}/trees")
        rows = [(j, [float(v) for v in limit], self.classes) for j, limit in enumerate(self.limits)]
        spark.createDataFrame(rows, "feature int, limits array<double>, classes int").write.mode("overwrite").parquet(f"{path}/bins")

    @staticmethod
    def load(spark, path: str) -> Forest | None:
        """The forest saved there; None if it is another model."""
        try:
            table = spark.read.parquet(f"{path}/bins")
        except AnalysisException:
            return None
        bins = table.orderBy("feature").collect()
        return Forest(spark.read.schema(TREES).parquet(f"{path}/trees"), [np.array(r["limits"], "f8") for r in bins], bins[0]["classes"])


def _cells(first: int, trees: Trees) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "pos": [first], "roots": [trees.roots], "feature": [trees.feature.tobytes()], "bin": [trees.bin.tobytes()],
        "left": [trees.left.tobytes()], "share": [trees.share.tobytes()],
    }, schema=pa.schema([("pos", pa.int32()), ("roots", pa.int32()), *((c, pa.binary()) for c in ("feature", "bin", "left", "share"))]))


def fit(rows: Rows, trees: int, max_features: str | int, depth: int, min_leaf: int, seed: int) -> Forest:
    spark = rows.table.sparkSession
    limits = rows.limits()
    pieces, starts = binned(rows, limits)
    n, width, classes, k = rows.n, len(limits), rows.classes, per_node(max_features, len(limits))
    shares = np.array_split(np.arange(trees), min(trees, TASKS))
    shares = [(int(s[0]), len(s)) for s in shares]

    def run(batches):
        task, matrix = _read(batches, starts, n, width)
        if matrix is None:
            return
        first, count = shares[task]
        step = _together(n, matrix.file is not None)
        for t in range(first, first + count, step):
            numbers = range(t, min(t + step, first + count))
            yield _cells(t, grow(matrix, classes, numbers, seed, k, depth, min_leaf))

    grown = streams.against(pieces, streams.tasks(spark, len(shares), "task")).mapInArrow(run, TREES)
    return Forest(streams.stored(grown), limits, classes)


def cross_validate(rows: Rows, folds: int, settings: Sequence[dict], seed: int) -> list[tuple[int, int, float | None, float | None]]:
    """(setting, fold, accuracy on the fold, accuracy on the other rows) of a forest for every setting and fold.

    Settings that differ in the number of trees alone are prefixes of one forest, which is grown once.
    """
    spark = rows.table.sparkSession
    shared: dict[tuple, list[int]] = {}
    for number, s in enumerate(settings):
        shared.setdefault((per_node(s["max_features"], len(rows.sketches[0][1])), s["max_depth"], s["min_leaf"]), []).append(number)
    groups = [(kind, sorted((settings[i]["n_estimators"], i) for i in members)) for kind, members in shared.items()]
    groups.sort(key=lambda g: -g[0][0] * g[1][-1][0])  # the longest first
    n, classes, out = rows.n, rows.classes, None
    for fold in range(folds):
        if all(f == fold for f, _ in rows.sketches):
            continue  # no rows outside the fold
        limits = rows.limits(without=fold)
        pieces, starts = binned(rows, limits)
        run = _validation(groups, starts, n, len(limits), classes, fold, seed)
        part = streams.against(pieces, streams.tasks(spark, len(groups), "task")).mapInArrow(
            run, "setting int, fold int, held double, seen double")
        out = part if out is None else out.unionByName(part)
    return [tuple(r) for r in out.collect()] if out is not None else []


def _validation(groups: list, starts: dict, n: int, width: int, classes: int, fold: int, seed: int):
    def run(batches):
        task, matrix = _read(batches, starts, n, width)
        if matrix is None:
            return
        (k, depth, min_leaf), ends = groups[task]
        held, vote, done = matrix.fold == fold, np.zeros((n, classes), np.int64), 0
        step = _together(n, matrix.file is not None)
        for end, setting in ends:
            while done < end:
                numbers = range(done, min(done + step, end))
                trees = grow(matrix, classes, numbers, seed, k, depth, min_leaf, without=fold)
                for s, x in matrix.pieces():
                    vote[s:s + len(x)] += votes(trees, x)
                done = numbers[-1] + 1
            right = vote.argmax(1) == matrix.y
            yield pa.RecordBatch.from_pydict({
                "setting": [setting], "fold": [fold], "held": [float(right[held].mean()) if held.any() else None],
                "seen": [float(right[~held].mean()) if not held.all() else None],
            }, schema=pa.schema([("setting", pa.int32()), ("fold", pa.int32()), ("held", pa.float64()), ("seen", pa.float64())]))

    return run
