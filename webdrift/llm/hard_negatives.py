"""Hard-negative mining by cover trees over norm-augmented integer vectors.

Rows with a null label, a null vector, or a null, non-finite or too large component (``|x| >
2**16``, so that every integer product and sum stays exact in 64 bits) take no part.  Where vec_id
is divisible by 7 the label becomes ``(label + 1) % 10``; each component x becomes
``floor(256 * x)``.  A row's score is its integer inner product with the anchor (shorter vectors
count as padded with zeros); higher scores come first, ties by smaller vec_id (null last).
Anchors are the rows whose vec_id is divisible by 100.  An anchor's positives are its first
``positives`` other rows (another vec_id) of the same label; for each positive with score p, the
negatives are the first ``negatives`` rows of another label whose score s has
``80 * p <= 100 * s <= 100 * p``.  Rows repeated in vec_id, label and vector count once.

Plan.  Vectors are cleaned and made integers by Spark.  Candidates are dealt into blocks of about
``block_rows`` rows, anchors (or anchor-positive windows) into blocks of ``query_rows``; each pair
of blocks meets in one group (the stated query set against all rows, in blocks).  In a group the
candidates of each label form a cover tree: vectors are augmented by ``sqrt(M**2 - |x|**2)`` so
that all have the norm M, each level halves the covering radius, and a node keeps the largest
distance of its descendants to its centre.  For a query q a node's scores lie within
``q.c +- |q| r``; a level-wise descent bounds each level's children at once and skips nodes whose
interval misses the window, then the leaves left are verified best-first by their upper bound, by
exact integer products, until ``k`` rows are found that no further leaf can beat.  One window with a rank limit merges the blocks, first for positives, then for
negatives.

Edge cases: empty tables and tables without anchors give no rows; an anchor without positives, or
a positive whose window holds no other-label row, gives no row; a negative score below zero never
satisfies the window of a negative positive score.  Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webdrift.llm.common import checkpointed

# fixed values of the contract
SCALE = 256.0
ANCHOR_EVERY = 100
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # 80 * positive <= 100 * negative <= 100 * positive
LIMIT = float(1 << 16)  # largest |component| taken

BLOCK_ROWS = 8192  # candidates of one group
QUERY_ROWS = 2048  # queries of one group
LEAF = 24  # points under which a node is a leaf


class CoverTree:
    """A cover tree over integer vectors, augmented to one norm; nodes in flat arrays."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, nulls: np.ndarray):
        self.vectors, self.ids, self.nulls = vectors, ids, nulls
        points = vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", points, points)
        extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        self.points = np.hstack([points, extra[:, None]])
        self.center, self.radius, self.children, self.members = [], [], [], []
        if len(ids):
            everything = np.arange(len(ids))
            far = self._distances(everything, 0).max()
            self._build(everything, 0, far)

    def _distances(self, idx: np.ndarray, c: int) -> np.ndarray:
        diff = self.points[idx] - self.points[c]
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))

    def _build(self, idx: np.ndarray, c: int, level: float) -> int:
        node = len(self.center)
        self.center.append(c)
        self.children.append([])
        self.members.append(None)
        distance = self._distances(idx, c)
        reach = float(distance.max()) if len(idx) else 0.0
        self.radius.append(reach * (1 + 1e-9) + 1e-9)
        if len(idx) <= LEAF or reach == 0.0:
            self.members[node] = idx
            return node
        while level / 2 >= reach:  # skip levels that would hold one child only
            level /= 2
        half = level / 2
        centers, nearest, assign = [c], distance.copy(), np.zeros(len(idx), dtype=np.int64)
        while nearest.max() > half:  # farthest point first: centres half a level apart cover all
            new = idx[int(np.argmax(nearest))]
            d = self._distances(idx, new)
            closer = d < nearest
            assign[closer], nearest = len(centers), np.minimum(nearest, d)
            centers.append(new)
        for j, centre in enumerate(centers):
            part = idx[assign == j]
            if len(part):
                self.children[node].append(self._build(part, centre, half))
        return node

    def _flatten(self) -> None:
        """Nodes as arrays: centres' vectors, radii, children in CSR form, leaf members contiguous."""
        wide = self.points.shape[1] - 1
        self.centres = self.points[self.center, :wide]
        self.radii = np.asarray(self.radius)
        self.child_ptr = np.cumsum([0] + [len(c) for c in self.children])
        self.child_idx = np.asarray([c for cs in self.children for c in cs], dtype=np.int64)
        members = [m if m is not None else np.zeros(0, dtype=np.int64) for m in self.members]
        self.leaf = np.asarray([m is not None for m in self.members])
        self.member_ptr = np.cumsum([0] + [len(m) for m in members])
        self.member_idx = np.concatenate(members) if members else np.zeros(0, dtype=np.int64)

    def leaves(self, q: np.ndarray, qn: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, upper bounds) whose score interval meets [low, high]: a level-wise descent in which
        each level's children are bounded at once by their centre's score and covering radius."""
        if not self.center:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        if not hasattr(self, "radii"):
            self._flatten()

        def bounds(nodes):
            s = self.centres[nodes] @ q
            slack = qn * self.radii[nodes]
            slack = slack + 1e-9 * (np.abs(s) + slack) + 1.0
            return s - slack, s + slack

        found, uppers, level = [], [], np.zeros(1, dtype=np.int64)
        while len(level):
            lo, hi = bounds(level)
            level, hi = level[(hi >= low) & (lo <= high)], hi[(hi >= low) & (lo <= high)]
            ends = self.leaf[level]
            found.append(level[ends])
            uppers.append(np.minimum(hi[ends], high))
            inner = level[~ends]
            if not len(inner):
                break
            starts, stops = self.child_ptr[inner], self.child_ptr[inner + 1]
            level = self.child_idx[np.concatenate([np.arange(a, b) for a, b in zip(starts, stops)])]
        return np.concatenate(found), np.concatenate(uppers)

    def members_of(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([self.member_idx[self.member_ptr[n]:self.member_ptr[n + 1]] for n in leaves])

    def search(self, query: np.ndarray, low: float, high: float, k: int, exclude: int | None, best: list) -> None:
        """Adds to ``best`` (a list of (-score, null, id)) the top k rows whose score is in [low, high]."""
        search([self], query, low, high, k, exclude, best)


def search(trees: list, query: np.ndarray, low: float, high: float, k: int, exclude: int | None, best: list) -> None:
    """The top k rows of several trees with a score in [low, high], added to ``best``.

    Leaves whose interval meets the window are verified best-first by their upper bound, a few at a
    time by exact integer products, until the k-th score found beats the next leaf's bound.
    """
    q = query.astype(np.float64)
    qn = float(np.sqrt(q @ q))
    found = [(t, *t.leaves(q, qn, low, high)) for t in trees]
    tree_of = np.concatenate([np.full(len(leaves), i) for i, (_, leaves, _) in enumerate(found)]) if found else np.zeros(0)
    leaves = np.concatenate([leaves for _, leaves, _ in found]) if found else np.zeros(0, dtype=np.int64)
    upper = np.concatenate([u for _, _, u in found]) if found else np.zeros(0)
    order = np.argsort(-upper, kind="stable")
    step = 8
    for start in range(0, len(order), step):
        if len(best) >= k and -best[k - 1][0] > upper[order[start]]:
            break
        for i in order[start:start + step]:
            tree = found[int(tree_of[i])][0]
            members = tree.members_of([leaves[i]])
            scores = tree.vectors[members] @ query
            keep = (scores >= low) & (scores <= high)
            if exclude is not None:
                keep &= tree.nulls[members] | (tree.ids[members] != exclude)
            best.extend(zip((-scores[keep]).tolist(), tree.nulls[members][keep].tolist(), tree.ids[members][keep].tolist()))
        best.sort()
        del best[k:]


def _trees(rows: pd.DataFrame, width: int) -> dict:
    """Cover trees of one block's candidates by label."""
    trees = {}
    for label, part in rows.groupby("label", sort=False):
        vectors = np.zeros((len(part), width), dtype=np.int64)
        for i, v in enumerate(part["vec"]):
            vectors[i, : len(v)] = v
        trees[int(label)] = CoverTree(vectors, part["vec_key"].to_numpy(dtype=np.int64), part["vec_null"].to_numpy(dtype=bool))
    return trees


def _width(*frames) -> int:
    return max([1] + [len(v) for f in frames for v in f["vec"]])


def _padded(v, width: int) -> np.ndarray:
    out = np.zeros(width, dtype=np.int64)
    out[: len(v)] = v
    return out


def positives_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int = POSITIVES) -> pd.DataFrame:
    """queries: anchor_id, label, vec; rows: vec_key, vec_null, label, vec -> anchor_id, positive_id (null flag), score."""
    out = {"anchor_id": [], "positive_key": [], "positive_null": [], "positive_score": []}
    if len(queries) and len(rows):
        width = _width(queries, rows)
        trees = _trees(rows, width)
        for anchor, label, vec in zip(queries["anchor_id"], queries["label"], queries["vec"]):
            best: list = []
            if int(label) in trees:
                trees[int(label)].search(_padded(vec, width), -np.inf, np.inf, k, int(anchor), best)
            for score, null, key in best:
                out["anchor_id"].append(int(anchor))
                out["positive_key"].append(key)
                out["positive_null"].append(null)
                out["positive_score"].append(-score)
    return pd.DataFrame(out).astype({"anchor_id": "int64", "positive_key": "int64", "positive_null": "bool", "positive_score": "int64"})


def negatives_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int = NEGATIVES) -> pd.DataFrame:
    """queries: anchor_id, pair, label, positive_score, vec; rows as above -> pair, negative key, null flag, score."""
    out = {"pair": [], "negative_key": [], "negative_null": [], "negative_score": []}
    if len(queries) and len(rows):
        width = _width(queries, rows)
        trees = _trees(rows, width)
        for pair, label, p, vec in zip(queries["pair"], queries["label"], queries["positive_score"], queries["vec"]):
            p = int(p)
            low, high = -((-LOW * p) // HIGH), p  # smallest integer s with 100 s >= 80 p
            best: list = []
            if low <= high:
                search([t for other, t in trees.items() if other != int(label)], _padded(vec, width), low, high, k, None, best)
            for score, null, key in best:
                out["pair"].append(int(pair))
                out["negative_key"].append(key)
                out["negative_null"].append(null)
                out["negative_score"].append(-score)
    return pd.DataFrame(out).astype({"pair": "int64", "negative_key": "int64", "negative_null": "bool", "negative_score": "int64"})


def cleaned(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec array<bigint>): rows that take part, labels moved, components as integers, repeats once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LIMIT))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return (
        embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select("vec_id", label.cast("bigint").alias("label"),
                F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("vec"))
        .dropDuplicates(["vec_id", "label", "vec"])
    )


def _blocked(queries: DataFrame, rows: DataFrame, function, schema: str, n_queries: int, n_rows: int,
             block_rows: int, query_rows: int) -> DataFrame:
    """Every query block against every candidate block; one group per pair of blocks."""
    q_blocks, r_blocks = max(1, -(-n_queries // query_rows)), max(1, -(-n_rows // block_rows))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = queries.withColumn("qb", F.pmod(F.xxhash64(*queries.columns[:2]), F.lit(q_blocks))).withColumn("rb", spread(r_blocks))
    right = rows.withColumn("rb", F.pmod(F.xxhash64("vec_key", "vec_null", "vec"), F.lit(r_blocks))).withColumn("qb", spread(q_blocks))
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(
        lambda a, b: function(a, b), schema)


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the module."""
    rows = cleaned(embeddings)
    candidates = rows.select(F.coalesce("vec_id", F.lit(0)).alias("vec_key"), F.col("vec_id").isNull().alias("vec_null"), "label", "vec")
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    n_rows, n_anchors = rows.count(), anchors.count()
    if n_anchors == 0:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    found = _blocked(anchors, candidates, lambda a, b: positives_block(a, b, positives),
                     "anchor_id long, positive_key long, positive_null boolean, positive_score long",
                     n_anchors, n_rows, block_rows, query_rows)
    first = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_null", "positive_key")
    chosen = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= positives).drop("r")
    # written once: the positives are found once, and the pair numbers stay fixed for both uses
    pairs = checkpointed(chosen.join(anchors, "anchor_id").withColumn("pair", F.monotonically_increasing_id()))
    n_pairs = pairs.count()

    queries = pairs.select("anchor_id", "pair", "label", "positive_score", "vec")
    hits = _blocked(queries, candidates, lambda a, b: negatives_block(a, b, negatives),
                    "pair long, negative_key long, negative_null boolean, negative_score long",
                    n_pairs, n_rows, block_rows, query_rows)
    order = Window.partitionBy("pair").orderBy(F.col("negative_score").desc(), "negative_null", "negative_key")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.join(pairs.select("pair", "anchor_id", "positive_key", "positive_null", "positive_score"), "pair").select(
        "anchor_id",
        F.when(~F.col("positive_null"), F.col("positive_key")).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.when(~F.col("negative_null"), F.col("negative_key")).alias("negative_id"),
        "positive_score", "negative_score",
    )


def embeddings_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Up to 5 hard negatives for each of up to 5 positives of every anchor (vec_id divisible by 100)."""
    return mine(embeddings_table(spark, folder))


ORACLE = r"""
WITH clean AS (
  SELECT DISTINCT vec_id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) > 65536)) = 0
), anchors AS (
  SELECT vec_id AS anchor_id, label, v FROM clean WHERE vec_id % 100 = 0
), scored AS (
  SELECT a.anchor_id, a.label AS alabel, c.vec_id, c.label,
         list_sum(list_transform(range(1, greatest(len(a.v), len(c.v)) + 1),
                  lambda i: coalesce(a.v[i], 0) * coalesce(c.v[i], 0))) AS score
  FROM anchors a, clean c
), positives AS (
  SELECT anchor_id, alabel, vec_id AS positive_id, CAST(score AS BIGINT) AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id ASC NULLS LAST) AS r
    FROM scored WHERE label = alabel AND (vec_id IS NULL OR vec_id <> anchor_id)
  ) WHERE r <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, CAST(s.score AS BIGINT) AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id ASC NULLS LAST) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.alabel
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
