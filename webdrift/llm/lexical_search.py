"""Ranked lexical search of every benchmark item against all documents, by blocked dense products.

Terms are the maximal runs of ASCII letters and digits and of any non-ASCII character; only A-Z is
lower-cased.  With N the documents that have a term, L all their terms, n a document's terms, df
the documents holding a term and tf its count in one document, a term weighs
``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` (doubles) and a document's length norm is
``m = 25 + (75 * n * N) div L``; every other step is 64-bit integer arithmetic.  An item's score
for a document sums ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` over the item's terms, repeats
included; the ``top`` documents with the highest positive scores are kept per item, equal scores
by ascending doc_id (null last).

Plan.  Each text is cut and its terms counted once, inside its row (Arrow batches; the words of
a text are in one row, so nothing is shuffled for it), and the table is written to the shared
folder; only terms that some item holds go on from there.  N, L and df are counted over all documents.  Items are
dealt into blocks of ``item_block`` rows and documents into blocks of ``doc_block`` rows; each
pair of blocks meets in one group, where the items' terms form a compact vocabulary, the
vocabulary is cut into tiles so that no partial sum of a tile can reach 2**53, and float64 tiles
(BLAS) give exact integers that are summed in int64.  A column whose own bound reaches 2**53 is
multiplied in int64.  Each group keeps its top per item by (score desc, doc_id asc, row) exactly,
ties at the cut included in the order, and one window with a rank limit (partial top-k before its
shuffle) merges the groups.

Edge cases: a null or empty text has no terms; an item with a null text or no term matches
nothing; each row of ``benchmark`` is an item of its own (rows equal in item_id and text count
once) and each row of ``documents`` a document of its own, so repeated rows may take two ranks.
Long texts are read whole.  Empty tables give no rows.  Other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webdrift.llm.common import checkpointed, documents
from webdrift.operators.vocabulary import number

# fixed values of the contract
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
TOP = 10

ITEM_BLOCK = 512  # items that one group scores together
DOC_BLOCK = 4096  # documents of one group
DOC_TILE = 2048  # documents of one dense product
COL_TILE = 4096  # vocabulary columns of one dense product, at most
EXACT = float(1 << 53)
VOCAB_BROADCAST = 1 << 20  # item terms up to which the vocabulary is broadcast; above it, a shuffle join

RESULT = "item_key long, row_key long, doc_id long, score long"


def terms_of(text) -> F.Column:
    """The terms of a text column, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


PER_DOC = "row_key long, doc_id long, n long, terms array<string>, tfs array<long>"


def _counted(batches):
    """Per document row: n, and its distinct terms with their counts (one pass over the text)."""
    pattern, lower = re.compile(TERM), str.maketrans(UPPER, LOWER)
    for batch in batches:
        ns, terms, tfs = [], [], []
        for text in batch.column("text").to_pylist():
            found = pattern.findall(text.translate(lower)) if text else []
            counts = Counter(found)
            ns.append(len(found))
            terms.append(list(counts))
            tfs.append(list(counts.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_key"), batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()),
             pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
            names=["row_key", "doc_id", "n", "terms", "tfs"])


def _by_term(big: DataFrame, small: DataFrame, size: int, how: str = "inner") -> DataFrame:
    """Join on term; the vocabulary side is broadcast only below VOCAB_BROADCAST terms."""
    return big.join(F.broadcast(small) if size <= VOCAB_BROADCAST else small, "term", how)


def _top(scores: np.ndarray, doc_keys: np.ndarray, nulls: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` highest positive scores, equal ones by doc_id (null last), then row."""
    pos = np.flatnonzero(scores > 0)
    if len(pos) > top:  # everything below the top-th value goes; ties at it stay for the order
        kth = np.partition(scores[pos], len(pos) - top)[len(pos) - top]
        pos = pos[scores[pos] >= kth]
    order = np.lexsort((rows[pos], doc_keys[pos], nulls[pos], -scores[pos]))
    return pos[order[:top]]


def score_block(items: pd.DataFrame, docs: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """Top ``top`` documents per item of one (item block, document block).

    ``items``: item_key, term, q (count in the item); ``docs``: row_key, doc_key (doc_id, 0 for
    null), doc_null, term, impact.  Scores are exact: float64 tiles whose partial sums stay below
    2**53, summed in int64.  Returns item_key, row_key, doc_id, score.
    """
    empty = pd.DataFrame({"item_key": pd.Series(dtype="int64"), "row_key": pd.Series(dtype="int64"),
                          "doc_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})
    if items.empty or docs.empty:
        return empty
    column, vocab = pd.factorize(items["term"])
    item_row, item_keys = pd.factorize(items["item_key"])
    q = np.zeros((len(item_keys), len(vocab)))
    np.add.at(q, (item_row, column), items["q"].to_numpy(dtype=np.float64))

    docs = docs.assign(col=pd.Index(vocab).get_indexer(docs["term"]))
    docs = docs[docs["col"] >= 0]
    if docs.empty:
        return empty
    doc_row, row_keys = pd.factorize(docs["row_key"], sort=True)
    row_keys = np.asarray(row_keys, dtype=np.int64)
    impact = docs["impact"].to_numpy(dtype=np.int64)
    col = docs["col"].to_numpy()
    firsts = docs.groupby(doc_row)[["doc_key", "doc_null"]].first()
    doc_keys, nulls = firsts["doc_key"].to_numpy(dtype=np.int64), firsts["doc_null"].to_numpy(dtype=bool)

    # per column: the largest impact and the largest count of an item
    most = np.zeros(len(vocab), dtype=np.int64)
    np.maximum.at(most, col, impact)
    alone = q.max(axis=0) * most.astype(np.float64) >= EXACT  # not even one column is safe in doubles
    tiles, start, qsum, peak = [], 0, np.zeros(len(item_keys)), 0
    for j in range(len(vocab)):
        if alone[j]:
            continue
        grown, high = qsum + q[:, j], max(peak, int(most[j]))
        if j > start and (j - start >= COL_TILE or float(grown.max()) * high >= EXACT):
            tiles.append((start, j))
            start, grown, high = j, q[:, j].copy(), int(most[j])
        qsum, peak = grown, high
    tiles.append((start, len(vocab)))

    totals = np.zeros((len(item_keys), len(row_keys)), dtype=np.int64)
    order = np.argsort(doc_row, kind="stable")
    doc_row, col, impact = doc_row[order], col[order], impact[order]
    for d0 in range(0, len(row_keys), DOC_TILE):
        d1 = min(d0 + DOC_TILE, len(row_keys))
        lo, hi = np.searchsorted(doc_row, [d0, d1])
        r, c, v = doc_row[lo:hi] - d0, col[lo:hi], impact[lo:hi]
        for c0, c1 in tiles:
            inside = (c >= c0) & (c < c1) & ~alone[c]
            if not inside.any():
                continue
            dense = np.zeros((d1 - d0, c1 - c0))
            dense[r[inside], c[inside] - c0] = v[inside]
            totals[:, d0:d1] += (q[:, c0:c1] @ dense.T).astype(np.int64)
        for j in np.flatnonzero(alone):  # exact integer product for the rest
            hit = c == j
            if hit.any():
                exact = np.zeros(d1 - d0, dtype=np.int64)
                exact[r[hit]] = v[hit]
                totals[:, d0:d1] += q[:, j].astype(np.int64)[:, None] * exact[None, :]

    out = []
    for i, key in enumerate(item_keys):
        keep = _top(totals[i], doc_keys, nulls, row_keys, top)
        if len(keep):
            out.append(pd.DataFrame({
                "item_key": np.int64(key), "row_key": row_keys[keep],
                "doc_id": pd.array(doc_keys[keep], dtype="Int64"), "score": totals[i, keep],
            }))
            out[-1].loc[nulls[keep], "doc_id"] = pd.NA
    return pd.concat(out, ignore_index=True) if out else empty


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score, item_key, row_key): each item's ``top`` highest-scoring documents.

    ``docs``: doc_id, text; ``items``: item_id, text.  Whole texts, all documents; see the module.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # the texts are read and cut once; N, L, df and the impacts all come from this table
    per_doc = checkpointed(rows.mapInArrow(_counted, PER_DOC))
    counts = per_doc.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    big_n, big_l = int(counts["N"]), int(counts["L"])

    # rows equal in both count once; the keys are fixed by a checkpoint, so that every use sees the same
    queries = checkpointed(items.select("item_id", "text").distinct().withColumn("item_key", F.monotonically_increasing_id()))
    n_items = queries.count()
    if big_l == 0 or n_items == 0:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, item_key long, row_key long")
    item_blocks = max(1, -(-n_items // ITEM_BLOCK))
    item_terms = (
        queries.withColumn("item_block", F.pmod(F.xxhash64("item_key"), F.lit(item_blocks)))
        .select("item_block", "item_key", F.explode(terms_of(F.col("text"))).alias("term"))
        .groupBy("item_block", "item_key", "term").agg(F.count("*").alias("q"))
    )
    # item terms numbered in Spark; groups then carry integers, not strings
    vocab = number(item_terms.select("term").distinct(), ["term"], out="term_id")
    n_vocab = vocab.count()
    item_terms = _by_term(item_terms, vocab, n_vocab).drop("term").withColumnRenamed("term_id", "term")
    # new attributes (not those of item_terms), so that both sides of the cogroup stay apart
    vocab_blocks = item_terms.select((F.col("term") + 0).alias("term"), (F.col("item_block") + 0).alias("item_block")).distinct()

    # distinct (document, item term) with tf, counted inside the row
    pairs = per_doc.select("row_key", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
    tf = _by_term(pairs.select("row_key", "doc_id", "n", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf")), vocab, n_vocab)
    tf = tf.drop("term").withColumnRenamed("term_id", "term")
    weights = tf.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", F.floor(F.lit(1000.0) * F.log((2.0 * big_n + 2.0) / (F.col("df") * 2.0 + 1.0))).cast("bigint").alias("w")
    )
    m = F.lit(25) + F.expr(f"(75L * n * {big_n}L) div {big_l}L")
    part = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    doc_blocks = max(1, -(-big_n // DOC_BLOCK))
    impacts = (
        tf.join(F.broadcast(weights) if n_vocab <= VOCAB_BROADCAST else weights, "term").withColumn("m", m)
        .select("row_key", F.coalesce("doc_id", F.lit(0)).alias("doc_key"), F.col("doc_id").isNull().alias("doc_null"),
                "term", (F.col("w") * part).alias("impact"),
                F.pmod(F.xxhash64("row_key"), F.lit(doc_blocks)).alias("doc_block"))
    )
    routed = impacts.join(F.broadcast(vocab_blocks) if n_vocab <= VOCAB_BROADCAST else vocab_blocks, "term")
    # the stated query set goes to every document block
    fanned = item_terms.withColumn("doc_block", F.explode(F.sequence(F.lit(0), F.lit(doc_blocks - 1)).cast("array<bigint>")))

    def group(items_pdf: pd.DataFrame, docs_pdf: pd.DataFrame) -> pd.DataFrame:
        return score_block(items_pdf, docs_pdf, top)

    best = (
        fanned.groupBy("item_block", "doc_block")
        .cogroup(routed.groupBy("item_block", "doc_block"))
        .applyInPandas(group, RESULT)
    )
    order = Window.partitionBy("item_key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row_key")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(queries.select("item_key", "item_id"), "item_key").select("item_id", "rank", "doc_id", "score", "item_key", "row_key")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet")


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item's 10 highest-scoring documents over all documents."""
    return lexical_search(documents(spark, folder), benchmark(spark, folder)).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_key, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sizes AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS big_n, sum(len(terms)) AS big_l FROM docs
), occ AS (
  SELECT row_key, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs
), tf AS (
  SELECT row_key, doc_id, n, term, count(*) AS tf FROM occ GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000.0 * ln((2.0 * big_n + 2.0) / (2.0 * count(*) + 1.0))) AS BIGINT) AS w
  FROM tf, sizes GROUP BY term, big_n
), items AS (
  SELECT DISTINCT item_id, text FROM benchmark
), item_terms AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM items
), q AS (
  SELECT item_id, text, term, count(*) AS q FROM item_terms GROUP BY ALL
), scored AS (
  SELECT q.item_id, q.text, tf.row_key, tf.doc_id,
         sum(q.q * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * sizes.big_n) // sizes.big_l)))) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) CROSS JOIN sizes
  GROUP BY q.item_id, q.text, tf.row_key, tf.doc_id
), ranked AS (
  SELECT item_id, doc_id, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST, row_key) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
