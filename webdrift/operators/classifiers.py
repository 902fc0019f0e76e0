"""The nine classifiers, scoring, comparison, random search, saving.

Vectors are an array column; the Spark ML vector is made at the border.  Every scored
row keeps its input columns and gains ``pred`` and, where the model has one, ``proba``
(probability of class 1).
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as ML
from pyspark.ml.feature import Binarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdrift import constants as C
from webdrift.operators import forest, metrics
from webdrift.operators.knn import knn_classify
from webdrift.operators.qda import fit_qda

FEATURES = "_features"
LABEL = "_label"


def with_features(df: DataFrame, vector: str, label: str | None = None) -> DataFrame:
    """Add the ML vector (from an array column, or the column itself) and the ML label."""
    is_array = dict(df.dtypes)[vector].startswith("array")
    df = df.withColumn(FEATURES, array_to_vector(F.col(vector)) if is_array else F.col(vector))
    return df if label is None else df.withColumn(LABEL, F.col(label).cast("double"))


def _base(estimator):
    return estimator.setFeaturesCol(FEATURES).setLabelCol(LABEL)


def bernoulli_nb() -> Pipeline:
    binary = Binarizer(threshold=0.0, inputCol=FEATURES, outputCol="_binary")
    return Pipeline(stages=[binary, _base(ML.NaiveBayes(modelType="bernoulli", smoothing=1.0)).setFeaturesCol("_binary")])


def logreg_l1(n_train: int, c: float = 1.0):
    """L1 penalty with inverse strength c; Spark averages the loss over the rows."""
    return _base(ML.LogisticRegression(
        elasticNetParam=1.0, regParam=1.0 / (c * n_train), standardization=False, maxIter=100, tol=1e-4
    ))


def linear_svc():
    return _base(ML.LinearSVC(regParam=1e-4, standardization=False))


def mlp(size: int, seed: int = C.SEED):
    return _base(ML.MultilayerPerceptronClassifier(layers=[size, 100, 2], maxIter=200, seed=seed))


# every task holds the statistics of a pass's nodes: large enough for few passes, small enough for four tasks in one heap
TREE_MEMORY = {"maxMemoryInMB": 256, "cacheNodeIds": True}


def tree(seed: int = C.SEED):
    return _base(ML.DecisionTreeClassifier(maxDepth=C.TREE_DEPTH, seed=seed, **TREE_MEMORY))


def random_forest(
    trees: int = 100, max_features: str | int = "sqrt", max_depth: int | None = None,
    min_leaf: int = 1, seed: int = C.SEED,
):
    """``max_depth`` None is as deep as Spark's trees go; more than that is refused."""
    if max_depth is not None and max_depth > C.TREE_DEPTH:
        raise ValueError(f"trees of depth {max_depth} cannot be grown; {C.TREE_DEPTH} at most")
    return _base(ML.RandomForestClassifier(
        numTrees=trees, featureSubsetStrategy=str(max_features), seed=seed,
        maxDepth=max_depth or C.TREE_DEPTH, minInstancesPerNode=min_leaf, **TREE_MEMORY,
    ))


def boosted_trees(seed: int = C.SEED):
    return _base(ML.GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=5, minInstancesPerNode=20, seed=seed))


def score(model, df: DataFrame, vector: str) -> DataFrame:
    """Add ``pred`` and ``proba``; rows keep their columns, nothing is matched by position."""
    if isinstance(model, forest.Forest):
        return model.score(df, vector)
    scored = model.transform(with_features(df, vector))
    proba = vector_to_array(F.col("probability"))[1] if "probability" in scored.columns else F.lit(None).cast("double")
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("pred"), proba.alias("proba"))


@contextmanager
def training_rows(
    df: DataFrame, key: str, rows_per_task: int = 5_000, max_tasks: int | None = None
) -> Iterator[tuple[DataFrame, int]]:
    """The rows cached for the passes of a fit, and their number.

    They are dealt out to as many tasks as are useful (``max_tasks`` at most), placed and ordered by
    key, so that the same rows give the same fit however they were stored and on however many cores.
    """
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = cached.count()
        useful = max(1, min(math.ceil(n / rows_per_task), max_tasks or n))
        placed = cached.repartition(useful, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)
        placed.count()
    finally:
        cached.unpersist()
    try:
        yield placed, n
    finally:
        placed.unpersist()


# Trees do much work per row, so few rows are worth a task.  Each task also sends the statistics of every
# node of a pass, even of nodes it has no row of; full-grown trees have nodes in proportion to the rows, so
# tasks in proportion as well would make what is moved grow with the square of the rows.
TREE_TASKS = {"rows_per_task": 200, "max_tasks": 12}

Scorer = Callable[[DataFrame], DataFrame]


def train(
    name: str, df: DataFrame, vector: str, label: str, key: str, seed: int = C.SEED
) -> Scorer:
    """Fit one of the nine models; the result scores a frame."""
    if name == "knn":
        def neighbours(test: DataFrame) -> DataFrame:
            pred = knn_classify(test, df, key, vector, label, k=2)
            return test.join(pred, key).withColumn("proba", F.lit(None).cast("double"))

        return neighbours
    if name == "qda":
        return fit_qda(df, vector, label).transform
    if name == "random_forest":
        model = fit_forest(df, vector, label, key, seed)
        return lambda test: score(model, test, vector)
    makers = {
        "bernoulli_nb": lambda n, size: bernoulli_nb(),
        "logreg_l1": lambda n, size: logreg_l1(n),
        "linear_svc": lambda n, size: linear_svc(),
        "mlp": lambda n, size: mlp(size, seed),
        "tree": lambda n, size: tree(seed),
        "gbt": lambda n, size: boosted_trees(seed),
    }
    tasks = TREE_TASKS if name in ("tree", "gbt") else {}
    with training_rows(with_features(df, vector, label).select(key, FEATURES, LABEL), key, **tasks) as (rows, n):
        model = makers[name](n, rows.first()[FEATURES].size).fit(rows)
    return lambda test: score(model, test, vector)


MODELS = ("bernoulli_nb", "logreg_l1", "knn", "linear_svc", "qda", "mlp", "tree", "random_forest", "gbt")


def compare(
    train_df: DataFrame, test_df: DataFrame, vector: str, label: str, key: str,
    models: Sequence[str] = MODELS, seed: int = C.SEED,
) -> DataFrame:
    """Classification report of every model on the same split."""
    scored, train_df = None, train_df.persist(StorageLevel.MEMORY_AND_DISK)
    for name in models:
        part = train(name, train_df, vector, label, key, seed)(test_df)
        part = part.select(F.lit(name).alias("model"), F.col(label).alias("truth"), "pred")
        scored = part if scored is None else scored.unionByName(part)
    train_df.unpersist()
    return metrics.classification_report(scored, "truth", "pred", by=["model"])


def _rows_to_grow(df: DataFrame, vector: str, label: str, key: str, n: int, fold=None) -> forest.Rows:
    if not dict(df.dtypes)[vector].startswith("array"):
        df = df.withColumn(vector, vector_to_array(F.col(vector)))
    return forest.prepare(df, vector, label, key, n, fold)


def draw_settings(
    grid: Mapping[str, Sequence] = C.SEARCH_GRID, n: int = C.SEARCH_DRAWS, seed: int = C.SEED
) -> list[dict]:
    """n settings of the grid, different ones as Spark runs them.

    Depths above Spark's limit, and None, are the limit; ``min_samples_split`` becomes the least
    size of a leaf, half of it.  Both are reported as they are used.
    """
    every = {}
    for values in itertools.product(*grid.values()):
        setting = dict(zip(grid, values))
        depth = min(setting["max_depth"] or C.TREE_DEPTH, C.TREE_DEPTH)
        used = {
            "n_estimators": setting["n_estimators"], "max_features": setting["max_features"],
            "max_depth": depth, "min_leaf": max(1, setting["min_samples_split"] // 2),
        }
        every[tuple(used.values())] = used
    return random.Random(seed).sample(list(every.values()), min(n, len(every)))


def random_search(
    df: DataFrame, vector: str, label: str, key: str,
    grid: Mapping[str, Sequence] = C.SEARCH_GRID, draws: int = C.SEARCH_DRAWS,
    folds: int = C.SEARCH_FOLDS, seed: int = C.SEED,
) -> tuple[object, DataFrame]:
    """Random search over forests with k-fold cross-validation.

    Returns the model of the best setting, fitted on all rows, and a table with one row
    per setting: mean accuracy on the held-out folds and on the training folds, and the
    rank.  The fold of a row follows from a hash of its key.  Forests are grown in the workers
    (``operators/forest.py``), those of all settings and folds at a time; settings that differ in the
    number of trees alone are read off one forest as it grows, which gives what separate fits give.
    """
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds))
    settings = draw_settings(grid, draws, seed)
    data = _rows_to_grow(df, vector, label, key, df.count(), fold)
    results = forest.cross_validate(data, folds, settings, seed)
    rows = []
    for number, setting in enumerate(settings):
        held = [r[2] for r in results if r[0] == number and r[2] is not None]
        seen = [r[3] for r in results if r[0] == number and r[3] is not None]
        rows.append((
            number, setting["n_estimators"], str(setting["max_features"]), setting["max_depth"],
            setting["min_leaf"], sum(held) / len(held), sum(seen) / len(seen),
        ))
    rows.sort(key=lambda r: (-r[5], r[0]))
    chosen = settings[rows[0][0]]
    best = forest.fit(data, chosen["n_estimators"], chosen["max_features"], chosen["max_depth"], chosen["min_leaf"], seed)
    schema = (
        "draw int, n_estimators int, max_features string, max_depth int, min_leaf int, "
        "mean_test_accuracy double, mean_train_accuracy double, rank int"
    )
    ranked = [(*row, place) for place, row in enumerate(rows, 1)]
    return best, df.sparkSession.createDataFrame(ranked, schema)


# Full-grown trees have about a node per four rows.  Up to this many are grown by Spark, whose trees are kept on
# the driver; beyond it the forest is grown in the workers, by the same rules.
NODES_ON_DRIVER = 1 << 19


def fit_forest(
    df: DataFrame, vector: str, label: str, key: str, seed: int = C.SEED, trees: int = 100
) -> PipelineModel | forest.Forest:
    """The chosen model on all rows of a frame."""
    n = df.count()
    if n * trees > 4 * NODES_ON_DRIVER:
        return forest.fit(_rows_to_grow(df, vector, label, key, n), trees, "sqrt", C.TREE_DEPTH, 1, seed)
    prepared = with_features(df, vector, label).select(key, FEATURES, LABEL)
    with training_rows(prepared, key, **TREE_TASKS) as (rows, _):
        return Pipeline(stages=[random_forest(trees, seed=seed)]).fit(rows)


def fit_bernoulli(df: DataFrame, vector: str, label: str, key: str) -> PipelineModel:
    """The Bernoulli model on all rows of a frame: cheap, and the same on any layout of the rows."""
    prepared = with_features(df, vector, label).select(key, FEATURES, LABEL)
    with training_rows(prepared, key) as (rows, _):
        return bernoulli_nb().fit(rows)


def save(model, path: str) -> None:
    if isinstance(model, forest.Forest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | forest.Forest:
    """A saved model; one grown in the workers has a table of bins."""
    saved = forest.Forest.load(SparkSession.active(), path)
    return PipelineModel.load(path) if saved is None else saved
