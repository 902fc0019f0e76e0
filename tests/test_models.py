"""Models by their invariants; nearest neighbours and QDA against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from webdrift.operators import bag_of_words, classifiers, clusters, encode, knn, qda, sampling, terms
from webdrift.plans import derived
from webdrift.sources import files


@pytest.fixture(scope="module")
def vectors(spark, folder):
    rows = derived.vectors(spark, folder).cache()
    yield rows
    rows.unpersist()


def brute_force(queries, base, k):
    result = {}
    for q, v in queries:
        order = sorted((np.sqrt(((np.array(b) - np.array(v)) ** 2).sum()), i) for i, b in base)
        result[q] = [i for _, i in order[:k]]
    return result


@pytest.mark.parametrize("block_bytes", [64 << 20, 2_000])
@pytest.mark.parametrize("size", [2, 16])
def test_knn_is_exact_with_many_copies(spark, block_bytes, size):
    rng = np.random.default_rng(3)
    base = [(i, rng.normal(size=size).round(3).tolist()) for i in range(300)]
    base += [(300 + i, [0.5] * size) for i in range(150)]
    queries = [(i, rng.normal(size=size).tolist()) for i in range(60)] + [(60 + i, [0.5] * size) for i in range(40)]
    schema = "id int, v array<double>"
    rows = knn.knn(spark.createDataFrame(queries, schema), spark.createDataFrame(base, schema), "id", "id", "v", 3,
                   block_bytes=block_bytes)
    got = {}
    for r in rows.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute_force(queries, base, 3)


def test_knn_refuses_an_unbounded_base(spark):
    base = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id int, v array<double>")
    with pytest.raises(ValueError, match="at most 1"):
        knn.knn(base, base, "id", "id", "v", 1, max_base=1)


def test_knn_takes_any_base_and_keeps_a_large_one_in_spark(spark, monkeypatch):
    base = spark.range(2_000_001).select(F.col("id"), F.array(F.col("id").cast("double")).alias("v"))
    queries = spark.createDataFrame([(7, [1_999_999.8])], "id bigint, v array<double>")
    monkeypatch.setattr(type(base), "toPandas", lambda self: pytest.fail("base on the driver"))
    rows = knn.knn(queries, base, "id", "id", "v", 2, block_bytes=4 << 20).orderBy("rank").collect()
    assert [r.neighbour for r in rows] == [2_000_000, 1_999_999]


def test_knn_sends_no_base_of_20_mb(spark, monkeypatch):
    base = spark.range(40_000).select("id", F.array(*[F.col("id") * (k + 1.0) for k in range(64)]).alias("v"))
    queries = base.where("id in (7, 39999)")
    monkeypatch.setattr(type(base), "toPandas", lambda self: pytest.fail("base on the driver"))
    rows = knn.knn(queries, base, "id", "id", "v", 2).orderBy("id", "rank").collect()
    assert [(r.id, r.neighbour) for r in rows] == [(7, 7), (7, 6), (39999, 39999), (39999, 39998)]


def test_knn_moves_no_query_vector(spark, vectors):
    near = knn.knn(vectors, vectors, "vec_id", "vec_id", "embedding", 2)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()


def test_knn_with_fewer_rows_than_k(spark):
    base = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id int, v array<double>")
    rows = knn.knn(base, base, "id", "id", "v", 5)
    assert rows.count() == 4


def test_knn_tie_goes_to_the_smaller_label(spark):
    train = spark.createDataFrame([(1, [0.0], 1), (2, [2.0], 0)], "id int, v array<double>, y int")
    test = spark.createDataFrame([(9, [1.0])], "id int, v array<double>")
    assert knn.knn_classify(test, train, "id", "v", "y").first().pred == 0


def test_qda_equals_numpy(vectors):
    train, test = sampling.split(vectors, "vec_id")
    model = qda.fit_qda(train, "embedding", "innov")
    rows = train.select("innov", "embedding").collect()
    logs = []
    x = np.array([r.embedding for r in test.orderBy("vec_id").collect()], dtype=float)
    for value in (0, 1):
        part = np.array([r.embedding for r in rows if r.innov == value], dtype=float)
        covariance = np.cov(part.T)
        d = x - part.mean(0)
        distance = (d @ np.linalg.inv(covariance) * d).sum(1)
        logs.append(np.log(len(part) / len(rows)) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * distance)
    scored = model.transform(test).orderBy("vec_id").collect()
    assert [r.pred for r in scored] == np.argmax(logs, axis=0).tolist()
    assert np.allclose([r.proba for r in scored], 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_qda_with_a_constant_component(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(rng.normal(i % 2 * 4)), 1.0], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    scored = qda.fit_qda(df, "v", "y").transform(df)
    assert scored.where("pred = y").count() > 54


@pytest.mark.parametrize("name", classifiers.MODELS)
def test_every_row_is_scored_once(vectors, name):
    train, test = sampling.split(vectors, "vec_id")
    scored = classifiers.train(name, train, "embedding", "innov", "vec_id")(test).select("vec_id", "pred", "proba").collect()
    assert len(scored) == test.count() and len({r.vec_id for r in scored}) == len(scored)
    assert {r.pred for r in scored} <= {0, 1}
    for r in scored:
        if r.proba is not None:
            assert 0.0 <= r.proba <= 1.0 and (r.proba == 0.5 or r.pred == int(r.proba > 0.5))


def test_forest_is_repeatable_and_survives_saving(spark, vectors):
    first = classifiers.fit_forest(vectors, "embedding", "innov", "vec_id", trees=10)
    again = classifiers.fit_forest(vectors.repartition(5), "embedding", "innov", "vec_id", trees=10)
    path = files.work_folder(spark)
    classifiers.save(first, path)
    results = [
        {r.vec_id: r.proba for r in classifiers.score(m, vectors, "embedding").collect()}
        for m in (first, again, classifiers.load(path))
    ]
    assert results[0] == results[1] == results[2]


def test_tasks_of_a_tree_fit_do_not_grow_with_the_rows(spark):
    for n, tasks in ((500, 3), (20_000, 12), (60_000, 12)):
        df = spark.range(n).select(F.col("id"), F.array(F.col("id").cast("double")).alias("v"), (F.col("id") % 2).alias("y"))
        prepared = classifiers.with_features(df, "v", "y")
        with classifiers.training_rows(prepared, "id", **classifiers.TREE_TASKS) as (rows, counted):
            assert counted == n == rows.select("id").distinct().count() and rows.rdd.getNumPartitions() == tasks


def test_settings_are_drawn_without_repeats():
    drawn = classifiers.draw_settings()
    assert len(drawn) == 50 == len({tuple(d.values()) for d in drawn})
    assert drawn == classifiers.draw_settings()
    assert len(classifiers.draw_settings(n=10_000)) == 160 and {d["max_depth"] for d in drawn} == {30}


def test_random_search(vectors):
    grid = {"n_estimators": [3], "max_features": ["sqrt", 240], "max_depth": [4, None], "min_samples_split": [2]}
    model, table = classifiers.random_search(vectors, "embedding", "innov", "vec_id", grid, draws=2, folds=2)
    rows = table.orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2] and rows[0].mean_test_accuracy >= rows[1].mean_test_accuracy
    assert all(r.mean_train_accuracy > r.mean_test_accuracy for r in rows)
    assert classifiers.score(model, vectors, "embedding").count() == vectors.count()


def test_the_search_query_has_the_whole_budget(spark, folder, monkeypatch):
    from webdrift import constants as C
    from webdrift.operators import forest
    from webdrift.plans import catalog

    asked = {}
    monkeypatch.setattr(forest, "cross_validate", lambda rows, folds, settings, seed: asked.update(n=rows.n, folds=folds, settings=settings) or [
        (i, f, 0.5, 0.5) for i in range(len(settings)) for f in range(folds)])
    monkeypatch.setattr(forest, "fit", lambda *a: None)
    assert catalog.QUERIES["random_search_rf"](spark, folder).count() == 50
    assert asked["folds"] == 5 and asked["n"] == sampling.split(derived.vectors(spark, folder), "vec_id")[0].count()
    assert {s["n_estimators"] for s in asked["settings"]} == set(C.SEARCH_GRID["n_estimators"])


def test_a_search_reads_smaller_forests_off_larger_ones(spark):
    from webdrift.operators import forest

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(i % 3, 1, 4).tolist(), i % 2) for i in range(300)], "id int, v array<double>, y int")
    rows = forest.prepare(df, "v", "y", "id", 300, F.col("id") % 2)
    settings = [{"n_estimators": t, "max_features": f, "max_depth": 30, "min_leaf": 1} for f in (1, 4) for t in (3, 9, 5)]
    together = sorted(forest.cross_validate(rows, 2, settings, 7))
    apart = sorted((i, f, a, b) for i, s in enumerate(settings) for _, f, a, b in forest.cross_validate(rows, 2, [s], 7))
    assert together == apart and len(together) == 12


@pytest.fixture
def grown_in_workers(monkeypatch):
    monkeypatch.setattr(classifiers, "NODES_ON_DRIVER", 0)
    monkeypatch.setattr(classifiers, "random_forest", lambda *a, **k: pytest.fail("trees on the driver"))


@pytest.mark.parametrize("in_file", [False, True])
def test_a_large_forest_is_grown_in_the_workers_and_scores_as_sparks(spark, monkeypatch, in_file):
    from webdrift.operators import forest

    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 6)).round(2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(900) < 0.1)).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id int, v array<double>, y int")
    train, test = df.where("id < 700"), df.where("id >= 700")
    known = classifiers.score(classifiers.fit_forest(train, "v", "y", "id", trees=60), test, "v").toPandas()
    monkeypatch.setattr(classifiers, "NODES_ON_DRIVER", 0)
    if in_file:
        monkeypatch.setattr(forest, "MATRIX_BYTES", 0)
    model = classifiers.fit_forest(train.repartition(5), "v", "y", "id", trees=60)
    assert isinstance(model, forest.Forest) and model.trees.agg(F.sum("roots")).first()[0] == 60
    ours = classifiers.score(model, test, "v")
    assert ours.columns == ["id", "v", "y", "pred", "proba"] and "CartesianProduct" in ours._jdf.queryExecution().executedPlan().toString()
    both = known.merge(ours.toPandas(), on="id")
    assert len(both) == 200 and both.proba_x.corr(both.proba_y) > 0.95 and (both.pred_x == both.pred_y).mean() > 0.9
    assert ((both.proba_y > 0.5) == both.pred_y).mean() > 0.98


def test_bins_are_those_spark_uses():
    from webdrift.operators import forest

    ones = np.ones(5)
    assert forest._limits(np.array([3.0, 1, 2, 2, 1]), ones).tolist() == [1.5, 2.5]
    values = np.r_[np.zeros(900), np.arange(1, 101)]
    limits = forest._limits(values, np.ones(1000))  # a heavy value takes one limit, the next values get the others
    assert limits.tolist() == [*(i + 0.5 for i in range(29)), 38.5, 69.5]
    kept, weight = forest._reduced(np.r_[np.zeros(9000), np.arange(1.0, 1001)], np.ones(10_000))
    assert len(kept) <= forest.POINTS and (kept > 0).sum() >= 250 and abs(weight.sum() - 10_000) < 1e-6


@pytest.mark.parametrize("query", ["rf_save_load_score", "score_rows", "clf_random_forest", "concept_drift_report"])
def test_forest_queries_keep_trees_off_the_driver(spark, folder, grown_in_workers, query):
    from webdrift.plans import catalog

    known = derived.vectors(spark, folder)
    want = {"rf_save_load_score": known.where("scrape = 12").count(), "score_rows": known.count(),
            "clf_random_forest": sampling.split(known, "vec_id")[1].count(), "concept_drift_report": 5}
    assert catalog.QUERIES[query](spark, folder).count() == want[query]


def test_fulltext_and_comparison_keep_trees_off_the_driver(spark, folder, vectors, grown_in_workers):
    from webdrift.plans import studies

    assert studies.fulltext_reports(derived.companies(spark, folder), "doc_id", "innov", size=16).count() == 20
    train, test = sampling.split(vectors, "vec_id")
    assert classifiers.compare(train, test, "embedding", "innov", "vec_id", models=["random_forest", "tree"]).count() == 10


def test_kmeans(spark, vectors):
    zero = spark.createDataFrame([(-1, [0.0] * 64)], "vec_id bigint, embedding array<float>")
    rows, centroids = clusters.cosine_kmeans(vectors.select("vec_id", "embedding").unionByName(zero), "embedding", 5, repeats=2)
    assert centroids.count() == 5 and rows.where("cluster is not null").select("cluster").distinct().count() == 5
    assert rows.count() == vectors.count() + 1
    assert [r.vec_id for r in rows.where("cluster is null").collect()] == [-1]


def test_encoder_is_an_argument(spark):
    def make_encoder():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype="float32")

    rows = spark.createDataFrame([(1, "aab"), (2, None)], "id int, text string")
    got = encode.embed(rows, size=2, make_encoder=make_encoder, batch=1).orderBy("id").collect()
    assert [list(r.embedding) for r in got] == [[3.0, 2.0], [0.0, 0.0]]
    default = encode.embed(rows, size=32).orderBy("id").collect()
    assert abs(sum(v * v for v in default[0].embedding) - 1) < 1e-6 and not any(default[1].embedding)


def test_assembled_features_match_the_long_form(spark, folder):
    docs = derived.companies(spark, folder)
    features = bag_of_words.fit_features(docs, "doc_id", word_emb=False, min_df=10)
    names = {r["index"]: r["name"] for r in features.feature_names().collect()}
    assert sorted(names) == list(range(len(names)))
    long_form = {(r.doc_id, r.term): r.tfidf for r in terms.tfidf(docs, "doc_id", min_df=10).collect()}
    rows = features.transform(docs)
    assert isinstance(rows.schema["features"].dataType, VectorUDT)
    got = {}
    for r in rows.select("doc_id", "features").collect():
        entries = zip(r.features.indices, r.features.values) if hasattr(r.features, "indices") else enumerate(r.features)
        got.update({(r.doc_id, names[i]): v for i, v in entries if v and names[i] != "Feature_taal"})
    assert got.keys() == long_form.keys()
    assert all(abs(got[k] - long_form[k]) < 1e-12 for k in got)


def test_vocabulary_is_numbered_in_spark_without_a_limit(spark, folder):
    docs = derived.companies(spark, folder)
    vocabulary = bag_of_words.fit_counts(docs, min_df=2)
    rows = sorted((r["index"], r["term"]) for r in vocabulary.table.collect())
    assert vocabulary.size == len(rows) > 50
    assert [i for i, _ in rows] == list(range(len(rows))) and [t for _, t in rows] == sorted(t for _, t in rows)
    from webdrift.operators import vocabulary as V

    many = spark.range(100_000).select(F.format_string("w%06d", (F.col("id") * 7919) % 100_000).alias("term"))
    numbered = V.number(many, ["term"], parts=13)
    assert numbered.agg(F.min("index"), F.max("index"), F.countDistinct("index")).first() == (0, 99_999, 100_000)
    assert numbered.where(F.col("index") != F.regexp_extract("term", "[0-9]+", 0).cast("bigint")).count() == 0


def test_a_text_is_normed_once_not_once_per_word(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc int")
    long_form = spark.createDataFrame([(1, 0, 3.0), (1, 2, 4.0)], "doc int, index int, w double")
    rows = bag_of_words.vocabulary.vectors(docs, "doc", long_form, "w", 3, "v", l2=True)
    assert {r.doc: r.v.toArray().tolist() for r in rows.collect()} == {1: [0.6, 0.0, 0.8], 2: [0.0, 0.0, 0.0]}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    scaled = [line for line in plan.splitlines() if "transform(" in line]
    assert scaled and not any("aggregate(" in line for line in scaled)


def test_bag_of_words(spark, folder):
    docs = derived.companies(spark, folder).withColumn("lang", F.lit("dutch"))
    result = bag_of_words.repeated_runs(docs, "doc_id", "innov", runs=1, size=8, min_df=10).collect()
    assert [r.run for r in result] == [0] and result[0].n == 18 and 0 <= result[0].accuracy <= 1


def test_buckets_without_rows_and_rows_without_bucket(spark, vectors):
    rows = vectors.select("vec_id", "embedding").withColumn(
        "bucket", F.when(F.col("vec_id") % 3 == 0, "correct_high").when(F.col("vec_id") % 3 == 1, "other"))
    found = clusters.cluster_buckets(rows, "embedding", clusters={"correct_high": 3, "wrong_high": 2}, repeats=1)
    assert found.count() == rows.count()
    assert found.where("bucket = 'correct_high' and cluster is null").count() == 0
    assert found.where("bucket is null or bucket = 'other'").where("cluster is not null").count() == 0


def test_word_vectors_equal_the_leading_eigenvectors_of_ppmi(spark):
    import random
    from collections import Counter

    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[(d % 3) * 20:(d % 3) * 20 + 25]) for _ in range(rng.randint(5, 60))) for d in range(400)]
    texts += [f"p{k} q{k} " * (5 + 3 * k) for k in range(12)] + [None, ""]  # pairs far above chance, each its own strength
    got = {r.word: np.array(r.vector) for r in bag_of_words.train_word_vectors(
        spark.createDataFrame([(t,) for t in texts], "text string"), size=6, power=8).collect()}
    count = Counter(w for t in texts if t for w in t.split())
    known = sorted(w for w, c in count.items() if c >= 5)
    assert sorted(got) == known and {len(v) for v in got.values()} == {6}
    at = {w: i for i, w in enumerate(known)}
    n = np.zeros((len(known), len(known)))
    for t in texts:
        tokens = (t or "").split()
        for a in range(len(tokens)):
            for b in range(max(0, a - 5), min(len(tokens), a + 6)):
                if a != b:
                    n[at[tokens[a]], at[tokens[b]]] += 1
    m = n.sum(1)
    with np.errstate(divide="ignore"):
        ppmi = np.where(n > 0, np.maximum(np.log(np.where(n > 0, n, 1) * n.sum() / np.outer(m, m)) - np.log(5), 0), 0)
    values, vectors = np.linalg.eigh(ppmi)
    top = np.argsort(-values)[:6]
    exact = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    ours = np.stack([got[w] for w in known])
    assert np.abs(exact @ exact.T).max() > 1 and np.abs(ours @ ours.T - exact @ exact.T).max() < 1e-6 * np.abs(exact @ exact.T).max()


@pytest.mark.parametrize("chunk", [3, 50, 1 << 20])
def test_pairs_are_counted_across_chunks_with_repeats_and_unknown_words(spark, monkeypatch, chunk):
    import random
    from collections import Counter

    from webdrift.operators import word_vectors as W

    monkeypatch.setattr(W, "CHUNK_TOKENS", chunk)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("aaabcdefgh") + str(rng.randint(0, 2)) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += texts[:5] + [None, "", "z", "a0 a0 a0"]
    rows, known = W.cooccurrence(spark.createDataFrame([(t,) for t in texts], "text string"), window=3, min_count=30)
    count = Counter(w for t in texts if t for w in t.split())
    want = Counter()
    for tokens in ((t or "").split() for t in texts):
        for i, w in enumerate(tokens):
            want.update((w, c) for c in tokens[max(0, i - 3):i] + tokens[i + 1:i + 4] if min(count[w], count[c]) >= 30)
    assert {(r.word, r.context): r.n for r in rows.collect()} == want and len(want) > 9
    assert {r.word: r.n for r in known.collect()} == {w: n for w, n in count.items() if n >= 30}


def test_no_join_reads_the_pairs_before_they_are_counted(spark):
    from webdrift.operators import word_vectors as W

    rows, _ = W.cooccurrence(spark.createDataFrame([("a b a c " * 9,)], "text string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert all("Join" not in line for line in plan[plan.index("Aggregate"):plan.index("Map")].splitlines())


@pytest.mark.parametrize("piece", [2, 1 << 14])
def test_blocks_of_a_product_equal_the_whole_product(spark, monkeypatch, piece):
    from webdrift.operators import word_vectors as W

    monkeypatch.setattr(W, "BLOCK_ROWS", 32)
    monkeypatch.setattr(W, "PIECE", piece)
    rng = np.random.default_rng(5)
    matrix = np.where(rng.random((90, 90)) < 0.1, rng.normal(size=(90, 90)), 0.0)
    factor = rng.normal(size=(90, 4))
    factor[7] = 0.0  # no row
    entries = spark.createDataFrame([(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))], "i long, j long, v double")
    right = spark.createDataFrame([(i, factor[i].tolist()) for i in range(90) if i != 7], "index long, x array<double>")
    got = np.zeros((90, 4))
    for r in W.multiply(entries, right, 90).collect():
        got[r["index"]] += r["x"]
    assert np.abs(got - matrix @ factor).max() < 1e-12


def test_a_product_shuffles_neither_the_factor_nor_its_sums(spark):
    from webdrift.operators import streams
    from webdrift.operators import word_vectors as W

    factor = W.as_factor(spark.range(5000).select(F.col("id").alias("index"), F.array(F.lit(1.0), F.col("id") * 0.5).alias("x")))
    pieces = W.packed(spark.range(3000).select(F.col("id").alias("i"), (F.col("id") + 1999).alias("j"), F.lit(2.0).alias("v")), 3000)
    assert pieces.select("r").distinct().count() == 3
    met = streams.against(factor, streams.against(pieces.withColumnRenamed("c", "of"), streams.tasks(spark, 3, "block"), F.col("r") == F.col("block")), F.col("c") == F.col("of"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Broadcast" not in plan and met.rdd.getNumPartitions() == 3
    got = {r["index"]: list(r["x"]) for r in W.as_rows(W.product(pieces, factor, 3000)).collect()}
    assert got == {i: [2.0, i + 1999.0] for i in range(3000)}


def test_wide_vectors_are_averaged_without_a_sum_per_value(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vector = {f"w{i}": rng.normal(size=70) for i in range(30)}
    texts = [(i, " ".join(rng.choice([*vector, "unknown"], size=12))) for i in range(50)] + [(50, None), (51, "unknown"), (None, "w1"), (7, "w2 w2")]
    docs = spark.createDataFrame(texts, "doc int, text string")
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in vector.items()], "word string, vector array<double>")
    rows = terms.mean_word_vectors(docs, "doc", vectors, 70)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_69" not in plan
    got = rows.collect()
    assert len(got) == len(texts)
    for r in got:
        known = [vector[w] for d, t in texts if d is not None and d == r.doc for w in (t or "").split() if w in vector]
        assert np.abs(np.array(r.word_vector) - (np.mean(known, axis=0) if known else np.zeros(70))).max() < 1e-12


def test_names_of_a_large_vocabulary_are_not_broadcast(spark, monkeypatch):
    from webdrift.operators import word_vectors as W

    assert W.SMALL_VOCABULARY * 100 <= 256 << 20  # a row of the broadcast table is some 100 bytes, the driver's heap 750 MB
    monkeypatch.setattr(W, "SMALL_VOCABULARY", 2)
    rows, _ = W.cooccurrence(spark.createDataFrame([("a b a c " * 9,)], "text string"))
    assert "ResolvedHint" not in rows._jdf.queryExecution().analyzed().toString() and "strategy=broadcast" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.word, r.context) for r in rows.collect()} == {(x, y) for x in "abc" for y in "abc"}


def test_knn_bounds_measure_few_pairs_and_stay_exact():
    rng = np.random.default_rng(8)
    base = np.vstack([rng.normal(size=(3000, 24)) * np.linspace(3, 0.01, 24), np.ones((5000, 24))])
    ids = rng.permutation(len(base))
    queries = np.vstack([rng.normal(size=(300, 24)) * np.linspace(3, 0.01, 24), np.ones((3, 24))])
    prepared = knn.prepare(base, ids, {}, 3)
    assert len(prepared["ids"]) == 3003 and prepared["axes"].shape[1] < 24  # equal rows cut to k; a steep spectrum needs fewer axes
    stats = {}
    near, distance = knn._nearest(queries, prepared, 3, stats)
    full = np.sqrt(((queries[:, None, :] - base[None]) ** 2).sum(2))
    want = np.lexsort((np.broadcast_to(ids, full.shape), full), axis=1)[:, :3]
    assert np.array_equal(prepared["ids"][near], ids[want])
    assert stats["measured"] < 0.1 * stats["pairs"]


def test_knn_with_131072_equal_rows_stays_small():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    base = np.full((131072, 64), 0.25)
    near, _ = knn._nearest(base[:4096], knn.prepare(base, np.arange(131072)[::-1].copy(), {}, 2), 2)
    assert near.shape == (4096, 2)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 1 << 20  # KB: under 1 GB more


@pytest.mark.parametrize("values", [
    [3.0, -1.0, 2.5, 2.5, 7.0, -0.0, 0.0, 1e-310, -1e-310, 5e-324, 1e308, -1e308, float("inf"), float("-inf")],
    [0.1 * i for i in range(1001)] + [0.1] * 4000,
    [-2.0, -2.0], [42.0], [1.0, float("nan"), 2.0, 3.0],
])
def test_median_by_radix_selection(spark, values):
    from webdrift.operators import statistics

    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    keys = [r.k for r in frame.where("v is not null").select("v", statistics.order_key(F.col("v")).alias("k")).orderBy("k").collect()]
    assert keys == sorted(keys)
    ordered = sorted(values, key=lambda v: (v != v, v))
    n = len(ordered)
    want = (ordered[(n + 1) // 2 - 1] + ordered[(n + 2) // 2 - 1]) / 2
    got = statistics.median(frame, "v").first()[0]
    assert got == want or (got != got and want != want)
    assert statistics.median(frame.limit(0), "v").first()[0] is None
