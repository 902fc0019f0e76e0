"""Joins, sampling, statistics, reports and similarity on small rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from webdrift.operators import decisions, metrics, relational, sampling, similarity, statistics, terms


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "k int, r string")
    assert [tuple(r) for r in relational.join_one_to_one(left, right, ["k"]).collect()] == [(1, "a", "x")]
    for a, b, side in ((left.union(left), right, "left"), (left, right.union(right), "right")):
        with pytest.raises(Exception, match=f"{side} side: key k is not unique"):
            relational.join_one_to_one(a, b, ["k"]).select("k").collect()


def test_suffixes(spark):
    left = spark.createDataFrame([(1, "a", 5)], "id int, text string, n int")
    right = spark.createDataFrame([(1, "b", 7)], "beid int, text string, m int")
    assert relational.join_with_suffixes(left, right, "id", "beid").first().asDict() == {
        "id": 1, "text_x": "a", "n": 5, "beid": 1, "text_y": "b", "m": 7,
    }


def test_semi_and_anti_make_the_whole(spark):
    left = spark.range(100).withColumn("v", F.col("id") % 7)
    right = spark.range(3).withColumnRenamed("id", "v").union(spark.range(1))
    semi, anti = relational.semi_join(left, right, "v"), relational.anti_join(left, right, "v")
    assert semi.count() + anti.count() == 100 and semi.where("v > 2").count() == 0


def test_key_overlap(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert tuple(relational.key_overlap(a, b, "k").first()) == (1, 1, 2)


def test_fill_blank(spark):
    rows = spark.createDataFrame([(None, None)], "a string, n int")
    assert tuple(relational.fill_blank(rows).first()) == (" ", None)


@pytest.mark.parametrize("n", [1, 2, 3, 99, 100, 5000])
def test_sample_is_exact(spark, n):
    rows = spark.range(1000)
    sample = {r.id for r in sampling.sample_rows(rows, "id", n).collect()}
    assert len(sample) == min(n, 1000)
    again = {r.id for r in sampling.sample_rows(rows.repartition(3), "id", n).collect()}
    assert again == sample


def test_split(spark):
    for n in (1, 7, 10, 1001):
        train, test = sampling.split(spark.range(n), "id")
        a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
        assert len(b) == math.ceil(0.2 * n) and not a & b and len(a | b) == n


def test_group_split_keeps_companies_together(spark):
    rows = spark.range(500).withColumn("company", F.col("id") % 20)
    train, test = sampling.split(rows, "id", group="company")
    a = {r.company for r in train.collect()}
    b = {r.company for r in test.collect()}
    assert not a & b and len(b) == 4 and train.count() + test.count() == 500


def test_sample_with_extra(spark):
    base = spark.range(50).withColumn("lang", F.lit("nl"))
    extra = spark.range(40, 60).withColumn("flag", F.lit(1))
    rows = sampling.sample_with_extra(base, extra, "id", n=10)
    assert rows.columns == ["flag", "id", "lang"]
    ids = [r.id for r in rows.collect()]
    assert len(ids) == len(set(ids))
    assert rows.where("lang is not null").count() == 10


def _values(kind, n=3001):
    rng = random.Random(1)
    return {
        "plain": [rng.random() for _ in range(n)],
        "even": [float(i) for i in range(n - 1)],
        "hot": [0.25] * (n // 3) + [rng.random() for _ in range(n - n // 3)],
        "equal": [2.0] * n,
        "two": [1.0] * 500 + [2.0] * 500,
        "tails": [math.exp(rng.gauss(0, 200)) for _ in range(n)],
        "one": [4.0],
        "sorted": sorted(rng.gauss(0, 1) for _ in range(n)),
    }[kind]


@pytest.mark.parametrize("kind", ["plain", "even", "hot", "equal", "two", "tails", "one", "sorted"])
def test_median(spark, kind):
    values = _values(kind)
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert statistics.median(rows, "x").first().median == float(np.median(values))


def test_median_of_nothing(spark):
    rows = spark.createDataFrame([], "x double")
    assert [tuple(r) for r in statistics.median(rows, "x").collect()] == [(None,)]
    assert tuple(statistics.summary(rows, "x").first()) == (0, None, None, None, None)


@pytest.mark.parametrize("value_range", [None, (0.0, 1.0)])
def test_histogram(spark, value_range):
    values = _values("hot")
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    counts, _ = np.histogram(values, bins=100, range=value_range)
    got = {r.bin: r.n for r in statistics.histogram(rows, "x", value_range=value_range).collect()}
    assert got == {i: n for i, n in enumerate(counts.tolist()) if n}


def test_histogram_of_one_value(spark):
    rows = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [tuple(r) for r in statistics.histogram(rows, "x").collect()] == [(50, 2)]


def test_report(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (0, 0), (0, 1)], "t int, p int")
    got = {r.row_name: r for r in metrics.classification_report(rows, "t", "p").collect()}
    assert got["NINN"][1:] == (0.5, 0.5, 0.5, 2)
    assert [round(v, 6) for v in got["INN"][1:4]] == [0.666667] * 3 and got["INN"].support == 3
    assert got["accuracy"].f1 == 0.6
    assert round(got["macro avg"].f1, 6) == 0.583333 and round(got["weighted avg"].f1, 6) == 0.6
    one = metrics.binary_metrics(rows, "t", "p").first()
    assert (one.n, one.accuracy) == (5, 0.6) and round(one.f1, 6) == 0.666667


def test_report_without_predictions_of_a_class(spark):
    rows = spark.createDataFrame([(1, 0), (0, 0)], "t int, p int")
    got = {r.row_name: r for r in metrics.classification_report(rows, "t", "p").collect()}
    assert got["INN"][1:] == (0.0, 0.0, 0.0, 1)


def test_rollup_and_thresholds(spark):
    rows = spark.createDataFrame(
        [("X", 1, 0, 0.5), ("X", 1, 1, 0.6), ("X", 1, 1, 0.58), ("Y", 0, 1, 0.55)],
        "company string, innov int, rf_pred_lab int, rf_proba double",
    )
    companies = decisions.rollup_company(rows, "company")
    assert round(companies.where("company = 'X'").first().mean_proba, 6) == 0.56
    got = {(r.company, r.threshold): r.decision for r in decisions.decide(companies).where("rule = 'probability'").collect()}
    assert got == {("X", 0.5): 1, ("X", 0.55): 1, ("X", 0.6): 0, ("Y", 0.5): 1, ("Y", 0.55): 0, ("Y", 0.6): 0}


def test_buckets(spark):
    cases = [
        (1, 1, 0.75, "correct_high"), (0, 1, 0.8, "wrong_high"), (0, 0, 0.35, "correct_low"), (1, 0, 0.1, "wrong_low"),
        (1, 0, 0.5, "middle"), (1, 1, 0.2, None),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "innov int, rf_pred_lab int, rf_proba double")
    assert [r.b for r in rows.select(decisions.score_bucket().alias("b")).collect()] == [c[3] for c in cases]


def test_word_overlap(spark):
    rows = spark.createDataFrame(
        [("a b c", "b c d"), ("a a b", "a b"), ("a", "b"), ("", " ")], "text_old string, text_new string"
    )
    assert [r.word_similarity for r in similarity.word_overlap(rows).collect()] == [0.5, 1.0, 0.0, None]


def test_cosine_by_key(spark):
    old = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "k int, v array<double>")
    new = spark.createDataFrame([(1, [2.0, 2.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (9, [1.0, 1.0])], "k int, v array<double>")
    got = {r.k: round(r.cosine_similarity, 9) for r in similarity.cosine_by_key(old, new, "k", "v").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "aaa aaa bbb"), (2, "bbb ccc")], "doc int, text string")
    got = {(r.doc, r.term): round(r.tfidf, 6) for r in terms.tfidf(docs, "doc", min_df=1).collect()}
    assert got == {(1, "aaa"): 0.921907, (1, "bbb"): 0.387411, (2, "bbb"): 0.579739, (2, "ccc"): 0.814802}


@pytest.mark.parametrize("sent", [0, 1 << 28])
def test_tfidf_shuffles_no_word_of_a_small_vocabulary(spark, monkeypatch, sent):
    monkeypatch.setattr(terms, "BROADCAST_BYTES", sent)
    docs = spark.createDataFrame([(1, "aaa aaa"), (1, "BBB zzz"), (2, "bbb ccc"), (3, None), (4, "ccc"), (None, "aaa")], "doc int, text string")
    weights = terms.tfidf(docs, "doc", min_df=2)
    got = {(r.doc, r.term): round(r.tfidf, 6) for r in weights.collect()}
    tf = 1 + math.log(2)
    length = math.hypot(tf, 1)  # aaa, bbb and ccc have the same idf
    assert got == {(1, "aaa"): round(tf / length, 6), (1, "bbb"): round(1 / length, 6), (2, "bbb"): round(math.sqrt(0.5), 6),
                   (2, "ccc"): round(math.sqrt(0.5), 6), (4, "ccc"): 1.0, (None, "aaa"): 1.0}
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert sent == 0 or not re.search(r"hashpartitioning\([^)]*term", plan)


def test_mean_word_vectors(spark):
    docs = spark.createDataFrame([(1, "a a b z"), (2, "z")], "doc int, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<double>")
    got = {r.doc: [round(v, 9) for v in r.word_vector] for r in terms.mean_word_vectors(docs, "doc", vectors, 2).collect()}
    assert got == {1: [round(2 / 3, 9), 1.0], 2: [0.0, 0.0]}


@pytest.mark.parametrize("sent", [0, 1 << 28])
def test_mean_word_vectors_shuffle_no_word_of_a_small_vocabulary(spark, monkeypatch, sent):
    monkeypatch.setattr(terms, "BROADCAST_BYTES", sent)
    docs = spark.createDataFrame(
        [(1, "a a b z"), (1, "b"), (2, "z"), (3, None), (4, ""), (None, "a"), (5, "\u00e9\u00a0a")], "doc int, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 4.0]), ("c", [9.0, 9.0])], "word string, vector array<double>")
    means = terms.mean_word_vectors(docs, "doc", vectors, 2)
    got = sorted((r.doc or 0, r.text or "", *r.word_vector) for r in means.collect())
    assert got == [(0, "a", 0.0, 0.0), (1, "a a b z", 0.5, 2.0), (1, "b", 0.5, 2.0), (2, "z", 0.0, 0.0), (3, "", 0.0, 0.0),
                   (4, "", 0.0, 0.0), (5, "\u00e9\u00a0a", 1.0, 0.0)]
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan  # sorts a task's words by text once it holds 128 texts
    assert sent == 0 or not re.search(r"hashpartitioning\([^)]*word", plan)


def test_cluster_review_of_a_hot_cluster(spark):
    rows = spark.range(3000).withColumn("cluster", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 5))
    rows = rows.withColumn("distance", (F.col("id") * 7919 % 1009) / 1009)
    near = decisions.cluster_review(rows, ["cluster"], "distance", "id", n=50)
    pdf = rows.toPandas()
    for side, up in (("nearest", True), ("farthest", False)):
        part = near.where(F.col("side") == side).toPandas()
        expected = pdf.sort_values(["distance", "id"], ascending=[up, True]).groupby("cluster").head(50)
        assert set(part.id) == set(expected.id)
