import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webdrift.llm import quality_rules as Q


@pytest.mark.parametrize("which", ["odd", "given"])
def test_pipeline_equals_brute_force(spark, odd_folder, folder, which):
    name = odd_folder if which == "odd" else folder
    docs = spark.read.parquet(f"{name}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{name}/benchmark.parquet").collect()]

    good = [r for r in rows if brute.kept_by_rules(r[1], Q.MIN_REPEAT, Q.MAX_COVERED, Q.MAX_LONGEST)]
    step = corpus_pipeline.keep_good_text(spark, docs, name)
    assert step.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in step.collect()))) == sorted(map(str, good))

    classes = brute.classes([(r[0], r[1]) for r in good])
    named = {classes[r[1]][0] for r in good} - {None}
    alone = corpus_pipeline.keep_one_of_each_group(spark, step, name)
    left = [tuple(r) for r in alone.collect()]
    assert {r[0] for r in left} - {None} == named and set(left) <= set(good)
    assert len({classes[r[1]][0] for r in left} - {None}) == len(named)

    bad = {d for d, _ in brute.leaks([(r[0], r[1]) for r in left], items)}
    clean = corpus_pipeline.drop_leaks(spark, alone, name)
    assert sorted(map(str, (tuple(r) for r in clean.collect()))) == sorted(str(r) for r in left if r[0] not in bad)

    mixed = corpus_pipeline.mix_sources(spark, clean, name)
    assert mixed.columns == docs.columns
    times = mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert times <= 2 * max(1, clean.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0])

    out = corpus_pipeline.put_in_shards(spark, mixed, name)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(counts) == mixed.count() and max(counts) - min(counts) <= 1


def test_stages_carry_clashing_columns(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet").withColumns(
        {c: F.lit(i) for i, c in enumerate(("key", "row", "n_words", "kept", "at", "block", "shard", "slot", "size", "times", "links", "class_id"))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, odd_folder)
        assert result.columns == docs.columns, name
        assert result.filter("key != 0 or slot != 7").count() == 0


def test_run(spark, odd_folder):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, odd_folder).count() > 0
