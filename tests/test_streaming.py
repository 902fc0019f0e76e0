from pyspark.sql import functions as F

from webdrift.operators import classifiers, encode
from webdrift.plans.studies import page_sentences
from webdrift.sources import files
from webdrift.streaming import arrivals


def test_stream_equals_batch(spark, folder):
    pages = files.read_table(spark, folder, "pages").select("page_id", "html")
    inbox, out, check = (files.work_folder(spark) for _ in range(3))
    texts = encode.embed(page_sentences(pages, ["page_id"]), size=16)
    labelled = texts.withColumn("innov", (F.col("page_id") % 2).cast("int"))
    labelled = labelled.withColumn("row", F.xxhash64("page_id", "sent_pos"))
    model = classifiers.fit_forest(labelled, "embedding", "innov", "row", trees=5)
    expected = classifiers.score(model, texts, "embedding").drop("embedding")
    for part in (0, 1):
        files.write_parquet(pages.where(F.col("page_id") % 2 == part), inbox, mode="append")
        stream = arrivals.read_page_batches(spark, inbox, pages.schema)
        arrivals.append_scores(arrivals.score_pages(stream, "page_id", model, size=16), out, check).awaitTermination()
    got = spark.read.parquet(out).select(*expected.columns)
    assert got.count() == expected.count()
    assert got.exceptAll(expected).isEmpty()
