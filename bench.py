"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder, BENCH_CPUS: cores, BENCH_QUERIES: names to run instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webdrift.plans.catalog import QUERIES  # noqa: E402
from webdrift.session import get_session  # noqa: E402

HEADLINE = [
    "sentence_profile", "page_text", "preprocess_text", "detect_language", "sentence_explode",
    "term_counts", "tfidf_sublinear", "word_jaccard", "similarity_summary", "mean_vector_by_key",
    "cosine_same_key", "median_value", "histogram_range", "join_validated_1to1", "join_renamed_keys",
    "split_train_test", "knn_classify", "company_rollup", "threshold_report", "centroid_distance",
    "cluster_review", "embed_texts", "count_vectorize", "class_mean_cov", "clf_bernoulli_nb",
    "clf_logreg_l1", "clf_qda", "clf_random_forest", "concept_drift_report", "bow_classifier",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__log__level="ERROR",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
