"""The analyses as a whole, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdrift import constants as C
from webdrift.operators import classifiers, decisions, encode, metrics, pages, relational, sampling, sentences
from webdrift.operators import similarity, statistics
from webdrift.sources import files

REPORT = ("row_name", "precision", "recall", "f1", "support")


def page_sentences(raw_pages: DataFrame, id_columns: list[str]) -> DataFrame:
    """Raw pages -> sentences with a letter: one stage, no shuffle."""
    texts = pages.normalize(pages.extract_text(raw_pages.select(*id_columns, "html")))
    return sentences.with_letters(sentences.explode_sentences(texts))


def company_texts(raw_pages: DataFrame, labels: DataFrame, key: str, scrape: int) -> DataFrame:
    """Labelled company texts of one scrape; fails when a company occurs twice on either side."""
    texts = pages.extract_text(relational.require_unique(raw_pages, [key], "left"))
    known = relational.require_unique(labels, [key], "right")
    return texts.join(known, key).withColumn("scrape", F.lit(scrape))


def vector_drift(
    old: DataFrame, new: DataFrame, id_map: DataFrame, old_id: str, new_id: str, vector: str
) -> DataFrame:
    """Cosine similarity per company between two scrapes that use different ids.

    The id map may give a company several old ids; the first one counts.  Companies in
    one scrape only are left out.
    """
    first = relational.first_per_key(id_map, [new_id], [F.col(old_id)])
    matched = first.join(old, old_id)
    return similarity.cosine_by_key(matched, new, new_id, vector)


def sentence_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences per page and their mean length."""
    rows = page_sentences(files.read_table(spark, folder, "pages", "page_id"), ["page_id"])
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.round(F.avg(F.length("text")), 6).alias("mean_chars")
    )


def text_similarity_over_time(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Summary of the cosine similarity of full-text vectors of two scrapes."""
    a, b = encode.embed(old.select(key, text), text), encode.embed(new.select(key, text), text)
    return statistics.summary(similarity.cosine_by_key(a, b, key, "embedding"), "cosine_similarity")


def fulltext_reports(
    companies: DataFrame, key: str, label: str, text: str = "text", seed: int = C.SEED, size: int = C.EMBEDDING_SIZE
) -> DataFrame:
    """Forest on one vector per company text; report of the labels and of every threshold."""
    vectors = encode.embed(companies.select(key, label, text), text, size=size)
    train, test = sampling.split(vectors, key, seed=seed)
    model = classifiers.fit_forest(train, "embedding", label, key, seed)
    scored = classifiers.score(model, test.select(key, label, "embedding"), "embedding")
    rules = [F.struct(F.lit("label").alias("rule"), F.lit(0.5).alias("threshold"), F.col("pred").alias("decision"))]
    rules += [
        F.struct(F.lit("probability").alias("rule"), F.lit(t).alias("threshold"), (F.col("proba") > t).cast("int").alias("decision"))
        for t in C.COMPANY_THRESHOLDS
    ]
    decided = scored.select(label, F.explode(F.array(*rules)).alias("r")).select(label, "r.*")
    return metrics.classification_report(decided, label, "decision", by=["rule", "threshold"])


def company_report(
    scored: DataFrame, company: str, truth: str, threshold: float = C.BEST_THRESHOLD
) -> DataFrame:
    """Report at company level: mean probability above the threshold."""
    companies = decisions.rollup_company(scored, company, truth, "pred", "proba")
    decided = companies.withColumn("decision", (F.col("mean_proba") > threshold).cast("int"))
    return metrics.classification_report(decided, "mean_innov", "decision")


def concept_drift(
    model, old: DataFrame, new: DataFrame, vector: str, company: str, truth: str, threshold: float = C.BEST_THRESHOLD
) -> DataFrame:
    """Company report of the later scrape under the old model, with the change in F1.

    ``old`` must be rows of the earlier scrape that the model has not seen.
    """
    before = company_report(classifiers.score(model, old, vector), company, truth, threshold)
    after = company_report(classifiers.score(model, new, vector), company, truth, threshold)
    base = before.select("row_name", F.col("f1").alias("f1_before"))
    return after.join(base, "row_name").select(*REPORT, (F.col("f1") - F.col("f1_before")).alias("f1_change"))


def external_validation(
    model, known: DataFrame, external: DataFrame, key: str, vector: str, company: str, truth: str,
    threshold: float = C.BEST_THRESHOLD,
) -> DataFrame:
    """Sentence and company reports for entities (``key``) that are not among the known ones."""
    unseen = relational.anti_join(external, known, key)
    scored = classifiers.score(model, unseen, vector)
    per_sentence = metrics.classification_report(scored, truth, "pred").withColumn("level", F.lit("sentence"))
    per_company = company_report(scored, company, truth, threshold).withColumn("level", F.lit("company"))
    return per_sentence.unionByName(per_company).select("level", *REPORT)
