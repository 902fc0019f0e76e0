"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from webdrift import constants as C
from webdrift.functions import text as X
from webdrift.functions import vectors as V
from webdrift.operators import (
    bag_of_words, classifiers, clusters, decisions, encode, knn, metrics, pages, qda, relational,
    sampling, sentences, similarity, statistics, terms, word_vectors,
)
from webdrift.plans import derived, studies
from webdrift.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIGITS = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return files.read_table(spark, folder, name)


def texts(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table for text work, spread over all cores."""
    return files.read_table(spark, folder, name, spread_by=key)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(F.col(name), DIGITS))
    return df


def components(df: DataFrame, keys: list[str], vector: str, name: str = "value") -> DataFrame:
    """One row per vector component."""
    rows = df.select(*keys, F.posexplode(F.col(vector)).alias("pos", name))
    return rows.withColumn(name, F.round(F.col(name).cast("double"), DIGITS))


def on_text(table_name: str, key: str, function: Callable[[Column], Column], column: str = "text") -> Query:
    """A query that applies a text expression to a whole table."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return texts(spark, folder, table_name, key).select(key, function(F.col(column)).alias("text"))

    return run


# --- sources and sinks ---------------------------------------------------------------


@query
def scan_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", "url", "html")


@query
def page_rejects(spark, folder):
    """Every page with its status; every seventh is made unreadable, every eleventh all script."""
    html = F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(
        F.col("page_id") % 11 == 0, F.concat(F.lit("<script>"), "url", F.lit("</script>"))
    ).otherwise(F.col("html"))
    rows = texts(spark, folder, "pages", "page_id").select("page_id", html.alias("html"))
    return pages.rejects(rows).select("page_id", "status")


@query
def scan_parquet(spark, folder):
    return components(table(spark, folder, "embeddings"), ["vec_id", "label"], "embedding")


DOCUMENT_SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])


def _csv_roundtrip(spark: SparkSession, folder: str, sep: str) -> DataFrame:
    path = files.work_folder(spark)
    files.write_csv(table(spark, folder, "documents"), path, sep)
    return files.read_csv(spark, path, DOCUMENT_SCHEMA, sep)


@query
def csv_roundtrip(spark, folder):
    return _csv_roundtrip(spark, folder, ",")


@query
def csv_semicolon_roundtrip(spark, folder):
    return _csv_roundtrip(spark, folder, ";")


@query
def parquet_roundtrip(spark, folder):
    """Written by scrape, so that the read of one scrape opens only its folder; all is read back."""
    path = files.work_folder(spark)
    rows = derived.vectors(spark, folder).select("vec_id", "company", "innov", "scrape", "embedding")
    files.write_parquet(rows, path, partition_by="scrape")
    return components(spark.read.parquet(path), ["vec_id", "company", "innov", "scrape"], "embedding")


@query
def text_files_by_key(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return files.texts_for_keys(rows, table(spark, folder, "labels"), "doc_id")


# --- pages ---------------------------------------------------------------------------


@query
def page_visible_text(spark, folder):
    return pages.visible_text(texts(spark, folder, "pages", "page_id").select("page_id", "html")).select("page_id", "text")


@query
def page_text(spark, folder):
    return derived.page_texts(spark, folder)


QUERIES["transliterate"] = on_text("documents", "doc_id", X.transliterate)
QUERIES["strip_markup"] = on_text("pages", "page_id", X.strip_markup, "html")
QUERIES["strip_markup_repeated"] = on_text("pages", "page_id", X.strip_markup_repeated, "html")
QUERIES["normalize_lines"] = on_text("documents", "doc_id", X.normalize_lines)
QUERIES["newline_to_sentence"] = on_text("documents", "doc_id", X.newline_to_sentence)
QUERIES["mask_phone"] = on_text("documents", "doc_id", X.mask_phone)
QUERIES["mask_email"] = on_text("documents", "doc_id", X.mask_email)


@query
def meta_description_prefix(spark, folder):
    """Two of three documents get a description (their source, with or without end mark)."""
    doc = F.col("doc_id") % 3
    about = F.when(doc == 1, F.concat("source", F.lit("!"))).otherwise(F.col("source"))
    head = F.when(doc == 0, F.lit("")).otherwise(
        F.concat(F.lit('<meta content="'), about, F.lit('" name="description">'))
    )
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body><p>"), "text", F.lit("</p></body></html>"))
    rows = texts(spark, folder, "documents", "doc_id").select("doc_id", html.alias("html"))
    return pages.visible_text(rows).select("doc_id", "text")


@query
def id_from_name(spark, folder):
    """The path part of the address as a file name."""
    name = F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit(".html"))
    return table(spark, folder, "pages").select("page_id", X.id_from_name(name).alias("id"))


@query
def drop_empty_text(spark, folder):
    """Some texts are emptied, some reduced to blanks or markup, before cleaning."""
    doc = F.col("doc_id")
    text = F.when(doc % 7 == 0, "").when(doc % 11 == 0, "  \n ").when(doc % 13 == 0, "<<b>>").otherwise(F.col("text"))
    rows = texts(spark, folder, "documents", "doc_id").select("doc_id", text.alias("text"))
    return pages.clean_text(pages.drop_empty_text(rows))


# --- normalisation, sentences, words --------------------------------------------------


@query
def fix_missing_space(spark, folder):
    rows = derived.raw_page_texts(spark, folder)
    return rows.select("page_id", X.fix_missing_space(F.col("text")).alias("text"))


@query
def fix_missing_period(spark, folder):
    rows = derived.raw_page_texts(spark, folder)
    return rows.select("page_id", X.fix_missing_period(F.col("text")).alias("text"))


@query
def preprocess_text(spark, folder):
    return pages.normalize(derived.page_texts(spark, folder))


@query
def detect_language(spark, folder):
    return sentences.detect_language(texts(spark, folder, "documents", "doc_id").select("doc_id", "text")).drop("text")


@query
def abbreviation_dictionary(spark, folder):
    """Dotted pieces of all document texts, each text taken as one cell of a list."""
    rows = texts(spark, folder, "documents", "doc_id").select("doc_id", "text")
    return sentences.abbreviation_dictionary(rows, "text", ["doc_id"])


@query
def sentence_split(spark, folder):
    rows = texts(spark, folder, "documents", "doc_id").select("doc_id", "text")
    return sentences.explode_sentences(rows, abbreviations=())


@query
def sentence_split_abbrev(spark, folder):
    """Documents with titles put in front of the capitalised words, to give abbreviations work."""
    titled = F.regexp_replace("text", r" ([A-Z][a-z]+)", " o.a. prof. Dr. $1")
    rows = texts(spark, folder, "documents", "doc_id").select("doc_id", titled.alias("text"))
    return sentences.explode_sentences(rows, abbreviations=[*C.ABBREVIATIONS, "o.a."])


@query
def sentence_explode(spark, folder):
    """Label, id and language go along to every sentence of a company."""
    rows = sentences.detect_language(derived.companies(spark, folder).select("doc_id", "innov", "text"))
    return sentences.explode_sentences(rows)


@query
def filter_nonalpha(spark, folder):
    """Sentences with a letter; end marks and digits alone are dropped."""
    pieces = F.explode(F.split("text", r"[ \n]"))
    rows = texts(spark, folder, "documents", "doc_id").select("doc_id", pieces.alias("text"))
    return sentences.with_letters(rows).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


@query
def whitespace_tokens(spark, folder):
    rows = texts(spark, folder, "documents", "doc_id")
    return rows.select("doc_id", F.posexplode(X.whitespace_tokens(F.col("text"))).alias("pos", "token"))


@query
def word_tokens(spark, folder):
    rows = texts(spark, folder, "documents", "doc_id")
    return rows.select("doc_id", F.posexplode(X.word_tokens(F.col("text"), 2)).alias("pos", "token"))


@query
def language_flag(spark, folder):
    lang = F.when(F.col("lang") == "de", "dutch").when(F.col("lang") == "en", "english")
    return table(spark, folder, "documents").select("doc_id", X.language_flag(lang).alias("flag"))


# --- nulls, distinct, joins, unions ---------------------------------------------------


@query
def fill_blank(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "source",
        F.nullif(F.col("n_chars") % 5, F.lit(0)).alias("n"),
    )
    return relational.fill_blank(rows)


@query
def dedup_subset(spark, folder):
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "id_nhr")
    rows = derived.id_map(spark, folder).join(labels, "id_nhr")
    return rows.select("beid", F.col("quality").alias("innov")).dropDuplicates(["beid", "innov"])


@query
def distinct_rows(spark, folder):
    return table(spark, folder, "documents").select("lang", "source").distinct()


@query
def first_per_key(spark, folder):
    return relational.first_per_key(derived.id_map(spark, folder), ["beid"], [F.col("id_nhr")])


@query
def key_overlap_counts(spark, folder):
    left = table(spark, folder, "documents").select("doc_id")
    right = table(spark, folder, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    return relational.key_overlap(left, right, "doc_id")


@query
def join_validated_1to1(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("innov"))
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return relational.join_one_to_one(rows, labels, ["doc_id"])


@query
def join_renamed_keys(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("amount")
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("beid"), F.col("c_acctbal").alias("amount")
    )
    return relational.join_with_suffixes(orders, customers, "id", "beid")


@query
def join_composite(spark, folder):
    rows = derived.companies(spark, folder).select(F.col("doc_id").alias("beid"), "innov", "lang")
    words = table(spark, folder, "labels").select(
        F.floor(F.col("doc_id") / 2).cast("bigint").alias("beid"), F.col("quality").alias("innov"), "toxic"
    )
    return rows.join(words, ["beid", "innov"])


@query
def join_id_map(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id_nhr"), "lang", "source")
    return derived.id_map(spark, folder).join(rows, "id_nhr")


@query
def semi_join(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return relational.semi_join(rows, table(spark, folder, "labels"), "doc_id")


@query
def anti_join(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return relational.anti_join(rows, table(spark, folder, "labels"), "doc_id")


@query
def union_scrapes(spark, folder):
    turns = table(spark, folder, "conversations")
    parts = [
        turns.where(F.col("turn") % 2 == odd).select("conv_id", "turn", F.lit(scrape).alias("scrape"), "text")
        for odd, scrape in ((0, 3), (1, 12))
    ]
    return relational.union_all(*parts)


@query
def union_missing_columns(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source")
    labels = table(spark, folder, "labels").select("quality", "doc_id")
    return relational.union_all(rows, labels, fill_missing=True)


@query
def sample_union_extra(spark, folder):
    base = table(spark, folder, "documents").select("doc_id", "lang")
    extra = table(spark, folder, "labels").select("doc_id", "quality")
    return sampling.sample_with_extra(base, extra, "doc_id", n=150)


# --- vectors and similarity -----------------------------------------------------------


@query
def vector_slice(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", V.slice_vector(F.col("embedding"), 8, 16).alias("v"))
    return components(rows, ["vec_id"], "v")


@query
def pack_vector(spark, folder):
    """The 64 components as columns, packed again."""
    names = [f"c{i}" for i in range(64)]
    wide = table(spark, folder, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    return components(wide.select("vec_id", V.pack(*names).alias("v")), ["vec_id"], "v")


@query
def mean_vector_by_key(spark, folder):
    return components(similarity.mean_vectors(derived.vectors(spark, folder), ["company"], "embedding"), ["company"], "mean_vector")


@query
def cosine_same_key(spark, folder):
    rows = derived.vectors(spark, folder)
    result = similarity.cosine_by_key(rows.where("scrape = 3"), rows.where("scrape = 12"), "label", "embedding")
    return rounded(result, "cosine_similarity")


@query
def word_jaccard(spark, folder):
    result = similarity.word_overlap(derived.text_pairs(spark, folder)).drop("text_old", "text_new")
    return rounded(result, "word_similarity")


@query
def similarity_summary(spark, folder):
    overlap = similarity.word_overlap(derived.text_pairs(spark, folder))
    return rounded(statistics.summary(overlap, "word_similarity"), "minimum", "maximum", "mean", "median")


@query
def word_similarity_hist(spark, folder):
    return statistics.histogram(similarity.word_overlap(derived.text_pairs(spark, folder)), "word_similarity")


@query
def similarity_over_time(spark, folder):
    """Full-text vectors of a turn and the next one of the same conversation."""
    pairs = derived.text_pairs(spark, folder).withColumn("pair", F.concat_ws("-", "conv_id", "turn"))
    old = pairs.select("pair", F.col("text_old").alias("text"))
    new = pairs.select("pair", F.col("text_new").alias("text"))
    result = studies.text_similarity_over_time(old, new, "pair")
    return rounded(result, "minimum", "maximum", "mean", "median")


@query
def sentence_profile(spark, folder):
    return studies.sentence_profile(spark, folder)


def _drift(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the earlier scrape by one id (two per company), of the later one by the other."""
    rows = derived.vectors(spark, folder)
    company = F.col("vec_id") % 60
    old = rows.where("scrape = 3").select(company.alias("id_nhr"), "embedding")
    new = rows.where("scrape = 12").select(F.floor(company / 2).cast("bigint").alias("beid"), "embedding")
    ids = rows.select(company.alias("id_nhr"), F.floor(company / 2).cast("bigint").alias("beid")).distinct()
    return studies.vector_drift(old, new, ids, "id_nhr", "beid", "embedding")


@query
def vector_drift(spark, folder):
    return rounded(_drift(spark, folder), "cosine_similarity")


@query
def vector_drift_summary(spark, folder):
    return rounded(statistics.summary(_drift(spark, folder), "cosine_similarity"), "minimum", "maximum", "mean", "median")


@query
def labelled_texts(spark, folder):
    """Page texts with the label of the page's company."""
    raw = texts(spark, folder, "pages", "page_id").select(F.col("page_id").alias("doc_id"), "html")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("innov"))
    return studies.company_texts(raw, labels, "doc_id", 3)


@query
def histogram_range(spark, folder):
    return statistics.histogram(table(spark, folder, "events"), "value")


@query
def histogram_unit(spark, folder):
    return statistics.histogram(derived.scored(spark, folder), "rf_proba", value_range=(0.0, 1.0))


@query
def label_match_hist(spark, folder):
    rows = derived.scored(spark, folder).withColumn("matched", F.col("innov") == F.col("rf_pred_lab"))
    return statistics.histogram(rows, "rf_proba", value_range=(0.0, 1.0), by=["matched"])


@query
def median_value(spark, folder):
    return rounded(statistics.median(table(spark, folder, "lineitem"), "l_extendedprice"), "median")


@query
def knn_topk(spark, folder):
    train, test = sampling.split(derived.vectors(spark, folder), "vec_id")
    return rounded(knn.knn(test, train, "vec_id", "vec_id", "embedding", 2), "distance")


@query
def knn_classify(spark, folder):
    train, test = sampling.split(derived.vectors(spark, folder), "vec_id")
    return knn.knn_classify(test, train, "vec_id", "embedding", "innov")


# --- decisions and reports ------------------------------------------------------------


@query
def score_buckets(spark, folder):
    return derived.scored(spark, folder).select("vec_id", "bucket")


@query
def company_rollup(spark, folder):
    result = decisions.rollup_company(derived.scored(spark, folder), "company")
    return rounded(result, "mean_innov", "mean_pred", "mean_proba")


@query
def threshold_sweep(spark, folder):
    companies = decisions.rollup_company(derived.scored(spark, folder), "company")
    return decisions.decide(companies).select("company", "rule", "threshold", "decision")


REPORT = ("precision", "recall", "f1")


@query
def threshold_report(spark, folder):
    return rounded(decisions.threshold_reports(derived.scored(spark, folder), "company"), *REPORT)


@query
def decision_boundary(spark, folder):
    rows = derived.scored(spark, folder)
    return rounded(statistics.conditional_max(rows, "rf_proba", F.col("rf_pred_lab") == 0, "boundary"), "boundary")


@query
def binary_metrics(spark, folder):
    result = metrics.binary_metrics(derived.scored(spark, folder), "innov", "rf_pred_lab")
    return rounded(result, "accuracy", *REPORT)


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(derived.scored(spark, folder), "innov", "rf_pred_lab")


@query
def classification_report(spark, folder):
    return rounded(metrics.classification_report(derived.scored(spark, folder), "innov", "rf_pred_lab"), *REPORT)


def _with_distance(spark: SparkSession, folder: str) -> DataFrame:
    rows = derived.scored(spark, folder)
    centroids = decisions.mean_centroids(rows, ["cluster"], "embedding")
    near = decisions.centroid_distance(rows, centroids, ["cluster"], "embedding")
    return rounded(near, "distance_from_centroid")


@query
def centroid_distance(spark, folder):
    return _with_distance(spark, folder).select("vec_id", "cluster", "distance_from_centroid")


REVIEW = ("bucket", "cluster", "rank", "vec_id")
REVIEW_N = C.REVIEW_ROWS


@query
def cluster_top_n(spark, folder):
    rows = _with_distance(spark, folder)
    return decisions.extreme_rows(rows, ["bucket", "cluster"], "distance_from_centroid", "vec_id", REVIEW_N).select(*REVIEW)


@query
def cluster_bottom_n(spark, folder):
    rows = _with_distance(spark, folder)
    return decisions.extreme_rows(
        rows, ["bucket", "cluster"], "distance_from_centroid", "vec_id", REVIEW_N, farthest=True
    ).select(*REVIEW)


@query
def cluster_review(spark, folder):
    """The 50 nearest and farthest rows of the clusters of both correct buckets."""
    rows = _with_distance(spark, folder).where(F.col("bucket").isin("correct_high", "correct_low"))
    return decisions.cluster_review(rows, ["bucket", "cluster"], "distance_from_centroid", "vec_id").select(*REVIEW, "side")


# --- terms and features ---------------------------------------------------------------


@query
def term_counts(spark, folder):
    return terms.term_counts(texts(spark, folder, "documents", "doc_id"), "doc_id")


@query
def doc_frequency(spark, folder):
    return terms.document_frequency(texts(spark, folder, "documents", "doc_id"))


@query
def tfidf_sublinear(spark, folder):
    return rounded(terms.tfidf(texts(spark, folder, "documents", "doc_id"), "doc_id"), "tfidf")


# Fewer texts are labelled than in a crawl, so words need fewer of them to count.
LABELLED_MIN_DF = 20


def _sparse_rows(df: DataFrame, key: str, vector: str, names: DataFrame) -> DataFrame:
    """(key, name, value) of the entries of a sparse or dense vector that are not 0; ``names`` is (index, name)."""
    parts = df.select(key, F.unwrap_udt(vector).alias("p"))
    entries = F.when(F.col("p.type") == 0, F.arrays_zip("p.indices", "p.values")).otherwise(
        F.transform("p.values", lambda v, i: F.struct(i.alias("indices"), v.alias("values")))
    )
    rows = parts.select(key, F.explode(entries).alias("e")).select(key, F.col("e.indices").cast("bigint").alias("index"), F.col("e.values").alias("value"))
    return rows.where("value <> 0").join(names, "index").select(key, "name", "value")


@query
def count_vectorize(spark, folder):
    """Counts of the training vocabulary in all labelled texts."""
    rows = derived.companies(spark, folder)
    train, _ = sampling.split(rows, "doc_id")
    vocabulary = bag_of_words.fit_counts(train, min_df=LABELLED_MIN_DF)
    counted = bag_of_words.vocabulary.vectors(
        rows, "doc_id", bag_of_words.vocabulary.known_counts(rows, "doc_id", vocabulary), "n", vocabulary.size, "_counts")
    names = vocabulary.table.select("index", F.col("term").alias("name"))
    result = _sparse_rows(counted, "doc_id", "_counts", names)
    return result.select("doc_id", F.col("name").alias("term"), F.col("value").cast("bigint").alias("n"))


def _plain_features(spark: SparkSession, folder: str) -> tuple[DataFrame, bag_of_words.BagOfWords]:
    rows = derived.companies(spark, folder).withColumn("lang", F.when(F.col("lang") == "de", "dutch").otherwise("english"))
    train, _ = sampling.split(rows, "doc_id")
    return rows, bag_of_words.fit_features(train, "doc_id", word_emb=False, min_df=LABELLED_MIN_DF)


@query
def assemble_features(spark, folder):
    """tf-idf of the training vocabulary and the language flag, assembled, for all labelled texts."""
    rows, features = _plain_features(spark, folder)
    result = _sparse_rows(features.transform(rows), "doc_id", "features", features.feature_names())
    return rounded(result, "value")


@query
def feature_names(spark, folder):
    _, features = _plain_features(spark, folder)
    return features.feature_names().select("name")


@query
def mean_word_vector(spark, folder):
    """Mean of the vectors of the known words; a word is known if 20 texts have it.

    The vectors are eight bytes of a hash of the word, so that the result is repeatable.
    """
    docs = texts(spark, folder, "documents", "doc_id").select("doc_id", "text")
    words = docs.select(F.explode(X.word_set(F.col("text"))).alias("word"))
    known = words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df >= 20")
    digest = F.md5("word")
    parts = [F.conv(F.substring(digest, 1 + 2 * i, 2), 16, 10).cast("double") / 257.0 for i in range(8)]
    vectors = known.select("word", F.array(*parts).alias("vector"))
    return components(terms.mean_word_vectors(docs, "doc_id", vectors, 8), ["doc_id"], "word_vector")


@query
def embed_texts(spark, folder):
    rows = encode.embed(derived.companies(spark, folder).select("doc_id", "text"))
    return rows.select("doc_id", F.size("embedding").alias("n_values"), F.round(V.norm(F.col("embedding")), 4).alias("length"))


@query
def split_train_test(spark, folder):
    return sampling.mark_split(table(spark, folder, "documents").select("doc_id"), "doc_id")


@query
def sample_n(spark, folder):
    return sampling.sample_rows(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", 120)


@query
def word2vec_vectors(spark, folder):
    """One row per word in at least five places."""
    vectors = bag_of_words.train_word_vectors(texts(spark, folder, "documents", "doc_id"))
    return vectors.select("word", F.size("vector").alias("n_values"))


@query
def word_cooccurrence(spark, folder):
    """Pairs of words in at least five places, at most five tokens apart, both orders, counted."""
    pairs, _ = word_vectors.cooccurrence(texts(spark, folder, "documents", "doc_id"))
    return pairs


# --- models ---------------------------------------------------------------------------


def _model_query(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        train, test = sampling.split(derived.vectors(spark, folder), "vec_id")
        scorer = classifiers.train(name, train, "embedding", "innov", "vec_id")
        return rounded(scorer(test).select("vec_id", "innov", "pred", "proba"), "proba")

    return run


for _name in classifiers.MODELS:
    if _name != "knn":
        QUERIES[f"clf_{_name}"] = _model_query(_name)


@query
def class_mean_cov(spark, folder):
    result = qda.moment_table(derived.vectors(spark, folder), "embedding", "innov")
    return rounded(result, "mean_i", "covariance")


@query
def compare_classifiers(spark, folder):
    train, test = sampling.split(derived.vectors(spark, folder), "vec_id")
    return rounded(classifiers.compare(train, test, "embedding", "innov", "vec_id"), *REPORT)


@query
def random_search_rf(spark, folder):
    """The whole budget: 50 settings of the full grid, five folds, forests of 100 to 1,000 trees."""
    train, _ = sampling.split(derived.vectors(spark, folder), "vec_id")
    return classifiers.random_search(train, "embedding", "innov", "vec_id")[1]


@query
def rf_save_load_score(spark, folder):
    """Fit on the earlier scrape, save, load, score the later one."""
    rows = derived.vectors(spark, folder)
    path = files.work_folder(spark)
    classifiers.save(classifiers.fit_forest(rows.where("scrape = 3"), "embedding", "innov", "vec_id"), path)
    scored = classifiers.score(classifiers.load(path), rows.where("scrape = 12"), "embedding")
    return rounded(scored.select("vec_id", "innov", "pred", "proba"), "proba")


@query
def score_rows(spark, folder):
    rows = derived.vectors(spark, folder)
    model = classifiers.fit_forest(rows, "embedding", "innov", "vec_id")
    return rounded(classifiers.score(model, rows, "embedding").select("vec_id", "company", "pred", "proba"), "proba")


@query
def fulltext_classifier(spark, folder):
    return rounded(studies.fulltext_reports(derived.companies(spark, folder), "doc_id", "innov"), *REPORT)


@query
def concept_drift_report(spark, folder):
    rows = derived.vectors(spark, folder)
    train, held_out = sampling.split(rows.where("scrape = 3"), "vec_id")
    model = classifiers.fit_forest(train, "embedding", "innov", "vec_id")
    result = studies.concept_drift(model, held_out, rows.where("scrape = 12"), "embedding", "company", "innov")
    return rounded(result, *REPORT, "f1_change")


@query
def external_validation_report(spark, folder):
    rows = derived.vectors(spark, folder)
    known = rows.where("scrape = 3 and company % 3 <> 0")
    model = classifiers.fit_forest(known, "embedding", "innov", "vec_id")
    result = studies.external_validation(model, known, rows, "company", "embedding", "company", "innov")
    return rounded(result, *REPORT)


@query
def nb_save_load_score(spark, folder):
    """As ``rf_save_load_score`` with the Bernoulli model."""
    rows = derived.vectors(spark, folder)
    path = files.work_folder(spark)
    classifiers.save(classifiers.fit_bernoulli(rows.where("scrape = 3"), "embedding", "innov", "vec_id"), path)
    scored = classifiers.score(classifiers.load(path), rows.where("scrape = 12"), "embedding")
    return rounded(scored.select("vec_id", "innov", "pred", "proba"), "proba")


@query
def nb_score_rows(spark, folder):
    rows = derived.vectors(spark, folder)
    model = classifiers.fit_bernoulli(rows, "embedding", "innov", "vec_id")
    return rounded(classifiers.score(model, rows, "embedding").select("vec_id", "company", "pred", "proba"), "proba")


@query
def nb_concept_drift_report(spark, folder):
    """As ``concept_drift_report`` with the Bernoulli model."""
    rows = derived.vectors(spark, folder)
    train, held_out = sampling.split(rows.where("scrape = 3"), "vec_id")
    model = classifiers.fit_bernoulli(train, "embedding", "innov", "vec_id")
    result = studies.concept_drift(model, held_out, rows.where("scrape = 12"), "embedding", "company", "innov")
    return rounded(result, *REPORT, "f1_change")


@query
def nb_external_validation_report(spark, folder):
    """As ``external_validation_report`` with the Bernoulli model."""
    rows = derived.vectors(spark, folder)
    known = rows.where("scrape = 3 and company % 3 <> 0")
    model = classifiers.fit_bernoulli(known, "embedding", "innov", "vec_id")
    result = studies.external_validation(model, known, rows, "company", "embedding", "company", "innov")
    return rounded(result, *REPORT)


@query
def cosine_kmeans(spark, folder):
    rows = derived.scored(spark, folder).drop("cluster")
    result = clusters.cluster_buckets(rows, "embedding")
    return rounded(result.select("vec_id", "bucket", "cluster", "distance_from_centroid"), "distance_from_centroid")


def _bow_data(spark: SparkSession, folder: str) -> DataFrame:
    return derived.companies(spark, folder).withColumn("lang", F.when(F.col("lang") == "de", "dutch").otherwise("english"))


BOW = {"min_df": LABELLED_MIN_DF}


@query
def bow_classifier(spark, folder):
    scored = bag_of_words.classify(_bow_data(spark, folder), "doc_id", "innov", **BOW)
    return rounded(scored.select("doc_id", "innov", "pred", "proba"), "proba")


@query
def bow_cross_dataset(spark, folder):
    """Train on one population, test on another (documents of every third source)."""
    rows = _bow_data(spark, folder)
    other = F.pmod(F.xxhash64("source"), F.lit(3)) == 0
    scored = bag_of_words.classify(rows.where(~other), "doc_id", "innov", test=rows.where(other), **BOW)
    return rounded(scored.select("doc_id", "innov", "pred", "proba"), "proba")


@query
def bow_register_sample(spark, folder):
    """A sample of the register plus all startups that were not sampled, then classified."""
    rows = _bow_data(spark, folder)
    startup = F.pmod(F.xxhash64("source"), F.lit(3)) == 0
    data = sampling.sample_with_extra(rows.where(~startup), rows.where(startup), "doc_id", n=200)
    scored = bag_of_words.classify(data, "doc_id", "innov", min_chars=2, **BOW)
    return rounded(scored.select("doc_id", "innov", "pred", "proba"), "proba")


@query
def bow_repeated_runs(spark, folder):
    result = bag_of_words.repeated_runs(_bow_data(spark, folder), "doc_id", "innov", runs=2, **BOW)
    return rounded(result, "accuracy", *REPORT)
