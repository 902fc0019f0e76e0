import random

import pytest


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): near and exact copies, shared passages, nulls, ties, extremes."""
    rng = random.Random(4)
    base = [prose(rng, 90) for _ in range(12)]
    passage = prose(rng, 60)
    item = prose(rng, 30)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for k in range(20, 34):  # near copies of one text, one word changed
        w = base[0].split()
        w[k % 80] = "changed%d" % k
        rows.append((k, " ".join(w), "en", "s0"))
    rows += [(40 + i, base[3], "en", "s1") for i in range(9)]  # exact copies
    rows += [(60 + i, f"{prose(rng, 70)} {passage} {prose(rng, 70)}", "de", "s2") for i in range(4)]
    rows += [(70, f"{prose(rng, 60)} {item.upper()}, {prose(rng, 60)}", "en", "s0"), (71, f"{item} {prose(rng, 60)}", "en", None)]
    rows += [
        (80, None, None, "s0"), (81, "", "en", "s0"), (82, " \n\t ", "en", None), (83, "one", "fr", "s9"), (84, "a b c", None, "s9"),
        (85, "same line here\n" * 60, "en", "s1"), (86, "ab" * 4000, "en", "s1"), (87, prose(rng, 4000), "en", "s1"),
        (88, "mail me: a.b@c.de or +31 (0)20-1234567, 10.0.0.255 4111 1111 1111 1111 é 999.1.1.1 x@y", "en", "s2"),
        (None, prose(rng, 80), "en", "s1"), (None, base[5], None, None),
        (90, base[6], "en", "s1"), (90, base[6], "en", "s1"), (90, prose(rng, 75), "en", "s2"),
        (91, "naïve café \U0001F600 ſ İ don't 'll <|endoftext|> x", "fr", "s2"), (92, "\x00\x01 odd", "en", "s2"),
    ]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows], item


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _write(spark, folder, rows, items, labels, vectors=()):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_folder(spark, odd_rows, tmp_path_factory):
    rows, item = odd_rows
    items = [(1, item), (2, "too short"), (3, None), (None, item), (5, "never seen words in any of the texts at all")]
    labels = [(0, 1, 0), (1, 1, 0), (85, 0, 0), (86, 0, None), (60, 1, 1), (None, 1, 0), (7, None, None), (0, 1, 0)]
    vectors = [(100, [0.1, 0.2], 1), (101, [0.1, 0.2], 1), (102, [0.1, 0.19], 2), (200, None, 1), (None, [0.3, 0.1], 2), (300, [1.0], 2)]
    return _write(spark, tmp_path_factory.mktemp("odd") / "t", rows, items, labels, vectors)


@pytest.fixture(scope="session")
def empty_folder(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("none") / "t", [], [], [])
