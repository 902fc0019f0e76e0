"""Operators against brute force on awkward rows and on the given documents; empty tables; clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from webdrift.llm import decontamination, jaccard_join, mixing, pii, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts
from webdrift.llm.language_id import fit, predict
from webdrift.llm.queries import QUERIES

CONTRACT = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_mixing": "doc_id size source_size target taken",
    "op9_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op13_lexical_search": "item_id rank doc_id score",
}


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def both(spark, name, odd_folder, folder, odd_rows, docs):
    """(rows of the query, its documents) for the awkward and the given table."""
    yield QUERIES[name](spark, odd_folder).collect(), pairs(odd_rows[0])
    yield QUERIES[name](spark, folder).collect(), pairs(docs.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_and_contract(spark, empty_folder, name):
    result = QUERIES[name](spark, empty_folder)
    assert set(CONTRACT.get(name, "doc_id").split()) <= set(result.columns)
    assert result.count() == 0


def test_sharding(spark, odd_folder, folder, odd_rows, docs):
    import zlib

    for got, rows in both(spark, "op1_sharding", odd_folder, folder, odd_rows, docs):
        assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32 or 0) for r in got) == sorted(
            (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32(t.encode()) if t is not None else 0) for d, t in rows)
        count = Counter(r.shard for r in got)
        assert set(count) <= set(range(16)) and max(count.values()) - min(count[s] for s in range(16)) <= 1
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_does_not_depend_on_storage_and_moves_little(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k").withColumn("shard", F.lit("old"))
    one = {r.k: r.shard for r in sharding.shard(rows, 16, ("k",)).collect()}
    assert one == {r.k: r.shard for r in sharding.shard(rows.repartition(3), 16, ("k",)).collect()}
    grown = {r.k: r.shard for r in sharding.shard(rows, 17, ("k",), slack=0.1).collect()}
    loose = {r.k: r.shard for r in sharding.shard(rows, 16, ("k",), slack=0.1).collect()}
    assert max(Counter(loose.values()).values()) <= -(-1.1 * 20_000 // 16)
    assert sum(grown[k] != loose[k] for k in grown) < 0.25 * len(grown)  # a modulus would move 94 %


def test_sharding_of_one_key(spark):
    rows = spark.range(1000).select(F.lit(7).alias("k"), F.col("id").alias("v"))
    got = Counter(r.shard for r in sharding.shard(rows, 7, ("k",), ("v",)).collect())
    assert sorted(got.values()) == [142, 143, 143, 143, 143, 143, 143]


def test_jaccard_join(spark, odd_folder, folder, odd_rows, docs):
    for got, rows in both(spark, "op2_jaccard_join", odd_folder, folder, odd_rows, docs):
        want = brute.classes(rows)
        assert sorted(((r.doc_id is None, r.doc_id or 0), (r.class_id is None, r.class_id or 0), r.n_links, r.n_copies) for r in got) == sorted(
            ((d is None, d or 0), (want[t or ""][0] is None, want[t or ""][0] or 0), *want[t or ""][1:]) for d, t in rows)


def test_jaccard_join_in_blocks(spark, odd_rows, monkeypatch):
    """Groups far over the block size lose no link."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = pairs(odd_rows[0])
    want = brute.classes(rows)
    got = jaccard_join.labelled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.class_id, r.n_links) for r in got) == Counter(want[t or ""][:2] for _, t in rows)


def test_depth_meets_the_target():
    d = jaccard_join.matched_depth()
    assert 1 - (1 - 0.8**d) ** jaccard_join.TREES >= jaccard_join.TARGET > 1 - (1 - 0.8 ** (d + 1)) ** jaccard_join.TREES


def test_one_of_each_group(spark, odd_rows):
    rows = odd_rows[0]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    kept = jaccard_join.one_of_each_group(frame)
    assert kept.columns == frame.columns
    want = brute.classes(pairs(rows))
    got = Counter(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert got == Counter({want[t or ""][0] for _, t in pairs(rows)} - {None})


def test_quality_rules(spark, odd_folder, folder, odd_rows, docs):
    Q = quality_rules
    for got, rows in both(spark, "op4_quality_rules", odd_folder, folder, odd_rows, docs):
        def line(d, t):
            n, chars, symbols, dup, rep, covered, longest = brute.rules(t, Q.MIN_REPEAT)
            failed = n < 50 or 100 * rep > 50 * n
            kept = brute.kept_by_rules(t, Q.MIN_REPEAT, Q.MAX_COVERED, Q.MAX_LONGEST)
            return (d is None, d or 0), n, chars, symbols, dup, rep, failed, kept, covered, longest

        short = [(d, t) for d, t in rows if len(t or "") < 9000]
        ids = {d for d, t in rows if len(t or "") >= 9000}
        assert sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in got if r.doc_id not in ids) == sorted(line(d, t) for d, t in short if d not in ids)


def test_quality_rules_keep_other_columns(spark):
    frame = spark.createDataFrame([("x", 1, "a b")], "text string, n_words int, keep string")
    row = quality_rules.judged(frame).first()
    assert (row.text, row.keep, row.n_words, row.kept) == ("x", "a b", 1, False)


def test_pii_patterns(spark, odd_folder, folder, odd_rows, docs):
    for got, rows in both(spark, "op5_pii", odd_folder, folder, odd_rows, docs):
        def line(d, t):
            spans = brute.personal(t)
            told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            count = Counter(k for k, _, _ in spans)
            return (d is None, d or 0), *[count[k] for k in pii.KINDS], hashlib.sha256(told.encode()).hexdigest()

        assert sorted(((r[0] is None, r[0] or 0), *r[1:6]) for r in got) == sorted(line(d, t) for d, t in rows)
        assert all(hashlib.sha256(",".join(s for s in r.spans.split(",") if s[:4] != "term").encode()).hexdigest() == r.base_sha256 for r in got)


def test_pii_long_runs_are_read_once():
    for text in ("a" * 300_000 + " @", "1" * 300_000 + ".1", "+1" + "(" * 300_000, "1." * 150_000):
        pii.pattern_spans(text)


def test_disclosing_terms(spark):
    rows = [(i, f"the owner zorblax lives here {i} write to z@x.org now please") for i in range(4)]
    rows += [(10 + i, f"the owner of number {i} writes to m{i}@x.org now please") for i in range(30)]
    rows += [(50 + i, "nothing to see for the owner here now please") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.sanitised(frame, keep_text=True).collect()}
    terms = {(d, rows[k][1][s.first:s.last]) for k, (d, _) in enumerate(rows) for s in got[d].spans if s.kind == "term"}
    assert {t for _, t in terms} == {"zorblax", "lives", "write"} and {d for d, _ in terms} == {0, 1, 2, 3}
    assert got[1].text == "the owner   here 1  to [email] now please"
    assert got[50].text == rows[34][1]


def test_disclosing_terms_far_from_the_value_and_without_it(spark):
    far = " ".join(f"é{k}" for k in range(20))
    rows = [(i, f"Zorblax signs {i} {far} mail to z@x.org now") for i in range(3)]
    rows += [(3, "again ZORBLAX, and zorblax but no value"), (4, f"zorblax z@x.org {far} {far} zorblax zorblax@y.org")]
    rows += [(50 + i, f"{far} mail to now signs nothing") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = dict(rows)
    got = {r.doc_id: [text[r.doc_id][s["first"]:s["last"]] for s in r.spans if s["kind"] == "term"] for r in pii.sanitised(frame).collect()}
    assert got == {d: [] for d, _ in rows} | {d: ["Zorblax"] for d in range(3)} | {3: ["ZORBLAX", "zorblax"], 4: ["zorblax", "zorblax"]}


def test_language_id(spark, odd_folder, folder, odd_rows, docs):
    import zlib

    for got, rows in both(spark, "op6_language_id", odd_folder, folder, odd_rows, docs):
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        text = defaultdict(list)
        for d, t in rows:
            text[d].append(t)
        for r in got:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            letters = [any(c.isalpha() for c in t or "") for t in text[r.doc_id]]
            assert (r.lang_pred == "und") in [not x for x in letters]
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_id_without_labels(spark):
    none = spark.createDataFrame([(None, "text")], "lang string, text string")
    assert fit(none) is None
    assert predict(none.drop("lang"), None).first().lang_pred == "und"


def test_token_counts(spark, odd_folder, folder, odd_rows, docs):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(token_counts.TOKENIZER)
    for got, rows in both(spark, "op7_token_counts", odd_folder, folder, odd_rows, docs):
        want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
            ((d is None, d or 0), len((t or "").encode()), n, n > 2048) for (d, t), n in zip(rows, want))


def test_token_counts_of_random_strings():
    tokenizers = pytest.importorskip("tokenizers")
    import random

    tokenizer = tokenizers.Tokenizer.from_file(token_counts.TOKENIZER)
    rng, signs = random.Random(5), "abcdrevlstm'  \n!.?0123éÉßĳﬁÅµΣσİ一ñ<|>€😀́\x85\x1cſ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["a" * 400, "ab'" * 99, "'ll" * 50]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(token_counts.TOKENIZER).texts(texts).tolist() == want


def test_mixing(spark, odd_folder, folder, odd_rows, docs):
    for name, rows in ((odd_folder, odd_rows[0]), (folder, docs.collect())):
        got = QUERIES["op8_mixing"](spark, name).collect()
        sizes, of = Counter(), {}
        for d, t, _, s, _ in rows:
            sizes[s] += len(brute.WORD.findall(t or ""))
        want = brute.targets(sizes)
        assert sorted(round(r.target, 3) for r in got) == sorted(round(want[r[3]], 3) for r in rows)
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        taken = defaultdict(int)
        for r in got:
            taken[r.source_size, round(r.target, 3)] += r.taken
        same = Counter((sizes[s], round(want[s], 3)) for s in sizes)
        for (size, target), n in taken.items():
            assert abs(n - same[size, target] * target) <= 300 * same[size, target]
        assert sorted(map(str, got)) == sorted(map(str, QUERIES["op8_mixing"](spark, name).collect()))


def test_schedule_is_even_and_its_ranks_are_right(spark):
    shares = [0.5, 0.3, 0.15, 0.05]
    edges = [round(sum(shares[:i]) * 2**mixing.BITS) for i in range(5)]
    targets = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(4)], "place int, low bigint, high bigint")
    rows = sorted(mixing.schedule(targets, 3000).collect())
    assert [r.slot for r in rows] == list(range(3000))
    seen = Counter()
    for r in rows:
        assert r.rank == seen[r.place]
        seen[r.place] += 1
        assert all(abs(seen[p] - shares[p] * (r.slot + 1)) < 6 for p in range(4))


def test_spans_of_the_mix_fill_blocks(spark, odd_folder):
    rows = spark.read.parquet(f"{odd_folder}/documents.parquet").select("doc_id", "source", F.length("text").alias("size"))
    spans, taken = mixing.mix(rows, block_words=64)
    blocks = spans.groupBy("slot").agg(F.sum("words").alias("n"), F.countDistinct("place", "rank").alias("blocks"))
    assert blocks.filter("n > 64 or blocks > 1").count() == 0
    assert spans.agg(F.sum("words")).first()[0] == taken.agg(F.sum("taken")).first()[0]


def test_suffix_dedup(spark, odd_folder, folder, odd_rows, docs, monkeypatch):
    for size in (suffix_dedup.GROUP_BYTES, 40_000):
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", size)
        for got, rows in both(spark, "op9_suffix_dedup", odd_folder, folder, odd_rows, docs):
            want = brute.cut(rows)
            assert sorted(((r.doc_id is None, r.doc_id or 0), *r[1:]) for r in got) == sorted(
                ((d is None, d or 0), *want[d, t]) for d, t in rows)


def test_suffix_array_orders_all_suffixes():
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        pieces = [bytes(rng.choice(b"ab\0\xff"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 40))) for _ in range(5)]
        text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, np.int16(0)) for p in pieces])
        array = suffix_dedup.suffix_array(text, 64)
        assert sorted(array) == np.flatnonzero(text).tolist()
        cut = [tuple(text[i : i + 1 + int(np.argmin(text[i:] != 0))]) for i in array]
        if not any(b"\0" in p for p in pieces):
            assert cut == sorted(cut)


def test_decontamination(spark, odd_folder, folder, odd_rows, docs):
    for name, rows in ((odd_folder, pairs(odd_rows[0])), (folder, pairs(docs.collect()))):
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{name}/benchmark.parquet").collect()]
        got = QUERIES["op10_decontamination"](spark, name).collect()
        assert {(r.doc_id, r.item_id) for r in got} == brute.leaks(rows, items)
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_decontamination_finds_changed_passages(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 7)  # the benchmark in several parts
    item = " ".join(f"w{i}" for i in range(60))
    changed = item.replace("w30 ", "other ")
    frame = spark.createDataFrame([(1, f"x y z {changed} p q"), (2, item[:100]), (3, "w1 w2 w3 w4 w5 w6")], "doc_id bigint, text string")
    found = decontamination.leaks(frame, spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.n_words) for r in found] == [(1, 9, 3, 60)]


def test_decontamination_finds_passages_just_similar_enough(spark):
    rng, docs, items = random.Random(11), [], []
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    for i in range(40):
        n = (24, 30, 50, 80)[i % 4]
        item = [rng.choice(vocabulary) for _ in range(n)]
        kept = -(-8 * (n - 4) // 10) + 4  # just 0.8 of the shingles, or the next above
        changed = item[:kept] + [f"x{i}y{j}" for j in range(n - kept)]
        docs.append((i, " ".join([*rng.choices(vocabulary, k=40), *changed, *rng.choices(vocabulary, k=40)])))
        items.append((i, " ".join(item)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontamination.leaks(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert max(r.hamming for r in got) > 14 and max(r.similarity for r in got) < 0.86
    assert {(r.doc_id, r.item_id) for r in got} == brute.leaks(docs, items)


def test_decontamination_takes_a_short_item_as_one_shingle(spark):
    docs = [(1, "He asked: who WROTE it? nobody"), (2, "who wrote what it"), (3, None), (4, ""), (5, "who wrote it"), (6, "x")]
    items = [(1, "Who wrote it"), (2, ""), (3, None), (None, "x"), (5, "wrote it nobody x")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    given = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.similarity, r.first_word, r.n_words, r.hamming) for r in decontamination.leaks(frame, given).collect()}
    assert got == {(1, 1, 1.0, 2, 3, 0), (5, 1, 1.0, 0, 3, 0), (6, None, 1.0, 0, 1, 0)}
    assert {r.doc_id for r in decontamination.without_leaks(frame, given).collect()} == {2, 3, 4}


def test_fingerprints_within_the_radius_share_a_band(spark):
    import random

    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), decontamination.RADIUS):
            b |= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, a ^ b)))
    frame = spark.createDataFrame(rows, "a bigint, b bigint")
    shared = F.arrays_overlap(F.array(*decontamination._bands("a")), decontamination._neighbours("b"))
    assert frame.filter(~shared).count() == 0


def test_quality_classifier(spark, odd_folder, folder, docs):
    got = QUERIES["op3_quality_classifier"](spark, odd_folder).collect()
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("grade")
    seen, held = labels.filter("doc_id % 4 != 0").select("doc_id", grade), labels.filter("doc_id % 4 = 0").select("doc_id", grade)
    model = quality_classifier.fit(texts, seen, 3)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    scored = quality_classifier.predict(texts, model).join(held, "doc_id").groupBy("grade").agg(F.avg("expected_grade").alias("e"))
    means = [r.e for r in scored.orderBy("grade").collect()]
    assert means[-1] > 1.2 and means == sorted(means)


def test_quality_classifier_without_ratings(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, grade int")
    assert quality_classifier.fit(docs, labels, 3) is None
    assert quality_classifier.predict(docs, None).filter("tail is not null").count() == 0

