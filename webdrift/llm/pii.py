"""Personal data: patterns, and terms that give a protected entity away.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Each value found is a
protected entity.  A term may reveal an entity even when the value itself is masked: the
corpus says how strongly.  With documents as events, what a term t tells about an entity e is
``log2(p(t, e) / (p(t) p(e)))``, at most the entity's own information ``-log2 p(e)``, reached if t
occurs with e only.  A term that discloses at least ``DISCLOSURE`` of an entity's information, seen with
it in ``SUPPORT`` documents or more, wherever in these, becomes a span of kind ``term`` at every place in
every document, with or without the value.  Terms are runs of letters and digits, in lower case as far as ASCII goes.

Counts are over whole documents, all of them.  Entities of fewer than ``SUPPORT`` documents have no such
term and are passed over; the corpus is counted for terms seen with the others in ``SUPPORT`` documents.
Entities and terms are looked up in bit maps of fixed size, with an exact filter or join behind them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift.llm.bytewise import Prefix, slices, words
from webdrift.llm.common import checkpointed, documents

SUPPORT = 3
DISCLOSURE = 0.9
MAP_BITS = 23  # 1 MB
HELD_TERMS = 200_000  # terms, or pairs of entity and term, that a task counts before it passes them on
KINDS = ("email", "ip", "card", "phone")

# a run of name characters is passed over whole, so that a text without @ is read once
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[A-Za-z0-9\u0080-\U0010FFFF]+")

_LOWER = np.full(256, 0x20, np.uint8)
for _low, _high, _shift in ((48, 57, 0), (65, 90, 32), (97, 122, 0), (128, 255, 0)):
    _LOWER[_low : _high + 1] = np.arange(_low, _high + 1) + _shift
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in characters: leftmost matches of each kind that do not overlap, less those that fail its test."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in EMAIL.finditer(text) if m.group(1)]
    if not text.isascii() or any(d in text for d in "0123456789"):
        for m in IP.finditer(text):
            if m.group(1) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return found


def _free(spans: list[tuple[str, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the stretches starts..ends do not overlap a value."""
    if not spans:
        return np.ones(len(starts), bool)
    taken = sorted((a, b) for _, a, b in spans)
    opens, closes = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken])
    k = np.searchsorted(opens, ends) - 1  # values that begin before the term ends
    return (k < 0) | (closes[np.maximum(k, 0)] <= starts)


def free_terms(text: str) -> set[str]:
    """The different terms of a text that do not overlap its values."""
    at = np.array([m.span() for m in TERM.finditer(text)], np.int64).reshape(-1, 2)
    free = at[_free(pattern_spans(text), at[:, 0], at[:, 1])]
    return {text[a:b].translate(_ASCII_LOWER) for a, b in free.tolist()}


SPANS = "spans array<struct<kind:string,first:int,last:int>>"
NEAR = "near array<struct<term:string,first:int,last:int>>"


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (entities, held): the different values of each, and the text itself if it has any."""
    for batch in batches:
        entities, held = [], []
        for value in batch.column(batch.schema.get_field_index("text")):
            text = value.as_py() or ""
            own = pattern_spans(text)
            entities.append(sorted({f"{k}:{text[a:b]}" for k, a, b in own}))
            held.append(text if own else None)
        yield pa.RecordBatch.from_arrays([pa.array(entities, pa.list_(pa.string())), pa.array(held, pa.string())], names=["entities", "held"])


def _pairs(bits: np.ndarray):
    """(entities, held) -> (entity, term, docs): entities whose place is set, with the terms of their texts of the task."""
    def told(counts: dict[tuple[str, str], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([e for e, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.string()), pa.array(counts.values(), pa.int64())],
            names=["entity", "term", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for entities, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = (_term_hash([e.encode() for e in entities]) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                asked = [e for e, known in zip(entities, bits[place]) if known]
                terms = free_terms(text) if asked else ()
                for entity in asked:
                    for term in terms:
                        counts[entity, term] = counts.get((entity, term), 0) + 1
                    if len(counts) > HELD_TERMS:
                        yield told(counts)
                        counts = {}
        if counts:
            yield told(counts)

    return run


def _find(names: list[str], bits: np.ndarray):
    """Texts -> spans of their values, and terms whose place is set, where they do not overlap these."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    terms = pa.list_(pa.struct([("term", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [pattern_spans(value.as_py() or "") for value in batch.column(batch.schema.get_field_index("text"))]
            near: list[list[dict]] = [[] for _ in own]
            for low, _, data, offsets in slices(batch, "text"):
                plain = _LOWER[data]
                start, end, border = words(plain, offsets)
                hit = np.flatnonzero(bits[(Prefix(plain).of(start, end) >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
                if not len(hit):
                    continue
                text = np.searchsorted(border, hit, "right") - 1
                chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                first = chars[start[hit]] - chars[offsets[text]]
                last = chars[end[hit]] - chars[offsets[text]]
                edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                for i, j in zip(edge, np.append(edge[1:], len(hit))):
                    free = _free(own[low + text[i]], first[i:j], last[i:j])
                    near[low + text[i]] = [
                        {"term": plain[start[h] : end[h]].tobytes().decode("utf-8", "replace"), "first": a, "last": b}
                        for h, a, b in zip(hit[i:j][free], first[i:j][free].tolist(), last[i:j][free].tolist())
                    ]
            spans = [[{"kind": k, "first": a, "last": b} for k, a, b in found] for found in own]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(spans, kinds), pa.array(near, terms)],
                names=[*names, "spans", "near"],
            )

    return run


def _term_hash(terms: list[bytes]) -> np.ndarray:
    if not terms:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(terms), np.uint8)
    end = np.cumsum([len(t) + 1 for t in terms]) - 1
    return Prefix(data).of(end - np.array([len(t) for t in terms]), end)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms -> their places in the bit map."""
    for batch in batches:
        if batch.num_rows:
            terms = [t.encode() for t in batch.column(0).to_pylist()]
            place = (_term_hash(terms) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])


def _count(bits: np.ndarray):
    """Texts -> (term, docs): terms whose place is set, with the number of texts of the task that have them."""
    def told(counts: dict[bytes, int]) -> pa.RecordBatch:
        terms = pa.array([t.decode("utf-8", "replace") for t in counts], pa.string())
        return pa.RecordBatch.from_arrays([terms, pa.array(counts.values(), pa.int64())], names=["term", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for _, _, data, offsets in slices(batch, "text"):
                plain = _LOWER[data]
                start, end, border = words(plain, offsets)
                key = Prefix(plain).of(start, end)
                hit = np.flatnonzero(bits[(key >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
                text = np.searchsorted(border, hit, "right") - 1
                order = np.lexsort((text, key[hit]))
                hit, text, value = hit[order], text[order], key[hit][order]
                if not len(hit):
                    continue
                new = np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]))
                hit, value = hit[new], value[new]
                begin = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                for i, n in zip(hit[begin], np.diff(np.append(begin, len(hit))).tolist()):
                    term = plain[start[i] : end[i]].tobytes()
                    counts[term] = counts.get(term, 0) + n
            if len(counts) > HELD_TERMS:
                yield told(counts)
                counts = {}
        if counts:
            yield told(counts)

    return run


def _bit_map(terms: DataFrame) -> np.ndarray:
    """The places of a column of terms in a map of 2**MAP_BITS."""
    packed = terms.mapInArrow(_place, "place bigint").groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set")
    ).collect()  # at most 2**(MAP_BITS - 6) rows
    map_ = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for row in packed:
        map_[row["at"]] = np.uint64(row["set"] & 0xFFFFFFFFFFFFFFFF)
    return np.unpackbits(map_.view(np.uint8), bitorder="little").astype(bool)


def disclosing(found: DataFrame, docs: DataFrame, n_docs: int, support: int = SUPPORT, share: float = DISCLOSURE) -> DataFrame:
    """(entity, term, told): terms that tell at least ``share`` of the entity's information."""
    entities = checkpointed(
        found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
        .filter(F.col("n_entity") >= support)
    )
    pairs = checkpointed(
        found.select("entities", "held").mapInArrow(_pairs(_bit_map(entities.select("entity"))), "entity string, term string, docs bigint")
        .groupBy("entity", "term").agg(F.sum("docs").alias("n_both")).filter(F.col("n_both") >= support)
    )
    bits = _bit_map(pairs.select("term").distinct())
    counted = docs.select("text").mapInArrow(_count(bits), "term string, docs bigint").groupBy("term").agg(F.sum("docs").alias("n_term"))
    told = F.log2(F.col("n_both") * float(n_docs) / (F.col("n_term") * F.col("n_entity")))
    whole = F.log2(float(n_docs) / F.col("n_entity"))
    return (
        pairs.join(counted, "term").join(entities, "entity")
        .withColumn("told", told).filter((whole > 0) & (F.col("told") >= share * whole)).select("entity", "term", "told")
    )


def sanitised(docs: DataFrame, keep_text: bool = False, support: int = SUPPORT, share: float = DISCLOSURE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, spans (kind, first, last), and ``text`` if asked for.

    spans: in characters, by kind as in KINDS, then ``term``, then start; term spans do not overlap
    values.  ``text``: values become their kind in brackets; terms with digits become ``[number]``, the
    more general, and all others are left out.

    Null text is empty.  Copies of a document count as documents.  Rows with equal doc_id are
    separate.  An empty table stays empty.
    """
    names = ["doc_id", "text"] if keep_text else ["doc_id"]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes)
    found = checkpointed(docs.select("text").mapInArrow(_entities, "entities array<string>, held string"))
    n_docs = found.count()
    terms = checkpointed(disclosing(found.filter("held is not null"), docs, n_docs, support, share).select("term").distinct())
    found = docs.select("doc_id", "text").mapInArrow(_find(names, _bit_map(terms)), f"{schema}, {SPANS}, {NEAR}")
    found = checkpointed(found.withColumn("row", F.monotonically_increasing_id()))
    hits = (
        found.select("row", F.explode("near").alias("n")).select("row", "n.*").join(terms, "term")
        .groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.lit("term").alias("kind"), "first", "last"))).alias("terms"))
    )
    joined = found.join(hits, "row", "left")
    spans = F.concat("spans", F.coalesce("terms", F.expr("cast(array() as array<struct<kind:string,first:int,last:int>>)")))
    out = joined.select(*names, spans.alias("spans"))
    return out.mapInArrow(_masked(), f"{schema}, {SPANS}") if keep_text else out


def _masked():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, out, at = text or "", [], 0
                for span in sorted(spans, key=lambda s: (s["first"], -s["last"])):
                    a, b = span["first"], span["last"]
                    if a < at:
                        if b <= at:
                            continue
                        a = at
                    word = text[a:b]
                    general = f"[{span['kind']}]" if span["kind"] != "term" else "[number]" if any(c.isdigit() for c in word) else ""
                    out += [text[at:a], general]
                    at = b
                texts.append("".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], names=batch.schema.names)

    return run


def op5_pii(spark, folder: str) -> DataFrame:
    """Numbers of values by kind, their digest, and all spans, for every document."""
    found = sanitised(documents(spark, folder).select("doc_id", "text"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s["first"], s["last"])), ",")

    def of_kind(kind: str):
        return F.filter("spans", lambda s: s.kind == kind)

    return found.select(
        "doc_id", *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(told(F.filter("spans", lambda s: s.kind != "term")), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
