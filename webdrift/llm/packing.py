"""Best-fit packing of tokenized documents into sequences, by exact-complement hashing of lengths.

A document is its token ids (``add_special_tokens=False``) followed by id 0.  Only documents
longer than the capacity are cut: the first piece holds the remainder (it may be shorter), every
further piece is full.  Pieces are packed into as few sequences of at most ``capacity`` ids as the
method finds; a piece is never cut again.

Plan.  Spark tokenizes each row once in Arrow batches (a worker gives the library each word once,
as far as it can keep their ids, and many of them in one call), writes the pieces to the shared checkpoint folder and counts
pieces per length: at most ``capacity`` rows, whatever the size of the corpus.
The packing itself is decided on these counts alone:

1. full pieces are sequences of their own;
2. the longest length l still available asks for its exact complement ``capacity - l``: direct
   tables of the lengths available (singles), of their pair sums and, through them, of triple
   sums give a combination of other pieces that fills the gap exactly, largest pieces first; as
   many sequences of that pattern are made as the counts allow at once;
3. what has no exact complement is placed by best fit decreasing, again on counts: a length goes
   into the open sequences with the smallest gap that holds it, and new ones open only when none
   does.

The result is a list of sequence patterns with multiplicities; its size depends on the number of
distinct lengths, not on the number of pieces, and is checked before it is broadcast.  Pieces
are numbered within their length (salted sub-ranges plus offsets, so that no length is one task),
and a range join with the plan gives each piece its sequence and offset.

Edge cases: a null text is empty and gives the single piece ``[0]``; null doc_ids and repeated
rows are pieces of their own; very long texts are tokenized whole.  Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webdrift.llm.common import checkpointed, documents

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
CHUNK_CHARS = 1 << 23  # characters of text cut into parts at once
WORDS_KEPT = 1 << 20  # parts of texts whose ids a worker keeps, some 200 MB
WORD_CHARS = 64  # parts of more bytes are not kept
CALL_CHARS = 1 << 18  # characters given to the library at once; its results are far larger than their ids
JOINED = 1 << 10  # parts given to the library as lines of one text
LINE = re.compile(r" ?[!-~\w]+")

# kinds of bytes, and between which of them the byte-level pattern always begins a piece
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SPACE, BLANK, LETTER_LEAD, SPACE_LEAD = range(9)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A], KIND[0x27], KIND[0x20], KIND[[0x09, 0x0A, 0x0D]] = DIGIT, APOSTROPHE, BLANK, SPACE
KIND[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = LETTER_LEAD  # U+00C0 to U+027F but two signs, U+0400 to U+047F
KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = SPACE_LEAD  # may begin a space
SPACES = [0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]  # first two bytes of all of them
START = np.zeros(256, dtype=bool)  # bytes that begin a character that is no space
START[0x21:0x7F] = START[0xC3:0xE1] = START[0xE4:0xEF] = START[0xF0:0xF5] = True
PAIRS = np.zeros(256, dtype=bool)
for _left, _right in ((LETTER, (DIGIT, MARK, APOSTROPHE, SPACE, BLANK)), (DIGIT, (LETTER, MARK, APOSTROPHE, SPACE, BLANK)),
                      (MARK, (LETTER, DIGIT, SPACE, BLANK)), (APOSTROPHE, (SPACE, BLANK))):
    PAIRS[[_left << 4 | k for k in _right]] = True
RANK_ROWS = 1024  # pieces of one length numbered in one window group, about
PLAN_LIMIT = 1 << 20  # rows of the plan that may be broadcast; above it the plan is joined by a shuffle

PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"

_tokenizers: dict = {}
_words: dict = {}  # tokenizer name -> (its rules, ids of parts met), one per worker process


def tokenizer(name: str = TOKENIZER):
    """The library's tokenizer for ``name`` under ``public_tokenizers``, one per worker process."""
    if name not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread per task: Spark deals the cores
        import public_tokenizers
        from tokenizers import Tokenizer

        _tokenizers[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _tokenizers[name]


def spans(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the remainder first, then full pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


def cut(ids, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of one document's ids (ids already end in 0)."""
    return spans(len(ids), capacity)


def crc(ids) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


class Rules(NamedTuple):
    """What a tokenizer allows _ids to do."""

    added: tuple[str, ...]  # texts with one of these added tokens are encoded whole
    newline: int  # the id of a line end


def _word_by_word(encode) -> Rules | None:
    """The rules for a tokenizer that cuts texts by the byte-level pattern before anything else; None for others."""
    told = json.loads(encode.to_str())
    first = told["pre_tokenizer"] or {}
    if (first.get("type") != "ByteLevel" or first.get("add_prefix_space", True) or not first.get("use_regex", True)
            or told["normalizer"] or told["truncation"] or told["padding"] or told["model"].get("dropout")):
        return None
    added, newline = tuple(t["content"] for t in told["added_tokens"]), encode.encode("\n", add_special_tokens=False).ids
    return None if len(newline) != 1 or any("\n" in a for a in added) else Rules(added, newline[0])


def _each(texts: list[str], encode) -> list[bytes]:
    """The library's ids of each text, little-endian unsigned 32-bit."""
    out, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CALL_CHARS):
            size += len(texts[end])
            end += 1
        for e in encode.encode_batch_fast(texts[start:end], add_special_tokens=False):  # the same ids as encode_batch, without offsets
            ids = e.ids
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        start = end
    return out


def _encoded(parts: list[bytes], encode, rules: Rules) -> list[bytes]:
    """The library's ids of each part.

    Short parts without a space but one blank in front go to it as lines of one text, as a call for
    each costs more than its ids: a line end between them is a piece and an id of its own, which
    no other piece holds.
    """
    out: list = [None] * len(parts)
    lines, alone = [], []
    for i, t in enumerate(texts := [p.decode() for p in parts]):
        (lines if len(t) <= WORD_CHARS and LINE.fullmatch(t) and not any(a in t for a in rules.added) else alone).append(i)
    for s in range(0, len(lines), JOINED):
        at = lines[s:s + JOINED]
        (e,) = encode.encode_batch_fast(["\n".join(map(texts.__getitem__, at))], add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u4")
        ends = [*(np.flatnonzero(ids == rules.newline) * 4).tolist(), len(ids) * 4]
        data, begin = ids.tobytes(), 0
        for i, end in zip(at, ends, strict=True):
            out[i] = data[begin:end]
            begin = end + 4
    for i, ids in zip(alone, _each([texts[i] for i in alone], encode), strict=True):
        out[i] = ids
    return out


def _rows(values: pa.Array) -> list[bytes]:
    """The values of a large_binary array without nulls and offset; to_pylist takes ten times as long."""
    data = values.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in pairwise(np.frombuffer(values.buffers()[1], dtype=np.int64, count=len(values) + 1).tolist())]


def _cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 texts that begin at ``begins``, whether a text may be cut before it; see _ids."""
    kind, start = KIND[data], START[data]
    lead = np.flatnonzero(kind == LETTER_LEAD)
    if len(lead):
        sign = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))  # the signs for times and divided
        kind[lead[sign]] = OTHER
        kind[lead[~sign]] = kind[lead[~sign] + 1] = LETTER
    lead = np.flatnonzero(kind == SPACE_LEAD)
    if len(lead):
        start[lead] = ~np.isin(data[lead].astype(np.int32) << 8 | data[lead + 1], SPACES)
    start[begins] = False  # what follows a text's end is no character of it
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = PAIRS[kind[:-1] << 4 | kind[1:]]
    cut[1:] |= (kind[:-1] == SPACE) & start[1:]
    cut[:-1] |= ((kind[:-1] == SPACE) | (kind[:-1] == BLANK)) & start[1:]
    cut[begins] = True
    return cut


def _ids(texts: list[str], encode, rules: Rules | None, words: dict[bytes, bytes]) -> list[bytes]:
    """The library's ids of whole texts, each part of a text given to it once.

    Texts are cut only where the byte-level pattern begins a new piece in any case and where what
    lies before the cut ends in the pieces it has in the text; no piece looks behind, so the ids
    of a text are those of its parts.  Such places are (a) the ends of runs of letters and of
    digits, and of runs of marks, but for an apostrophe before a letter ('s, 't); (b) the end of
    such a run before a space; (c) in a run of spaces before a character that is none, the place
    before the last space, which the pattern leaves out of the run, and the place after it unless
    it is a blank, which the next piece takes.  Characters of which the bytes do not tell at
    once whether they are letters, marks or spaces get no cut, which leaves longer parts only.
    ``words`` keeps the ids of parts; texts with an added token are one part.
    """
    if rules is None:
        return _each(texts, encode)
    rows = [t.encode() for t in texts]
    data = b"".join(rows)
    if not data:
        return rows
    ends = np.cumsum([0, *map(len, rows)])
    cut = _cuts(np.frombuffer(data, dtype=np.uint8), ends[ends < len(data)])
    for i, t in enumerate(texts):
        if any(a in t for a in rules.added):
            cut[ends[i] + 1:ends[i + 1]] = False
    bounds = np.append(np.flatnonzero(cut), len(data))
    parts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    met = _rows(parts.dictionary)
    found = [*map(words.get, met)]
    new = [i for i, ids in enumerate(found) if ids is None]
    for i, ids in zip(new, _encoded([met[i] for i in new], encode, rules), strict=True):
        found[i] = ids
    kept = new
    if len(words) + len(new) > WORDS_KEPT:  # begin again with what these texts hold
        words.clear()
        kept = range(len(met))
    words.update((met[i], found[i]) for i in kept if len(met[i]) <= WORD_CHARS)
    laid = pa.array(found, pa.large_binary()).take(parts.indices)  # the ids of all parts, one after the other
    begins = np.frombuffer(laid.buffers()[1], dtype=np.int64)[np.searchsorted(bounds, ends)].tolist()
    flat = laid.buffers()[2].to_pybytes()
    return [flat[a:b] for a, b in pairwise(begins)]


def _pieces(batches, capacity: int, name: str):
    """Arrow batches of documents -> batches of pieces; texts are cut in chunks of about CHUNK_CHARS
    characters and their parts encoded in calls of about CALL_CHARS (longer ones alone); only ids are kept."""
    encode = tokenizer(name)
    if name not in _words:
        _words[name] = _word_by_word(encode), {}
    rules, words = _words[name]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or "") <= CHUNK_CHARS):
                size += len(texts[end] or "")
                end += 1
            at, piece, begin, length, crcs = [], [], [], [], []
            for j, ids in enumerate(_ids([t or "" for t in texts[start:end]], encode, rules, words), start):
                ids += bytes(4)
                for k, (s, n) in enumerate(spans(len(ids) // 4, capacity)):
                    at.append(j)
                    piece.append(k)
                    begin.append(s)
                    length.append(n)
                    crcs.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(taken), batch.column("doc_id").take(taken), pa.array(piece, pa.int32()),
                 pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())],
                names=["row_key", "doc_id", "piece", "start", "length", "ids_crc32"])
            start = end


def tokenized(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """One row per piece: row_key, doc_id, piece, start, length, ids_crc32; written once and read again."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row_key"))
    return checkpointed(rows.mapInArrow(lambda b: _pieces(b, capacity, name), PIECES))


# ---- the plan, on counts of lengths only -------------------------------------------------------


def _pair(gap: int, avail: np.ndarray) -> tuple[int, int] | None:
    """Two available lengths summing to ``gap``, the larger one as large as possible."""
    if gap < 2:
        return None
    a = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
    b = gap - a
    ok = (avail[a] > 0) & (avail[b] > 0) & ((a != b) | (avail[a] >= 2))
    hit = np.flatnonzero(ok)
    return (int(a[hit[0]]), int(b[hit[0]])) if len(hit) else None


def _exact(gap: int, avail: np.ndarray) -> tuple[int, ...] | None:
    """Lengths, one to three, that fill ``gap`` exactly under the counts ``avail``."""
    if gap <= 0:
        return ()
    if gap < len(avail) and avail[gap] > 0:
        return (gap,)
    found = _pair(gap, avail)
    if found:
        return found
    if gap < 3:
        return None
    # pair sums of the lengths present, as a direct table; a triple is one length plus one pair sum
    present = (avail > 0).astype(np.float64)
    size = 1 << int(2 * len(avail)).bit_length()
    sums = np.rint(np.fft.irfft(np.fft.rfft(present, size) ** 2, size)[: 2 * len(avail)]).astype(np.int64)
    lengths = np.arange(min(gap - 2, len(avail) - 1), 0, -1)
    rest = gap - lengths
    lengths = lengths[(avail[lengths] > 0) & (rest >= 2) & (rest < len(sums))]
    for a in lengths[sums[gap - lengths] > 0]:
        avail[a] -= 1
        found = _pair(int(gap - a), avail)
        avail[a] += 1
        if found:
            return (int(a), *found)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequence patterns (lengths, longest first) and how many sequences take each, from counts of lengths."""
    avail = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        avail[int(length)] += int(count)
    groups: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = min(int(avail[x]) // c for x, c in need.items())
        for x, c in need.items():
            avail[x] -= c * times
        groups.append((tuple(sorted(pattern, reverse=True)), times))

    if avail[capacity]:
        take((capacity,))
    for length in range(capacity - 1, 0, -1):  # exact complements, longest first
        while avail[length] > 0:
            avail[length] -= 1
            found = _exact(capacity - length, avail)
            avail[length] += 1
            if found is None:
                break
            take((length, *found))

    # best fit decreasing on counts for the rest: open sequences by gap
    patterns: list[list] = []  # [pattern, times]
    by_gap: dict[int, list[int]] = defaultdict(list)

    def open_(pattern: tuple[int, ...], times: int) -> None:
        if times > 0 and pattern:
            patterns.append([pattern, times])
            by_gap[capacity - sum(pattern)].append(len(patterns) - 1)

    for length in range(capacity - 1, 0, -1):
        left = int(avail[length])
        while left > 0:
            gap = next((g for g in range(length, capacity) if by_gap.get(g)), None)
            if gap is None:  # a new sequence takes as many as fit, then the next
                each = capacity // length
                open_((length,) * each, left // each)
                open_((length,) * (left % each), 1)
                left = 0
                continue
            index = by_gap[gap].pop()
            pattern, times = patterns[index]
            each = gap // length
            full = min(times, left // each)
            open_(pattern + (length,) * each, full)
            left -= full * each
            rest = times - full
            if left > 0 and rest > 0:
                open_(pattern + (length,) * left, 1)
                left, rest = 0, rest - 1
            if rest > 0:
                patterns[index][1] = rest
                by_gap[gap].append(index)
            else:
                patterns[index][1] = 0
        avail[length] = 0
    groups += [(tuple(sorted(p, reverse=True)), t) for p, t in patterns if t > 0]
    return [(p, t) for p, t in groups if t > 0 and p]


def plan_rows(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, seq_base, copies, offset): pieces first..last-1 of a length fill ``copies`` places per sequence."""
    rows, seq, taken = [], 0, Counter()
    for pattern, times in groups:
        place = 0
        for length, copies in sorted(Counter(pattern).items(), reverse=True):
            first = taken[length]
            taken[length] += copies * times
            rows.append((length, first, taken[length], seq, copies, place))
            place += copies * length
        seq += times
    return rows


# ---- Spark --------------------------------------------------------------------------------------


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, row_key."""
    spark = docs.sparkSession
    pieces = tokenized(docs, capacity, name)
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_rows(plan(counts, capacity))
    schema = "length long, first long, last long, seq_base long, copies long, place long"
    if not rows:
        return spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, row_key long")
    plan_df = spark.createDataFrame(rows, schema)

    # number the pieces of each length 0.. in (doc_id, piece, crc, row) order: salted groups plus offsets
    salts = F.create_map(*[x for length, n in counts.items() for x in (F.lit(length), F.lit(max(1, -(-n // RANK_ROWS))))])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row_key", "piece"), F.element_at(salts, F.col("length"))))
    within = Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32", "row_key")
    numbered = salted.withColumn("r", F.row_number().over(within) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("base", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    indexed = numbered.join(offsets.select("length", "salt", "base"), ["length", "salt"]).withColumn("k", F.col("base") + F.col("r"))

    joined_plan = F.broadcast(plan_df) if len(rows) <= PLAN_LIMIT else plan_df
    placed = indexed.join(
        joined_plan, (indexed["length"] == plan_df["length"]) & (indexed["k"] >= plan_df["first"]) & (indexed["k"] < plan_df["last"])
    )
    at = F.col("k") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", indexed["length"], "ids_crc32",
        (F.col("seq_base") + F.expr("(k - first) div copies")).alias("sequence_id"),
        (F.col("place") + (at % F.col("copies")) * indexed["length"]).alias("offset"),
        "row_key",
    )


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids of the byte-level BPE vocabulary."""
    return pack(documents(spark, folder)).drop("row_key")
