"""Removing passages that occur in an earlier document, found by suffix sorting.

A passage counts from ``LENGTH`` bytes on.  All windows of that length are to be compared with all
others, so windows are dealt to tasks by their smallest ``GRAM``-byte hash: equal windows have the
same one, and neighbouring windows mostly share it, so what is sent is runs of windows (about 16
windows in 65 bytes), not windows.

1. Of each run only its hash goes out first.  A run whose hash occurs in no other text is done.
2. The other runs go, with their bytes, to the task of their hash.  Equal runs are merged, before
   they are sent and after.  Different ones are suffix-sorted in two stages: only suffixes smaller
   than their successors are sorted, the others are induced from these in one scan of the buckets of
   first bytes.  Neighbours whose common prefix has ``LENGTH`` bytes or more are equal windows.
3. A window is removed from a text if a text with a smaller doc_id has it.

Documents with equal texts are one text, of the smallest doc_id; of the others all is removed.
Texts are dealt to groups of about ``GROUP_BYTES`` by doc_id, and groups are what tasks work on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift.llm.bytewise import Prefix, slices
from webdrift.llm.common import checkpointed, documents

LENGTH = 50
GRAM = 20
GROUP_BYTES = 8 << 20
SORT_BYTES = 1 << 20
MARK = np.uint32(0xFFFFFFFF)  # instead of an owner: several texts of the group have the hash
LAST = np.iinfo(np.int64).max  # for documents without doc_id


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, text, first, end): runs of windows with equal smallest hash; first..end-1 are their starts."""
    n, width = len(data) - length + 1, length - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    at = np.arange(len(data) - gram + 1)
    least = Prefix(data).of(at, at + gram)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    whole = np.zeros(n + 1, np.int32)
    begin, stop = offsets[:-1], offsets[1:] - length + 1
    some = stop > begin
    np.add.at(whole, begin[some], 1)
    np.add.at(whole, stop[some], -1)
    valid = np.cumsum(whole[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    new[begin[some]] = True
    new |= ~valid
    first = np.flatnonzero(new)
    end = np.append(first[1:], n)
    keep = valid[first]
    first, end = first[keep], end[keep]
    return least[first], np.searchsorted(offsets, first, "right") - 1, first, end


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (0 ends a piece, bytes are 1 to 256) in the order of their first ``depth`` bytes.

    Two stages: suffixes smaller than their successors are sorted, the rest is induced.
    Suffixes that start with 0 are left out.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(n, bool)
    run = np.searchsorted(change, np.arange(n - 1))
    inner = run < len(change)
    where = change[np.minimum(run, len(change) - 1)] if len(change) else np.zeros(n - 1, np.int64)
    smaller[:-1] = inner & (text[where] < text[np.minimum(where + 1, n - 1)])
    smaller[text == 0] = False

    padded = np.zeros(n + depth + 8, np.uint8)
    padded[:n] = np.where(text > 0, text - 1, 0)
    eight = np.ndarray(n + depth, ">u8", padded, strides=(1,))
    direct = np.flatnonzero(smaller)
    order = direct[np.argsort(text[direct], kind="stable")]
    group = text[order].astype(np.int64) << 32
    # most significant bytes first; suffixes already alone in their group move no more
    active = np.arange(len(order))
    for at in range(0, depth, 8):
        if not len(active):
            break
        word = eight[order[active] + at].astype(np.uint64)
        inner = np.lexsort((word, group[active]))
        order[active] = order[active][inner]
        word, base = word[inner], group[active]
        new = np.ones(len(active), bool)
        new[1:] = (base[1:] != base[:-1]) | (word[1:] != word[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(active)))
        group[active] = np.repeat(active[begin], size)
        active = active[np.repeat(size, size) > 1]
    sorted_by_byte = np.searchsorted(text[order], np.arange(258))

    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    result = []

    def induce(entries: np.ndarray, byte: int) -> np.ndarray:
        """Hands the predecessors of sorted entries to their buckets; returns those in this bucket."""
        before = entries[entries > 0] - 1
        first = text[before]
        up = first > byte
        if up.any():
            moved = before[up]
            moved = moved[np.argsort(text[moved], kind="stable")]
            values, begin = np.unique(text[moved], return_index=True)
            for value, part in zip(values, np.split(moved, begin[1:])):
                pending[value].append(part)
        return before[(first == byte) & ~smaller[before]]

    induce(np.flatnonzero(text == 0), 0)
    for byte in range(1, 257):
        wave = np.concatenate(pending[byte]) if pending[byte] else np.zeros(0, np.int64)
        pending[byte] = []
        while len(wave):
            result.append(wave)
            wave = induce(wave, byte)
        own = order[sorted_by_byte[byte] : sorted_by_byte[byte + 1]]
        if len(own):
            result.append(own)
            induce(own, byte)
    return np.concatenate(result) if result else np.zeros(0, np.int64)


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, end to end."""
    total = np.cumsum(size)
    return data[np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)]


def earlier_windows(data: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of bytes end to end, each of a doc -> (piece, start) of windows that a smaller doc's piece has."""
    offset = np.cumsum(size) - size
    text = np.zeros(len(data) + len(size), np.int16)
    place = np.arange(len(data)) + np.repeat(np.arange(len(size)), size)
    text[place] = data.astype(np.int16) + 1
    piece = np.repeat(np.arange(len(size)), size + 1)
    start = offset + np.arange(len(size))
    left = (start + size)[piece] - np.arange(len(text))
    array = suffix_array(text, length)
    array = array[left[array] >= length]
    if not len(array):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = np.zeros(len(text) + 8, np.uint8)
    plain[place] = data
    eight = np.ndarray(len(text), ">u8", plain, strides=(1,))
    # common prefix with the neighbour before, as far as it matters
    same = np.ones(len(array) - 1, bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        word = eight[array + at]
        same &= word[1:] == word[:-1]
    new = np.append(True, ~same)
    owner = doc[piece[array]]
    least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
    found = array[least < owner]
    return piece[found], found - start[piece[found]]


def _packed(**columns: np.ndarray) -> dict[str, bytes]:
    return {name: np.ascontiguousarray(values).tobytes() for name, values in columns.items()}


def _unpacked(table: pa.Table, column: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", dtype) for x in table.column(column).to_pylist()]


def _texts(docs: pa.Table, side: pa.Table):
    """The texts of a group, once each: (rows in key order, keys, doc numbers).  side has (text_key, first_id)."""
    if not docs.num_rows or not side.num_rows:  # a side without rows has no columns either
        return [], [], np.zeros(0, np.int64)
    first = {k: LAST if d is None else d for k, d in zip(side.column("text_key").to_pylist(), side.column("first_id").to_pylist()) if k is not None}
    rows: dict[bytes, int] = {}
    for row, (key, doc) in enumerate(zip(docs.column("key").to_pylist(), docs.column("doc_id").to_pylist())):
        if first.get(key) == (LAST if doc is None else doc):
            rows.setdefault(key, row)
    keys = sorted(rows)
    return [rows[k] for k in keys], keys, np.array([first[k] for k in keys], np.int64)


def _all_runs(docs: pa.Table, rows: list[int], with_bytes: bool):
    """Per slice of the texts: (hash, owner, first in text, size in bytes, bytes, first in bytes, piece hash)."""
    if not rows:
        return
    texts = docs.select(["text"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
    for low, _, data, offsets in slices(texts, "text"):
        value, text, first, end = window_runs(data, offsets)
        size = end - first + LENGTH - 1
        piece = Prefix(data).of(first, first + size) if with_bytes else None
        yield value, (text + low).astype(np.uint32), (first - offsets[text]).astype(np.uint32), size, data, first, piece


SEEN = "part int, g int, value binary, owner binary, first binary"
PIECES = "part int, g int, value binary, owner binary, first binary, doc binary, size binary, bytes binary"
SPANS = "g int, owner binary, first binary, size binary"


def _table(rows: list[dict], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    return pa.Table.from_pylist(rows, pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))]))


def _local(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which runs share their hash with another text of the group."""
    order = np.lexsort((owner, value))
    v, o = value[order], owner[order]
    new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    if not len(begin):
        return np.zeros(0, bool)
    size = np.diff(np.append(begin, len(v)))
    several = o[begin] != o[begin + size - 1]
    shared = np.zeros(len(v), bool)
    shared[order] = np.repeat(several, size)
    return shared


def _by_part(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)):
        yield int(p), order[edge[p] : edge[p + 1]]


def _send_hashes(parts: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        rows, _, _ = _texts(docs, side)
        found = [(v, o, f) for v, o, f, *_ in _all_runs(docs, rows, False)]
        if not found:
            return _table([], SEEN)
        value, owner, first = (np.concatenate(x) for x in zip(*found))
        shared = _local(value, owner)
        several = np.unique(value[shared])
        value = np.concatenate([value[~shared], several])
        owner = np.concatenate([owner[~shared], np.full(len(several), MARK)])
        first = np.concatenate([first[~shared], np.zeros(len(several), np.uint32)])
        g = docs.column("g")[0].as_py()
        return _table([
            {"part": p, "g": g, **_packed(value=value[i], owner=owner[i], first=first[i])}
            for p, i in _by_part((value % np.uint64(parts)).astype(np.int64), parts)
        ], SEEN)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Which of the runs sent have a hash that another text has too."""
    value, owner, first = _unpacked(table, "value", np.uint64), _unpacked(table, "owner", np.uint32), _unpacked(table, "first", np.uint32)
    group = np.repeat(table.column("g").to_numpy(), [len(x) for x in value]).astype(np.int64)
    value, owner, first = np.concatenate(value), np.concatenate(owner), np.concatenate(first)
    who = (group << 32) | owner.astype(np.int64)
    order = np.lexsort((who, value))
    v, w = value[order], who[order]
    begin = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    size = np.diff(np.append(begin, len(v)))
    several = (w[begin] != w[begin + size - 1])
    several |= np.logical_or.reduceat(owner[order] == MARK, begin)
    hit = order[np.repeat(several, size)]
    hit = hit[owner[hit] != MARK]
    groups, code = np.unique(group[hit], return_inverse=True)
    return _table([
        {"g": int(groups[p]), **_packed(owner=owner[hit[i]], first=first[hit[i]]), "size": b""}
        for p, i in _by_part(code, len(groups))
    ], SPANS)


def _send_pieces(parts: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        rows, _, doc_of = _texts(docs, side)
        if not rows:
            return _table([], PIECES)
        asked = np.unique(np.concatenate([
            (o.astype(np.int64) << 32) | f for o, f in zip(_unpacked(side, "owner", np.uint32), _unpacked(side, "first", np.uint32))
        ] or [np.zeros(0, np.int64)]))
        # hashes that several texts of this group have need no answer
        runs = [(v, o) for v, o, *_ in _all_runs(docs, rows, False)]
        value, owner = (np.concatenate(x) for x in zip(*runs))
        shared = _local(value, owner)
        found, low = [], 0
        for value, owner, first, size, data, at, piece in _all_runs(docs, rows, True):
            high = low + len(value)
            hit = np.flatnonzero(shared[low:high] | np.isin((owner.astype(np.int64) << 32) | first, asked))
            found.append((value[hit], owner[hit], first[hit], size[hit], piece[hit], gathered(data, at[hit], size[hit])))
            low = high
        value, owner, first, size, piece, data = (np.concatenate(x) for x in zip(*found))
        if not len(value):
            return _table([], PIECES)
        doc, at = doc_of[owner], np.cumsum(size) - size
        order = np.lexsort((doc, piece))
        new = np.append(True, piece[order][1:] != piece[order][:-1])
        least = doc[order][new][np.cumsum(new) - 1]
        sent = np.ones(len(value), bool)
        sent[order] = doc[order] == least  # equal pieces: that of the smallest doc_id stands for all
        g = docs.column("g")[0].as_py()
        out = []
        keep, rest = np.flatnonzero(sent), np.flatnonzero(~sent)
        for p, i in _by_part((value[keep] % np.uint64(parts)).astype(np.int64), parts):
            i = keep[i]
            out.append({"part": p, "g": g, **_packed(
                value=value[i], owner=owner[i], first=first[i], doc=doc[i], size=size[i].astype(np.uint32),
                bytes=gathered(data, at[i], size[i]))})
        if len(rest):  # all of these is removed; nothing is left to ask
            out.append({"part": g % parts, "g": g, "value": b"", "doc": b"", "bytes": b"", **_packed(
                owner=owner[rest], first=first[rest], size=size[rest].astype(np.uint32))})
        return _table(out, PIECES)

    return run


def _piece_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, low = np.empty(len(size), np.uint64), 0
    end = at + size
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(end, at[low] + SORT_BYTES, "right")))
        base = at[low]
        prefix = Prefix(data[base : end[high - 1]])
        out[low:high] = prefix.of(at[low:high] - base, end[low:high] - base)
        low = high
    return out


def _sort_pieces(table: pa.Table) -> pa.Table:
    """Pieces of one part -> the stretches of texts that a text with a smaller doc_id has too."""
    raw = {c: _unpacked(table, c, t) for c, t in (
        ("value", np.uint64), ("owner", np.uint32), ("first", np.uint32), ("doc", np.int64), ("size", np.uint32), ("bytes", np.uint8))}
    groups = table.column("g").to_numpy()
    told = [i for i in range(table.num_rows) if not len(raw["value"][i])]
    asked = [i for i in range(table.num_rows) if len(raw["value"][i])]
    out = [(np.full(len(raw["owner"][i]), groups[i], np.int64), raw["owner"][i], raw["first"][i], raw["size"][i].astype(np.int64)) for i in told]
    if asked:
        group = np.repeat(groups[asked], [len(raw["value"][i]) for i in asked]).astype(np.int64)
        value, owner, first, doc, size, data = (np.concatenate([raw[c][i] for i in asked]) for c in raw)
        size = size.astype(np.int64)
        at = np.cumsum(size) - size
        piece = _piece_hashes(data, at, size)
        order = np.lexsort((doc, piece, value))
        new = np.append(True, (value[order][1:] != value[order][:-1]) | (piece[order][1:] != piece[order][:-1]))
        kind = np.cumsum(new) - 1
        lead = order[new]  # of equal pieces, the one with the smallest doc_id
        least = doc[lead][kind]
        whole = order[doc[order] > least]
        out.append((group[whole], owner[whole], first[whole], size[whole]))
        # different pieces with one hash are compared; batches of whole hashes
        hashes = value[lead]
        begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        count = np.diff(np.append(begin, len(lead)))
        many = np.repeat(count, count) > 1
        pick = np.flatnonzero(many)
        if len(pick):
            edge = np.flatnonzero(np.append(True, hashes[pick][1:] != hashes[pick][:-1]))
            total = np.append(0, np.cumsum(size[lead[pick]]))
            edge = np.append(edge, len(pick))
            firsts = [order[(doc[order] == least)], kind[doc[order] == least]]
            low = 0
            while low < len(edge) - 1:
                high = max(low + 1, int(np.searchsorted(total[edge], total[edge[low]] + SORT_BYTES, "right")) - 1)
                some = pick[edge[low] : edge[high]]
                ids = lead[some]
                p, s = earlier_windows(gathered(data, at[ids], size[ids]), size[ids], doc[ids])
                if len(p):
                    sort = np.lexsort((s, p))
                    p, s = p[sort], s[sort]
                    opens = np.append(True, (p[1:] != p[:-1]) | (s[1:] > s[:-1] + LENGTH))
                    closes = np.append(np.flatnonzero(opens)[1:], len(p)) - 1
                    p, s, e = p[opens], s[opens], s[closes] + LENGTH
                    # all texts of the smallest doc_id that have the piece
                    left = np.searchsorted(firsts[1], some[p], "left")
                    times = np.searchsorted(firsts[1], some[p], "right") - left
                    who = firsts[0][np.repeat(left - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                    out.append((group[who], owner[who], (first[who] + np.repeat(s, times)).astype(np.uint32), np.repeat(e - s, times)))
                low = high
    if not out:
        return _table([], SPANS)
    group, owner, first, size = (np.concatenate(x) for x in zip(*out))
    groups, code = np.unique(group, return_inverse=True)
    return _table([
        {"g": int(groups[p]), **_packed(owner=owner[i], first=first[i], size=size[i].astype(np.uint32))}
        for p, i in _by_part(code, len(groups))
    ], SPANS)


KEPT = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        rows, keys, _ = _texts(docs, side)
        if not rows:
            return _table([], KEPT)
        spans = [np.concatenate([np.zeros(0, np.int64), *[x.astype(np.int64) for x in _unpacked(side, c, np.uint32)]]) for c in ("owner", "first", "size")]
        order = np.lexsort((spans[1], spans[0]))
        owner, begin, size = (x[order] for x in spans)
        edge = np.searchsorted(owner, np.arange(len(keys) + 1))
        texts = docs.column("text")
        out = []
        for i, (row, key) in enumerate(zip(rows, keys)):
            text = np.frombuffer((texts[row].as_py() or "").encode(), np.uint8)
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, begin[edge[i] : edge[i + 1]], 1)
            np.add.at(cover, begin[edge[i] : edge[i + 1]] + size[edge[i] : edge[i + 1]], -1)
            removed = np.cumsum(cover[:-1]) > 0
            kept = text[~removed].tobytes()
            starts = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
            out.append({
                "key": key, "n_removed": int(removed.sum()), "n_spans": starts,
                "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None,
            })
        return _table(out, KEPT)

    return run


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Removed is each byte of a 50-byte string that a document with a smaller doc_id has too; strings
    do not span documents and are looked up in the texts as given.  ``kept``: the bytes that are left
    (a removed stretch may begin inside a character), null unless ``with_text``.

    Null text is empty.  Null doc_ids come after all others.  Rows with equal doc_id do not count as
    earlier for each other.  Texts under 50 bytes stay as they are.  An empty table stays empty.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    sizes = keyed.select("doc_id", "key", F.octet_length("text").alias("n"))
    firsts = sizes.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"))
    firsts = checkpointed(firsts)
    parts = max(1, -(-(firsts.agg(F.sum("n")).first()[0] or 0) // GROUP_BYTES))

    def group(doc_id: str):
        return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int").alias("g")

    grouped_docs = keyed.select(group("doc_id"), "doc_id", "key", "text")
    base = firsts.select(group("first_id"), F.col("key").alias("text_key"), "first_id", *[F.lit(None).cast("binary").alias(c) for c in ("owner", "first", "size")])

    def with_side(extra: DataFrame | None):
        side = base
        if extra is not None:
            side = base.unionByName(extra, allowMissingColumns=True)
        return grouped_docs.groupBy("g").cogroup(side.groupBy("g"))

    answers = with_side(None).applyInArrow(_send_hashes(parts), SEEN).groupBy("part").applyInArrow(_answer, SPANS)
    pieces = with_side(answers).applyInArrow(_send_pieces(parts), PIECES)
    spans = pieces.groupBy("part").applyInArrow(_sort_pieces, SPANS)
    cut = with_side(spans).applyInArrow(_cut(with_text), KEPT)

    rest = docs.select(
        "doc_id", F.unhex(F.md5(text)).alias("key"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.when(F.octet_length(text) < LENGTH, F.sha2(text, 256)).alias("short_sha"),
        F.when(F.octet_length(text) < LENGTH, text.cast("binary")).alias("short"),
    )
    own = firsts.select("key", "first_id").join(cut, "key")
    again = ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    long = again & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    return rest.join(own, "key").select(
        "doc_id", "n_bytes",
        F.when(long, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(long, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(long, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(long & F.lit(with_text), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op9_suffix_dedup(spark, folder: str) -> DataFrame:
    """What is left of every document without the passages that earlier documents have."""
    return without_repeats(documents(spark, folder).select("doc_id", "text")).drop("kept")
