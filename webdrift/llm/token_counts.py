"""Token counts of a word-wise BPE tokenizer by finite-state transduction.

Text -> characters -> words is a deterministic transducer over classes of characters
(letter, number, sign, apostrophe, the letters of English contractions, white space).  It runs on
all characters of a slice at once: the slice is cut into chunks, each chunk is the map from the
state before it to the state behind it, maps compose by a parallel prefix scan, and with every
chunk's first state known a second pass yields the transitions.  The transition that closes a word
emits the word's number of tokens.

Those numbers come from the merge table.  An automaton for the merges themselves needs a state for
nearly every prefix of a word, so they are not compiled into it: the different words of a slice
are merged side by side, one merge per word and step, and counts are kept for the next slices.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webdrift.llm.bytewise import Prefix, mixed
from webdrift.llm.common import documents

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
LIMIT = 2048
SLICE_CHARS = 1 << 19
CHUNK = 128
LONG = 48  # bytes; longer words are merged one by one
KEPT_WORDS = 400_000  # counts a task keeps; when full it starts anew

# classes: white space, letter, number, sign, apostrophe, letters of contractions
SPACE, LETTER, NUMBER, SIGN, APOSTROPHE, SHORT, R, V, L, E = range(10)
# states: between words, in letters, in signs, behind a first apostrophe, behind 'r, 'v, 'l
OUT, LETTERS, SIGNS, AFTER, AFTER_R, AFTER_V, AFTER_L = range(7)
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], SIGN) for c in range(0x110000)], np.uint8)
    out[WHITE] = SPACE
    out[ord("'")] = APOSTROPHE
    for letters, name in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in letters]] = name
    return out


@functools.lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class.  Emission 1: a word begins here, 2: one character before, 3: both."""
    follow, emit = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = [LETTER, SHORT, R, V, L, E]
    for state in (OUT, LETTERS, SIGNS, AFTER):
        for c in letters:
            follow[state, c], emit[state, c] = LETTERS, state != LETTERS
        emit[state, NUMBER] = 1
        for c in (SIGN, APOSTROPHE):
            goes_on = state in (SIGNS, AFTER)
            follow[state, c], emit[state, c] = AFTER if c == APOSTROPHE and not goes_on else SIGNS, not goes_on
    for c, to in ((SHORT, OUT), (R, AFTER_R), (V, AFTER_V), (L, AFTER_L)):
        follow[AFTER, c], emit[AFTER, c] = to, 0
    for state, end in ((AFTER_R, E), (AFTER_V, E), (AFTER_L, L)):
        # no contraction after all: the letter before began a word
        follow[state], emit[state] = follow[LETTERS], emit[LETTERS] + 2
        follow[state, end], emit[state, end] = OUT, 0
    return follow, emit


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Where words begin.  The last character must be white space."""
    follow, emit = _machine()
    n = len(classes)
    parts = -(-n // CHUNK)
    steps = np.full(parts * CHUNK, SPACE, np.uint8)
    steps[:n] = classes
    steps = np.ascontiguousarray(steps.reshape(parts, CHUNK).T)
    flat = follow.ravel()
    reach = np.repeat(np.arange(7, dtype=np.uint8)[:, None], parts, 1)
    for step in steps:
        reach = flat[reach * np.uint8(10) + step]
    # reach[s, p]: state behind chunk p from state s before it; compose with all chunks before
    maps, span = reach.T.copy(), 1
    while span < parts:
        joined = maps.copy()
        joined[span:] = np.take_along_axis(maps[span:], maps[:-span].astype(np.int64), 1)
        maps, span = joined, span * 2
    state = np.append(np.uint8(OUT), maps[:-1, OUT]).astype(np.uint8)
    out = np.empty((CHUNK, parts), np.uint8)
    emitted = emit.ravel()
    for i, step in enumerate(steps):
        move = state * np.uint8(10) + step
        out[i], state = emitted[move], flat[move]
    found = out.T.ravel()[:n]
    begins = (found & 1) == 1
    begins[:-1] |= (found[1:] & 2) == 2
    return np.flatnonzero(begins)


class Merges:
    """Number of tokens of words, from the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = [t["content"] for t in described["added_tokens"]]
        # the printable stand-ins of byte-level vocabularies: bytes that are not printable follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sign[b] + end] for b in range(256)], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.rank = {(a, b): (rank, to) for rank, (a, b, to) in enumerate(pairs)}
        self.bits = 19
        size = 1 << self.bits
        self.keys = np.full(size + 64, -1, np.int64)
        self.values = np.zeros(size + 64, np.int64)
        for rank, (a, b, to) in enumerate(pairs):
            if self.rank[a, b][0] != rank:
                continue
            key = (a << 16) | b
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.values[slot] = key, (rank << 16) | to
        self.none = np.int64(1) << 40

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        shape, key = key.shape, key.ravel()
        slot = self._slot(key)
        held = self.keys[slot]
        found = np.where(held == key, self.values[slot], self.none)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        slot = slot[open_]
        while len(open_):
            slot = slot + 1
            held = self.keys[slot]
            same = held == key[open_]
            found[open_[same]] = self.values[slot[same]]
            more = ~same & (held >= 0)
            open_, slot = open_[more], slot[more]
        return found.reshape(shape)

    def _one(self, word: bytes) -> int:
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.rank[a, b], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (a, b) in self.rank]
        heap = [(rank, i, to, a, b) for rank, to, i, a, b in heap]
        heapq.heapify(heap)
        count = len(ids)
        while heap:
            _, i, to, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = to, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            count -= 1
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := self.rank.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (pair[0], left, pair[1], ids[left], ids[right]))
        return count

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the words data[start : start + size]."""
        out = np.zeros(len(start), np.int64)
        for i in np.flatnonzero(size > LONG):
            out[i] = self._one(data[start[i] : start[i] + size[i]].tobytes())
        for n in np.unique(size[size <= LONG]):
            word = np.flatnonzero(size == n)
            at = data[start[word, None] + np.arange(n)]
            ids = self.inner[at]
            ids[:, -1] = self.last[at[:, -1]]
            while len(word):
                width = ids.shape[1]
                if width == 1:
                    out[word] = 1
                    break
                found = self._look_up((ids[:, :-1] << 16) | ids[:, 1:])
                first = found.argmin(1)  # of equal ranks the leftmost
                best = found[np.arange(len(word)), first]
                go = best < self.none
                out[word[~go]] = width
                word, ids, first, best = word[go], ids[go], first[go], best[go]
                column = np.arange(width - 1)
                ids = np.take_along_axis(ids, column + (column > first[:, None]), 1)
                ids[np.arange(len(word)), first] = best & 0xFFFF
        return out


@functools.lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts texts, keeping the counts of words it has met."""

    def __init__(self, path: str):
        self.merges = merges(path)
        self.known, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def texts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        clean = []
        for i, text in enumerate(texts):
            for special in self.merges.special:
                if special in text:
                    out[i] += text.count(special)
                    text = text.replace(special, "\n")
            if not text.isascii():
                # lower-casing goes by character: sigma has one small form
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            clean.append(text.lower())
        joined = "\n".join(clean) + "\n"
        border = np.cumsum([len(t) + 1 for t in clean])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = _classes()[points]
        start = word_starts(classes)
        if not len(start):
            return out
        stop = np.zeros(len(points), bool)
        stop[start] = True
        stop |= classes == SPACE
        stops = np.flatnonzero(stop)
        end = stops[np.searchsorted(stops, start, "right")]
        key = Prefix(mixed(points.astype(np.uint64) + np.uint64(1))).of(start, end)
        words, first, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, words)
        met = np.zeros(len(words), bool)
        if len(self.known):
            met = self.known[np.minimum(place, len(self.known) - 1)] == words
        count = np.zeros(len(words), np.int64)
        count[met] = self.tokens[place[met]]
        new = np.flatnonzero(~met)
        if len(new):
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.append(0, np.cumsum(width))
            data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
            a, b = at[start[first[new]]], at[end[first[new]]]
            count[new] = self.merges.counts(data, a, b - a)
            if len(self.known) + len(new) > KEPT_WORDS:
                self.known, self.tokens = words[:KEPT_WORDS], count[:KEPT_WORDS]
            else:
                self.known, self.tokens = np.append(self.known, words[new]), np.append(self.tokens, count[new])
                order = np.argsort(self.known)
                self.known, self.tokens = self.known[order], self.tokens[order]
        total = np.append(0, np.cumsum(count[back]))
        edge = np.searchsorted(start, np.append(0, border))
        return out + total[edge[1:]] - total[edge[:-1]]


def token_counts(docs: DataFrame, path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizer without begin, end or added special tokens; its special
    strings inside a text are one token each.  Null text is empty and has none.  Every row is
    counted by itself, so repeated rows count alike and an empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            found, low = [], 0
            while low < len(texts):
                before = size[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(size, before + SLICE_CHARS, "right")))
                found.append(counter.texts(texts[low:high]))
                low = high
            tokens = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


def op7_token_counts(spark, folder: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(documents(spark, folder))
