"""Quality rules: counts of words, symbols and lines, and repetition by a suffix array.

The suffix array of a text is over its words.  It is built by prefix doubling for all texts of a
slice at once: suffixes are ranked by their first 3 words, then 6, 12 and so on; only those whose
rank is not yet theirs alone are sorted again.  Neighbours in the array give the longest common
prefixes.  The intervals of the array with a common prefix of ``MIN_REPEAT`` words or more are
the repeated substrings; the union of their occurrences is the union, over all suffixes, of the
longest prefix that a suffix shares with a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift.llm.bytewise import SPACE, Prefix, mixed, per_text, slices, words
from webdrift.llm.common import documents

MIN_REPEAT = 8  # words of a repeated substring that counts
MAX_COVERED = 0.4  # of a text's words inside repeated substrings
MAX_LONGEST = 100  # words of the longest one
START = 3

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COLUMNS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
    "n_repeat_words": "bigint", "covered_words": "bigint", "longest_repeat": "bigint",
}


def repeats(word_hash: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in_window, longest): per word, whether the 3 words from it on occur again in its text, and
    the length of the longest stretch from it on that occurs again, 0 if under 3 words."""
    n = len(word_hash)
    in_window, longest = np.zeros(n, bool), np.zeros(n, np.int64)
    if n <= START:
        return in_window, longest
    # numbers of the words, in any order that is the same for all; 0: behind the end of the text
    number = np.zeros(n + START, np.int64)
    number[:n] = np.unique(word_hash, return_inverse=True)[1] + 1
    third = [number[:n]] + [
        np.where(text[np.minimum(np.arange(n) + k, n - 1)] == text, number[k : n + k], 0) for k in range(1, START)
    ]
    if number.max() < 1 << 21:
        order = np.argsort((third[0] << 42) | (third[1] << 21) | third[2], kind="stable")
    else:
        order = np.lexsort(third[::-1])
    new = np.ones(n, bool)
    new[1:] = text[order[1:]] != text[order[:-1]]
    for part in third:
        new[1:] |= part[order[1:]] != part[order[:-1]]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, size)
    active = order[np.repeat(size, size) > 1]
    in_window[active] = True
    if not len(active):
        return in_window, longest
    candidates, levels, step = active, [rank.copy()], START
    while len(active):
        after = np.minimum(active + step, n - 1)
        follow = np.where((active + step < n) & (text[after] == text[active]), rank[after], -1)
        order = np.lexsort((follow, rank[active]))
        active, follow = active[order], follow[order]
        base = rank[active]
        new = np.ones(len(active), bool)
        new[1:] = (base[1:] != base[:-1]) | (follow[1:] != follow[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(active)))
        old = np.ones(len(active), bool)
        old[1:] = base[1:] != base[:-1]
        old_begin = np.repeat(np.flatnonzero(old), np.diff(np.append(np.flatnonzero(old), len(active))))
        rank[active] = base + np.repeat(begin, size) - old_begin
        step *= 2
        active = active[np.repeat(size, size) > 1]
        if len(active):
            levels.append(rank.copy())
    array = candidates[np.argsort(rank[candidates], kind="stable")]
    a, b = array[:-1], array[1:]
    common = np.zeros(len(a), np.int64)
    step = START << (len(levels) - 1)
    for level in reversed(levels):
        i, j = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        same = (level[i] == level[j]) & (i != j) & (a + common < n) & (b + common < n)
        same &= (text[i] == text[a]) & (text[j] == text[b])
        common += step * same
        step //= 2
    for _ in range(START - 1):
        i, j = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        more = (a + common < n) & (b + common < n) & (word_hash[i] == word_hash[j]) & (i != j)
        common += more & (text[i] == text[a]) & (text[j] == text[b]) & (text[a] == text[b])
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return in_window, longest


def _line_repeats(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, prefix: Prefix) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    text = np.searchsorted(offsets[1:], begin, "right")
    # a break that ends a text leaves an empty line behind it, which belongs to no text that counts
    has_word = np.searchsorted(start, end) > np.searchsorted(start, begin)
    begin, end, text = begin[has_word], end[has_word], text[has_word]
    key = prefix.of(begin, end) + mixed(text.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    n = len(offsets) - 1
    return np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    start, end, border = words(data, offsets)
    prefix = Prefix(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(border))
    in_window, longest = repeats(prefix.of(start, end), text)
    repeat_word = in_window.copy()
    repeat_word[1:] |= in_window[:-1]
    repeat_word[2:] |= in_window[:-2]
    counted = np.flatnonzero(longest >= min_repeat)
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, counted, 1)
    np.add.at(edge, counted + longest[counted], -1)
    covered = np.cumsum(edge[:-1]) > 0
    top = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(top, text, longest)
    return {
        "n_words": np.diff(border),
        "word_chars": per_text(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(SYMBOL[data], offsets),
        "n_dup_lines": _line_repeats(data, offsets, start, prefix),
        "n_repeat_words": per_text(repeat_word, border),
        "covered_words": per_text(covered, border),
        "longest_repeat": top,
    }


def with_measures(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``docs`` with the columns of ``COLUMNS`` for its column ``text``; those of these names are replaced."""
    docs = docs.drop(*COLUMNS)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch, text):
                found = measure(data, offsets, min_repeat)
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *[pa.array(found[c], pa.int64()) for c in COLUMNS]], names=[*names, *COLUMNS]
                )

    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"{n} {t}" for n, t in COLUMNS.items()])
    return docs.mapInArrow(run, schema)


def judged(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``docs`` (any columns, ``text`` among them) with the measures, ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in 3-word windows that occur twice.
    ``kept``: not so, at most ``max_covered`` of the words inside repeated substrings of
    ``min_repeat`` words or more, and none longer than ``max_longest`` words.

    Null text is no text: 0 words, so it fails.  Every row is judged by itself, so repeated rows
    are judged alike and an empty table stays empty.  Memory follows the longest text.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return with_measures(docs, min_repeat=min_repeat).withColumn("base_failed", base).withColumn("kept", ~base & fine)


def op4_quality_rules(spark, folder: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = documents(spark, folder).select("doc_id", "text")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "covered_words", "longest_repeat",
    )
