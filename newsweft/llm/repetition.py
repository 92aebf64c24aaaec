"""Quality rules by repeated substrings.

The words of a text are sorted by suffix. Neighbours in that order share a longest common prefix; the
intervals of the order whose common prefix cannot be made longer on either side are the maximal repeated
substrings. The union of their spans, and the longest of them, decide.

A text in which no ``least`` words stand twice has no interval of that depth and is left out before sorting.
All other texts of a batch are sorted together, by text first.
Nothing is shuffled; memory grows with the longest text of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsweft.llm.units import BYTE, SPACE, Runs, Words, edges, flat, grams, mix, per_text, repeated, slices, spread

#: Characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
)
#: A repeat counts from so many words; a text fails with over so many percent of its words in repeats, or a
#: repeat of so many words.
LEAST_WORDS, MOST_COVERED_PERCENT, LONGEST_WORDS = 8, 25, 60


def suffix_order(words: Words, texts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of the marked texts in suffix order within their text, and the common prefix of each with the one before.

    They are sorted by ``least`` words first; ties are sorted again by twice the depth, with the ranks found so far,
    until none is left.
    """
    start = np.nonzero(texts[words.doc])[0]
    ends = words.at[words.doc + 1]
    padded = np.concatenate([words.hash, np.zeros(least, np.uint64)])
    keys = [np.where(start + t < ends[start], padded[start + t], 0) for t in range(least)]
    order = np.lexsort((*keys[::-1], words.doc[start]))
    fresh = np.ones(len(start), bool)
    fresh[1:] = words.doc[start[order[1:]]] != words.doc[start[order[:-1]]]
    for key in keys:
        fresh[1:] |= key[order[1:]] != key[order[:-1]]
    del keys
    start = start[order]
    place = np.arange(len(start))
    rank = np.full(len(padded) + 1, -1, np.int64)
    rank[start] = np.maximum.accumulate(np.where(fresh, place, 0))
    step = least
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = place[tied]
        if not len(at):
            break
        some = start[at]
        later = np.where(some + step < ends[some], rank[np.minimum(some + step, len(padded))], -1)
        order = np.lexsort((later, rank[some]))
        some, later = some[order], later[order]
        again = np.ones(len(at), bool)
        again[1:] = (rank[some[1:]] != rank[some[:-1]]) | (later[1:] != later[:-1])
        start[at], fresh[at] = some, again
        rank[some] = at[np.maximum.accumulate(np.where(again, np.arange(len(at)), 0))]
        step *= 2
    runs = Runs(words.hash)
    a, b = start[:-1], start[1:]
    low = np.zeros(len(a), np.int64)
    high = np.where(words.doc[a] == words.doc[b], np.minimum(ends[a] - a, ends[b] - b), 0)
    while np.any(low < high):
        middle = (low + high + 1) // 2
        same = runs.of(a, a + middle) == runs.of(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    shared = np.zeros(len(start), np.int64)
    shared[1:] = low
    return start, shared


def maximal_repeats(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length in words of the occurrences of maximal repeats of ``least`` words or more.

    A suffix's longest repeat is the larger common prefix with its two neighbours. It is maximal to the left
    unless the suffix one word earlier has a repeat one word longer, which holds it whole.
    """
    hashes, whole = grams(words, least)
    texts = np.zeros(len(words.at) - 1, bool)
    texts[words.doc[repeated(hashes, words.doc, whole)]] = True
    if not texts.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, shared = suffix_order(words, texts, least)
    longest = shared.copy()
    longest[:-1] = np.maximum(longest[:-1], shared[1:])
    by_place = np.zeros(len(words.hash) + 1, np.int64)
    by_place[start] = longest
    before = np.where((start > 0) & (words.doc[start - 1] == words.doc[start]), by_place[start - 1], 0)
    keep = (longest >= least) & (before != longest + 1)
    return start[keep], longest[keep]


def measure(texts: pa.Array, least: int) -> list[np.ndarray]:
    """Words, their characters, symbols, repeated lines, words of repeated windows, covered words, longest repeat."""
    buf, at = flat(texts)
    parts = []
    for i, j, data, places in slices(buf, at):
        words = Words(data, places)
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        word_chars = np.zeros(j - i, np.int64)
        np.add.at(word_chars, words.doc, chars[words.end] - chars[words.start])
        line_start, line_end, line_doc = edges(data != 10, places)
        solid = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~SPACE[data], out=solid[1:])
        with_word = solid[line_end] > solid[line_start]
        line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
        lines = mix(Runs(BYTE[data]).of(line_start, line_end))
        order = np.lexsort((line_start, lines, line_doc))
        twin = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        hashes, whole = grams(words, 5)
        start, length = maximal_repeats(words, least)
        steps = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(steps, start, 1)
        np.add.at(steps, start + length, -1)
        longest = np.zeros(j - i, np.int64)
        np.maximum.at(longest, words.doc[start], length)
        parts.append([
            np.diff(words.at), word_chars, per_text(SYMBOLS[data], places),
            np.bincount(line_doc[order][1:][twin], minlength=j - i),
            per_text(spread(repeated(hashes, words.doc, whole), 5), words.at),
            per_text(np.cumsum(steps)[:-1] > 0, words.at), longest,
        ])
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 7


def repetition_rules(
    docs: DataFrame, least_words: int = LEAST_WORDS, most_covered: int = MOST_COVERED_PERCENT, longest_words: int = LONGEST_WORDS
) -> DataFrame:
    """One row per document with its measures and verdict.

    A null or empty text has no words and fails the base rule. Every row is judged by itself: repeated rows give
    repeated results, a null ``doc_id`` stays null, and columns besides ``doc_id`` and ``text`` are not looked at.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = verdicts(batch.column("text"), least_words, most_covered, longest_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, found)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def verdicts(texts: pa.Array, least_words: int, most_covered: int, longest_words: int) -> list[np.ndarray]:
    """The columns after ``doc_id``."""
    n, chars, symbols, lines, again, covered, longest = measure(texts, least_words)
    failed = (n < 10) | (100 * again > 20 * n)
    kept = ~failed & (100 * covered <= most_covered * n) & (longest < longest_words)
    return [n, chars, symbols, lines, again, failed, kept, covered, longest]


def keep_clean(docs: DataFrame, least_words: int = LEAST_WORDS, most_covered: int = MOST_COVERED_PERCENT, longest_words: int = LONGEST_WORDS) -> DataFrame:
    """The rows that ``repetition_rules`` keeps, with all their columns, by the same cases."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = verdicts(batch.column("text"), least_words, most_covered, longest_words)[6]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
