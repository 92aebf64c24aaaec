"""Periodic runs of words: seeds of equal grams, extended along their diagonal.

A run of smallest period q and length L >= max(6, 4 q) overlaps its own copy q words later in L - q words. Periods are taken
in classes P <= q < 2 P; in a class at least 3 P words overlap (five for q = 1), which is longer than the period. So a gram of
that length stands in the run at every start and, q words later, again, and never between: only neighbouring occurrences in
the same text have to be paired, one pair for each place. Pairs whose lag is in the class are seeds. On each diagonal (text and
lag) the furthest place covered so far says which seeds lie in a run that is already known; the others are extended both ways.

Grams are named by exact ranks, longer ones by the names of their halves, so equal names are equal words; places whose gram is
alone in its text drop out before the next class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The white space between words.
GAPS = r"[\x20\x09-\x0D]+"
#: A run is at least so many words and so many periods long.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: So many bytes of text are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 2_000_000
SCHEMA = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where those of each text begin; a null text has none."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), GAPS)
    flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy()
    solid = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    counts = np.zeros(len(solid) + 1, np.int64)
    np.cumsum(solid, out=counts[1:])
    ends = np.cumsum(sizes)
    return flat.filter(pa.array(solid)), np.concatenate([[0], counts[ends]]).astype(np.int64)


def renamed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of the pairs of two names; -1 where either is -1."""
    out = np.full(len(first), -1, np.int32)
    at = np.nonzero((first >= 0) & (second >= 0))[0]
    if len(at):
        keys = first[at].astype(np.int64) * (int(second[at].max()) + 1) + second[at]
        out[at] = np.unique(keys, return_inverse=True)[1]
    return out


def shifted(names: np.ndarray, by: int) -> np.ndarray:
    out = np.full(len(names), -1, names.dtype)
    if by < len(names):
        out[: len(names) - by] = names[by:]
    return out


def twins(names: np.ndarray) -> np.ndarray:
    """The names that stand twice or more; -1 for the others."""
    out = names.copy()
    live = names >= 0
    if live.any():
        out[live & (np.bincount(names[live])[np.maximum(names, 0)] < 2)] = -1
    return out


def seeds(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of occurrences whose next one is from ``low`` to ``high`` words later."""
    at = np.nonzero(names >= 0)[0]
    at = at[np.argsort(names[at], kind="stable")]
    lag = np.where(names[at[1:]] == names[at[:-1]], at[1:] - at[:-1], 0)
    good = (lag >= low) & (lag <= high)
    return at[:-1][good], lag[good]


def reach(names: dict[int, np.ndarray], at: np.ndarray, lag: np.ndarray, step: int) -> np.ndarray:
    """For each place the end (``step`` 1) or the first (-1) of the equal words of its diagonal, by ever shorter named grams."""
    here = at.copy()
    for size in sorted(names, reverse=True):
        known = names[size]
        while True:
            begin = here if step > 0 else here - size
            inside = (begin >= 0) & (begin + lag + size <= len(known))
            place = np.where(inside, begin, 0)
            a, b = known[place], known[np.where(inside, begin + lag, 0)]
            same = inside & (a >= 0) & (a == b)
            if not same.any():
                break
            here = np.where(same, here + step * size, here)
    return here


def runs_of(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (over all texts), length and period of every run, by start and period; ``words`` are numbers, ``at`` their texts' begins."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # A word's first name tells its text too, so no gram is shared by two texts and none reaches over an end.
    one = renamed(text, words)
    names = {1: twins(one)}

    def grown(size: int, from_size: int) -> np.ndarray:
        """Names of ``size`` words by two overlapping or adjoining grams of ``from_size``; alone ones are left out."""
        return twins(renamed(names[from_size], shifted(names[from_size], size - from_size)))

    names[2] = grown(2, 1)
    names[3] = grown(3, 2)
    names[5] = grown(5, 3)
    size = 3
    while (names[size] >= 0).any():
        names[2 * size] = grown(2 * size, size)
        size *= 2
    found, least = [], 1
    while (gram := 3 * least if least > 1 else 5) in names:
        place, lag = seeds(names[gram], least, 2 * least - 1)
        if len(place):
            found.append(extended(names, place, lag, gram))
        least *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def extended(names: dict[int, np.ndarray], place: np.ndarray, lag: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of the seeds: start, length, period.

    Seeds are taken by diagonal and place. One that the furthest covered place of its lag already holds is left out, so each
    run is extended once.
    """
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    follows = np.zeros(len(place), bool)
    # Neighbouring seeds of a diagonal overlap in all but one word: the first one covers the next.
    follows[1:] = (lag[1:] == lag[:-1]) & (place[1:] == place[:-1] + 1)
    place, lag = place[~follows], lag[~follows]
    end = reach(names, place + gram, lag, 1)
    new = np.ones(len(place), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (place[1:] >= end[:-1])
    place, lag, end = place[new], lag[new], end[new]
    first = reach(names, place, lag, -1)
    return first, end + lag - first, lag


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Marks the words that a run holds behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps)[:n] > 0


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``SLICE_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield i, j
        i = j


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, pa.int64()))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: its words, its runs (by start, then period) and its text without the repeats.

    A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` words long, that no neighbouring word extends.
    The repeats are the words of a run after its first q; the others are joined by one space. A null or empty text has no words
    and no runs and gives an empty text. Every row is judged by itself: repeated rows give repeated results, a null ``doc_id``
    stays null, and columns besides ``doc_id`` and ``text`` are not looked at. Nothing is shuffled; memory grows with the longest text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").cast(pa.string()), batch.column("doc_id").cast(pa.int64())
            for i, j in pieces(texts):
                words, at = words_of(texts.slice(i, j - i))
                coded = words.dictionary_encode()
                start, length, period = runs_of(coded.indices.to_numpy(), at)
                kept = ~dropped(len(words), start, length, period)
                counts = np.zeros(len(words) + 1, np.int64)
                np.cumsum(kept, out=counts[1:])
                rest = pa.ListArray.from_arrays(pa.array(counts[at].astype(np.int32)), words.filter(pa.array(kept)))
                runs_at = np.searchsorted(start, at)
                own = np.repeat(at[:-1], np.diff(runs_at))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i), pa.array(np.diff(at)), lists(start - own, runs_at), lists(length, runs_at),
                    lists(period, runs_at), pc.binary_join(rest, " "),
                ], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
