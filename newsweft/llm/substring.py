"""Removal of words in repeated passages, by seed and extend.

Documents meet on winnowed seeds of a few words (``seeds``). From a seed the match is extended word by word to
the left and to the right: neighbourhoods that agree so far stay in one class, so all pairs are extended at once
and none is listed. A window of the wanted length is a repeat where an earlier place is in the same class.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsweft.llm.seeds import Open, Windows, grouped, repeats
from newsweft.llm.units import U, Words, per_text

SCHEMA = "doc_id long, n_words long, n_removed long, kept string, span_starts array<int>, span_ends array<int>"


def classes(*keys: np.ndarray) -> np.ndarray:
    order, fresh = grouped(*keys)
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def windows_by_extension(met: Open, kind: Windows) -> np.ndarray:
    """Marks windows that also start earlier: in a smaller document, or before in the same one."""
    side, n = kind.width - kind.seed, len(met.key)
    out = np.zeros((n, side + 1), bool)
    every = np.arange(n)

    def word(offset: int) -> tuple[np.ndarray, np.ndarray]:
        """The word so far from the seed's first, and whether there is one."""
        at = met.left + offset
        there = (at >= 0) & (at < met.length)
        return met.units[every, np.where(there, at, 0)], there

    # Class of the match extended by so many words to one side; 0 where the text ends before.
    right = [classes(met.key)]
    for b in range(side):
        value, there = word(kind.seed + b)
        right.append(np.where(there & (right[-1] > 0), classes(right[-1].astype(U), value), 0))
    left = right[0]
    for a in range(side + 1):
        if a:
            value, there = word(-a)
            left = np.where(there & (left > 0), classes(left.astype(U), value), 0)
        some = np.nonzero((left > 0) & (right[side - a] > 0))[0]
        if not len(some):
            continue
        order, fresh = grouped(left[some], right[side - a][some], met.ids[some], met.pos[some])
        some = some[order]
        fresh[1:] = (left[some[1:]] != left[some[:-1]]) | (right[side - a][some[1:]] != right[side - a][some[:-1]])
        head = some[np.maximum.accumulate(np.where(fresh, np.arange(len(some)), 0))]
        late = (met.ids[some] > met.ids[head]) | ((met.ids[some] == met.ids[head]) & (met.pos[some] > met.pos[head]))
        late = some[late]
        out[late, met.left[late] - a] = True
    return out


def cut_words(table: pa.Table, marked: Iterator, layout: bool = False) -> pa.Table:
    """The words left, joined by single spaces, and the spans of removed words.

    With ``layout`` the text is left as it is but for the spans, which go up to the next word; what stands before them stays.
    """
    cols: list[list] = [[] for _ in range(5)]
    for _, data, places, at, marks in marked:
        words = Words(data, places)
        keep = np.nonzero(~marks)[0]
        doc = words.doc[keep]
        last = np.ones(len(keep), bool)
        last[:-1] = doc[1:] != doc[:-1]
        steps = np.zeros(len(data) + 1, np.int32)
        steps[words.start[keep]] += 1
        steps[words.end[keep]] -= 1
        taken = np.cumsum(steps)[:-1] > 0
        gap = words.end[keep[~last]]
        joined = data.copy()
        joined[gap] = 0x20
        taken[gap] = True
        sums = np.concatenate([[0], np.cumsum(taken)])
        fresh = np.concatenate([[True], (words.doc[1:] != words.doc[:-1])]) if len(marks) else marks
        open_at = marks & (fresh | ~np.concatenate([[False], marks[:-1]]))
        shut = np.concatenate([fresh[1:], [True]]) | ~np.concatenate([marks[1:], [False]]) if len(marks) else marks
        start, end = np.nonzero(open_at)[0], np.nonzero(marks & shut)[0] + 1
        if layout:
            after = np.minimum(end, len(words.start) - 1)
            until = np.where((end < len(words.start)) & (words.doc[after] == words.doc[start]), words.start[after], words.end[end - 1])
            steps = np.zeros(len(data) + 1, np.int32)
            steps[words.start[start]] += 1
            steps[until] -= 1
            joined, taken = data, np.cumsum(steps)[:-1] == 0
            sums = np.concatenate([[0], np.cumsum(taken)])
        spans = np.searchsorted(start, at)
        base = at[words.doc[start]]
        for c, x in zip(cols, (
            pa.array(np.diff(at)), pa.array(per_text(marks, at)),
            pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(sums[places].astype(np.int64)), pa.py_buffer(joined[taken])).cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array((start - base).astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array((end - base).astype(np.int32))),
        ), strict=True):
            c.append(x)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.table([table.column("doc_id").cast(pa.int64()), *(pa.chunked_array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def substring_dedup(docs: DataFrame, width: int = 20, seed: int = 8, carry: Sequence[str] = (), layout: bool = False) -> DataFrame:
    """Each text without the words covered by a window of ``width`` words that also starts earlier.

    Earlier is a smaller ``doc_id``, or a smaller place in the same document. A null text has no words. Rows with one
    ``doc_id`` count as that document, each with its own places; a null ``doc_id`` comes after all others. Texts of fewer
    words stay whole. Of other columns those to ``carry`` are passed on, the rest are not looked at. ``kept`` is the words left, joined
    by one space; with ``layout`` it is the text itself without the spans, so a text of which nothing is removed is unchanged.
    """
    return repeats(docs, Windows(width, seed, words=True, same_text=True), windows_by_extension, partial(cut_words, layout=layout), SCHEMA, carry)
