"""Removal of bytes that stand in an earlier document, by suffix order.

Windows of 50 bytes meet by winnowed seeds (``seeds``). Neighbourhoods of a seed that differ are sorted by
suffix with Lyndon grouping; suffixes that share 50 bytes or more lie side by side, and the least document of
each such run owns the string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsweft.llm.lyndon import suffix_array
from newsweft.llm.seeds import Open, Windows, repeats
from newsweft.llm.units import edges, per_text

SCHEMA = "doc_id long, n_bytes long, n_removed long, span_starts array<int>, span_ends array<int>, kept binary"
#: So many units are sorted at once; all neighbourhoods of one seed are sorted together whatever their number.
SORT_UNITS = 30_000


def longest_shared(key: np.ndarray, side: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each row, how many units it shares with another row of the same key. ``room``: units that a row has."""
    rows = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), side], axis=1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel())
    rows = rows[order]
    differ = np.concatenate([rows[1:] != rows[:-1], np.ones((max(len(rows) - 1, 0), 1), bool)], axis=1)
    shared = np.minimum(differ.argmax(axis=1) - 8, np.minimum(room[order][1:], room[order][:-1]))
    most = np.full(len(rows), -1, np.int64)
    most[1:] = shared
    most[:-1] = np.maximum(most[:-1], shared)
    out = np.zeros(len(rows), np.int64)
    out[order] = most
    return out


def windows_by_suffix(met: Open, kind: Windows) -> np.ndarray:
    """Marks windows that also stand in a smaller document.

    Units at either end of a neighbourhood that no other of the same seed shares can't be in a common window and are
    cut off; what is left is often equal, and sorted once for its least document.
    """
    side, n = kind.width - kind.seed, len(met.key)
    out = np.zeros((n, side + 1), bool)
    if n < 2:
        return out
    padded = np.concatenate([met.units, np.zeros((n, 1), np.uint8)], axis=1)
    every, reach = np.arange(n)[:, None], np.arange(side)[None, :]
    after = met.length - met.left - kind.seed
    ahead = np.minimum(met.left[:, None] + kind.seed + reach, padded.shape[1] - 1)
    back = np.where(reach < met.left[:, None], met.left[:, None] - 1 - reach, padded.shape[1] - 1)
    right = longest_shared(met.key, padded[every, ahead], after)
    left = longest_shared(met.key, padded[every, back], met.left)
    some = np.nonzero((right >= 0) & (left >= 0) & (left + right >= side))[0]
    if not len(some):
        return out
    begin, length = (met.left - left)[some], (left + kind.seed + right)[some]
    cut = np.where(np.arange(padded.shape[1])[None, :] < length[:, None], padded[some[:, None], np.minimum(begin[:, None] + np.arange(padded.shape[1])[None, :], padded.shape[1] - 1)], 0)
    cut[:, -1] = length
    _, one, text = np.unique(np.ascontiguousarray(cut).view(f"V{cut.shape[1]}").ravel(), return_index=True, return_inverse=True)
    owner = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(owner, text, met.ids[some])
    least = np.full((len(one), side + 1), np.iinfo(np.int64).max)
    # A text that is the only one left of its seed owns its windows; the texts of other seeds are sorted together.
    by_seed = np.argsort(met.key[some[one]], kind="stable")
    seed = met.key[some[one[by_seed]]]
    fresh = np.concatenate([[True], seed[1:] != seed[:-1], [True]])
    alone = by_seed[fresh[1:] & fresh[:-1]]
    least[alone] = np.where(np.arange(side + 1)[None, :] + kind.width <= length[one[alone]][:, None], owner[alone][:, None], least[alone])
    by_seed = by_seed[~(fresh[1:] & fresh[:-1])]
    if len(by_seed):
        sort_in_turns(cut[one], length[one], owner, met.key[some[one]], by_seed, kind, least)
    entry, offset = np.nonzero(met.ids[some][:, None] > least[text])
    out[some[entry], begin[entry] + offset] = True
    return out


def sort_in_turns(rows: np.ndarray, length: np.ndarray, owner: np.ndarray, key: np.ndarray, by_seed: np.ndarray, kind: Windows, least: np.ndarray) -> None:
    """Fills in the least owners of the given texts, whole seeds at a time."""
    seed = key[by_seed]
    bounds = [*np.nonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))[0].tolist(), len(seed)]
    sizes = np.concatenate([[0], np.cumsum(length[by_seed] + 1)])
    at = 0
    while at < len(bounds) - 1:
        to = at + 1
        while to < len(bounds) - 1 and sizes[bounds[to + 1]] - sizes[bounds[at]] <= SORT_UNITS:
            to += 1
        own = by_seed[bounds[at] : bounds[to]]
        least[own] = least_documents(rows[own], length[own], owner[own], kind)
        at = to


def least_documents(rows: np.ndarray, length: np.ndarray, owner: np.ndarray, kind: Windows) -> np.ndarray:
    """The least owner of each window of each text, by the place of its first unit."""
    used = np.arange(rows.shape[1])[None, :] <= length[:, None]
    text = rows.astype(np.int64) + 1
    text[np.arange(rows.shape[1])[None, :] >= length[:, None]] = 0
    units = text[used]
    entry, offset = np.nonzero(used)
    out = np.full((len(rows), kind.width - kind.seed + 1), np.iinfo(np.int64).max)
    order = np.asarray(suffix_array(units.tolist()))
    # Only suffixes of a whole window can own one.
    order = order[(offset + kind.width <= length[entry])[order]]
    if len(order):
        views = np.lib.stride_tricks.sliding_window_view(units.astype(np.int16), kind.width)
        fresh = np.concatenate([[True], (views[order[1:]] != views[order[:-1]]).any(axis=1)])
        least = np.minimum.reduceat(owner[entry[order]], np.nonzero(fresh)[0])[np.cumsum(fresh) - 1]
        out[entry[order], offset[order]] = least
    return out


def cut_bytes(table: pa.Table, marked: Iterator) -> pa.Table:
    """What is left of each text, and the removed spans."""
    cols: list[list] = [[] for _ in range(5)]
    for _, data, places, _, marks in marked:
        start, end, doc = edges(marks, places)
        spans = np.searchsorted(doc, np.arange(len(places)))
        removed = per_text(marks, places)
        left = np.concatenate([[0], np.cumsum(np.diff(places) - removed)])
        for c, x in zip(cols, (
            pa.array(np.diff(places)), pa.array(removed),
            pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array((start - places[doc]).astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array((end - places[doc]).astype(np.int32))),
            pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(removed), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~marks])]).cast(pa.binary()),
        ), strict=True):
            c.append(x)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
    return pa.table([table.column("doc_id").cast(pa.int64()), *(pa.chunked_array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def suffix_dedup(docs: DataFrame, width: int = 50, seed: int = 20) -> DataFrame:
    """Each text without the bytes covered by a string of ``width`` bytes that starts in a smaller document too.

    A null text is empty. Of documents with one ``doc_id`` none is smaller; a null ``doc_id`` is larger than all
    others. Texts shorter than ``width`` bytes stay whole. Columns besides ``doc_id`` and ``text`` are not looked at.
    """
    return repeats(docs, Windows(width, seed, words=False, same_text=False), windows_by_suffix, cut_bytes, SCHEMA)
