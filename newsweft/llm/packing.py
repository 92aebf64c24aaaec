"""Packing of tokenized documents into fixed windows by non-negative least squares.

Pieces are counted by length, in steps of a few tokens. All combinations of up to three lengths that fill a window are
listed; how often each is to be used is the non-negative least-squares solution against the counts, rounded down to what
there is. What is left is packed greedily, the longest first, each window filled with the longest that fits. All this works on
counts: one number for each length, however many documents there are. Then each piece finds its window by its number
among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.seeds import LAST
from newsweft.llm.tokens import encoded, with_end
from newsweft.operators.ranges import running_number
from newsweft.session import durable

WINDOW, STEP = 2048, 8
PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def fillings(units: int, deep: int = 3) -> list[tuple[int, ...]]:
    """Combinations of up to ``deep`` lengths (at most 3), longest first, that make ``units``."""
    out = [(units,)]
    if deep > 1:
        out += [(a, units - a) for a in range((units + 1) // 2, units)]
    if deep > 2:
        out += [(a, b, units - a - b) for a in range(-(-units // 3), units - 1) for b in range(-(-(units - a) // 2), min(a, units - a - 1) + 1)]
    return out


def nonnegative(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """The x >= 0 that makes ``|a x - b|`` least, by an active set."""
    gram, aim = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(aim).max(initial=0)))
    for _ in range(most):
        gain = aim - gram[:, free] @ x[free]
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= slack:
            break
        free[best] = True
        while True:
            own = np.nonzero(free)[0]
            trial = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (trial > 0).all():
                break
            low = trial <= 0
            old = x[own]
            pace = np.min(old[low] / np.maximum(old[low] - trial[low], 1e-300))
            x[own] = old + pace * (trial - old)
            gone = own[(x[own] <= 1e-12) | (low & (x[own] <= slack))]
            gone = gone if len(gone) else own[low][:1]
            free[gone] = False
            x[gone] = 0
        x[:] = 0
        x[own] = trial
    return x


@dataclass
class Plan:
    """For each length, by ascending number of its pieces: from which number on, in which first window, how many of a window."""

    key: np.ndarray
    window: np.ndarray
    times: np.ndarray
    windows: int


def make_plan(counts: np.ndarray, units: int, deep: int = 3) -> Plan:
    """``counts``: pieces of each length from 0 to ``units`` steps."""
    left = counts.astype(np.int64).copy()
    used: list[tuple[tuple[int, ...], int]] = []
    shapes = fillings(units, deep)
    shapes = [s for s in shapes if all(left[u] for u in s)]
    if shapes:
        matrix = np.zeros((units + 1, len(shapes)))
        for k, s in enumerate(shapes):
            for u in s:
                matrix[u, k] += 1
        wanted = nonnegative(matrix, left.astype(float))
        for k in np.argsort(-wanted, kind="stable").tolist():
            need: dict[int, int] = {}
            for u in shapes[k]:
                need[u] = need.get(u, 0) + 1
            n = min(int(round(wanted[k])), *(int(left[u]) // m for u, m in need.items()))
            if n > 0:
                used.append((shapes[k], n))
                for u, m in need.items():
                    left[u] -= n * m
    while left.any():
        room, shape, need = units, [], {}
        while True:
            fits = np.nonzero(left[: room + 1] > 0)[0]
            fits = [u for u in fits[::-1].tolist() if left[u] > need.get(u, 0)] if room else []
            if not fits:
                break
            shape.append(fits[0])
            need[fits[0]] = need.get(fits[0], 0) + 1
            room -= fits[0]
        n = min(int(left[u]) // m for u, m in need.items())
        used.append((tuple(shape), n))
        for u, m in need.items():
            left[u] -= n * m
    keys, windows, times = [], [], []
    at = np.zeros(units + 1, np.int64)
    first = 0
    for shape, n in used:
        for u in dict.fromkeys(shape):
            m = shape.count(u)
            keys.append((u << 48) + int(at[u]))
            windows.append(first)
            times.append(m)
            at[u] += n * m
        first += n
    order = np.argsort(np.array(keys, np.int64))
    return Plan(np.array(keys, np.int64)[order], np.array(windows, np.int64)[order], np.array(times, np.int64)[order], first)


def pieces_of(docs: DataFrame, tokenizer: str, keeps_space: bool, end: int, window: int) -> DataFrame:
    """Each document's ids with the end id, cut into whole windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = batch.column("doc_id"), batch.column("row")
            for i, j, ids, at in encoded(batch.column("text"), tokenizer, keeps_space):
                ids, at = with_end(ids, at, end)
                size = np.diff(at)
                number = -(-size // window)
                text = np.repeat(np.arange(j - i), number)
                start = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * window
                length = np.minimum(window, size[text] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((at[text] + start).tolist(), (at[text] + start + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own.slice(i, j - i).take(pa.array(text)), rows.slice(i, j - i).take(pa.array(text)), *map(pa.array, (start, length)), pa.array(sums, pa.int64()), pa.array(size[text])],
                    names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"],
                )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool = False, end: int = 1, window: int = WINDOW, step: int = STEP, deep: int = 3) -> DataFrame:
    """One row per piece with its window (``sequence_id``) and its place there (``offset``).

    A null or empty text is the end id alone. A null ``doc_id`` stays null; rows that share a ``doc_id`` are packed each by itself.
    An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are not looked at.
    """
    units = window // step
    pieces = pieces_of(docs, tokenizer, keeps_space, end, window)
    # Stored before the numbering, which reads it twice: once for its ranges.
    sized = durable(pieces.withColumn("size", F.ceil(F.col("length") / step).cast("int")))
    numbered = running_number(sized, ["size"], ["doc_id", "row", "start"])
    counts = np.zeros(units + 1, np.int64)
    for row in numbered.groupBy("size").agg(F.count("*").alias("n")).collect():  # at most one row for each length
        counts[row["size"]] = row.n
    plan = make_plan(counts, units, deep)
    names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("size").to_numpy().astype(np.int64) << 48) + batch.column("number").to_numpy()
            at = np.searchsorted(plan.key, key, "right") - 1
            sequence = plan.window[at] + (key - plan.key[at]) // plan.times[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(sequence)], names=names)

    placed = numbered.mapInArrow(place, f"{PIECES}, sequence_id long")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("doc_id", F.nullif("doc_id", F.lit(LAST))).drop("row")
