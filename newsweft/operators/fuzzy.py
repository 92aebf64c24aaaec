"""Fuzzy title equality by matching-block ratio, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.operators.ranges import running_number
from newsweft.session import by_all_cores, durable

#: Titles of a block, pairs of titles looked at together, and characters read together.
BLOCK, CELLS, CHARS = 4096, 200_000, 500_000
#: Gram lengths and bins of the counts that two similar titles nearly share; the first is compared for all pairs of like length.
GRAMS = ((1, 64), (4, 2048), (5, 4096))
#: Titles longer than this are compared by all their grams of this length too, which are held for so many titles.
LONG, GRAM, HELD = 400, 5, 512
#: The common subsequence is looked at again after so many characters.
LOOK_EVERY = 64


def common_subsequence_reaches(a: str, b: str, least: int) -> bool:
    """Whether the longest common subsequence has ``least`` characters, by bit-parallel rows.

    One whole number holds a row of the table; the walk ends as soon as the characters left can't make up for those lost.
    """
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for i, c in enumerate(a):
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
        if i % LOOK_EVERY == LOOK_EVERY - 1 and len(b) - row.bit_count() + len(a) - i - 1 < least:
            return False
    return len(b) - row.bit_count() >= least


def _least(a: str, b: str, slack: float) -> int:
    """Characters of the common subsequence of two titles with at most ``slack`` of their lengths in insertions and deletions."""
    total = len(a) + len(b)
    return (total - int(total * slack + 1e-9) + 1) // 2


def ratio_reaches(a: str, b: str, ratio: float) -> bool:
    """Whether the share of characters in matching blocks, as the standard library defines it, reaches ``ratio``.

    The share depends on the side in rare cases, so either direction may call the titles equal. The blocks are a common
    subsequence, which is tried first.
    """
    return common_subsequence_reaches(a, b, _least(a, b, 1.0 - ratio)) and any(
        SequenceMatcher(None, x, y).ratio() >= ratio for x, y in ((a, b), (b, a))
    )


def _counts(titles: list[str], gram: int, bins: int) -> np.ndarray:
    """Per title how many of its grams fall into each bin, 255 at most."""
    out = np.zeros((len(titles), bins), np.uint8)
    ends = np.cumsum([len(t) for t in titles])
    first = 0
    while first < len(titles):
        done = ends[first - 1] if first else 0
        last = min(max(int(np.searchsorted(ends, done + CHARS, "right")), first + 1), first + 256)
        some = titles[first:last]
        chars = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(some)), [len(t) for t in some])
        size = max(len(chars) - gram + 1, 0)
        code = np.zeros(size, np.uint64)
        for i in range(gram):
            code = code * np.uint64(1_000_003) + chars[i:size + i]
        inside = row[:size] == row[gram - 1:]
        code = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(bins)
        cell = row[:size][inside] * bins + code[inside].astype(np.int64)
        out[first:last] = np.minimum(np.bincount(cell, minlength=len(some) * bins), 255).reshape(len(some), bins)
        first = last
    return out


def _grams(title: str, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of a title, by 64 bits, and how often each stands there."""
    chars = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.zeros(max(len(chars) - gram + 1, 0), np.uint64)
    for i in range(gram):
        code = code * np.uint64(0x9E3779B97F4A7C15) + chars[i:len(code) + i]
    return np.unique(code, return_counts=True)


def _grams_near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int) -> bool:
    """Whether the grams of two titles differ by ``most`` at most."""
    if not len(a[0]) or not len(b[0]):
        return True
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return int(a[1].sum() + b[1].sum() - 2 * shared) <= most


def _near_counts(a: list[str], b: list[str], slack: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in two lists of titles, each by length, whose counts differ no more than the insertions and deletions between
    similar titles can make them: one of them changes ``2 q - 1`` grams of length q at most. With ``same`` the lists are one."""
    size_a, size_b = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    counts = [(x, x if same else _counts(b, *g)) for g in GRAMS for x in (_counts(a, *g),)]
    bags = [np.ascontiguousarray(x.T.astype(np.int16)) for x in counts[0]]
    step = max(1, CELLS // len(b))
    for first in range(0, len(a), step):
        last = min(first + step, len(a))
        # Both ways: a block of longer titles may begin with the lengths that the other one ends with.
        low = int(np.searchsorted(size_b, size_a[first] * ((1 - slack) / (1 + slack)) - 1))
        low = max(low, first + 1) if same else low
        high = int(np.searchsorted(size_b, size_a[last - 1] * ((1 + slack) / (1 - slack)) + 1, "right"))
        if low >= high:
            continue
        allowed = np.floor((size_a[first:last, None] + size_b[None, low:high]) * slack + 1e-9)
        apart = np.zeros(allowed.shape, np.int16)
        for x, y in zip(*bags):
            if x[first:last].any() or y[low:high].any():
                apart += np.abs(x[first:last, None] - y[None, low:high])
        r, c = np.nonzero((apart <= allowed) & (np.abs(size_a[first:last, None] - size_b[None, low:high]) <= allowed))
        most, r, c = allowed[r, c], r + first, c + low
        if same:
            later = r < c
            most, r, c = most[later], r[later], c[later]
        for (gram, _), (x, y) in zip(GRAMS[1:], counts[1:]):
            keep = np.zeros(len(r), bool)
            for at in range(0, len(r), 1000):
                some = slice(at, at + 1000)
                differ = np.abs(x[r[some]].astype(np.int16) - y[c[some]]).sum(axis=1, dtype=np.int64)
                keep[some] = differ <= (2 * gram - 1) * most[some]
            most, r, c = most[keep], r[keep], c[keep]
        yield r, c


def candidate_titles(titles: DataFrame, keys: Sequence[str], slack: float, block: int = BLOCK) -> DataFrame:
    """Pairs ``keys, t1, t2`` of ids, shorter title first, whose common subsequence is long enough; none that is similar gets lost.
    ``titles(keys, _id, title_key)``.

    At most ``slack * (len1 + len2)`` insertions and deletions lie between two similar titles, so their lengths and the counts of
    their characters and grams are near. The titles of a key are cut into blocks by length; blocks of like lengths meet in one
    task, which compares the counts by arrays and the titles that are left by the common subsequence. What is shuffled are the
    titles, once per block that theirs meets.
    """
    keys = list(keys)
    base = titles.select(*keys, "_id", "title_key", F.length("title_key").alias("_n"))
    placed = durable(running_number(base, keys, ["_n", "_id"], "_at").withColumn("_block", F.floor(F.col("_at") / block).cast("int")).drop("_at"))
    spans = durable(placed.groupBy(*keys, "_block").agg(F.min("_n").alias("_low"), F.max("_n").alias("_high")))
    i = spans.select(*keys, F.col("_block").alias("_i"), F.col("_high").alias("_high_i"))
    j = spans.select(*keys, F.col("_block").alias("_j"), F.col("_low").alias("_low_j"))
    like = (F.col("_low_j") - F.col("_high_i")) <= (F.col("_low_j") + F.col("_high_i")) * slack + 1e-9
    meets = i.join(j, keys).where((F.col("_i") <= F.col("_j")) & like).select(*keys, "_i", "_j")
    sides = (F.when(F.col("_i") == F.col("_j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    meets = meets.withColumn("_side", F.explode(sides)).withColumn("_block", F.when(F.col("_side") == 0, F.col("_i")).otherwise(F.col("_j")))
    dealt = placed.join(meets, [*keys, "_block"]).select(*keys, "_i", "_j", "_side", "_id", "title_key", "_n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("_n", "ascending"), ("_id", "ascending")])
        same = table["_i"][0] == table["_j"][0]
        left = table.filter(pc.equal(table["_side"], 0))
        right = left if same else table.filter(pc.equal(table["_side"], 1))
        a, b = left["title_key"].to_pylist(), right["title_key"].to_pylist()
        # Bins hide how long titles differ; their grams are compared as they are.
        grams = lru_cache(HELD)(lambda title: _grams(title, GRAM))

        def near(x: str, y: str) -> bool:
            most = int((len(x) + len(y)) * slack + 1e-9)
            if len(x) > LONG and not _grams_near(grams(x), grams(y), (2 * GRAM - 1) * most):
                return False
            return common_subsequence_reaches(x, y, _least(x, y, slack))

        for r, c in _near_counts(a, b, slack, same):
            reach = [near(a[x], b[y]) for x, y in zip(r.tolist(), c.tolist())]
            r, c = r[np.array(reach, bool)], c[np.array(reach, bool)]
            found = {k: pa.repeat(table[k][0], len(r)) for k in keys}
            found |= {"t1": left["_id"].take(pa.array(r)).combine_chunks(), "t2": right["_id"].take(pa.array(c)).combine_chunks()}
            yield pa.RecordBatch.from_pydict(found)

    fields = [f"{k} {base.schema[k].dataType.simpleString()}" for k in keys]
    fields += [f"{c} {base.schema['_id'].dataType.simpleString()}" for c in ("t1", "t2")]
    group = [*keys, "_i", "_j"]
    return by_all_cores(dealt, *group).groupBy(*group).applyInArrow(compare, ", ".join(fields))


def similar_titles(titles: DataFrame, keys: Sequence[str], ratio: float = rules.FUZZY_TITLE_RATIO) -> DataFrame:
    """Pairs of different titles with match ratio >= ``ratio``: ``keys, t1, t2``, shorter title first, else the smaller one.

    ``titles(keys, title_key)`` must be distinct and not empty. Titles of any length are whole; candidates come from
    ``candidate_titles``, by the hash of a title, and each is settled by the ratio itself.
    """
    keys = list(keys)
    named = durable(titles.select(*keys, "title_key").withColumn("_id", F.sha2("title_key", 256)))
    pairs = durable(candidate_titles(named, keys, 1.0 - ratio))
    both = pairs.join(named.select(*keys, F.col("_id").alias("t1"), F.col("title_key").alias("_a")), [*keys, "t1"]).join(
        named.select(*keys, F.col("_id").alias("t2"), F.col("title_key").alias("_b")), [*keys, "t2"]
    )

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[ratio_reaches(a, b, ratio) for a, b in zip(frame["_a"], frame["_b"])]]

    both = both.select(*keys, "_a", "_b")
    first, second = (
        F.when((F.length("_a") < F.length("_b")) | ((F.length("_a") == F.length("_b")) & (F.col("_a") < F.col("_b"))), x).otherwise(y)
        for x, y in ((F.col("_a"), F.col("_b")), (F.col("_b"), F.col("_a")))
    )
    return both.mapInPandas(settle, both.schema).select(*keys, first.alias("t1"), second.alias("t2"))


def both_ways(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    return pairs.select(*keys, "t1", "t2").unionByName(
        pairs.select(*keys, F.col("t2").alias("t1"), F.col("t1").alias("t2"))
    )
