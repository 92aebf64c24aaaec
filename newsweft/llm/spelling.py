"""Spelling variants: words one edit apart, by bidirectional search in FM-indexes of the vocabulary.

Two words one edit apart share one of two halves: the first ``m // 2`` code points or the last ``m - m // 2``, where ``m`` is
the length of the longer one. Words of length ``m`` and ``m - 1`` that share a half go to one cell, so a cell holds a bounded part
of the vocabulary whole. There the words, each between delimiters, are one text with an index of its suffixes and one of
its reversed suffixes. A query is matched exactly over one half, from the middle outwards to the delimiter; then the search turns and
goes on across the other half, where one replaced or one left-out code point is allowed. Intervals of suffix ranks
in both indexes say after each step which places are left. A word of one code point less is found from the longer word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.session import durable

#: Words of one cell's index, and queries of one cell.
BLOCK = 4096
DELIMITER = 1
NEAR = "word string, near string, near_n long"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text whose last symbol stands there only, by prefixes of doubled length."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        later = np.zeros(len(text), np.int64)
        if step < len(text):
            later[:-step] = rank[step:] + 1
        found, rank = np.unique(rank * (len(text) + 2) + later, return_inverse=True)
        if len(found) == len(text):
            return np.argsort(rank)
        step *= 2


class Side:
    """One direction: for each symbol and rank the occurrences before it in the transform, of it and of all smaller symbols."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_array(text)
        before = text[self.order - 1]
        marks = np.zeros((symbols, len(text) + 1), np.int32)
        marks[before, np.arange(1, len(text) + 1)] = 1
        self.count = np.cumsum(marks, axis=1, dtype=np.int32)
        self.less = np.cumsum(self.count, axis=0, dtype=np.int32) - self.count
        self.first = np.concatenate([[0], np.cumsum(self.count[:-1, -1])])

    def step(self, own: np.ndarray, other: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals after one more symbol on this side: here, on the other side, and their size."""
        at = self.count[symbol, own]
        return self.first[symbol] + at, other + self.less[symbol, own + size] - self.less[symbol, own], self.count[symbol, own + size] - at

    def choices(self, own: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which symbols (rows) go on from which intervals."""
        return self.count[:, own + size] > self.count[:, own]


class Index:
    """A bidirectional index of distinct words given as rows of code points, padded with zeros."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        #: 0 ends the text, 1 is the delimiter, the code points follow in their order.
        self.alphabet = np.unique(codes[codes > 0])
        rows = np.zeros((len(codes), codes.shape[1] + 1), np.int64)
        rows[:, 1:] = self.coded(codes)
        rows[:, 0] = DELIMITER
        inside = np.arange(rows.shape[1])[None, :] <= lengths[:, None]
        body = np.concatenate([rows[inside], [DELIMITER]])
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbols = len(self.alphabet) + 2
        self.forward = Side(np.concatenate([body, [0]]), symbols)
        self.backward = Side(np.concatenate([body[::-1], [0]]), symbols)
        self.size = len(body) + 1

    def coded(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes > 0, np.searchsorted(self.alphabet, codes) + 2, 0)

    def word_at(self, rank: np.ndarray) -> np.ndarray:
        """The word whose delimiter stands at the begin of the suffix of a rank."""
        return np.searchsorted(self.begin, self.forward.order[rank])


def near_words(index: Index, words: np.ndarray, lengths: np.ndarray, exact_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, indexed word): those that share the query's first half (else its last one) and differ by one replaced or
    left-out code point in the other. ``words`` are coded; a pair may be told twice."""
    half = lengths // 2
    low, high = (np.zeros_like(half), half) if exact_first else (half, lengths)
    n = len(words)
    query = np.arange(n)
    a, b, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.size)

    def extend(left: bool, a: np.ndarray, b: np.ndarray, size: np.ndarray, symbol: np.ndarray):
        if left:
            return index.forward.step(a, b, size, symbol)
        b, a, size = index.backward.step(b, a, size, symbol)
        return a, b, size

    # The exact half, from the middle outwards, then its delimiter.
    out = exact_first
    for k in range(int((high - low).max(initial=0)) + 1):
        place = high - 1 - k if out else low + k
        symbol = np.where(k < high - low, words[query, np.clip(place, 0, words.shape[1] - 1)], DELIMITER)
        live = k <= high - low
        na, nb, ns = extend(out, a, b, size, symbol)
        a, b, size = np.where(live, na, a), np.where(live, nb, b), np.where(live, ns, size)
        keep = size > 0
        query, a, b, size, low, high = query[keep], a[keep], b[keep], size[keep], low[keep], high[keep]
    # The other half the other way, with one error.
    back = not out
    side = index.forward if back else index.backward
    todo = np.where(exact_first, lengths[query] - half[query], half[query])
    done, wrong = np.zeros(len(query), np.int64), np.zeros(len(query), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(query):
        over = done == todo
        if over.any():
            last = over & wrong
            fa, _, fs = extend(back, a[last], b[last], size[last], np.full(int(last.sum()), DELIMITER))
            hit = fs > 0
            # Words are distinct, so the delimiters on both sides leave one place. Where the search went to the
            # right, the interval begins at the left delimiter as well.
            found.append((query[last][hit], index.word_at(fa[hit])))
            query, a, b, size, todo, done, wrong = (x[~over] for x in (query, a, b, size, todo, done, wrong))
            if not len(query):
                break
        place = half[query] + done if exact_first else half[query] - 1 - done
        symbol = words[query, place]
        na, nb, ns = extend(back, a, b, size, symbol)
        straight = ns > 0
        parts = [(query[straight], na[straight], nb[straight], ns[straight], todo[straight], done[straight] + 1, wrong[straight])]
        clean = ~wrong
        if clean.any():
            q, x, y, s, t, d = (v[clean] for v in (query, a, b, size, todo, done))
            parts.append((q, x, y, s, t, d + 1, np.ones(len(q), bool)))
            other, at = np.nonzero(side.choices(x if back else y, s)[2:])
            other = other + 2
            differs = other != symbol[clean][at]
            other, at = other[differs], at[differs]
            ea, eb, es = extend(back, x[at], y[at], s[at], other)
            parts.append((q[at], ea, eb, es, t[at], d[at] + 1, np.ones(len(at), bool)))
        query, a, b, size, todo, done, wrong = (np.concatenate(v) for v in zip(*parts, strict=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))  # type: ignore[return-value]


def code_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, padded with zeros, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max(initial=1))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width).astype(np.int64), lengths


def cell_pairs(words: list[str], counts: np.ndarray, asks: list[str], asked_counts: np.ndarray, exact_first: bool) -> tuple[list, list, list]:
    """``word, near, near's count`` of one cell: from each query to the words found, and back from those that are shorter."""
    codes, lengths = code_matrix(words)
    index = Index(codes, lengths)
    asked, sizes = code_matrix(asks)
    known = np.isin(asked, index.alphabet) | (asked == 0)
    # A code point that no indexed word holds is a symbol of its own that is never found.
    coded = np.where(known, index.coded(asked), 0)
    query, word = near_words(index, coded, sizes, exact_first)
    if not len(query):
        return [], [], []
    query, word = np.unique(np.stack([query, word], axis=1), axis=0).T
    out: tuple[list, list, list] = ([], [], [])
    for q, w in zip(query.tolist(), word.tolist()):
        ask, near = asks[q], words[w]
        # What also shares the first half has been found by it.
        if not exact_first and near.startswith(ask[: len(ask) // 2]):
            continue
        out[0].append(ask)
        out[1].append(near)
        out[2].append(int(counts[w]))
        if len(near) < len(ask):
            out[0].append(near)
            out[1].append(ask)
            out[2].append(int(asked_counts[q]))
    return out


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, near, near_n``: all pairs one edit apart, both ways, each once. ``words(word, n)``, distinct, of two code points or more."""
    size = F.length("word")

    def keys(m: Column) -> Column:
        first = F.floor(m / 2).cast("int")
        return F.array(
            F.struct(F.lit(True).alias("first"), m.alias("m"), F.substring(F.col("word"), F.lit(1), first).alias("half")),
            F.struct(F.lit(False).alias("first"), m.alias("m"), F.substring(F.col("word"), size - (m - first) + 1, m - first).alias("half")),
        )

    spread = words.select("word", "n", F.explode(F.concat(keys(size), keys(size + 1))).alias("key")).select("word", "n", "key.*")
    spread = durable(spread.withColumn("asks", F.col("m") == size))
    hot = spread.groupBy("first", "m", "half").agg(
        F.ceil(F.count("*") / block).cast("int").alias("word_blocks"), F.ceil(F.count_if("asks") / block).cast("int").alias("ask_blocks")
    ).where(F.col("word_blocks") > 1)
    bins = spread.count() // block + 1
    key = F.xxhash64("first", "m", "half")
    placed = spread.join(hot, ["first", "m", "half"], "left").withColumn(
        # A hot half has cells of its own.
        "bin", F.when(F.col("word_blocks").isNull(), F.pmod(key, F.lit(bins))).otherwise(bins + F.pmod(key, F.lit(2**40)))
    ).withColumns({c: F.coalesce(c, F.lit(1)) for c in ("word_blocks", "ask_blocks")})

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("word"), F.col(own)).cast("int").alias(own)
        return df.select("first", "bin", "word", "n", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    # New names tell the two sides apart for Spark.
    asked = dealt(placed.where("asks").toDF(*placed.columns), "ask_blocks", "word_blocks")
    held = dealt(placed, "word_blocks", "ask_blocks")
    cell = ("first", "bin", "word_blocks", "ask_blocks")

    def search(asks: pa.Table, rows: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if asks.num_rows and rows.num_rows:
            # A word may be here for two lengths.
            known = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
            found = cell_pairs(
                list(known), np.array(list(known.values())), asks.column("word").to_pylist(), asks.column("n").to_numpy(), asks.column("first")[0].as_py()
            )
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

    return asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(search, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of forms that begins at each word of ``forms(word, form)``.

    Each round follows the chain twice as far as the one before; counts at least double from word to form, so a chain is
    short and a few rounds end it.
    """
    now = durable(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = durable(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return now.select("word", "root")


def spelling_variants(words: DataFrame, least: int = 2, block: int = BLOCK) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of ``words(word, n)``.

    Words are near if one inserted, deleted or replaced code point turns one into the other. The form of a word is its near word
    with the largest count (ties: the smallest by code points) if that is at least ``least`` (over 1) times its own; the root is the end
    of the chain of forms, the word itself if it has none. Words have two code points or more. A null word or count is left
    out; repeated rows of a word are added up; other columns are not looked at.
    """
    words = durable(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_pairs(words.where(F.length("word") > 1), block)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = durable(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.minus") >= least * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.minus") >= least * F.col("n"), -F.col("best.minus")).alias("form_n"),
    ))
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
