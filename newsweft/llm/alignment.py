"""Benchmark passages in training texts: n-gram seeds, then local alignment.

All word n-grams of a test item are its seeds, so what is found in one text doesn't depend on others. Where a seed stands in a training
text, the words around it are aligned with the item (Smith-Waterman), so edited copies score too; stretches that hold too few of the
item's words for the least score are left out before. The items go out in blocks of bounded size, each block against all texts; no
text is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.units import Runs, U, Words, flat, grams, mix, slices

#: Words of a seed; words of items in a block; share of an item's best score that makes a copy.
SEED_WORDS, BLOCK_WORDS, LEAST_SCORE = 4, 1_000_000, 0.5
MATCH, MISMATCH, GAP = 1, -1, -1
FOUND = "doc_id long, item_id long, score double, first_word long, end_word long"

#: Letters, digits and everything beyond ASCII make words; ASCII capitals count as small letters.
_ascii = np.arange(256)
SMALL = np.where((_ascii >= 65) & (_ascii <= 90), _ascii + 32, _ascii).astype(np.uint8)
INSIDE = (_ascii >= 128) | ((_ascii >= 48) & (_ascii <= 57)) | ((SMALL >= 97) & (SMALL <= 122))


def plain_words(data: np.ndarray, at: np.ndarray) -> Words:
    data = SMALL[data]
    return Words(data, at, INSIDE[data])


def best_scores(items: np.ndarray, item_len: np.ndarray, texts: np.ndarray, text_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local alignment score of each pair of rows, and the column after the best one. All pairs go row by row together."""
    n, width = texts.shape
    held = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    inside = np.arange(1, width + 1)[None, :] <= text_len[:, None]
    for i in range(items.shape[1]):
        live = i < item_len
        same = (texts == items[:, i][:, None]) & inside
        new = np.zeros_like(held)
        new[:, 1:] = np.maximum(held[:, :-1] + np.where(same, MATCH, MISMATCH), held[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        # A gap in the item: the best of all columns before, less their distance.
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        np.maximum(new, 0, out=new)
        new[:, 1:][~inside] = 0
        held = np.where(live[:, None], new, held)
        top = held.argmax(axis=1)
        score = held[np.arange(n), top]
        better = live & (score > best)
        best[better], end[better] = score[better], top[better]
    return best, end


def item_words(items: DataFrame) -> DataFrame:
    """``item_id`` and the hashes of its words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("item_id")
            buf, at = flat(batch.column("text"))
            for i, j, data, places in slices(buf, at):
                words = plain_words(data, places)
                held = [words.hash[a:b].tobytes() for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([own.slice(i, j - i), pa.array(held, pa.binary()), pa.array(np.diff(words.at))], names=["item_id", "words", "n"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(split, "item_id long, words binary, n long").where("n > 0")


def item_grams(words: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, place and hash of all its n-grams; an item with fewer words has all of them as one."""
    item, place, key = [], [], []
    for k, w in enumerate(words):
        got = mix(Runs(w).windows(min(width, len(w)))) if len(w) >= width else mix(Runs(w).windows(len(w)) + U(len(w)))
        item.append(np.full(len(got), k))
        place.append(np.arange(len(got)))
        key.append(got)
    return np.concatenate(item), np.concatenate(place), np.concatenate(key)


def text_grams(words: Words, width: int, shorter: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of n-grams of the texts; ``shorter``: lengths below ``width`` that items have."""
    hashes, whole = grams(words, width)
    at = np.nonzero(whole)[0]
    yield at, hashes[at]
    for n in shorter:
        if len(words.hash) >= n:
            runs = mix(Runs(words.hash).windows(n) + U(n))
            at = np.nonzero(words.doc[: len(runs)] == words.doc[n - 1 :])[0]
            yield at, runs[at]


def copies_of(docs: DataFrame, ids: list[int | None], words: list[np.ndarray], seed_words: int, least_score: float) -> DataFrame:
    """Rows of the training texts that hold a copy of an item of the block."""
    item, place, key = item_grams(words, seed_words)
    shorter = sorted({len(w) for w in words if len(w) < seed_words})
    seeds = np.argsort(key, kind="stable")
    seed_key, seed_item, seed_place = key[seeds], item[seeds], place[seeds]
    length = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(length)])
    flat_words = np.concatenate(words)
    names = np.array([-1 if i is None else i for i in ids])
    nameless = np.array([i is None for i in ids])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("doc_id")
            buf, at = flat(batch.column("text"))
            for i, j, data, places in slices(buf, at):
                words = plain_words(data, places)
                hits = []
                for where, found in text_grams(words, seed_words, shorter):
                    low, high = np.searchsorted(seed_key, found, "left"), np.searchsorted(seed_key, found, "right")
                    n = high - low
                    s = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    hits.append((np.repeat(where, n), seed_item[s], seed_place[s]))
                pos, it, ipos = (np.concatenate(x) for x in zip(*hits, strict=True))
                if not len(pos):
                    continue
                slack = length[it] // 4 + 3
                doc = words.doc[pos]
                first = np.maximum(pos - ipos - slack, words.at[doc])
                last = np.minimum(pos - ipos + length[it] + slack, words.at[doc + 1])
                # Seeds of one item that lie close together make one stretch of the text.
                order = np.lexsort((first, it, doc))
                doc, it, first, last = doc[order], it[order], first[order], last[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (it[1:] != it[:-1]) | (first[1:] - first[:-1] > length[it[1:]])
                head = np.nonzero(fresh)[0]
                stop = np.maximum.reduceat(last, head)
                doc, it, first = doc[head], it[head], first[head]
                out = []
                by_size = np.argsort(length[it] * 4096 + (stop - first), kind="stable")
                for some in np.array_split(by_size, max(1, len(by_size) // 256)):
                    a = int(length[it[some]].max())
                    b = int((stop - first)[some].max())
                    rows = flat_words[np.minimum(start[it[some]][:, None] + np.arange(a)[None, :], len(flat_words) - 1)]
                    cols = words.hash[np.minimum(first[some][:, None] + np.arange(b)[None, :], len(words.hash) - 1)]
                    # The score is at most the number of the item's words that the stretch holds.
                    inside = np.arange(b)[None, :] < (stop - first)[some][:, None]
                    most = np.zeros(len(some), np.int64)
                    for k in range(a):
                        most += ((cols == rows[:, k, None]) & inside).any(axis=1) & (k < length[it[some]])
                    enough = most * MATCH >= least_score * MATCH * length[it[some]]
                    if not enough.any():
                        continue
                    some, rows, cols = some[enough], rows[enough], cols[enough]
                    score, end = best_scores(rows, length[it[some]], cols, (stop - first)[some])
                    share = score / (MATCH * length[it[some]])
                    good = share >= least_score
                    end = first[some] + end - words.at[doc[some]]
                    out.append((doc[some][good], it[some][good], share[good], np.maximum(end - length[it[some]], 0)[good], end[good]))
                if not out:
                    continue
                doc, it, share, begin, end = (np.concatenate(x) for x in zip(*out, strict=True))
                # One row for each text and item: its best copy.
                order = np.lexsort((begin, -share, it, doc))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (it[order][1:] != it[order][:-1])
                k = order[fresh]
                yield pa.RecordBatch.from_arrays(
                    [own.slice(i, j - i).take(pa.array(doc[k])), pa.array(names[it[k]], mask=nameless[it[k]]), pa.array(share[k]), pa.array(begin[k]), pa.array(end[k])],
                    names=["doc_id", "item_id", "score", "first_word", "end_word"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, FOUND)


def benchmark_copies(
    docs: DataFrame, items: DataFrame, seed_words: int = SEED_WORDS, least_score: float = LEAST_SCORE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row for each document row and item of which it holds a copy: the best score, as a share of the item's words, and where.

    Null and wordless texts and items match nothing. Null ids stay null; repeated rows of either side give rows each. Without
    documents, items or copies the result is empty. Other columns are not looked at.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    words = item_words(items)
    total = words.agg(F.sum("n")).head()[0] or 0
    blocks = -(-total // block_words)
    found = None
    for b in range(blocks):
        rows = words.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).collect()  # about block_words words
        if not rows:
            continue
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, bytes(r.words)))
        own = copies_of(docs, [r.item_id for r in rows], [np.frombuffer(bytes(r.words), U) for r in rows], seed_words, least_score)
        found = own if found is None else found.unionByName(own)
    return docs.sparkSession.createDataFrame([], FOUND) if found is None else found
