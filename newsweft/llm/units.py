"""Texts of an Arrow batch as flat arrays: bytes, words, their hashes, and hashes of any run of them.

Everything here works on all texts of a batch at once. A hash of a run is the difference of two prefix sums of a polynomial, brought
back to power zero, over the prime field of 2**31 - 1 at two bases; each unit enters as two random numbers. Over a field no pattern of
units makes the difference of two runs vanish by itself, as it does over a power of two (words in Thue-Morse order).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd number that spreads keys over 64 bits.
BASE = U(0x9E3779B97F4A7C15)
#: The prime of the field, and two numbers whose powers run through all of it but zero.
PRIME, BASES = 2**31 - 1, (742_938_285, 950_706_376)
_PRIME, _BITS = U(PRIME), U(31)
#: Units worked on at once, so that they stay in the processor's cache.
STEP = 1 << 14
#: Fixed random odd numbers, one for each byte; the same on every machine.
BYTE = np.random.Generator(np.random.PCG64(20_240_229)).integers(0, 2**63, 256).astype(U) * U(2) + U(1)
#: The white space between words: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: So many bytes of text are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1_000_000

_powers: dict[int, np.ndarray] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """Makes the numbers smaller in place, with the same residues: below 2**32 if they were below 2**62."""
    upper = x >> _BITS
    x &= _PRIME
    x += upper
    return x


def least(x: np.ndarray) -> np.ndarray:
    """The residues, of numbers below twice the prime; a difference below zero is a very large number."""
    return np.minimum(x, x - _PRIME)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n, in the field; 32 bits each, as a long text needs many."""
    held = _powers.get(base, np.ones(1, np.uint32))
    while len(held) <= n:
        grown = held[: n + 1 - len(held) if n >= 1 << 20 else len(held)].astype(U)
        grown *= U(pow(base, len(held), PRIME))
        held = np.concatenate([held, least(fold(fold(grown))).astype(np.uint32)])
    _powers[base] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """All bits of a number depend on all bits of the other."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class Runs:
    """Hashes of runs of units, of 62 bits. Units are 64-bit numbers whose upper 31 bits, and the 31 bits from the third lowest on, are random."""

    def __init__(self, values: np.ndarray):
        self.sums, self.down = [], []
        n = len(values)
        ups = [powers(base, n) for base in BASES]
        self.down = [powers(pow(base, -1, PRIME), n) for base in BASES]
        self.sums = [np.zeros(n + 1, U) for _ in BASES]
        for k in range(0, n, STEP):
            some = values[k : k + STEP]
            for sums, up, part in zip(self.sums, ups, (some >> U(33), some >> U(2) & _PRIME), strict=True):
                part *= up[k : k + STEP][: len(some)]
                to = sums[k + 1 : k + 1 + len(some)]
                np.cumsum(fold(part), out=to)
                to += sums[k]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), U)
        for k in range(0, len(out), STEP):
            a, b = start[k : k + STEP], end[k : k + STEP]
            self.put(out[k : k + STEP], [(sums[b] - sums[a], down[a]) for sums, down in zip(self.sums, self.down, strict=True)])
        return out

    def windows(self, width: int) -> np.ndarray:
        """One for each start."""
        out = np.empty(max(0, len(self.sums[0]) - width), U)
        for k in range(0, len(out), STEP):
            j = min(k + STEP, len(out))
            self.put(out[k:j], [(sums[k + width : j + width] - sums[k:j], down[k:j]) for sums, down in zip(self.sums, self.down, strict=True)])
        return out

    @staticmethod
    def put(out: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for total, down in parts:
            fold(fold(total))
            total *= down
            fold(fold(total))
        upper, lower = (least(total) for total, _ in parts)
        np.left_shift(upper, _BITS, out=out)
        out |= lower


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = pa.concat_arrays(filled.chunks) if filled.num_chunks else pa.array([], pa.large_string())
    _, at, data = filled.buffers()
    if len(filled) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(buf: np.ndarray, at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, text after the last, their bytes and their places, of so many bytes at a time."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def edges(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the runs of bytes that are inside; none reaches over two texts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start = np.nonzero(first)[0]
    return start, np.nonzero(last)[0] + 1, np.searchsorted(at, start, "right") - 1


class Words:
    """The words of all texts: start and end in bytes, text, hash, and where each text's words begin."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None):
        self.start, self.end, self.doc = edges(~SPACE[buf] if inside is None else inside, at)
        self.hash = mix(Runs(BYTE[buf]).of(self.start, self.end)) if len(buf) else np.zeros(0, U)
        self.at = np.searchsorted(self.doc, np.arange(len(at)), "left")


def grams(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of ``width`` words at each word, and whether it lies in one text."""
    n = len(words.hash)
    hashes, whole = np.zeros(n, U), np.zeros(n, bool)
    if n >= width:
        hashes[: n - width + 1] = mix(Runs(words.hash).windows(width))
        whole[: n - width + 1] = words.doc[: n - width + 1] == words.doc[width - 1 :]
    return hashes, whole


def slide(a: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` (minimum or maximum) of each run of ``width`` values."""
    got, done = a, 1
    while done * 2 <= width:
        got = best(got[:-done], got[done:])
        done *= 2
    return best(got[: len(got) - (width - done)], got[width - done :]) if done < width else got


def repeated(keys: np.ndarray, docs: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Marks the entries that are whole and whose key stands at two or more entries of their text."""
    at = np.nonzero(whole)[0]
    out = np.zeros(len(keys), bool)
    if len(at) > 1:
        mixed = keys[at] ^ (docs[at].astype(U) * BASE)
        order = np.argsort(mixed)
        same = mixed[order][1:] == mixed[order][:-1]
        same &= docs[at][order][1:] == docs[at][order][:-1]
        twin = np.zeros(len(at), bool)
        twin[1:] |= same
        twin[:-1] |= same
        out[at[order[twin]]] = True
    return out


def spread(marks: np.ndarray, width: int) -> np.ndarray:
    """Marks every entry that a run of ``width`` beginning at a marked entry covers."""
    steps = np.zeros(len(marks) + width + 1, np.int32)
    steps[: len(marks)] += marks
    steps[width : width + len(marks)] -= marks
    return np.cumsum(steps)[: len(marks)] > 0


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the marks in each text, from where each text begins."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
