"""Token ids of whole batches, each distinct piece of text encoded once per worker.

The tokenizers never merge over a boundary that their own split pattern makes, and white space always makes one.
So a text is cut at ASCII white space as the pattern would cut it, the distinct pieces are encoded by the library,
and the ids are put together again. A text with other white space or with a special token's brackets is
encoded as it is.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from newsweft.llm.units import BYTE, SLICE_BYTES, SPACE, Runs, U, edges, flat, mix, slices

#: A worker forgets its pieces after so many.
MOST_PIECES = 2_000_000
#: Pieces encoded at a time.
TOGETHER = 10_000


_ascii = np.arange(256)
SMALL = np.where((_ascii >= 65) & (_ascii <= 90), _ascii + 32, _ascii).astype(np.uint8)
LETTER = (SMALL >= 97) & (SMALL <= 122)
CLOSING = np.zeros(256, bool)
CLOSING[list(b".,;:!?")] = True


class Numbers:
    """A number for each known key, looked up for whole arrays at once: a table of open slots, at most half full."""

    def __init__(self, room: int = 1 << 17):
        self.used, self.keys, self.values = 0, np.zeros(room, U), np.zeros(room, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is unknown. No key is zero."""
        out = np.full(len(keys), -1, np.int64)
        rest, slot = np.arange(len(keys)), keys & U(len(self.keys) - 1)
        while len(rest):
            held = self.keys[slot]
            hit = held == keys
            out[rest[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            rest, slot, keys = rest[on], (slot[on] + U(1)) & U(len(self.keys) - 1), keys[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Gives the next numbers to distinct new keys."""
        values = np.arange(self.used, self.used + len(keys), dtype=np.int32)
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            old = self.keys != 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            room = 1 << int(4 * self.used - 1).bit_length()
            self.keys, self.values = np.zeros(room, U), np.zeros(room, np.int32)
        slot = keys & U(len(self.keys) - 1)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            got = free & (self.keys[slot] == keys)
            self.values[slot[got]] = values[got]
            keys, values, slot = keys[~got], values[~got], (slot[~got] + U(1)) & U(len(self.keys) - 1)


class Pieces:
    """Ids of known pieces."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.keeps_space = Tokenizer.from_file(path), keeps_space
        special = {n: t.content for n, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|")}
        self.mark_id = max(special)
        self.mark = special[self.mark_id]
        # ASCII capitals may be made small beforehand where the tokenizer does so itself.
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("A") == "a"
        # Where the pattern leaves a word of ASCII letters as it is, but for the look of the space before it, the model can have it at once.
        word = " " * keeps_space + "abcXYZ"
        if self.folds:
            word = word.lower()
        parts = [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]
        self.blank = parts[0][:1] if keeps_space else " "
        self.direct = parts == [word.replace(" ", self.blank)]
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def add(self, keys: np.ndarray, texts: list[str], words: np.ndarray) -> None:
        """Encodes new pieces; ``words`` tells those that are a word of ASCII letters. The others go to the library as one text with
        a special token, which no piece holds, after each: it cuts the text before anything else is done, and one text costs
        far less than many short ones."""
        words = words & self.direct
        order = np.argsort(~words, kind="stable")
        split = int(words.sum())
        tokenize = self.tokenizer.model.tokenize
        for k in range(0, split, TOGETHER):
            some = order[k : min(k + TOGETHER, split)]
            found = [[t.id for t in tokenize(texts[i].replace(" ", self.blank))] for i in some.tolist()]
            self.hold(keys[some], np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64))
        for k in range(split, len(order), TOGETHER):
            some = order[k : k + TOGETHER]
            joined = self.mark.join([*(texts[i] for i in some.tolist()), ""])
            ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.nonzero(ids == self.mark_id)[0]
            self.hold(keys[some], np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1)

    def hold(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        n, grown = self.numbers.used, len(keys)
        while n + grown > len(self.first):
            self.first, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.numbers.add(keys)
        self.first[n : n + grown] = self.used + np.cumsum(count) - count
        self.count[n : n + grown] = count
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def alone(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each begins."""
        if self.numbers.used > MOST_PIECES:
            self.clear()
        odd_data = data
        if self.folds:
            data = SMALL[data]
        start, end, doc = self.cut(data, at)
        # A mark after an ASCII letter at the end of a piece is a piece of its own for the pattern too.
        tail = (end - start > 1) & CLOSING[data[end - 1]] & LETTER[data[end - 2]]
        start, end, doc = np.concatenate([start, end[tail] - 1]), np.concatenate([end - tail, end[tail]]), np.concatenate([doc, doc[tail]])
        order = np.argsort(start, kind="stable")
        start, end, doc = start[order], end[order], doc[order]
        odd = odd_texts(data, at)
        if odd.any():
            plain = ~odd[doc]
            start, end, doc = start[plain], end[plain], doc[plain]
        hashes = mix(Runs(BYTE[data]).of(start, end) ^ (end - start).astype(U))
        hashes[hashes == 0] = 1
        number = self.numbers.find(hashes)
        unknown = np.nonzero(number < 0)[0]
        if len(unknown):
            keys, one = np.unique(hashes[unknown], return_index=True)
            begin, stop = start[unknown[one]], end[unknown[one]]
            letters = np.concatenate([[0], np.cumsum(LETTER[data], dtype=np.int32)])
            spaced = data[begin] == 0x20
            raw = data.tobytes()
            texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(begin.tolist(), stop.tolist(), strict=True)]
            self.add(keys, texts, (letters[stop] - letters[begin] == stop - begin - spaced) & (stop - begin > spaced))
            number[unknown] = self.numbers.find(hashes[unknown])
        count = self.count[number]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[number] - before[:-1], count) + np.arange(before[-1])]
        starts = before[np.searchsorted(doc, np.arange(len(at)))]
        whole = np.nonzero(odd)[0]
        if not len(whole):
            return ids, starts
        raw = odd_data.tobytes()
        found = self.alone([raw[at[i] : at[i + 1]].decode("utf-8", "replace") for i in whole.tolist()])
        sizes = np.array([len(x) for x in found])
        ids = np.insert(ids, np.repeat(starts[whole], sizes), np.concatenate([np.asarray(x, np.uint32) for x in found]))
        grown = np.zeros(len(at), np.int64)
        grown[whole + 1] = sizes
        return ids, starts + np.cumsum(grown)

    def cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        solid = ~SPACE[data]
        start, end, doc = edges(solid, at)
        if not self.keeps_space:
            return start, end, doc
        # A space right before a word belongs to it. Of the white space left before a word the last character stands
        # alone if it is not a space; white space at the end of a text is one piece.
        gap, stop, gap_doc = edges(~solid, at)
        closes = stop == at[gap_doc + 1]
        blank = (data[stop - 1] == 0x20) & ~closes
        has = np.isin(start, stop[blank])
        start = start - has
        lone = ~closes & ~blank
        inner = np.where(closes, stop, stop - 1)
        some = inner > gap
        parts = [(start, end, doc), (gap[some], inner[some], gap_doc[some]), (stop[lone] - 1, stop[lone], gap_doc[lone])]
        start, end, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], end[order], doc[order]


def odd_texts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts with white space beyond ASCII, or with the opening of a special token."""
    n = len(data)
    out = np.zeros(len(at) - 1, bool)
    if n < 2:
        return out
    a, b = data[:-1], data[1:]
    c = np.append(data[2:], 0)
    # U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000, and "<|".
    found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    found |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) & (c >= 0x80) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    found |= (a == 0x3C) & (b == 0x7C)
    hits = np.nonzero(found)[0]
    out[np.searchsorted(at, hits, "right") - 1] = True
    return out


_pieces: dict[tuple[str, bool], Pieces] = {}


def encoded(texts: pa.Array, path: str, keeps_space: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, text after the last, ids and places of each slice of a batch; a null is an empty text."""
    if (path, keeps_space) not in _pieces:
        _pieces[path, keeps_space] = Pieces(path, keeps_space)
    pieces = _pieces[path, keeps_space]
    buf, at = flat(texts)
    for i, j, data, places in slices(buf, at, SLICE_BYTES):
        yield i, j, *pieces.encode(data, places)


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with one more after each text."""
    return np.insert(ids, at[1:], end), at + np.arange(len(at))
