"""Hashes of runs against plain numbers, and texts in Thue-Morse order, which a polynomial over a power of two can't tell apart."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsweft.llm.huffman import checksum, huffman_store
from newsweft.llm.packing import pack
from newsweft.llm.repetition import repetition_rules
from newsweft.llm.substring import substring_dedup
from newsweft.llm.tokens import encoded
from newsweft.llm.units import BASES, PRIME, STEP, Runs, U, Words, flat

LETTERS = 4096
DOCS = "doc_id long, text string"


def in_order_of_bits(one, other, n=LETTERS):
    return [(one, other)[bin(k).count("1") % 2] for k in range(n)]


TWINS = ["".join(in_order_of_bits(*x)) for x in ("ab", "ba")]


def test_runs_are_polynomials_over_the_field():
    values = np.random.default_rng(3).integers(0, 2**63, 2 * STEP + 700).astype(U) * U(2) + U(1)
    runs = Runs(values)
    spans = [(0, 40), (3, 3), (STEP - 5, STEP + 9), (len(values) - 30, len(values)), (7, 7 + STEP)]
    got = runs.of(*(np.array(x) for x in zip(*spans, strict=True)))
    for (a, b), h in zip(spans, got.tolist(), strict=True):
        parts = [sum((int(v) >> 33 if k == 0 else int(v) >> 2 & PRIME) * pow(base, i, PRIME) for i, v in enumerate(values[a:b])) % PRIME for k, base in enumerate(BASES)]
        assert h == parts[0] << 31 | parts[1]
    for width in (1, 9, STEP + 1):
        starts = np.arange(len(values) + 1 - width)
        assert (runs.windows(width) == runs.of(starts, starts + width)).all()
    assert len(runs.windows(len(values) + 2)) == 0 and len(Runs(values[:0]).windows(1)) == 0


def test_words_of_twins_differ():
    assert len(set(Words(*flat(pa.array(TWINS))).hash.tolist())) == 2


@pytest.mark.parametrize("name,keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_twins(name, keeps_space):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    texts = [*TWINS, " ".join(TWINS), TWINS[1]]
    found = [list(ids[a:b]) for _, _, ids, at in encoded(pa.array(texts), path, keeps_space) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_operators_on_twins(spark):
    words = [" ".join(in_order_of_bits(a, b, 2048)) for a, b in (("red", "blue"), ("blue", "red"))]
    texts = ["\n".join(TWINS), *TWINS, *words, "\n".join([*TWINS, TWINS[0]])]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rules = {r.doc_id: r for r in repetition_rules(docs).collect()}
    assert [rules[i].n_dup_lines for i in range(len(texts))] == [0, 0, 0, 0, 0, 1]

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    crc = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in checksum(huffman_store(docs, path)).collect()} == crc

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = {}
    for r in pack(docs, path).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for r in pieces[i]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in pieces[i]) == len(ids)

    first = {}
    for i, t in enumerate(texts):
        units = t.split()
        for p in range(len(units) - 19):
            first.setdefault(tuple(units[p : p + 20]), (i, p))
    for r in substring_dedup(docs).collect():
        units = texts[r.doc_id].split()
        gone = [False] * len(units)
        for p in range(len(units) - 19):
            if first[tuple(units[p : p + 20])] < (r.doc_id, p):
                gone[p : p + 20] = [True] * 20
        assert r.n_removed == sum(gone)
