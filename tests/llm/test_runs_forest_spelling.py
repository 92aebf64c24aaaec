"""Periodic runs, the projection forest and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from newsweft.llm.forest import Forest, nearest_vectors
from newsweft.llm.periodic import periodic_runs, runs_of
from newsweft.llm.queries import QUERIES, op11_periodic_runs, with_loops
from newsweft.llm.spelling import cell_pairs, roots, spelling_variants, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    out = []
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            part = words[i : i + n]
            if n >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_texts():
    rng = random.Random(4)
    texts = [None, "", " \n", "one", "x " * 300, "a b " * 3, "a b a b a b a b", "été été " * 5]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            block = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += (block * 9)[: rng.randint(0, 60)] if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    # Every gram of the block stands in it twice.
    parts = {"a": [f"p{i}" for i in range(7)], "b": [f"q{i}" for i in range(7)]}
    texts.append(" ".join(w for c in "aaababbb" * 5 for w in parts[c]))
    # Two sequences that polynomial hashes modulo a power of two can't tell apart.
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    texts.append(" ".join("ab"[x] for x in morse) + " " + " ".join("ba"[x] for x in morse))
    return texts


@pytest.fixture(scope="module")
def run_rows():
    rows = list(enumerate(run_texts()))
    return [*rows, rows[9], (None, rows[10][1])]


def test_periodic_runs(spark, run_rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in run_rows], "doc_id long, text string, starts string, n_words int")
    got = sorted(map(repr, ((r.doc_id, r.n_words, list(zip(r.starts, r.lengths, r.periods)), r.collapsed) for r in periodic_runs(df).collect())))
    want = []
    for i, t in run_rows:
        words = WORD.findall(t or "")
        runs = plain_runs(words) if len(words) < 3000 else None
        if runs is None:
            s, n, q = runs_of(np.array([hash(w) for w in words]) % 2**31, np.array([0, len(words)]))
            runs = list(zip(s.tolist(), n.tolist(), q.tolist()))
            assert all(words[a : a + b - c] == words[a + c : a + b] for a, b, c in runs)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append(repr((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone))))
    assert got == sorted(want)
    assert periodic_runs(df.limit(0)).count() == 0


def test_loops_of_the_query(spark, run_rows):
    rows = [(i, t) for i, t in run_rows] + [(1000 + i, " ".join(f"w{k}" for k in range(i))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(repr((r.doc_id, WORD.findall(r.text or ""))) for r in with_loops(df).collect())
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        want.append(repr((i, words)))
    assert got == sorted(want)


def test_digests_of_runs(spark, sf_dir):
    for r in op11_periodic_runs(spark, sf_dir).collect():
        assert (r.n_runs == 0) == (r.length is None) == (r.runs_sha256 == hashlib.sha256(b"").hexdigest())
        assert r.length is None or (r.length >= max(6, 4 * r.period) and r.exponent_milli == 1000 * r.length // r.period)


def test_tree_walk_finds_the_home_leaves():
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((300, 8))
    forest = Forest(rows, np.arange(300), 5, 10)
    leaves = forest.leaves(rows)
    for i in range(0, 300, 30):
        visited, seen = forest.visited(rows[i], 0.01)
        assert all(leaf // (forest.inner + 1) < 5 for leaf in visited)
        first = visited[0]
        assert leaves[i, first // (forest.inner + 1)] == first % (forest.inner + 1)
        everything, seen = forest.visited(rows[i], 1.0)
        assert seen == 2**300 - 1
        exact = np.sort(np.delete(rows, i, axis=0) @ rows[i])[-7]
        assert exact - 1e-6 < forest.floor(rows[i], i, seen, 7) <= exact


def vector_rows():
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6)]) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(90)]
    rows += [(700, None), (701, []), (702, [0.0] * 6), (703, [1.0, None, 0.0, 0.0, 0.0, 1.0]), (704, [math.nan] * 6), (705, [math.inf] + [1.0] * 5),
             (706, [1.0, 2.0]), (None, [1.0] * 6), rows[5], rows[5], (720, None), (740, [0.0] * 6)]
    return rows


@pytest.mark.parametrize("share, block", [(1.0, 4096), (1.0, 16), (0.6, 16)])
def test_nearest_vectors(spark, share, block):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, leaves string, query_id int")
    got = nearest_vectors(df, df.where("vec_id % 20 = 0"), 20, trees=6, sample=64, leaf=4, share=share, block=block).collect()
    use = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)}
    hits = 0
    for q in (i for i in use if i % 20 == 0):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        want = sorted(((-(use[q] * v).sum(), i) for i, v in use.items() if i != q))[:20]
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(r.score == (use[q] * use[r.vec_id]).sum() for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({i for _, i in want} & {r.vec_id for r in mine})
        if share == 1.0:
            assert [r.vec_id for r in mine] == [i for _, i in want]
    assert hits >= 0.9 * 20 * len({r.query_id for r in got})
    assert {r.query_id for r in got} == {i for i in use if i % 20 == 0}


def test_nearest_vectors_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert nearest_vectors(*[spark.createDataFrame([], kind)] * 2).count() == 0
    two = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 1.0])], kind)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest_vectors(two, two.where("vec_id = 20")).collect()] == [(20, 1, 1, 1.0)]


def test_recall_on_the_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    use = {r.vec_id: np.array(r.embedding, float) for r in rows}
    ids, all_vectors = np.array(list(use)), np.stack(list(use.values()))
    got = QUERIES["op12_projection_forest"](spark, sf_dir).collect()
    hits = total = 0
    for q in (i for i in use if i % 20 == 0):
        scores = np.where(ids == q, -np.inf, all_vectors @ use[q])
        want = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits += len(want & {r.vec_id for r in got if r.query_id == q})
        total += 20
    assert hits >= 0.9 * total


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def small_words(seed, n):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abéÿ") for _ in range(rng.randint(2, 7))) for _ in range(n)})


def test_suffix_array():
    rng = random.Random(6)
    for _ in range(100):
        text = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 40))] + [0])
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("seed", range(8))
def test_pairs_of_a_cell(seed):
    words = small_words(seed, 40)
    counts = np.arange(len(words))
    got = sorted(x for first in (True, False) for x in zip(*cell_pairs(words, counts, words, counts, first), strict=True))
    assert got == sorted((a, b, words.index(b)) for a in words for b in words if near(a, b))


@pytest.mark.parametrize("block", [4096, 7])
def test_spelling_variants(spark, block):
    rng = random.Random(5)
    counts = {w: rng.choice([1, 1, 2, 2, 4, 8, 16, 40]) for w in small_words(11, 150)}
    rows = [(w, n, 0) for w, n in counts.items()] + [(None, 3, 0), ("zz", None, 0)]
    # A repeated row of a word adds up.
    rows += [("abab", 5, 0), ("abab", 6, 0), ("a", 9, 0), ("", 2, 0)]
    counts["abab"] = counts.get("abab", 0) + 11
    counts |= {"a": 9, "": 2}
    got = {r.word: r for r in spelling_variants(spark.createDataFrame(rows, "word string, n int, near int"), block=block).collect()}
    assert set(got) == set(counts)
    form = {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x) and len(w) > 1 and len(x) > 1]
        best = min(around, key=lambda x: (-counts[x], x)) if around else None
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n, len(around), form[w], counts.get(form[w]) if form[w] else None)
    for w in counts:
        end = w
        while form[end] is not None:
            end = form[end]
        assert got[w].root == end
    assert len({got[w].root for w in counts}) < len(counts)


def test_roots_of_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(30)]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w30" for w, _ in chain}


def test_spelling_of_nothing(spark):
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_the_query(spark):
    from newsweft.llm.queries import spelled

    rng = random.Random(3)
    stock = ["Straße", "ÉTUDE", "kilometre", "Words", "abcd", "naïvely"]
    rows = [(i if i % 17 else None, " ".join(rng.choice(stock) + rng.choice(["", ".", "1"]) for _ in range(30)) if i % 13 else None) for i in range(300)]
    got = {r.word: r.n for r in spelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                want[run] = want.get(run, 0) + 1
    assert got == {w: n for w, n in want.items() if n >= 3} and any(w.startswith("É") for w in got)
