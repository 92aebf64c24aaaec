"""The training-data operators against plain Python on small tables with nulls, ties, copies and clashing columns."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsweft.llm.alignment import benchmark_copies
from newsweft.llm.archive import archive_pages, read_records, warc_record, write_archive
from newsweft.llm.hostpaths import Page, host_paths, main_texts
from newsweft.llm.huffman import canonical, checksum, code_lengths, decoding_table, from_bits, huffman_store, stretch_sizes, to_bits
from newsweft.llm.lyndon import lyndon_groups, suffix_array
from newsweft.llm.packing import fillings, make_plan, nonnegative, pack
from newsweft.llm.repetition import keep_clean, repetition_rules
from newsweft.llm.shards import least_loaded, lpt_shards
from newsweft.llm.substring import substring_dedup
from newsweft.llm.suffixdedup import suffix_dedup
from newsweft.llm.weighted import components, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside.
EXTRA = ("part", "bucket", "key", "size", "row", "number", "file", "kept", "shard", "ids", "_range")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(1, 7))) for _ in range(n))


def sample_texts():
    rng = random.Random(11)
    passage = sentence(rng, 60)
    texts = [None, "", " \n\t ", "one", "a b c d", "é" * 70, "x" * 400, "ab " * 90, passage, passage, passage + " " + sentence(rng, 30)]
    texts += [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    for k in range(12):
        words = (sentence(rng, 20) + " " + passage + " " + sentence(rng, 20)).split()
        for _ in range(k):
            words[rng.randrange(len(words))] = "zz"
        texts.append("  ".join(words))
    long = sentence(rng, 400)
    texts += [long, long.replace(" ", "\n", 3), long + " end", " ".join(w if i % 97 else "edit" for i, w in enumerate(long.split())), long]
    texts += ["same line here\nsame line here\nother # line $", "<|endoftext|> it's  odd 　 space"]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = sample_texts()
    found = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    return [*found, found[8], (None, texts[30])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", None, None if t is None else len(t), *("x",) * len(EXTRA)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_suffix_order_of_small_texts():
    rng = random.Random(5)

    def plain(units):
        def key(i):
            out = []
            while units[i]:
                out.append((1, units[i]))
                i += 1
            return [*out, (0, i)]

        return sorted(range(len(units)), key=key)

    for _ in range(400):
        units = []
        for _ in range(rng.randint(0, 5)):
            top = rng.choice([1, 2, 3, 26])
            units += [rng.randint(1, top) for _ in range(rng.randint(0, 14))] + [0]
        assert suffix_array(units) == plain(units)


def test_groups_are_longest_lyndon_prefixes():
    units = [2, 1, 2, 1, 3, 1, 2, 0]
    group, size, _ = lyndon_groups(units)
    lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    for i in range(len(units) - 1):
        want = max(n for n in range(1, len(units) - i) if lyndon(units[i : i + n]))
        assert size[i] == want
    assert len(group) == len(units)


def covered(words, width):
    seen = collections.Counter(tuple(words[p : p + width]) for p in range(len(words) - width + 1))
    marks = [False] * len(words)
    for p in range(len(words) - width + 1):
        if seen[tuple(words[p : p + width])] > 1:
            marks[p : p + width] = [True] * width
    return sum(marks)


def test_repetition_rules(docs, rows, nothing):
    got = sorted(map(tuple, repetition_rules(docs).collect()), key=str)
    want = []
    for i, t in rows:
        text = t or ""
        words = WORD.findall(text)
        longest = 0
        for n in range(8, len(words)):
            seen = [tuple(words[p : p + n]) for p in range(len(words) - n + 1)]
            if len(set(seen)) == len(seen):
                break
            longest = n
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n, again, deep = len(words), covered(words, 5), covered(words, 8)
        failed = n < 10 or 100 * again > 20 * n
        kept = not failed and 100 * deep <= 25 * n and longest < 60
        want.append((i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), again, failed, kept, deep, longest))
    assert got == sorted(want, key=str)
    kept = keep_clean(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(w[7] for w in want)
    assert repetition_rules(nothing).count() == 0 and keep_clean(nothing).count() == 0


def test_suffix_dedup(docs, rows, nothing):
    got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, list(zip(r.span_starts, r.span_ends, strict=True))) for r in suffix_dedup(docs).collect()), key=str)
    owner = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            owner[w] = min(owner.get(w, math.inf), math.inf if i is None else i)
    want = []
    for i, t in rows:
        data = (t or "").encode()
        marks = bytearray(len(data))
        for p in range(len(data) - 49):
            if owner[data[p : p + 50]] < (math.inf if i is None else i):
                marks[p : p + 50] = b"\1" * 50
        want.append((i, bytes(c for c, m in zip(data, marks, strict=True) if not m), len(data), sum(marks), [m.span() for m in re.finditer(b"\1+", bytes(marks))]))
    assert got == sorted(want, key=str)
    assert any(w[3] for w in want)
    assert suffix_dedup(nothing).count() == 0


def test_substring_dedup(docs, rows, nothing):
    found = substring_dedup(docs, carry=["lang", "source", "size"]).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, r.lang, r.source, r["size"]) for r in found), key=str)
    first = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for p in range(len(words) - 19):
            k = tuple(words[p : p + 20])
            first[k] = min(first.get(k, (math.inf, math.inf, 0)), (math.inf if i is None else i, p))
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        marks = [False] * len(words)
        for p in range(len(words) - 19):
            if first[tuple(words[p : p + 20])] < (math.inf if i is None else i, p):
                marks[p : p + 20] = [True] * 20
        want.append((i, len(words), sum(marks), " ".join(w for w, m in zip(words, marks, strict=True) if not m), "en", None, "x"))
    assert got == sorted(want, key=str)
    assert substring_dedup(nothing).count() == 0


def test_near_duplicates(docs, rows, nothing):
    got = collections.Counter(map(tuple, near_duplicates(docs).collect()))
    n = len(rows)
    shingles = {}
    for _, t in rows:
        words = WORD.findall(t or "")
        shingles[t or ""] = collections.Counter(tuple(words[p : p + 5]) for p in range(len(words) - 4)) if len(words) >= 5 else collections.Counter([tuple(words)] if words else [])
    held = collections.Counter(g for s in shingles.values() for g in s)
    weight = {t: {g: c * (1 + 0.25 * math.log(n / held[g]) / math.log(n)) for g, c in s.items()} for t, s in shingles.items()}
    texts = list(shingles)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in range(len(texts)):
        for b in range(a):
            x, y = weight[texts[a]], weight[texts[b]]
            both = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
            if both and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                root[find(texts[a])] = find(texts[b])
    least = {}
    for i, t in rows:
        if i is not None:
            r = find(t or "")
            least[r] = min(least.get(r, i), i)
    want = collections.Counter((i, least.get(find(t or ""))) for i, t in rows)
    assert got == want
    assert near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_star(spark):
    """Copies of one original edited apart: each is near the original only, so all have to be found through it."""
    rng = random.Random(5)
    original = sentence(rng, 300).split()
    texts = [" ".join(original)]
    for _ in range(300):
        words = list(original)
        for p in rng.sample(range(5, 295, 12), 5):
            words[p] = f"edit{rng.random()}"
        texts.append(" ".join(words))
    # A chain: each is near its neighbours, the ends are not near each other.
    words = sentence(rng, 300).split()
    for k in range(40):
        texts.append(" ".join(words))
        for p in range(7 + k, 300, 60):
            words[p] = f"step{k}.{p}"
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    shingles = [collections.Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4)) for w in map(str.split, texts)]
    held = collections.Counter(g for s in shingles for g in s)
    weight = {g: 1 + 0.25 * math.log(len(texts) / n) / math.log(len(texts)) for g, n in held.items()}
    total = [sum(c * weight[g] for g, c in s.items()) for s in shingles]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = 0
    for a in range(len(texts)):
        for b in range(a):
            both = sum(min(c, shingles[b][g]) * weight[g] for g, c in shingles[a].items() if g in shingles[b])
            if both and both >= 0.8 * (total[a] + total[b] - both):
                pairs += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert 300 <= pairs < 1000
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 80)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(k, 0) for k in range(1, 41)} | {(90, 80), (100, 80)}


def test_least_loaded_is_greedy():
    rng = random.Random(2)
    for _ in range(500):
        loads = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        size, count = rng.randint(1, 9), rng.randint(0, 120)
        heap, got = [(v, k) for k, v in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            v, k = heapq.heappop(heap)
            got[k] += 1
            heapq.heappush(heap, (v + size, k))
        assert least_loaded(loads, size, count) == got


def test_lpt_shards(docs, rows, nothing):
    found = lpt_shards(docs, 4).collect()
    assert len(found) == len(rows)
    text_of = collections.defaultdict(set)
    for i, t in rows:
        text_of[i].add(t or "")
    by_text, loads = collections.defaultdict(set), collections.Counter()
    for r in found:
        if len(text_of[r.doc_id]) == 1:
            (t,) = text_of[r.doc_id]
            assert (r["size"], r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
            by_text[t].add(r.shard)
        loads[r.shard] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    groups = collections.Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    heap = [0] * 4
    for v in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + v)
    assert sorted(loads.values()) == sorted(heap)
    for k in range(4):
        slots = sorted(r.slot for r in found if r.shard == k)
        assert slots == list(range(len(slots)))
    assert lpt_shards(nothing, 4).count() == 0


@pytest.mark.parametrize("count", [0, 1, 2, 5, 300, 4000])
def test_huffman_codes(count):
    rng = np.random.default_rng(3)
    counts = (rng.pareto(0.6, count) * 10).astype(np.int64) + 1
    free = code_lengths(counts, 60)
    heap = counts.tolist()
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert count < 2 or int((free.astype(np.int64) * counts).sum()) == total
    lengths = code_lengths(counts, 12)
    assert count < 2 or abs(sum(2.0 ** -int(n) for n in lengths) - 1) < 1e-9
    assert not count or lengths.max() <= 12
    if count:
        ids = rng.choice(count, 5000).astype(np.uint32)
        at = np.array([0, 0, 1, 257, 513, 2000, 2000, 5000])
        bits, _, offsets, first = to_bits(ids, at, canonical(lengths), lengths)
        byte_at = to_bits(ids, at, canonical(lengths), lengths)[1]
        whole = offsets + 8 * np.repeat(byte_at[:-1], np.diff(first))
        for back in from_bits([(stretch_sizes(np.diff(at)), whole, bits)] * 2, decoding_table(lengths)):
            assert (back == ids).all()


def test_huffman_store(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted((tuple(r) for r in checksum(huffman_store(docs, path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(path)
    ids = {(i, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    plain = {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in ids.items()}
    assert {(i, n, c) for i, _, n, c in got} == plain and len(got) == len(rows)
    at = 0
    for i, start, n, _ in got:
        assert start == at
        at += n
    assert [r[0] for r in got] == [i for i, _ in in_order(rows)]
    assert huffman_store(nothing, path).count() == 0


def test_packing(docs, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    window = 64
    found = pack(docs, path, window=window, step=4).collect()
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), window):
            piece = ids[at : at + window]
            want[i, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert pack(nothing, path).count() == 0


def test_packing_plan():
    assert set(fillings(6)) == {(6,), (3, 3), (4, 2), (5, 1), (2, 2, 2), (3, 2, 1), (4, 1, 1)}
    a = np.array([[2.0, 1, 0], [0, 1, 3], [1, 0, 1]])
    x = nonnegative(a, np.array([4.0, 7, 3]))
    assert (x >= 0).all() and np.abs(a.T @ (a @ x - [4.0, 7, 3]))[x > 0].max() < 1e-9
    rng = np.random.default_rng(0)
    counts = np.concatenate([[0], rng.integers(0, 60, 32)])
    plan = make_plan(counts, 32)
    room = collections.Counter()
    for u in range(1, 33):
        for number in range(counts[u]):
            at = np.searchsorted(plan.key, (u << 48) + number, "right") - 1
            assert plan.key[at] >> 48 == u
            room[int(plan.window[at] + ((u << 48) + number - plan.key[at]) // plan.times[at])] += u
    assert max(room.values()) <= 32 and set(room) == set(range(plan.windows))
    assert plan.windows <= 1.1 * math.ceil((counts * np.arange(33)).sum() / 32) + 1


PAGES = "page_id long, url string, html string, host string, payload string, sha256 string, header string"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    around = '<nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad-box">buy <p>this</p></div>{}<div class="comments"><p>I like it</p></div><footer>&copy; me</footer>'
    big = "<p>word " + "many words " * 200 + "</p>"
    rows = [
        (k, f"https://a.example/{k}", page(around.format(f"<div class='post-{k}'><h1>Head {k}</h1><p>One <b>two</b>\n three &amp; four.<br>five</p><p> six </p></div>"))) for k in range(5)
    ]
    rows += [(10, "http://b.example", None), (11, None, ""), (12, "http://b.example/q", "no tags  at all &lt;"), (13, "http://c.example", big), (14, "http://c.example/2", big), (9, "http://c.example/3", big)]
    rows += [(15, "http://d.example", "<p>short</p>"), (16, "http://d.example", "<p>short</p>"), (None, "http://c.example/4", big)]
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], PAGES)


def test_main_texts(pages, spark):
    got = {r.page_id: (r.text, r.n_chars) for r in main_texts(pages).collect()}
    for k in range(5):
        assert got[k][0] == f"Head {k}\nOne two three & four. five\nsix"
    assert got[10] == ("", 0) and got[11] == ("", 0)
    assert got[12][0] == "no tags at all <"
    assert got[15] == ("short", 5) and len(got) == pages.count()
    assert dict(host_paths(pages).collect())["a.example"][0] == "/html/body/div.post"
    assert main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_archive(pages, spark, tmp_path):
    got = {r.page_id: r for r in archive_pages(pages).collect()}
    for r in pages.collect():
        data = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert [(k, got[k].record_type, got[k].refers_to) for k in (9, 13, 14, None)] == [(9, "revisit", 14), (13, "revisit", 14), (14, "response", None), (None, "revisit", 14)]
    assert got[15].record_type == got[16].record_type == "response"
    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0
    path = str(tmp_path / "warc")
    write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r.html or "" for r in pages.collect()})
    html = {r.page_id: r.html or "" for r in pages.collect()}
    for r in read_records(spark, path).select("page_id", warc_record().alias("record")).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest == rest[:size] + b"\r\n\r\n"
        assert rest[:size].decode() == ("" if b"revisit" in head else html[r.page_id])


def test_a_damaged_payload_stops_the_reader(pages, spark, tmp_path):
    path = str(tmp_path / "warc")
    write_archive(pages, path)
    damaged = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    damaged.write.parquet(f"{path}/2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/2/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        read_records(spark, f"{path}/2").collect()


def test_benchmark_copies(docs, nothing, spark):
    rng = random.Random(21)
    items = [(k, sentence(rng, n).replace(" ", ", ", 2)) for k, n in enumerate([40, 40, 15, 25, 3])] + [(7, None), (8, " ... "), (None, sentence(rng, 30))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")

    def around(t):
        return sentence(rng, 50) + "\n" + t + "\n" + sentence(rng, 50)

    edited = items[1][1].split()
    for k in (3, 11, 19, 20, 33):
        edited[k] = "changed"
    del edited[27]
    planted = [(5000, around(items[0][1].upper())), (5001, around(" ".join(edited))), (5002, around(items[2][1])), (5003, around(items[7][1])), (5004, around(" ".join(items[3][1].split()[:8]))), (None, items[3][1])]
    more = spark.createDataFrame(planted, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id, r.item_id): r.score for r in benchmark_copies(both, bench).collect()}
    assert set(got) >= {(5000, 0), (5001, 1), (5002, 2), (5003, None), (None, 3)}
    assert got[5000, 0] == got[5002, 2] == 1.0 and 0.6 < got[5001, 1] < 1
    assert not any(i in (0, 1, 2, 3, None) for d, i in got if d is not None and (d < 5000 or d == 5004))
    again = {(r.doc_id, r.item_id): r.score for r in benchmark_copies(both, bench, block_words=20).where("item_id <> 4 or item_id is null").collect()}
    assert again == {k: v for k, v in got.items() if k[1] != 4}
    assert benchmark_copies(nothing, bench).count() == 0 and benchmark_copies(docs, bench.limit(0)).count() == 0


def test_an_exact_copy_elsewhere_hides_no_edited_copy(spark):
    rng = random.Random(31)
    item = [f"w{k}" for k in range(20)]
    edited = [w if k % 5 != 4 else f"new{k}" for k, w in enumerate(item)]
    docs = [(k, sentence(rng, 30) + " " + " ".join(w) + " " + sentence(rng, 30)) for k, w in enumerate([item, edited])]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = lambda rows: {r.doc_id for r in benchmark_copies(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found(docs[1:]) == {1}
    assert found(docs) == {0, 1}


@pytest.mark.parametrize("mark", ["class='site-main has-sidebar'", "class='post no-comments'", "class='content with-menu'", "id='share-of-voice'", "class='content widget'"])
def test_main_container_is_no_surrounding(mark):
    found = Page(page(f"<div {mark}><p>{'words of the text ' * 20}</p></div><div class='comment-list'><p>me too</p></div><div class='ad'>buy</div>"))
    assert [line for _, line in found.blocks] == [("words of the text " * 20).strip()]
    beside = Page(page(f"<main class='widget'><p>one of the main</p><div {mark}>two</div></main><div class='comments'><p>me me</p></div>"))
    assert [line for _, line in beside.blocks][0] == "one of the main" and not any("me me" in line for _, line in beside.blocks)


def test_whole_articles(spark):
    long = "long words of the text " * 40
    bodies = {
        "a": f"<article><h1>Head</h1><p>lead</p><section><p>{long}</p></section><section><p>second</p></section></article>",
        "b": f"<div class=post><h1>Head</h1><div class=intro><p>{'intro ' * 20}</p></div><div class=body><p>{long}</p></div></div>",
        "c": f"<div class=post><h1>Head</h1><p>before</p><ul><li>{long}</li><li>{long}</li></ul><p>after</p></div>",
    }
    rows = [(10 * i + k, f"http://{h}.example/{k}", page(f"{b}<div class=comments>no</div>")) for i, (h, b) in enumerate(bodies.items()) for k in range(3)]
    got = {r.page_id: r.text.split("\n") for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    long = long.strip()
    for k in range(3):
        assert got[k] == ["Head", "lead", long, "second"]
        assert got[10 + k] == ["Head", ("intro " * 20).strip(), long]
        assert got[20 + k] == ["Head", "before", long, long, "after"]


def test_substring_dedup_keeps_the_layout(docs, rows):
    plain = {(r.doc_id, r.kept): r for r in substring_dedup(docs).collect()}
    for r in substring_dedup(docs, layout=True).collect():
        assert (r.doc_id, " ".join(WORD.findall(r.kept))) in plain
        if r.n_removed == 0:
            assert any(i == r.doc_id and (t or "") == r.kept for i, t in rows)
        else:
            assert any(i == r.doc_id and len(r.kept) < len(t or "") for i, t in rows)
