"""Clustering, vector joins and fuzzy titles against plain walks over small inputs."""

import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweft.functions.text import proper_nouns, title_keywords
from newsweft.operators import fuzzy, greedy, samestory, vectors
from newsweft.operators.dedup import accept_in_order
from newsweft.operators.linkage import link_progress
from newsweft.plans.titles_sql import similar_sql


def walk_clusters(order, near):
    clusters = []
    for x in order:
        for c in clusters:
            if all(near(x, m) for m in c):
                c.append(x)
                break
        else:
            clusters.append([x])
    return {x: c[0] for c in clusters for x in c}


@pytest.mark.parametrize("n,p,limit", [(60, 0.05, 10**6), (60, 0.5, 10**6), (24, 0.3, 5)])
def test_complete_link(spark, n, p, limit):
    rnd = random.Random(n + int(p * 100))
    pairs = [(g, g * 1000 + i, g * 1000 + j) for g in (0, 1) for i in range(n) for j in range(i + 1, n) if rnd.random() < p]
    if limit == 5:
        pairs = [x for x in pairs if x[0] == 0]
    near = {frozenset(x[1:]) for x in pairs}
    vertices = spark.createDataFrame([(g, g * 1000 + i, i) for g in (0, 1) for i in range(n)], "g int, id long, ord long")
    edges = spark.createDataFrame(pairs, "g int, a long, b long")
    got = {r.id: r.leader for r in greedy.complete_link(vertices, edges, "g", limit).collect()}
    want = {}
    for g in (0, 1):
        want |= walk_clusters([g * 1000 + i for i in range(n)], lambda a, b: frozenset((a, b)) in near)
    assert got == want


def test_no_chain(spark):
    vertices = spark.createDataFrame([(0, i, i) for i in range(3)], "g int, id long, ord long")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "g int, a long, b long")
    got = {r.id: r.leader for r in greedy.complete_link(vertices, edges, "g").collect()}
    assert got == {0: 0, 1: 0, 2: 2}


WORDS = ["rate", "cut", "bank", "vote", "floods", "flood", "deal", "court", "talks", "plan", "tax", "oil", "storm"]
NAMES = ["Ukraine", "Microsoft", "Federal Reserve", "Anthropic", "WTO", "Poland"]


def random_titles(rnd, n):
    out = []
    for _ in range(n):
        parts = rnd.sample(WORDS, rnd.randint(2, 6)) + rnd.sample(NAMES, rnd.choice([0, 0, 1, 2]))
        rnd.shuffle(parts)
        out.append(" ".join(parts))
    return out + out[: n // 4]


# Common keywords needed, and the part of the shorter title that makes one less do, by named sides.
NEEDED = {0: (4, 0.5), 1: (3, 0.5), 2: (4, 0.6)}


def same_story(a, b):
    (ka, pa), (kb, pb) = a, b
    if pa & pb:
        named = set(" ".join(pa | pb).split())
        events = [{w.rstrip("s") for w in k - named} for k in (ka, kb)]
        return not events[0].isdisjoint(events[1])
    need, part = NEEDED[bool(pa) + bool(pb)]
    common = len(ka & kb)
    return common >= need or (common == need - 1 and common / max(1, min(len(ka), len(kb))) >= part)


@pytest.mark.parametrize("seed", [1, 8, 64])
def test_story_pairs_and_clusters(spark, seed):
    rnd = random.Random(seed)
    titles = random_titles(rnd, 60)
    rows = [(i, "r", t, float(rnd.randint(0, 5)), f"s{i % 3}", i % 4 == 0, i % 3, i) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id long, run_key string, title string, score double, source string, reference boolean, feed_idx int, entry_idx int")
    feats = {r.id: (set(r.kw), set(r.pn)) for r in df.select("id", title_keywords(F.col("title")).alias("kw"), proper_nouns(F.col("title")).alias("pn")).collect()}
    sigs = samestory.title_signatures(samestory.title_features(df))
    got = {(r.a, r.b) for r in samestory.story_edges(sigs).collect()}
    reps = sorted(r.sig for r in sigs.collect())
    want = {(a, b) for a in reps for b in reps if a < b and same_story(feats[a], feats[b])}
    assert got == want and got

    if seed != 8:
        return
    clustered = df.join(samestory.cluster_stories(df), "id").cache()
    order = [r[0] for r in sorted(rows, key=lambda r: (-r[3], r[6], r[7]))]
    walked = walk_clusters(order, lambda a, b: same_story(feats[a], feats[b]))
    assert {r.id: r.cluster for r in clustered.collect()} == walked
    by_id = {r[0]: r for r in rows}
    for rep in samestory.boost_clusters(clustered).collect():
        members = [by_id[i] for i in order if walked[i] == rep.cluster]
        best = next((m for m in members if not m[5]), members[0])
        assert rep.id == best[0] and rep.cluster_size == len(members)
        assert rep.score == max(m[3] for m in members) + min((len(members) - 1) * 1.5, 3)
        others = [m for m in members if m[0] != rep.id]
        assert rep.cluster_titles == [f"{m[4]}: {m[2]}" for m in others[:4]]


def test_many_reworded_reports_of_one_story(spark):
    rnd = random.Random(12)
    stock = [f"{c}{v}{d}ing" for c in "bcdfglmnprst" for v in "aeiou" for d in "mnrt"]
    rows = [(i, "r", " ".join(["flood", "river", "bridge", "rescue", *rnd.sample(stock, 12)]), float(i % 7), 0, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, run_key string, title string, score double, feed_idx int, entry_idx int")
    found = samestory.cluster_stories(df).collect()
    assert len(found) == 1000 and len({r.cluster for r in found}) == 1


def test_stories_of_the_desk(spark):
    def clusters(titles):
        rows = [(i, "r", t, 1.0, 0, i) for i, t in enumerate(titles)]
        df = spark.createDataFrame(rows, "id long, run_key string, title string, score double, feed_idx int, entry_idx int")
        return samestory.cluster_stories(df).select("cluster").distinct().count()

    assert clusters(["Federal Reserve cuts rate by half point", "Federal Reserve announces rate cut", "Federal Reserve rate cut lifts shares"]) == 1
    assert clusters(["Microsoft and Anthropic sign cloud deal", "Microsoft sues Anthropic rival over patents"]) == 2
    assert clusters(["Ukraine launches counteroffensive in east", "Ukraine counteroffensive gains ground", "Stock markets rally on earnings"]) == 2


def vector_rows(spark, n, runs, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n // 3, 8))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + rnd.normal(size=8) * rnd.choice([0.0, 0.2, 0.5])
        rows.append((i, i % runs, i, [float(x) for x in v]))
    rows.append((n, 0, n, [0.0] * 8))
    rows.append((n + 1, 0, n + 1, None))
    return rows, spark.createDataFrame(rows, "id long, run int, ord long, vec array<double>")


def cos(a, b):
    a, b = np.array(a), np.array(b)
    d = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / d) if d else 0.0


@pytest.mark.parametrize("block_rows,pivots", [(2048, 32), (16, 5)])
def test_similar_pairs_and_merge(spark, block_rows, pivots):
    rows, df = vector_rows(spark, 90, 2, 5)
    got = vectors.similar_pairs(df.filter("vec is not null"), df.filter("vec is not null"), 0.86, ["run"], same=True, block_rows=block_rows, pivots=pivots)
    got = sorted((r.a, r.b) for r in got.collect())
    by = {r[0]: r for r in rows if r[3]}
    want = sorted((a, b) for a in by for b in by if a < b and by[a][1] == by[b][1] and cos(by[a][3], by[b][3]) >= 0.86)
    assert got == want and want
    merged = {r.id: r.cluster for r in vectors.merge_similar(df, "run", block_rows=block_rows, pivots=pivots).collect()}
    expected = {}
    for run in (0, 1):
        ids = [r[0] for r in rows if r[1] == run]
        expected |= walk_clusters(ids, lambda a, b: bool(by.get(a) and by.get(b)) and cos(by[a][3], by[b][3]) >= 0.86)
    assert merged == expected


def test_angles_do_not_chain(spark):
    rows = [(i, 0, i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate((0.0, 0.4, 0.8))]
    df = spark.createDataFrame(rows, "id long, run int, ord long, vec array<double>")
    assert vectors.merge_similar(df, "run", 0.9).select("cluster").distinct().count() == 2


def test_merge_groups(spark):
    rows = [(0, 0, 0, "a", "A", False, 5.0, 2, ["x: 1"], 0), (0, 0, 1, "b", "B", True, 9.0, 3, ["y: 1", "y: 2"], 1), (0, 2, 2, "c", "C", False, 1.0, 1, [], 2)]
    df = spark.createDataFrame(rows, "run int, cluster long, id long, source string, title string, reference boolean, score double, cluster_size long, cluster_titles array<string>, ord long")
    out = {r.cluster: r for r in vectors.merge_groups(df, ["run"]).collect()}
    assert (out[0].id, out[0].score, out[0].cluster_size) == (0, 12.0, 5)
    assert out[0].cluster_titles == ["x: 1", "b: B", "y: 1", "y: 2"]
    assert (out[2].score, out[2].cluster_size, out[2].cluster_titles) == (1.0, 1, [])


def test_links(spark):
    rows, df = vector_rows(spark, 60, 5, 9)
    got = {r.id: r.prev_id for r in link_progress(df, df, "run", block_rows=8, pivots=4).collect()}
    by = [r for r in rows if r[3] and any(r[3])]
    for x in by:
        past = [(cos(x[3], p[3]), -p[0]) for p in by if x[1] - 3 <= p[1] < x[1]]
        best = max(past, default=(0, 0))
        assert got.get(x[0]) == (-best[1] if best[0] >= 0.8 else None)
    kept = {r.id for r in vectors.drop_near_copies(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), ["run"]).collect()}
    want = {x[0] for x in rows if x[0] % 2 and not (x[3] and any(cos(x[3], b[3]) >= 0.84 for b in by if b[0] % 2 == 0 and b[1] == x[1]))}
    assert kept == want


def fuzzy_inputs(seed, n):
    rnd = random.Random(seed)
    letters = "abcdefgh"
    out = set()
    for _ in range(n):
        base = "".join(rnd.choice(letters) for _ in range(rnd.choice([5, 8, 12, 20, 40, 90, 110])))
        out.add(base)
        for _ in range(3):
            t = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 10))):
                i = rnd.randrange(len(t) + 1)
                if rnd.random() < 0.5 and t:
                    del t[min(i, len(t) - 1)]
                else:
                    t.insert(i, rnd.choice(letters))
            out.add("".join(t))
    return sorted(x for x in out if x)


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_titles(spark, seed):
    titles = fuzzy_inputs(seed, 25)
    df = spark.createDataFrame([(0, t) for t in titles], "d int, title_key string")
    got = {frozenset((r.t1, r.t2)) for r in fuzzy.similar_titles(df, ["d"]).collect()}
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    want = {frozenset((a, b)) for i, a in enumerate(titles) for b in titles[i + 1:] if ratio(a, b) >= 0.92}
    assert got == want and len(want) > 10


def long_titles():
    """Titles of 30,000 characters: a base, near copies, and another text of the same syllables; and one long repeat."""
    rnd = random.Random(8)
    syllables = ["".join(rnd.choice("abcdefghijklmnoprst") for _ in range(rnd.randint(2, 4))) for _ in range(400)]
    text = lambda n: "".join(rnd.choice(syllables) for _ in range(n))[: 3 * n]
    base = text(10_000)
    near = list(base)
    for i in range(0, len(near), 400):
        near[i] = "Z"
    far = "".join(c for i, c in enumerate(base) if i % 5)
    return [base, "".join(near), base[:-900] + "Ü", far, text(10_000), "ab" * 15_000, "ab" * 14_900 + "c"]


def test_fuzzy_titles_of_any_length(spark):
    titles = long_titles()
    df = spark.createDataFrame([(0, t) for t in titles], "d int, title_key string")
    got = {frozenset((r.t1, r.t2)) for r in fuzzy.similar_titles(df, ["d"]).collect()}
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    assert got == {frozenset((a, b)) for i, a in enumerate(titles) for b in titles[i + 1:] if ratio(a, b) >= 0.92} and got
    # Edits that the ratio does not forgive, as all letters of so long a title are common, are candidates all the same.
    named = df.withColumn("_id", F.col("title_key"))
    pairs = {frozenset((r.t1, r.t2)) for r in fuzzy.candidate_titles(named, ["d"], 0.08).collect()}
    assert {frozenset(titles[:2]), frozenset((titles[0], titles[2])), frozenset(titles[5:])} <= pairs
    assert not any(titles[3] in p or titles[4] in p for p in pairs)


def test_check_sql_of_similar_titles():
    rnd = random.Random(9)
    titles = set(fuzzy_inputs(4, 12))
    for n in (210, 260, 420):
        base = "".join(rnd.choice("abcdefghiklmnorstu" + "xyzäöé" * (rnd.random() < 0.2)) for _ in range(n))
        titles |= {base, base[: n // 2] + "qj" + base[n // 2 + 3 :], base[5:], "".join(c for i, c in enumerate(base) if i % 14)}
    con = duckdb.connect()
    con.execute("CREATE TABLE title (scope INT, k VARCHAR)")
    con.executemany("INSERT INTO title VALUES (0, ?)", [[t] for t in titles])
    got = {frozenset(r) for r in con.execute(f"WITH RECURSIVE {similar_sql()} SELECT a, b FROM sim").fetchall()}
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    want = {frozenset((a, b)) for a in titles for b in titles if a < b and ratio(a, b) >= 0.92}
    assert got == want and len(want) > 8


@pytest.mark.parametrize("limit", [10**6, 1])
def test_keep_first(spark, limit):
    rnd = random.Random(3)
    n = 40
    rows = [(i, i, 0, f"u{rnd.randrange(12)}", f"t{rnd.randrange(12)}" if i % 9 else "") for i in range(n)]
    titles = [f"t{i}" for i in range(12)]
    pairs = [(a, b) for a in titles for b in titles if a < b and rnd.random() < 0.1]
    both = [(0, a, b) for a, b in pairs] + [(0, b, a) for a, b in pairs]
    df = spark.createDataFrame(rows, "id long, ord long, d int, url_key string, title_key string")
    got = {r.id for r in greedy.keep_first(df, spark.createDataFrame(both, "d int, t1 string, t2 string"), "d", limit).collect()}
    kept = []
    linked = {frozenset(p) for p in pairs}
    for r in rows:
        if not any(r[3] == k[3] or (r[4] and (r[4] == k[4] or frozenset((r[4], k[4])) in linked)) for k in kept):
            kept.append(r)
    assert got == {k[0] for k in kept}


@pytest.mark.parametrize("limit", [10**6, 1])
def test_feed_order(spark, limit):
    rnd = random.Random(4)
    rows = [("r", i, i // 10, i, f"f{i // 10}", f"T{rnd.randrange(15)}", rnd.choice(["", f"l{rnd.randrange(20)}"])) for i in range(50)]
    df = spark.createDataFrame(rows, "run string, id long, feed_idx int, entry_idx int, source string, title string, link string")
    got = {r.id for r in accept_in_order(df, "run", 3, limit=limit).collect()}
    titles, links, count, want = set(), set(), {}, set()
    for r in rows:
        if count.get(r[4], 0) >= 3 or r[5] in titles or (r[6] and r[6] in links):
            continue
        want.add(r[1])
        titles.add(r[5])
        links.add(r[6])
        count[r[4]] = count.get(r[4], 0) + 1
    assert got == want
