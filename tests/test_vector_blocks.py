"""Vector joins by cells and by blocks against brute force."""

import numpy as np
import pytest

from newsweft.operators import vectors


def table(spark, vecs, run=lambda i: 0):
    return spark.createDataFrame([(i * 3, run(i), [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, run int, vec array<double>")


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def clustered(seed, n):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(6, 24))
    return base[rnd.integers(6, size=n)] + rnd.normal(size=(n, 24)) * 0.05


@pytest.mark.parametrize("kind,threshold,cells", [("near", 0.99, True), ("far", 0.3, False)])
@pytest.mark.parametrize("same", [True, False])
def test_cells_only_where_they_part_rows(spark, monkeypatch, kind, threshold, cells, same):
    """Vectors far apart, which a row had a copy of in every cell before, are compared block by block."""
    vecs = clustered(1, 120) if kind == "near" else np.random.default_rng(2).normal(size=(120, 24))
    df = table(spark, vecs)
    used = []
    plain = vectors._with_cells
    monkeypatch.setattr(vectors, "_with_cells", lambda *a, **k: used.append(1) or plain(*a, **k))
    got = vectors.similar_pairs(df, df, threshold, ["run"], same=same, block_rows=10, pivots=30)
    cos = unit(vecs) @ unit(vecs).T
    want = sorted((i * 3, j * 3) for i, j in zip(*np.nonzero(cos >= threshold)) if not same or i < j)
    assert sorted((r.a, r.b) for r in got.collect()) == want and want
    assert bool(used) == cells


def test_number_of_blocks_does_not_grow_with_small_blocks(spark):
    """300 rows in blocks of 2 were 22,500 groups."""
    df = table(spark, np.random.default_rng(3).normal(size=(300, 8)))
    plan = vectors.similar_pairs(df, df, 0.9, ["run"], same=True, block_rows=2)
    vecs = np.array([r.vec for r in df.orderBy("id").collect()])
    cos = unit(vecs) @ unit(vecs).T
    assert plan.count() == int((np.triu(cos, 1) >= 0.9).sum())


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_nearest_of_each_block(spark, block_rows):
    vecs = clustered(4, 90)
    vecs[40] = vecs[50] = vecs[60]
    left, right = table(spark, vecs[:45], lambda i: i % 2), table(spark, vecs[45:], lambda i: i % 2)
    rows = vectors.similar_pairs(left, right, 0.5, ["run"], nearest=True, block_rows=block_rows).collect()
    assert len(rows) <= 45 * 8
    best = {}
    for r in rows:
        best[r.a] = min(best.get(r.a, (9, 0)), (-round(r.cos, 9), r.b))
    cos = unit(vecs[:45]) @ unit(vecs[45:]).T
    for i in range(45):
        near = [(-round(cos[i, j], 9), j * 3) for j in range(45) if i % 2 == j % 2 and cos[i, j] >= 0.5]
        assert best.get(i * 3) == min(near, default=None)
