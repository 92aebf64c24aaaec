"""Exact cosine joins: merging, dropping near copies and nearest earlier reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.operators.greedy import complete_link
from newsweft.session import by_all_cores, durable

#: Rows of a block, blocks that a cell may be cut into whatever their rows, and pairs looked at together.
BLOCK_ROWS, LEAST_SLICES, CELLS = 49_152, 8, 2_000_000
#: Cells are used if a row of the sample has partners in this share of them at most.
PIVOTS, SAMPLE, MOST_NEAR = 32, 256, 0.25


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 when one of them is all zero; native, for few pairs."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _with_cells(df: DataFrame, pivots: np.ndarray, radius: float, outer: bool) -> DataFrame:
    """Cell of the nearest pivot; with ``outer`` also every cell that may hold a partner.

    A point within ``radius`` of a point of another cell lies within ``radius`` of the plane
    that halves the way between the two pivots.
    """
    spread = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)

    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            if len(rows) == 0:
                yield pd.Series([], dtype=object)
                continue
            cos = _unit(rows) @ pivots.T
            home = cos.argmax(axis=1)
            if not outer:
                yield pd.Series([[int(h)] for h in home])
                continue
            gap = cos[np.arange(len(home)), home][:, None] - cos
            near = gap <= radius * spread[home] + 1e-9
            near[np.arange(len(home)), home] = True
            yield pd.Series([np.flatnonzero(r).astype(np.int32) for r in near])

    return df.withColumn("cell", F.explode(cells("vec")))


def _sampled(df: DataFrame, count: int) -> np.ndarray:
    """A fixed number of vectors, chosen by hash; any vectors would give right results."""
    rows = df.select("vec").orderBy(F.xxhash64("id"), "id").limit(count).collect()
    return _unit(pd.Series([r["vec"] for r in rows])) if rows else np.zeros((0, 1))


def _pivot_rows(df: DataFrame, count: int, radius: float) -> np.ndarray:
    """The pivots, or none where a sampled row has partners in so many of their cells that cells would only copy it."""
    sample = _sampled(df, max(count, SAMPLE))
    pivots = np.unique(sample[:count], axis=0)
    if not len(pivots):
        return pivots
    cos = sample @ pivots.T
    home = cos.argmax(axis=1)
    spread = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)
    near = cos.max(axis=1, keepdims=True) - cos <= radius * spread[home] + 1e-9
    return pivots if near.mean() <= MOST_NEAR else pivots[:0]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a column of arrays."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, keys: Sequence[str], *, same: bool = False,
                  nearest: bool = False, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """All pairs of equal ``keys`` with cosine >= ``threshold``: ``keys, a, b, cos``.

    Both sides are ``(keys, id, vec)``; with ``same`` they are one table and each pair comes
    once, ``a < b``. A key with few rows is one dense product. A bigger one is cut into cells
    around pivots, if a row has partners in few of them: the right row goes to its own cell, the left row also to every cell close
    enough to hold a partner. Cells, or the key itself, are cut further into blocks of bounded size, so a key that
    holds a third of all rows is spread over many tasks; a block holds up to ``block_rows`` rows, or an eighth of a small cell.
    No pair is lost. With ``nearest`` a block tells only the best partner of each left row, of equal ones that with the smallest id.
    """
    keys = list(keys)
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    # Each side is read several times below, so it is stored once without its history.
    right = durable(right.select(*keys, "id", "vec"))
    left = right if same else durable(left.select(*keys, "id", "vec"))
    sizes_r = right.groupBy(*keys).agg(F.count("*").alias("n_r"))
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n_l")).join(sizes_r, keys).withColumn(
        "big", F.greatest("n_l", "n_r") > block_rows
    ).select(*keys, "big")
    left, right = left.join(sizes, keys), right.join(sizes, keys)
    points = _pivot_rows(right.filter("big"), pivots, radius)
    if len(points):
        whole = F.lit(-1)
        left = durable(_with_cells(left.filter("big"), points, radius, outer=True)).unionByName(
            left.filter("not big").withColumn("cell", whole)
        )
        right = durable(_with_cells(right.filter("big"), points, radius, outer=False)).unionByName(
            right.filter("not big").withColumn("cell", whole)
        )
    else:
        left, right = left.withColumn("cell", F.lit(-1)), right.withColumn("cell", F.lit(-1))

    cell_keys = [*keys, "cell"]
    most = F.greatest(F.lit(LEAST_SLICES), F.ceil(F.col("n") / BLOCK_ROWS))
    slices = F.least(F.ceil(F.col("n") / block_rows), most).cast("int")

    def sliced(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*cell_keys).agg(F.count("*").alias("n")).select(*cell_keys, slices.alias(name))

    grid = sliced(left, "g_l").join(sliced(right, "g_r"), cell_keys)
    slot = lambda g: F.pmod(F.xxhash64("id"), F.col(g)).cast("int")
    span = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    block = [*cell_keys, "i", "j"]
    columns = [*block, "side", "id", "vec"]
    # One table that is not cut into cells meets itself: every two blocks once.
    itself = F.lit(same) & (F.col("cell") == -1)
    once = left.where(itself).join(grid, cell_keys).withColumn("own", slot("g_l")).withColumn("other", span("g_l")).select(
        *cell_keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "vec",
    )
    lhs = left.where(~itself).join(grid, cell_keys).withColumn("i", slot("g_l")).withColumn("j", span("g_r")).withColumn("side", F.lit(0))
    rhs = right.where(~itself).join(grid, cell_keys).withColumn("j", slot("g_r")).withColumn("i", span("g_l")).withColumn("side", F.lit(1))
    dealt = lhs.select(*columns).unionByName(rhs.select(*columns))
    dealt = once.unionByName(dealt) if same else dealt

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        l, r = table.filter(pc.equal(table["side"], 0)), table.filter(pc.equal(table["side"], 1))
        halves = same and table["cell"][0].as_py() == -1
        if halves and table["i"][0] == table["j"][0]:
            r = l
        if not len(l) or not len(r):
            return
        r = r.sort_by("id")
        id_l, id_r = l["id"].to_numpy(), r["id"].to_numpy()
        vec_l, vec_r = _matrix(l["vec"]), _matrix(r["vec"])
        # Blocks of two numbers hold both orders of ids, all others only those asked for.
        ordered = same and not (halves and table["i"][0] != table["j"][0])
        step = max(1, CELLS // len(r))
        for at in range(0, len(l), step):
            cos = vec_l[at:at + step] @ vec_r.T
            if nearest:
                x, y = np.arange(len(cos)), cos.argmax(axis=1)
                x, y = x[cos[x, y] >= threshold], y[cos[x, y] >= threshold]
            else:
                hit = cos >= threshold
                if ordered:
                    hit &= id_l[at:at + step, None] < id_r[None, :]
                x, y = np.nonzero(hit)
            a, b = id_l[at + x], id_r[y]
            if same:
                a, b = np.where(a < b, a, b), np.where(a < b, b, a)
            found = {k: pa.repeat(table[k][0], len(x)) for k in keys}
            found |= {"a": pa.array(a, l["id"].type), "b": pa.array(b, l["id"].type), "cos": pa.array(cos[x, y])}
            yield pa.RecordBatch.from_pydict(found)

    fields = [f"{k} {left.schema[k].dataType.simpleString()}" for k in keys]
    fields += [f"{c} {left.schema['id'].dataType.simpleString()}" for c in ("a", "b")]
    return by_all_cores(dealt, *block).groupBy(*block).applyInArrow(match, ", ".join([*fields, "cos double"]))


def _distinct_vectors(df: DataFrame, keys: Sequence[str], order: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with pairwise different vectors, and the map of all rows to them."""
    firsts = df.groupBy(*keys, "vec").agg(F.min_by("id", order).alias("rep"))
    mapping = df.join(firsts, [*keys, "vec"]).select(*keys, "id", "rep")
    return firsts.select(*keys, F.col("rep").alias("id"), "vec"), mapping


def merge_similar(reports: DataFrame, scope: str, threshold: float = rules.MERGE_SIMILARITY,
                  **blocking: int) -> DataFrame:
    """Greedy complete-link groups of vectors in the order of ``ord``: ``id, cluster``.

    ``reports(<scope>, id, ord, vec)``. A row without vector (null or all zero) is a group of its own.
    """
    norm2 = F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    usable = reports.filter(F.col("vec").isNotNull()).filter(norm2 > 0)
    nodes, mapping = _distinct_vectors(usable, [scope], F.col("ord"))
    edges = similar_pairs(nodes, nodes, threshold, [scope], same=True, **blocking)
    placed = complete_link(nodes.join(reports.select("id", "ord"), "id").select(scope, "id", "ord"), edges, scope)
    groups = mapping.join(placed.withColumnRenamed("id", "rep"), "rep").select("id", "leader")
    return reports.select("id").join(groups, "id", "left").select(
        "id", F.coalesce("leader", "id").alias("cluster")
    )


def merge_groups(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group of already boosted representatives.

    The winner is elected as in a cluster; sizes add up, the score is the best of the group plus
    1.5 per added source, at most 3, titles are the winner's own, then each other row's title
    followed by its titles, four in all. A group of one row is left as it is.
    """
    keys = [*keys, "cluster"]
    election = F.struct(F.col("reference"), (-F.col("score")).alias("s"), F.col("ord"))
    win = members.groupBy(*keys).agg(
        F.min_by(F.struct("id", "source", "title", "cluster_size", "cluster_titles", "reference", "score"), election)
        .alias("w"),
        F.max("score").alias("best"), F.sum("cluster_size").alias("total"), F.count("*").alias("rows"),
    )
    own = F.transform(F.col("w.cluster_titles"), lambda t: t)
    # Four rows of others are enough for four titles; the rank filter runs before the shuffle.
    others = (
        members.join(win.select(*keys, F.col("w.id").alias("wid")), keys).filter("id <> wid")
        .withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
        .filter(F.col("rk") <= rules.CLUSTER_TITLES)
        .groupBy(*keys)
        .agg(
            F.flatten(F.transform(
                F.array_sort(F.collect_list(F.struct(
                    "rk",
                    F.concat(F.array(F.concat("source", F.lit(": "), "title")), F.col("cluster_titles")).alias("t"),
                ))), lambda x: x["t"],
            )).alias("more")
        )
    )
    added = F.col("total") - F.col("w.cluster_size")
    single = F.col("rows") == 1
    return win.join(others, keys, "left").select(
        *keys, F.col("w.id").alias("id"), F.col("w.source").alias("source"), F.col("w.title").alias("title"),
        F.col("w.reference").alias("reference"), F.col("total").alias("cluster_size"),
        F.when(single, own).otherwise(
            F.slice(F.concat(own, F.coalesce("more", F.array().cast("array<string>"))), 1, rules.CLUSTER_TITLES)
        ).alias("cluster_titles"),
        F.when(single, F.col("w.score")).otherwise(
            F.col("best") + F.least(added * rules.BOOST_PER_SOURCE, F.lit(rules.BOOST_MAX))
        ).alias("score"),
    )


def drop_near_copies(candidates: DataFrame, base: DataFrame, keys: Sequence[str],
                     threshold: float = rules.BASE_SIMILARITY, **blocking: int) -> DataFrame:
    """Candidates without any base row of the same keys at or above the threshold."""
    cand, mapping = _distinct_vectors(candidates.filter("vec is not null"), keys, F.col("id"))
    known, _ = _distinct_vectors(base.filter("vec is not null"), keys, F.col("id"))
    hits = similar_pairs(cand, known, threshold, keys, nearest=True, **blocking).select(F.col("a").alias("rep")).distinct()
    return candidates.join(mapping.join(hits, "rep", "left_semi").select("id"), "id", "left_anti")


def nearest_earlier(today: DataFrame, past: DataFrame, keys: Sequence[str],
                    threshold: float = rules.PROGRESS_SIMILARITY, **blocking: int) -> DataFrame:
    """Most similar past row per row of today, at or above the threshold: ``keys, id, prev_id, cos``.

    Of equally similar past rows the one with the smallest id wins.
    """
    now, now_map = _distinct_vectors(today.filter("vec is not null"), keys, F.col("id"))
    old, _ = _distinct_vectors(past.filter("vec is not null"), keys, F.col("id"))
    best = similar_pairs(now, old, threshold, keys, nearest=True, **blocking).groupBy(*keys, "a").agg(
        F.min_by(F.struct("b", "cos"), F.struct((-F.col("cos")).alias("c"), F.col("b").alias("o"))).alias("m")
    )
    return now_map.join(best.withColumnRenamed("a", "rep"), [*keys, "rep"]).select(
        *keys, "id", F.col("m.b").alias("prev_id"), F.col("m.cos").alias("cos")
    )
