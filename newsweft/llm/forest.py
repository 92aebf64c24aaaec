"""Nearest vectors by a forest of random-projection trees.

A tree cuts the space by random directions at the median of a bounded sample, down to leaves of a few sample rows. Every row of
the table goes to its leaf of each tree. A query walks all trees through one priority queue: the node with the least penalty
(the squared distances to the cuts on whose far side it lies) is opened next, whatever its tree, until the leaves found hold a
given share of the sample. The rows of these leaves are compared exactly.

Leaves and their visitors meet in cells of bounded size: a leaf with many rows or visitors is split into as many blocks of
either as it takes, so copies of one vector do not meet in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.session import durable

#: Trees, rows of the sample that they are fitted on, sample rows of a leaf, and share of the sample that a query's leaves hold.
TREES, SAMPLE, LEAF, SHARE = 20, 4096, 16, 0.7
#: Rows and visitors of one cell.
BLOCK = 4096
SEED = 20_240_311
#: A product of matrices may differ from the exact sum by this share.
SLACK = 1e-9
RESULT = "query_id long, vec_id long, score double"


class Forest:
    """Trees of one depth as arrays: the directions and cuts of all inner nodes, level by level, and the sample's leaves."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, trees: int, leaf: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        if len(sample):
            # Copies would only make leaves uneven.
            sample, first = np.unique(sample, axis=0, return_index=True)
            ids = ids[first]
        self.sample, self.ids = sample, ids
        self.dim = sample.shape[1] if len(sample) else 0
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
        self.trees, self.inner = trees, 2**self.depth - 1
        self.directions = rng.standard_normal((trees, self.inner, self.dim))
        self.cuts = np.zeros((trees, self.inner))
        self.size = max(1, len(sample))
        #: Sample rows of each leaf, as the bits of one whole number.
        self.held: list[list[int]] = []
        for t in range(trees):
            rows = [np.arange(len(sample))]
            for node in range(self.inner):
                far = sample[rows[node]] @ self.directions[t, node]
                middle = len(far) // 2
                # Between two rows, so that no row of the sample lies on a cut.
                self.cuts[t, node] = np.sort(far)[max(0, middle - 1) : middle + 1].mean() if len(far) else 0.0
                right = far > self.cuts[t, node]
                rows += [rows[node][~right], rows[node][right]]
        at = self.leaves(sample) if len(sample) else np.zeros((0, trees), np.int32)
        for t in range(trees):
            self.held.append([0] * (self.inner + 1))
            for i, leaf_at in enumerate(at[:, t]):
                self.held[t][leaf_at] |= 1 << i

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                far = np.einsum("ij,ij->i", vectors, self.directions[t, node])
                node = 2 * node + 1 + (far > self.cuts[t, node])
            out[:, t] = node - self.inner
        return out

    def visited(self, vector: np.ndarray, share: float) -> tuple[list[int], int]:
        """The leaves of all trees that a query visits, as tree * leaves + leaf, in the order of the queue, and the bits of
        the sample rows in them."""
        margins = self.directions @ vector - self.cuts if self.inner else np.zeros((self.trees, 0))
        wanted, seen, out = share * self.size, 0, []
        queue = [(0.0, t, 0) for t in range(self.trees)]
        while queue and (seen.bit_count() < wanted or not out):
            penalty, tree, node = heapq.heappop(queue)
            while node < self.inner:
                margin = margins[tree, node]
                near, other = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (penalty + margin * margin, tree, other))
                node = near
            leaf = node - self.inner
            seen |= self.held[tree][leaf]
            out.append(tree * (self.inner + 1) + leaf)
        return out, seen

    def floor(self, vector: np.ndarray, own: int, seen: int, k: int) -> float:
        """The ``k``-th best score of the sample rows seen, a little less: no worse row can be among the best ``k`` found."""
        bits = np.frombuffer(seen.to_bytes((self.size + 7) // 8, "little"), np.uint8)
        some = np.unpackbits(bits, bitorder="little")[: len(self.ids)].astype(bool) & (self.ids != own)
        scores = self.sample[some] @ vector
        if len(scores) < k:
            return -np.inf
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        return float(edge - SLACK * (1 + abs(edge)))


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, added up in the same order for every row."""
    return (rows * query).sum(axis=1)


def nearest_of(query: np.ndarray, own: int, floor: float, rough: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a query's best rows but itself, and their scores; ties go to the smaller id. ``rough``: scores by a product of matrices."""
    some = np.nonzero((rough >= floor) & (ids != own))[0]
    if len(some) > k:
        edge = np.partition(rough[some], len(some) - k)[len(some) - k]
        some = some[rough[some] >= edge - SLACK * (1 + abs(edge))]
    scores = exact_scores(query, vectors[some])
    best = np.lexsort((ids[some], -scores))[:k]
    return some[best], scores[best]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (double) of the rows that take part: one per id, of the most frequent length."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(
        F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def fit(rows: DataFrame, trees: int, sample: int, leaf: int) -> Forest:
    """The forest of the ``sample`` rows with the least hashes of their ids; no more rows reach the driver."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    vectors = np.array([np.asarray(x, float) for x in some["embedding"]]).reshape(len(some), -1)
    return Forest(vectors, some["vec_id"].to_numpy(), trees, leaf)


def nearest_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, share: float = SHARE, block: int = BLOCK
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the greatest inner product found for each query, nearest first.

    ``vectors(vec_id, embedding)`` and ``queries(vec_id, embedding)``; a query is compared with the rows of other ids. Vectors that
    are null, empty, zero, hold null or numbers that are not finite, or have another length than most take no part, nor do rows
    without an id. Of rows with one id the smallest vector counts, so repeated rows count once. Ties go to the smaller id; a query
    with fewer rows to compare gets all of them. Other columns are not looked at. The trees are fitted on at most ``sample`` rows, which
    the driver holds with the trees; every row is indexed.
    """
    spark = vectors.sparkSession
    rows = durable(usable(vectors))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (x.where(F.size("embedding") == sizes["n"]) for x in (rows, usable(queries)))
    forest = spark.sparkContext.broadcast(fit(rows, trees, sample, leaf))

    def placed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at = forest.value.leaves(matrix(frame.column("embedding"), forest.value.dim))
            at += np.arange(forest.value.trees, dtype=np.int32) * (forest.value.inner + 1)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(list(at), pa.list_(pa.int32()))], names=["vec_id", "embedding", "leaves"])

    def walked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for frame in frames:
            ids, at = frame.column("vec_id").to_numpy(), matrix(frame.column("embedding"), trees.dim)
            found = [trees.visited(v, share) for v in at]
            floors = [trees.floor(v, i, seen, k) for v, i, (_, seen) in zip(at, ids, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*frame.columns, pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array(floors, pa.float64())],
                names=["vec_id", "embedding", "leaves", "floor"],
            )

    kind = "vec_id long, embedding array<double>, leaves array<int>"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    indexed = durable(rows.mapInArrow(placed, kind))
    # Walking the trees costs far more than a query's bytes tell.
    visits = durable(asked.repartition(tasks, "vec_id").mapInArrow(walked, f"{kind}, floor double"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    splits = counted(indexed, "row_blocks").join(counted(visits, "query_blocks"), "leaf")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row of a leaf in one block of its side, for all blocks of the other side."""
        flat = df.select("*", F.explode("leaves").alias("leaf")).join(F.broadcast(splits) if bounded else splits, "leaf")
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(own)
        return flat.select("leaf", *df.columns, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    # One row per leaf of a forest of a bounded sample.
    bounded = trees * 2 * sample <= 1_000_000
    cells = dealt(visits, "query_blocks", "row_blocks").groupBy("leaf", "row_blocks", "query_blocks").cogroup(
        dealt(indexed, "row_blocks", "query_blocks").groupBy("leaf", "row_blocks", "query_blocks")
    )

    def compare(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if asks.num_rows and rows.num_rows:
            q, v = matrix(asks.column("embedding"), forest.value.dim), matrix(rows.column("embedding"), forest.value.dim)
            own, ids, floors = asks.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy(), asks.column("floor").to_numpy()
            leaves, here, paths = matrix(rows.column("leaves"), forest.value.trees), asks.column("leaf")[0].as_py(), asks.column("leaves")
            width = forest.value.inner + 1
            for some in range(0, len(q), 256):
                rough = q[some : some + 256] @ v.T
                for i, scores in enumerate(rough, some):
                    found, exact = nearest_of(q[i], own[i], floors[i], scores, ids, v, k)
                    if len(found):
                        # A pair may meet in a leaf of each tree; the first tree tells it.
                        seen = np.zeros(forest.value.trees * width, bool)
                        seen[paths[i].values.to_numpy()] = True
                        first = seen[leaves[found]].argmax(axis=1) == here // width
                        out[0].append(np.full(int(first.sum()), own[i]))
                        out[1].append(ids[found[first]])
                        out[2].append(exact[first])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = cells.applyInArrow(compare, RESULT).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
