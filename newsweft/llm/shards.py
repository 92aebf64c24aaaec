"""Sharding by longest processing time: groups that stay together go, the largest first, to the least loaded shard.

Groups of one size are alike, so the schedule is made on counts: how many groups of each size go to each shard. Sizes that
sum to the whole input can't be many (n different ones sum to n * (n + 1) / 2 at least), and only their counts reach the
driver. Each group then finds its shard by its number among the groups of its size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.operators.ranges import running_number


def least_loaded(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets, given one by one to the least loaded, ties to the first."""
    got = [0] * len(loads)
    if count > 4 * len(loads):
        # All but the last few at once: whatever fills up to a level that the greedy order surely reaches.
        low, high = min(loads), max(loads) + size * count
        while low < high:
            level = (low + high + 1) // 2
            if sum(max(0, (level - load) // size) for load in loads) <= count - len(loads):
                low = level
            else:
                high = level - 1
        got = [max(0, (low - load) // size) for load in loads]
    heap = [(load + size * n, k) for k, (load, n) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, k = heap[0]
        got[k] += 1
        heapq.heapreplace(heap, (load + size, k))
    return got


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """From (size, number of groups): rows of size, first and end number among the groups of that size, shard."""
    loads, out = [0] * shards, []
    for size, count in sorted(sizes, reverse=True):
        at = 0
        for k, n in enumerate(least_loaded(loads, size, count)):
            if n:
                out.append((size, at, at + n, k))
                loads[k] += size * n
                at += n
    return out


def lpt_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``shard`` and its ``slot`` there.

    Equal texts form a group; a null text is an empty one. A null ``doc_id`` stays null and comes first in its shard; repeated rows get a
    slot each. Columns besides ``doc_id`` and ``text`` are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("content"),
    )
    groups = slim.groupBy("content").agg(F.sum("size").alias("total"))
    numbered = running_number(groups, ["total"], ["content"])
    sizes = [(r.total, r.n) for r in numbered.groupBy("total").agg(F.count("*").alias("n")).collect()]
    plan = docs.sparkSession.createDataFrame(schedule(sizes, shards), "total long, low long, high long, shard int")
    placed = numbered.join(plan, "total").where((F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))).select("content", "shard")
    rows = slim.join(placed, "content").drop("content")
    return running_number(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
