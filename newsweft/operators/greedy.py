"""Order-dependent grouping, exact at any size.

The rules below are defined by a walk over the rows of a run in a fixed order. A run whose
rows and similar pairs are few enough, which is measured first, is walked in one task, all
such runs in parallel. A bigger run is solved by rounds of joins: a row can be decided as
soon as every earlier row that could matter to it is decided, so each round decides all such
rows at once; the earliest open row always qualifies and the loop ends. Between rounds the
state is a written table, and only the fact that open rows remain reaches the driver.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.session import durable

# A run is walked in one task up to this many rows plus similar pairs.
WALK_LIMIT = 2_000_000


def _positions(ord_column: pd.Series) -> list[int]:
    """Row numbers in walking order; ``ord`` is a number or a struct."""
    keys = [tuple(v.values()) if isinstance(v, dict) else v for v in ord_column]
    return sorted(range(len(keys)), key=keys.__getitem__)


def _by_size(scope: str, limit: int, *tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that fit one task, and runs that do not, by the rows of all ``tables``."""
    rows = tables[0].groupBy(scope).count()
    for t in tables[1:]:
        rows = rows.unionByName(t.groupBy(scope).count())
    sizes = durable(rows.groupBy(scope).agg(F.sum("count").alias("n")))
    return sizes.filter(F.col("n") <= limit).select(scope), sizes.filter(F.col("n") > limit).select(scope)


def complete_link(vertices: DataFrame, edges: DataFrame, scope: str, limit: int = WALK_LIMIT) -> DataFrame:
    """Greedy complete-link clusters of each run.

    ``vertices(<scope>, id, ord)``: unique ids with a unique sortable position;
    ``edges(<scope>, a, b)``: similar pairs, each once. Walking by ``ord``, a row joins the
    first cluster whose members are all similar to it, else it opens one. Returns
    ``(id, leader)`` where ``leader`` is the row that opened the cluster.
    """
    edges = durable(edges.select(scope, "a", "b"))
    ends = edges.select(scope, F.col("a").alias("id")).union(edges.select(scope, F.col("b").alias("id")))
    linked = durable(vertices.select(scope, "id", "ord").join(ends.distinct(), [scope, "id"], "left_semi"))
    small, big = _by_size(scope, limit, linked, edges)
    id_type = vertices.schema["id"].dataType.simpleString()

    def walk(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        # Rows by their place in the order; per row the places of the similar rows before it.
        ids = nodes["id"].to_numpy()[_positions(nodes["ord"])]
        place = pd.Series(np.arange(len(ids)), index=ids)
        ends = np.sort(np.stack([place.loc[pairs[c]].to_numpy() for c in ("a", "b")], axis=1), axis=1)
        ends = ends[np.argsort(ends[:, 1], kind="stable")]
        bounds = np.searchsorted(ends[:, 1], np.arange(len(ids) + 1))
        leader, size = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
        for me in range(len(ids)):
            clusters, links = np.unique(leader[ends[bounds[me]:bounds[me + 1], 0]], return_counts=True)
            full = clusters[links == size[clusters]]
            # Clusters are numbered by their opener, so the smallest number is the oldest one.
            leader[me] = full[0] if len(full) else me
            size[leader[me]] += 1
        return pd.DataFrame({"id": ids, "leader": ids[leader]})

    placed = (
        linked.join(small, scope, "left_semi").groupBy(scope)
        .cogroup(edges.join(small, scope, "left_semi").groupBy(scope))
        .applyInPandas(walk, f"id {id_type}, leader {id_type}")
    )
    if not big.isEmpty():
        placed = placed.unionByName(
            complete_link_rounds(
                linked.join(big, scope, "left_semi"), edges.join(big, scope, "left_semi")
            )
        )
    return vertices.select("id").join(placed, "id", "left").select(
        "id", F.coalesce("leader", "id").alias("leader")
    )


def complete_link_rounds(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The same clusters by rounds of joins, for runs of any size: ``id, leader``."""
    pos = vertices.select("id", "ord")
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("nbr")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("nbr"))
    )
    # Only similar rows that come earlier matter to a row.
    earlier = durable(
        both.join(pos, "id")
        .join(pos.select(F.col("id").alias("nbr"), F.col("ord").alias("nbr_ord")), "nbr")
        .filter("nbr_ord < ord")
        .select("id", "ord", "nbr", "nbr_ord")
    )
    null_id = F.lit(None).cast(vertices.schema["id"].dataType)
    null_ord = F.lit(None).cast(vertices.schema["ord"].dataType)
    state = durable(pos.withColumn("leader", null_id).withColumn("leader_ord", null_ord))
    while not state.filter("leader is null").isEmpty():
        state = durable(_complete_link_round(state, earlier))
    return state.select("id", "leader")


def _complete_link_round(state: DataFrame, earlier: DataFrame) -> DataFrame:
    open_ids = state.filter("leader is null").select("id")
    seen = earlier.join(open_ids, "id", "left_semi").join(
        state.select(F.col("id").alias("nbr"), "leader", "leader_ord"), "nbr"
    )
    waiting = seen.filter("leader is null").groupBy("id").agg(F.min("nbr_ord").alias("first_open"))

    # Clusters whose opener is similar to the row, with the number of similar members so far.
    offers = (
        seen.filter("leader is not null")
        .groupBy("id", "ord", "leader", "leader_ord")
        .agg(F.count("*").alias("similar"), F.max(F.col("nbr") == F.col("leader")).alias("near_opener"))
        .filter("near_opener")
        .drop("near_opener")
    )
    members = state.filter("leader is not null").select(
        F.lit(None).cast(state.schema["id"].dataType).alias("id"), "ord", "leader", "leader_ord",
        F.lit(None).cast("long").alias("similar"), F.lit(1).alias("member"),
    )
    by_cluster = Window.partitionBy("leader").orderBy("ord")
    live = (
        offers.withColumn("member", F.lit(0))
        .unionByName(members)
        .withColumn("members_before", F.sum("member").over(by_cluster))
        .filter("member = 0 and members_before = similar")
        .withColumn("rivals_before", F.row_number().over(by_cluster) - 1)
        .select("id", "ord", "leader", "leader_ord", "rivals_before")
    )
    first = live.groupBy("id").agg(
        F.min_by(F.struct("leader", "leader_ord", "rivals_before"), "leader_ord").alias("t")
    ).select("id", "t.*")

    # Open rows that still may enter the same cluster before this one, and are similar to it.
    friends = (
        seen.filter("leader is null").select("id", "nbr")
        .join(first.select("id", "leader"), "id")
        .join(live.select(F.col("id").alias("nbr"), "leader"), ["nbr", "leader"])
        .groupBy("id").agg(F.count("*").alias("friends"))
    )
    decided = (
        open_ids.join(first, "id", "left").join(waiting, "id", "left").join(friends, "id", "left")
        .join(state.select("id", "ord"), "id")
        .select(
            "id",
            F.when(
                F.col("leader").isNotNull()
                & (F.col("first_open").isNull() | (F.col("first_open") > F.col("leader_ord")))
                & (F.col("rivals_before") == F.coalesce("friends", F.lit(0))),
                F.struct("leader", "leader_ord"),
            ).when(
                F.col("leader").isNull() & F.col("first_open").isNull(),
                F.struct(F.col("id").alias("leader"), F.col("ord").alias("leader_ord")),
            ).alias("d"),
        )
    )
    return state.join(decided, "id", "left").select(
        "id", "ord",
        F.coalesce("leader", "d.leader").alias("leader"),
        F.coalesce("leader_ord", "d.leader_ord").alias("leader_ord"),
    )


def keep_first(rows: DataFrame, title_pairs: DataFrame, scope: str, limit: int = WALK_LIMIT) -> DataFrame:
    """Drop a row when an earlier *kept* row has the same URL or a similar title.

    ``rows(id, ord, <scope>, url_key, title_key)``; ``title_pairs(<scope>, t1, t2)``: similar,
    different title keys in both directions. Returns ``(<scope>, id)`` of the rows kept; an id may stand in many runs.
    """
    rows = durable(rows.select("id", "ord", scope, "url_key", "title_key"))
    title_pairs = durable(title_pairs.select(scope, "t1", "t2"))
    small, big = _by_size(scope, limit, rows, title_pairs)

    def walk(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pairs["t1"], pairs["t2"]):
            near.setdefault(a, set()).add(b)
        urls, titles, kept = set(), set(), []
        ids, url_keys, title_keys = (nodes[c].tolist() for c in ("id", "url_key", "title_key"))
        for pos in _positions(nodes["ord"]):
            url, title = url_keys[pos], title_keys[pos]
            if url in urls or title in titles or not titles.isdisjoint(near.get(title, ())):
                continue
            kept.append(ids[pos])
            urls.add(url)
            if title:
                titles.add(title)
        return pd.DataFrame({scope: nodes[scope].iloc[:1].repeat(len(kept)).to_numpy(), "id": pd.Series(kept, dtype=nodes["id"].dtype)})

    kind = {c: rows.schema[c].dataType.simpleString() for c in (scope, "id")}
    kept = (
        rows.join(small, scope, "left_semi").groupBy(scope)
        .cogroup(title_pairs.join(small, scope, "left_semi").groupBy(scope))
        .applyInPandas(walk, f"{scope} {kind[scope]}, id {kind['id']}")
    )
    if not big.isEmpty():
        kept = kept.unionByName(
            keep_first_rounds(rows.join(big, scope, "left_semi"), title_pairs.join(big, scope, "left_semi"), scope)
        )
    return kept


def keep_first_rounds(rows: DataFrame, title_pairs: DataFrame, scope: str) -> DataFrame:
    """The same by rounds. Equal URLs and titles are compared through per-key minima, so a
    key shared by many rows costs one aggregate and no pairs."""
    state = durable(rows.withColumn("kept", F.lit(None).cast("boolean")))
    pairs = durable(title_pairs)

    def minima(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.min(F.when(F.col("kept").isNull(), F.col("ord"))).alias("open_ord"),
            F.min(F.when(F.col("kept"), F.col("ord"))).alias("kept_ord"),
        )

    while not state.filter("kept is null").isEmpty():
        alive = state.filter("kept is null or kept")
        urls = minima(alive, scope, "url_key").select(
            scope, "url_key", F.col("open_ord").alias("u_open"), F.col("kept_ord").alias("u_kept")
        )
        titles = minima(alive.filter("title_key <> ''"), scope, "title_key")
        around = titles.select(
            scope, "title_key", "open_ord", "kept_ord"
        ).unionByName(
            pairs.join(titles.withColumnRenamed("title_key", "t2"), [scope, "t2"])
            .select(scope, F.col("t1").alias("title_key"), "open_ord", "kept_ord")
        ).groupBy(scope, "title_key").agg(
            F.min("open_ord").alias("t_open"), F.min("kept_ord").alias("t_kept")
        )
        joined = state.join(urls, [scope, "url_key"], "left").join(around, [scope, "title_key"], "left")
        beaten = F.least("u_kept", "t_kept")
        rival = F.least("u_open", "t_open")
        state = durable(
            joined.select(
                "id", "ord", scope, "url_key", "title_key",
                F.when(F.col("kept").isNotNull(), F.col("kept"))
                .when(beaten.isNotNull() & (beaten < F.col("ord")), F.lit(False))
                .when(rival >= F.col("ord"), F.lit(True))
                .alias("kept"),
            )
        )
    return state.filter("kept").select(scope, "id")


def accept_in_feed_order(entries: DataFrame, scope: str, limit: int = WALK_LIMIT) -> DataFrame:
    """Feed entries of each run taken in order under unique titles and links and a cap per feed.

    ``entries(<scope>, id, ord, feed, cap, title_key, link_key)``, walked by ``ord``. An entry
    is taken iff its title and link were not taken before and its feed has room; entries that
    are not taken mark nothing as seen. Returns the ids taken.
    """
    columns = [scope, "id", "ord", "feed", "cap", "title_key", "link_key"]
    entries = durable(entries.select(*columns))
    small, big = _by_size(scope, limit, entries)

    def walk(nodes: pd.DataFrame) -> pd.DataFrame:
        titles, links, count, taken = set(), set(), Counter(), []
        ids, feeds, caps, title_keys, link_keys = (nodes[c].tolist() for c in columns[1:2] + columns[3:])
        for pos in _positions(nodes["ord"]):
            title, link, feed = title_keys[pos], link_keys[pos], feeds[pos]
            if count[feed] >= caps[pos] or title in titles or (link and link in links):
                continue
            taken.append(ids[pos])
            titles.add(title)
            links.add(link)
            count[feed] += 1
        return pd.DataFrame({"id": pd.Series(taken, dtype=nodes["id"].dtype)})

    taken = entries.join(small, scope, "left_semi").groupBy(scope).applyInPandas(
        walk, f"id {entries.schema['id'].dataType.simpleString()}"
    )
    if not big.isEmpty():
        taken = taken.unionByName(accept_rounds(entries.join(big, scope, "left_semi"), scope))
    return taken


def accept_rounds(entries: DataFrame, scope: str) -> DataFrame:
    """The same by rounds. Within the first ``cap`` rows still alive of a feed there is room
    whatever happens to the rows before. Keys travel as digests, empty ones as null, and rows that are refused leave the table."""
    for key in ("title_key", "link_key"):
        entries = entries.withColumn(key, F.when(F.col(key) != "", F.unhex(F.sha2(F.col(key).cast("string"), 256))))
    state = durable(entries.withColumn("taken", F.lit(None).cast("boolean")))
    in_feed = Window.partitionBy(scope, "feed").orderBy("ord")
    most = state.agg(F.max("cap")).first()[0]
    while not state.filter("taken is null").isEmpty():
        alive = state
        room = (
            alive.withColumn("r", F.row_number().over(in_feed)).filter((F.col("r") <= most) & (F.col("r") <= F.col("cap")))
            .filter("taken is null")
            .select("id", F.lit(True).alias("room"))
        )
        full = alive.filter("taken").groupBy(scope, "feed", "cap").agg(F.count("*").alias("n")).filter(
            "n >= cap"
        ).select(scope, "feed", F.lit(True).alias("is_full"))

        def seen(key: str, prefix: str) -> DataFrame:
            return alive.filter(F.col(key).isNotNull()).groupBy(scope, key).agg(
                F.min(F.when(F.col("taken").isNull(), F.col("ord"))).alias(f"{prefix}_open"),
                F.min(F.when(F.col("taken"), F.col("ord"))).alias(f"{prefix}_taken"),
            )

        joined = (
            state.join(seen("title_key", "t"), [scope, "title_key"], "left")
            .join(seen("link_key", "l"), [scope, "link_key"], "left")
            .join(room, "id", "left").join(full, [scope, "feed"], "left")
        )
        before, first_open = F.least("t_taken", "l_taken"), F.least("t_open", "l_open")
        state = durable(
            joined.select(
                *entries.columns,
                F.when(F.col("taken").isNotNull(), F.col("taken"))
                .when((before.isNotNull() & (before < F.col("ord"))) | F.col("is_full"), F.lit(False))
                .when(F.col("room") & (F.coalesce(first_open, "ord") >= F.col("ord")), F.lit(True))
                .alias("taken"),
            ).filter("taken is null or taken")
        )
    return state.filter("taken").select("id")
