"""The archive of running events: ids, matching, upsert and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions.text import event_title_key


def event_id(title: Column, day: Column) -> Column:
    """Id of an event opened on ``day`` (text) under ``title``."""
    key = F.substring(F.sha1(event_title_key(title)), 1, 12)
    return F.concat(F.lit("evt_"), F.replace(day, F.lit("-"), F.lit("")), F.lit("_"), key)


def _lookup(archive: DataFrame) -> DataFrame:
    """First archived event per title key, for previous titles (p) and raw titles (r)."""
    kinds = F.array(
        F.struct(F.lit("p").alias("kind"), event_title_key(F.col("latest_title")).alias("key")),
        F.struct(F.lit("p").alias("kind"), event_title_key(F.col("title")).alias("key")),
        F.struct(F.lit("r").alias("kind"), event_title_key(F.col("latest_raw_title")).alias("key")),
    )
    keyed = archive.select("event_id", "ord", F.explode(kinds).alias("k")).select("event_id", "ord", "k.*")
    return keyed.filter((F.col("kind") == "r") | (F.col("key") != "")).groupBy("kind", "key").agg(
        F.min(F.struct("ord", "event_id")).alias("e")
    )


def match_events(batch: DataFrame, archive: DataFrame, day: Column) -> DataFrame:
    """Event of every article of one run: ``id, event_id, is_update``.

    ``batch(id, ord, title, prev_title)``, ``archive(event_id, ord, title, latest_title,
    latest_raw_title)``. An article belongs to the first archived event whose latest or first title
    equals its linked previous title, or whose latest raw title equals its own; titles are compared
    by key, never fuzzily. What is left opens one event per title key, or follows an earlier article
    of the run with the same title. Articles are grouped by their keys before they meet the archive,
    so a title repeated many times is looked up once.
    """
    keyed = batch.select(
        "id", "ord", "title", event_title_key(F.col("title")).alias("raw_key"),
        event_title_key(F.coalesce("prev_title", F.lit(""))).alias("prev_key"),
    )
    groups = keyed.groupBy("raw_key", "prev_key").agg(F.min("ord").alias("first_ord"))
    known = _lookup(archive)
    by_prev = known.filter("kind = 'p'").select(F.col("key").alias("prev_key"), F.col("e").alias("pe"))
    by_raw = known.filter("kind = 'r'").select(F.col("key").alias("raw_key"), F.col("e").alias("re"))
    matched = groups.join(by_prev, "prev_key", "left").join(by_raw, "raw_key", "left").withColumn(
        "e", F.least("pe", "re")
    )
    # Same title in one run: followers of a matched article go to its event.
    leads = matched.groupBy("raw_key").agg(
        F.min(F.when(F.col("e").isNotNull(), F.struct("first_ord", "e"))).alias("lead"),
        F.min("first_ord").alias("run_first"),
    )
    joined = keyed.join(matched.select("raw_key", "prev_key", "e"), ["raw_key", "prev_key"]).join(leads, "raw_key")
    follows = F.col("lead").isNotNull() & (F.col("lead.first_ord") < F.col("ord"))
    return joined.select(
        "id",
        F.when(F.col("e").isNotNull(), F.col("e.event_id")).when(follows, F.col("lead.e.event_id"))
        .otherwise(event_id(F.col("title"), day)).alias("event_id"),
        (F.col("e").isNotNull() | follows | (F.col("ord") > F.col("run_first"))).alias("is_update"),
    )


def upsert_events(archive: DataFrame, batch: DataFrame, matches: DataFrame, day: Column) -> DataFrame:
    """The archive after a run: one row per event with first and latest state.

    ``batch`` carries the state an article sets: ``id, ord, title, zh, key_facts, open_questions,
    sources``; the last article of an event in the run sets it. Updates live in their own table
    (:func:`event_updates`), so no event row grows with its history.
    """
    state = F.struct(
        F.coalesce("zh", "title").alias("latest_title"), F.col("title").alias("latest_raw_title"),
        F.slice("key_facts", 1, 3).alias("key_facts"), F.slice("open_questions", 1, 3).alias("open_questions"),
        F.col("sources"),
    )
    fresh = batch.join(matches.select("id", "event_id"), "id").groupBy("event_id").agg(
        F.max_by(state, "ord").alias("n"), F.min_by(F.coalesce("zh", "title"), "ord").alias("new_title"),
        F.min("ord").alias("new_ord"),
    )
    old = archive.select("event_id", "ord", F.struct(
        "title", "first_seen", "latest_seen", "latest_title", "latest_raw_title", "key_facts", "open_questions", "sources"
    ).alias("o"))
    pick = lambda f: F.when(F.col("n").isNotNull(), F.col(f"n.{f}")).otherwise(F.col(f"o.{f}"))
    today = F.when(F.col("n").isNotNull(), day)
    return old.join(fresh, "event_id", "full_outer").select(
        "event_id", F.coalesce("ord", "new_ord").alias("ord"), F.coalesce("o.title", "new_title").alias("title"),
        F.coalesce(F.col("o.first_seen"), day).alias("first_seen"),
        F.coalesce(today, F.col("o.latest_seen")).alias("latest_seen"),
        pick("latest_title").alias("latest_title"), pick("latest_raw_title").alias("latest_raw_title"),
        pick("key_facts").alias("key_facts"), pick("open_questions").alias("open_questions"),
        pick("sources").alias("sources"), F.lit(rules.STATUS_ACTIVE).alias("status"),
    )


def event_updates(updates: DataFrame, batch: DataFrame, matches: DataFrame, day: Column) -> DataFrame:
    """History table with the run's updates appended, once per event and article."""
    new = batch.join(matches.select("id", "event_id"), "id").select(
        "event_id", day.alias("date"), F.col("id").alias("article_id"), F.coalesce("zh", "title").alias("title"),
        F.col("title").alias("raw_title"),
    ).dropDuplicates(["event_id", "article_id"])
    return updates.unionByName(new.join(updates, ["event_id", "article_id"], "left_anti"))


def active_events(archive: DataFrame, as_of_day: Column, days: int = rules.ACTIVE_EVENT_DAYS) -> DataFrame:
    return archive.filter(F.col("latest_seen") >= F.date_sub(as_of_day, days))
