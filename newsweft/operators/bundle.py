"""Export of verified runs, the multi-source bundle, context and hand-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions.text import bundle_title_key, leading_int
from newsweft.operators.evidence import primary_source
from newsweft.operators.fuzzy import both_ways, similar_titles
from newsweft.operators.greedy import WALK_LIMIT, keep_first
from newsweft.session import durable

ITEM = ("article_id", "title", "url", "publisher", "score", "evidence_complete", "source_system",
        "source_artifact_date", "freshness_label")


def export_items(cards: DataFrame, runs: DataFrame, quality: DataFrame, digests: DataFrame, key: str = "run_key") -> DataFrame:
    """Flat items of the runs whose artifacts are complete; whether a run was delivered is told, not asked.

    ``cards(<key>, card)``. Other runs export nothing.
    """
    whole = runs.filter((F.col("artifact_bundle_status") == "present")).select(key, "delivered_at")
    whole = whole.join(quality.select(key), key, "left_semi").join(digests.select(key), key, "left_semi")
    source = primary_source(F.col("card.sources"))
    url = F.coalesce(
        F.when(F.coalesce(source["canonical_url"], F.lit("")) != "", source["canonical_url"]), source["url"], F.lit("")
    )
    return cards.join(whole, key).select(
        key, F.col("delivered_at").isNotNull().alias("delivery_successful"), "card.article_id",
        F.col("card.headline").alias("title"), url.alias("url"),
        F.coalesce(source["publisher"], F.lit("")).alias("publisher"), "card.summary", "card.category",
        "card.published_at", "card.why_relevant", "card.relevance_score", "card.confirmed_facts", "card.entities",
        "card.numbers", "card.dates", "card.unknowns", "card.coverage",
        ((F.size("card.confirmed_facts") > 0) & (url != "")).alias("evidence_complete"),
    )


def with_previous_night(items: DataFrame, targets: DataFrame, date: str = "date") -> DataFrame:
    """Items of each target date, or of the day before if that date has none; never older ones.

    The real date of an item stays in ``source_artifact_date``.
    """
    usable = items.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    offered = usable.withColumn("lag", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "source_artifact_date", F.col(date)
    ).withColumn(date, F.date_add(F.col(date), F.col("lag"))).join(targets.select(date).distinct(), date, "left_semi")
    nearest = offered.groupBy(date).agg(F.min("lag").alias("best"))
    return offered.join(nearest, date).filter("lag = best").withColumn(
        "freshness_label", F.when(F.col("lag") == 0, "today").otherwise("previous_night")
    ).drop("lag", "best")


def review_candidates(items: DataFrame, min_score: int = rules.BUNDLE_MIN_SCORE) -> DataFrame:
    """Candidates that are pending or approved, good enough and traceable."""
    return items.filter(
        F.coalesce("status", F.lit("pending")).isin("pending", "approved")
        & (leading_int(F.col("score").cast("string")) >= min_score)
        & (F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    )


def source_status(items: DataFrame, targets: DataFrame, systems: Sequence[str], date: str = "date") -> DataFrame:
    """Per date and source: present, previous_night or missing, with the number of items."""
    grid = targets.select(date).distinct().withColumn("source_system", F.explode(F.array(*[F.lit(s) for s in systems])))
    counts = items.groupBy(date, "source_system").agg(
        F.count("*").alias("items"), F.bool_or(F.col("freshness_label") == "previous_night").alias("late")
    )
    return grid.join(counts, [date, "source_system"], "left").select(
        date, "source_system", F.coalesce("items", F.lit(0)).alias("items"),
        F.when(F.col("items").isNull(), "missing").when(F.col("late"), "previous_night").otherwise("present").alias("status"),
    )


def dedupe_bundle(items: DataFrame, first_source: str, date: str = "date", limit: int | None = rules.BUNDLE_LIMIT,
                  walk_limit: int = WALK_LIMIT) -> DataFrame:
    """Items of each date in order of evidence, source and score, without repeated URLs or titles.

    ``items(id, <date>, title, url, evidence_complete, source_system, score, pos)``. A row is dropped
    only against a row that is kept; then the first ``limit`` of each date are taken.
    """
    order = F.struct(
        (~F.coalesce("evidence_complete", F.lit(False))).alias("e"), (F.col("source_system") != first_source).alias("s"),
        (-leading_int(F.col("score").cast("string"))).alias("p"), F.col("pos"), F.col("id"),
    )
    rows = items.withColumn("url_key", F.lower(F.trim(F.coalesce("url", F.lit(""))))).filter("url_key <> ''").withColumn(
        "title_key", bundle_title_key(F.col("title"))
    ).withColumn("ord", order)
    rows = durable(rows)
    titles = rows.filter("title_key <> ''").select(date, "title_key").distinct()
    pairs = both_ways(similar_titles(titles, [date]), [date])
    kept = keep_first(rows.select("id", "ord", date, "url_key", "title_key"), pairs, date, walk_limit)
    out = rows.join(kept, [date, "id"], "left_semi").withColumn(
        "rank", F.row_number().over(Window.partitionBy(date).orderBy("ord"))
    )
    out = out if limit is None else out.filter(F.col("rank") <= limit)
    return out.drop("url_key", "title_key", "ord")


def enrich_context(items: DataFrame, contexts: DataFrame, date: str = "date") -> DataFrame:
    """Items with the context of the same date or the day before: by URL, else by similar title.

    ``contexts(captured, pos, url, title, <any fields>)``; the first context by ``pos`` wins. The new
    column ``knowledge_context`` is null for items without one.
    """
    fields = [c for c in contexts.columns if c not in ("url", "title", "pos")]
    offered = contexts.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")).withColumn(
        date, F.explode(F.array(F.col("captured"), F.date_add("captured", 1)))
    ).select(
        date, "pos", F.lower(F.trim("url")).alias("url_key"), bundle_title_key(F.col("title")).alias("title_key"),
        F.struct(*fields).alias("ctx"),
    )
    offered = durable(offered)
    best = F.min_by(F.struct("pos", "ctx"), "pos")
    by_url = offered.groupBy(date, "url_key").agg(best.alias("u"))
    by_title = offered.filter("title_key <> ''").groupBy(date, "title_key").agg(best.alias("c"))
    keyed = items.withColumn("url_key", F.lower(F.trim(F.coalesce("url", F.lit(""))))).withColumn(
        "title_key", bundle_title_key(F.col("title"))
    )
    keyed = durable(keyed)
    wanted = keyed.filter("title_key <> ''").select(date, "title_key").distinct()
    both = wanted.unionByName(by_title.select(date, "title_key")).distinct()
    near = both_ways(similar_titles(both, [date]), [date]).select(
        date, F.col("t1").alias("title_key"), F.col("t2").alias("other")
    ).unionByName(wanted.select(date, "title_key", F.col("title_key").alias("other")))
    by_similar = near.join(wanted, [date, "title_key"], "left_semi").join(
        by_title.withColumnRenamed("title_key", "other"), [date, "other"]
    ).groupBy(date, "title_key").agg(F.min_by("c", "c.pos").alias("t"))
    return keyed.join(by_url, [date, "url_key"], "left").join(by_similar, [date, "title_key"], "left").withColumn(
        "knowledge_context", F.coalesce("u.ctx", "t.ctx")
    ).drop("u", "t", "url_key", "title_key")


def handoff_fingerprint(date: Column, item_id: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(date.cast("string"), F.lit(":"), item_id, F.lit(":"), url), 256), 1, 16)


def promotion_fingerprint(run_id: Column, entry_id: Column) -> Column:
    return F.substring(F.sha2(F.concat(run_id, F.lit(":"), entry_id), 256), 1, 16)


def upsert_handoffs(existing: DataFrame, requested: DataFrame, now: Column, version: int = 3) -> DataFrame:
    """Hand-offs after a request: new ones are created, those of an older schema rewritten with
    their first creation time, the others left as they are.

    Both tables: ``handoff_id, schema_version, status, created_at, payload``.
    """
    new = requested.dropDuplicates(["handoff_id"]).select("handoff_id", F.col("payload").alias("new_payload"), F.lit(True).alias("asked"))
    joined = existing.join(new, "handoff_id", "full_outer")
    write = F.coalesce("asked", F.lit(False)) & (F.coalesce("schema_version", F.lit(0)) < version)
    return joined.select(
        "handoff_id",
        F.when(write, F.lit(version)).otherwise(F.col("schema_version")).alias("schema_version"),
        F.when(write, "pending").otherwise(F.col("status")).alias("status"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(write, F.col("new_payload")).otherwise(F.col("payload")).alias("payload"),
    )
