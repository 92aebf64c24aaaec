"""Full texts for important articles whose own source has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions.text import content_sha256, truncate
from newsweft.functions.urls import host_allowed, hostname, normalize_url


def backfill_texts(targets: DataFrame, results: DataFrame, captured_at: Column, scope: str = "run_key",
                   domains: Sequence[str] = rules.FULLTEXT_DOMAINS, search: str = "id") -> DataFrame:
    """Targets with the text of their first usable search result: ``fulltext`` and ``backfill``.

    ``targets(<scope>, id, <search>, ...)``, ``results(<search>, search_rank, url, title, source, text)``. A result is
    usable if its host is allowed and its page gave a text. Targets without one keep a null
    ``backfill``. Each search keeps one result by a partial aggregate before it meets the targets that made it, so
    targets with the same search never multiply the results.
    """
    host = hostname(F.col("url"))
    usable = results.filter(host_allowed(host, domains) & (F.coalesce("text", F.lit("")) != ""))
    text = truncate(F.col("text"), rules.FULLTEXT_CHARS)
    best = usable.groupBy(search).agg(F.min_by(
        F.struct(
            F.struct(
                "url", normalize_url(F.col("url")).alias("canonical_url"), host.alias("hostname"),
                F.coalesce("source", F.lit("")).alias("publisher"), F.col("title").alias("candidate_title"), "search_rank",
                F.lit("preferred_domain").alias("match_reason"), captured_at.cast("string").alias("captured_at"),
                content_sha256(text).alias("content_sha256"),
            ).alias("backfill"),
            text.alias("text"),
        ), "search_rank",
    ).alias("b"))
    found = best.select(search, F.col("b.backfill").alias("backfill"), F.col("b.text").alias("_text"))
    out = targets.drop("backfill").join(found, search, "left")
    return out.withColumn("fulltext", F.coalesce("_text", "fulltext")).drop("_text")


def with_numbered_text(items: DataFrame, lines: DataFrame, keys: Sequence[str], description: str,
                       skip: str = "skip", length: int = 80) -> DataFrame:
    """Items with the line of their number, else the head of their description, as ``line``.

    ``lines(keys, idx, text)``; the last line of a number counts, a line that says ``skip`` drops
    the item.
    """
    said = lines.groupBy(*keys, "idx").agg(F.max_by("text", "pos").alias("said"))
    out = items.join(said, [*keys, "idx"], "left").filter(F.lower(F.coalesce("said", F.lit(""))) != skip)
    return out.withColumn("line", F.coalesce("said", F.substring(description, 1, length))).drop("said")
