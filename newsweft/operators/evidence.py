"""Sentences, anchored facts and evidence cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions.numbers import extract_claims
from newsweft.functions.scoring import content_level, trust_of, trust_tier
from newsweft.functions.text import content_sha256, let, normalize_ws, proper_nouns, truncate
from newsweft.functions.urls import article_id, hostname

_NO_TEXT = "array<string>"


def split_sentences(text: Column) -> Column:
    """Sentences of the whitespace-normalised text."""
    return F.filter(F.split(normalize_ws(text), r"(?<=[。！？.!?])\s+"), lambda s: s != "")


def claims_of(claims: Column, dates: bool) -> Column:
    kept = F.filter(claims, lambda c: (c["type"] == rules.CLAIM_DATE) == F.lit(dates))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda c: c["claim"])))


def anchored_facts(sentences: Column, anchors: Column, limit: int = rules.FACTS_PER_CARD,
                   case_sensitive: bool = True) -> Column:
    """First sentences that hold an anchor: array of (fact_no, excerpt, sentence_hash, anchors).

    Names are stored lower-cased, so with ``case_sensitive`` a capitalised name does not anchor
    its own sentence; without it, letters compare in either case.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    tagged = let(anchors, lambda known: F.transform(
        sentences,
        lambda s: F.struct(
            s.alias("sentence"), F.filter(known, lambda a: F.contains(fold(s), fold(a))).alias("anchors")
        ),
    ))
    first = F.slice(F.filter(tagged, lambda t: F.size(t["anchors"]) > 0), 1, limit)
    return F.transform(
        first,
        lambda t, i: F.struct(
            (i + 1).alias("fact_no"),
            truncate(t["sentence"], rules.EXCERPT_CHARS).alias("excerpt"),
            content_sha256(truncate(t["sentence"], rules.EXCERPT_CHARS)).alias("sentence_hash"),
            F.array_sort(t["anchors"]).alias("anchors"),
        ),
    )


def _source(id_: Column | str, role: str, publisher: Column, url: Column, canonical: Column, host: Column,
            level: Column, tier: Column, captured: Column, sha: Column) -> Column:
    lit = F.lit(id_) if isinstance(id_, str) else id_
    return F.struct(
        lit.alias("id"), F.lit(role).alias("role"), publisher.alias("publisher"), url.alias("url"),
        canonical.alias("canonical_url"), host.alias("hostname"), level.alias("content_level"),
        tier.alias("trust_tier"), captured.alias("captured_at"), sha.alias("content_sha256"),
    )


def build_evidence_cards(articles: DataFrame, captured_at: Column, day: Column,
                         trust: dict[str, int] | None = None, case_sensitive: bool = True) -> DataFrame:
    """Articles with ``article_id`` and ``card``; one projection, no shuffle.

    Used columns: ``title, summary, fulltext, link, source, category, published, cluster_titles,
    ai_reason, ai_score, canonical_url, backfill`` (the last a struct or null); missing ones count
    as null.
    """
    trust = rules.SOURCE_TRUST if trust is None else trust
    empty, null_text = F.lit(""), F.lit(None).cast("string")

    def col(name: str, default: Column = empty) -> Column:
        return F.coalesce(F.col(name), default) if name in articles.columns else default

    title, summary, fulltext, link, source = (col(c) for c in ("title", "summary", "fulltext", "link", "source"))
    backfill = (
        F.col("backfill") if "backfill" in articles.columns
        else F.lit(None).cast("struct<publisher:string,url:string,canonical_url:string,hostname:string,"
                          "captured_at:string,content_sha256:string>")
    )
    has_backfill = backfill.isNotNull()
    captured = captured_at.cast("string")
    level = content_level(fulltext, summary, has_backfill)
    primary_text = (
        F.when(level == "fulltext", fulltext)
        .when(level == "summary", F.concat(title, F.lit("\n"), summary))
        .otherwise(title)
    )
    primary = _source(
        "source:primary", "primary", source, link, col("canonical_url", null_text), hostname(link), level,
        trust_tier(trust_of(source, trust)), captured, content_sha256(primary_text),
    )
    context = _source(
        "source:backfill", "context", F.coalesce(backfill["publisher"], empty), F.coalesce(backfill["url"], empty),
        backfill["canonical_url"], F.coalesce(backfill["hostname"], empty), F.lit("fulltext"), F.lit("major_media"),
        F.coalesce(backfill["captured_at"], captured),
        F.coalesce(backfill["content_sha256"], content_sha256(fulltext)),
    )
    titles = col("cluster_titles", F.array().cast(_NO_TEXT))
    others = F.transform(
        titles,
        lambda t, i: _source(
            F.concat(F.lit("source:corroboration:"), i.cast("string")), "corroboration", F.lit("Unknown"), empty,
            null_text, empty, F.lit("headline"), F.lit("unknown"), captured, content_sha256(t),
        ),
    )
    searched = F.when(fulltext != "", fulltext).when(summary != "", summary).otherwise(title)
    rows = (
        articles.withColumn("article_id", article_id(link, source, title, col("published", day), col("canonical_url", null_text)))
        .withColumn("_entities", proper_nouns(searched))
        .withColumn("_claims", extract_claims(searched))
        .withColumn("_numbers", claims_of(F.col("_claims"), dates=False))
        .withColumn("_dates", claims_of(F.col("_claims"), dates=True))
        .withColumn("_sources", F.concat(
            F.array(primary), F.when(has_backfill, F.array(context)).otherwise(F.array().cast(
                "array<struct<id:string,role:string,publisher:string,url:string,canonical_url:string,hostname:string,"
                "content_level:string,trust_tier:string,captured_at:string,content_sha256:string>>")), others))
        .withColumn("_facts", anchored_facts(
            split_sentences(searched), F.concat("_entities", "_numbers", "_dates"), case_sensitive=case_sensitive))
    )
    from_backfill = has_backfill & (fulltext != "")
    facts = F.transform(
        "_facts",
        lambda f: F.struct(
            F.concat(F.lit("f"), f["fact_no"].cast("string")).alias("fact_id"), f["excerpt"].alias("text"),
            F.when(from_backfill, "source:backfill").otherwise("source:primary").alias("source_id"),
            captured.alias("captured_at"),
            F.when(from_backfill, F.coalesce(backfill["content_sha256"], empty))
            .otherwise(F.col("_sources")[0]["content_sha256"]).alias("content_sha256"),
            f["excerpt"].alias("excerpt"), f["sentence_hash"].alias("sentence_hash"), f["anchors"].alias("anchors"),
        ),
    )
    unknowns = F.array_compact(F.array(
        F.when(fulltext == "", rules.UNKNOWN_NO_FULLTEXT), F.when(F.size("_dates") == 0, rules.UNKNOWN_NO_DATE)
    ))
    card = F.struct(
        F.lit(1).alias("version"), F.lit(1).alias("id_scheme_version"), F.col("article_id"), title.alias("headline"),
        facts.alias("confirmed_facts"), F.col("_entities").alias("entities"), F.col("_numbers").alias("numbers"),
        F.col("_dates").alias("dates"), unknowns.alias("unknowns"), F.col("_sources").alias("sources"),
        F.struct(
            (fulltext != "").alias("has_fulltext"), (F.size("_sources") > 1).alias("has_multiple_sources"),
            F.size("_facts").alias("fact_count"),
            (F.size("_entities") + F.size("_numbers") + F.size("_dates")).alias("anchor_count"),
        ).alias("coverage"),
        summary.alias("summary"), col("category").alias("category"),
        col("published", null_text.cast("timestamp_ntz")).cast("string").alias("published_at"),
        col("ai_reason").alias("why_relevant"), col("ai_score", F.lit(0.0)).cast("double").alias("relevance_score"),
    )
    return rows.withColumn("card", card).drop("_entities", "_claims", "_numbers", "_dates", "_sources", "_facts")


def card_problems(card: Column) -> Column:
    """Structural problems of a card; empty when it is valid."""
    def blank(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    per_fact = F.flatten(F.transform(
        F.coalesce(card["confirmed_facts"], F.array()),
        lambda f: F.array_compact(F.array(*[
            F.when(blank(f[name]), F.concat(F.lit("fact "), f["fact_id"], F.lit(f" missing {name}")))
            for name in ("excerpt", "content_sha256", "sentence_hash", "source_id")
        ])),
    ))
    head = F.array_compact(F.array(
        F.when(~F.coalesce(card["version"] == 1, F.lit(False)), "version must be 1"),
        F.when(blank(card["article_id"]), "missing article_id"),
    ))
    return F.when(card.isNull(), F.array(F.lit("no card"))).otherwise(F.concat(head, per_fact))


def primary_source(sources: Column) -> Column:
    return F.get(F.filter(sources, lambda s: s["role"] == "primary"), F.lit(0))
