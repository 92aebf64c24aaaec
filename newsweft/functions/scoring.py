"""Score expressions: keyword tiers, freshness, trust and headline quality."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions.text import WORD_END, WORD_START, proper_nouns
from newsweft.rules import ScoringRules


def keyword_pattern(terms: Sequence[str], escape: bool = True) -> str:
    """One whole-word, case-insensitive alternation; the order of the terms is kept."""
    body = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) if escape else t for t in terms)
    return f"(?i){WORD_START}(?:{body}){WORD_END}"


def keyword_hit_list(text: Column, terms: Sequence[str]) -> Column:
    """The distinct terms found, sorted."""
    if not terms:
        return F.array().cast("array<string>")
    hits = F.regexp_extract_all(F.lower(text), F.lit(keyword_pattern(terms)), F.lit(0))
    return F.array_sort(F.array_distinct(hits))


def keyword_hits(text: Column, terms: Sequence[str]) -> Column:
    return F.size(keyword_hit_list(text, terms))


def hours_between(as_of: Column, published: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", published, as_of) / F.lit(3_600_000_000.0)


def freshness_bonus(published: Column, as_of: Column, steps: Sequence[tuple[int, float]]) -> Column:
    """Bonus of the first step whose age limit holds; 0 without a time."""
    age = hours_between(as_of, published)
    out: Column | None = None
    for limit, bonus in sorted(steps):
        out = F.when(age <= limit, bonus) if out is None else out.when(age <= limit, bonus)
    return F.coalesce(out.otherwise(0.0), F.lit(0.0)) if out is not None else F.lit(0.0)


def trust_of(source: Column, trust: dict[str, int]) -> Column:
    """Trust points of a source; the rule table is folded into the plan as a literal map."""
    if not trust:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for pair in trust.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(0))


def has_hard_number(title: Column) -> Column:
    return F.rlike(title, F.lit("(?i)" + rules.HARD_NUMBER))


def hard_number_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("(?i)" + rules.HARD_NUMBER), F.lit(0)))


def is_clickbait(title: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.rlike(F.lower(title), F.lit("|".join(f"(?:{p})" for p in patterns)))


def score_importance(title: Column, summary: Column, published: Column, source: Column, as_of: Column,
                     scoring: ScoringRules | None = None) -> Column:
    """Importance of one article as a single native expression."""
    scoring = scoring or ScoringRules()
    text = F.concat(title, F.lit(" "), F.coalesce(summary, F.lit("")))
    high, medium, low, personal = scoring.weights
    return (
        keyword_hits(text, scoring.high) * high
        + keyword_hits(text, scoring.medium) * medium
        + keyword_hits(text, scoring.low) * low
        + keyword_hits(text, scoring.personal) * personal
        + freshness_bonus(published, as_of, scoring.freshness)
        + trust_of(source, scoring.trust)
        + F.when(is_clickbait(title, scoring.clickbait), -2.0).otherwise(0.0)
        + F.when(has_hard_number(title), 1.0).otherwise(0.0)
        + F.when(F.size(proper_nouns(title)) >= 2, 1.0).otherwise(0.0)
    )


def score_life_science(title: Column, summary: Column, published: Column, source: Column, as_of: Column,
                       terms: Sequence[str] = rules.LIFE_SCIENCE,
                       trust: dict[str, int] | None = None) -> Column:
    text = F.concat(title, F.lit(" "), F.coalesce(summary, F.lit("")))
    trust = rules.LIFE_SCIENCE_TRUST if trust is None else trust
    return (
        keyword_hits(text, terms) * 3.0
        + freshness_bonus(published, as_of, ((24, 2.0), (48, 1.0)))
        + trust_of(source, trust)
    )


def score_signal(title: Column, summary: Column, terms: Sequence[str] = rules.SIGNAL_TERMS) -> Column:
    """Every occurrence counts here, not only the distinct ones."""
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce(summary, F.lit(""))))
    hits = F.size(F.regexp_extract_all(text, F.lit(keyword_pattern(terms, escape=False)), F.lit(0)))
    return hits * 3.0 + F.when(F.rlike(text, F.lit(rules.REPO_URL)), 2.0).otherwise(0.0)


def length_bonus(score: Column, fulltext: Column) -> Column:
    long_text = F.length(fulltext) >= rules.FULLTEXT_BONUS_LENGTH
    return F.when(long_text, score + rules.FULLTEXT_BONUS).otherwise(score)


def trust_tier(trust: Column) -> Column:
    return F.when(trust >= 2, "major_media").when(trust == 1, "secondary").otherwise("unknown")


def content_level(fulltext: Column, summary: Column, backfilled: Column) -> Column:
    has_text, has_summary = F.coalesce(fulltext, F.lit("")) != "", F.coalesce(summary, F.lit("")) != ""
    return (
        F.when(backfilled & has_summary, "summary")
        .when(backfilled, "headline")
        .when(has_text, "fulltext")
        .when(has_summary, "summary")
        .otherwise("headline")
    )


def evidence_notice(has_conflict: Column, has_fulltext: Column, cluster_size: Column) -> Column:
    return (
        F.when(F.coalesce(has_conflict, F.lit(False)), rules.NOTICE_CONFLICT)
        .when(~F.coalesce(has_fulltext, F.lit(False)), rules.NOTICE_NO_FULLTEXT)
        .when(F.coalesce(cluster_size, F.lit(1)) < 2, rules.NOTICE_SINGLE_SOURCE)
        .otherwise("")
    )


def classify_by_pattern(text: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern, in the given order, that occurs in the text."""
    out: Column | None = None
    for needle, label in patterns:
        test = F.contains(text, F.lit(needle))
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(default) if out is None else out.otherwise(default)
