"""Weekly review tables and quality metrics over a window of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules


def weekly_items(runs: DataFrame, items: DataFrame, quality: DataFrame, digests: DataFrame, as_of_day: Column,
                 days: int = 7, key: str = "run_key") -> DataFrame:
    """Items of the runs of the last days that were delivered with complete artifacts.

    The day is the head of the run key, so the bound prunes partitions of a stored table.
    """
    day = F.to_date(F.substring(key, 1, 10))
    whole = runs.filter(
        day.between(F.date_sub(as_of_day, days), as_of_day)
        & (F.col("artifact_bundle_status") == "present") & F.col("delivered_at").isNotNull()
    ).select(key).join(quality.select(key), key, "left_semi").join(digests.select(key), key, "left_semi")
    return items.join(whole, key, "left_semi")


def weekly_review(items: DataFrame, events: DataFrame, as_of_day: Column, top: int = 5,
                  order: Sequence[str | Column] = ("run_key", "id")) -> DataFrame:
    """The four short lists of a weekly review: ``part, rank, ref, title``."""
    def ranked(df: DataFrame, part: str, ref: str, title: str, *by: Column | str) -> DataFrame:
        return df.orderBy(*by).limit(top).select(
            F.lit(part).alias("part"), F.row_number().over(Window.orderBy(*by)).alias("rank"),
            F.col(ref).cast("string").alias("ref"), F.col(title).alias("title"),
        )

    recent = events.filter(F.col("latest_seen") >= F.date_sub(as_of_day, 7))
    uncertain = items.filter(~F.col("has_fulltext") | (F.size("unknowns") > 0))
    parts = [
        ranked(recent, "changed", "event_id", "latest_title", F.desc("latest_seen"), "ord", "event_id"),
        ranked(items, "worth_rereading", "id", "headline", F.desc("relevance_score"), *order),
        ranked(uncertain, "uncertain", "id", "headline", *order),
        ranked(recent, "watch", "event_id", "title", "ord", "event_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bundle_coverage(attempts: DataFrame, key: str = "run_key") -> DataFrame:
    """Share of eligible runs whose evidence and quality are both readable and marked present.

    ``attempts(<key>, attempt, eligible, evidence_ok, quality_ok, marked)``; the last attempt of a
    run counts, a missing artifact stays in the denominator.
    """
    last = attempts.filter("eligible").groupBy(key).agg(
        F.max_by(F.col("evidence_ok") & F.col("quality_ok") & F.col("marked"), "attempt").alias("covered")
    )
    return last.agg(
        F.count("*").alias("eligible_runs"), F.count_if("covered").alias("covered_runs"),
        F.try_divide(F.count_if("covered"), F.count("*")).alias("coverage"),
    )


def card_validity(expected: DataFrame, cards: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Valid cards over expected items; ``cards(keys, problems)`` with an array of problems."""
    valid = cards.filter(F.size("problems") == 0).select(*keys).distinct().withColumn("ok", F.lit(True))
    joined = expected.join(valid, list(keys), "left")
    return joined.groupBy(*group).agg(
        F.count("*").alias("expected"), F.count_if("ok").alias("valid"),
        F.try_divide(F.count_if("ok"), F.count("*")).alias("validity"),
    )


def render_completeness(expected: DataFrame, found: DataFrame, run: str, id_: str = "article_id") -> DataFrame:
    """Per run: expected ids, how many are rendered, and ids missing, unexpected or repeated.

    A run that expects nothing has no row.
    """
    want = expected.select(run, id_).distinct().withColumn("want", F.lit(1))
    have = found.groupBy(run, id_).agg(F.count("*").alias("times"))
    both = want.join(have, [run, id_], "full_outer")
    out = both.groupBy(run).agg(
        F.count("want").alias("expected"), F.count_if(F.col("want").isNotNull() & F.col("times").isNotNull()).alias("rendered"),
        F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected"),
        F.count_if(F.col("times") > 1).alias("repeated"),
    ).filter("expected > 0")
    return out.withColumn("completeness", F.col("rendered") / F.col("expected"))


def two_source_rate(items: DataFrame, run: str) -> DataFrame:
    """Backfilled items that keep a primary and a context source; null when nothing was backfilled."""
    roles = F.transform("sources", lambda s: s["role"])
    backfilled = F.array_contains(roles, "context") | F.col("backfilled")
    both = F.array_contains(roles, "primary") & F.array_contains(roles, "context")
    out = items.groupBy(run).agg(F.count_if(backfilled).alias("backfilled"), F.count_if(backfilled & both).alias("labelled"))
    return out.withColumn("rate", F.try_divide("labelled", "backfilled")).withColumn(
        "status", F.when(F.col("backfilled") == 0, "not_applicable").otherwise("measured")
    )


ISSUE_KEY = ("run_key", "article_id", "code", "normalized_value")


#: Tasks that issues are dealt to, for each of the session's shuffle partitions.
ISSUE_TASKS = 8


def by_issue(df: DataFrame) -> DataFrame:
    """Rows dealt by issue to many small tasks: what is told apart or joined by issue holds the keys of its task, more than once."""
    return df.repartition(ISSUE_TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ISSUE_KEY)


def unique_issues(issues: DataFrame) -> DataFrame:
    return by_issue(issues.select(*ISSUE_KEY)).distinct()


def review_sample(issues: DataFrame, size: int = 30, seed: int = 7) -> DataFrame:
    """Equal-probability sample of a fixed size over unique issues, the same for the same seed.

    With no more issues than ``size`` all are taken. Sorting by a hash and taking the head keeps
    only ``size`` rows per task.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ISSUE_KEY]))
    return unique_issues(issues).orderBy(key, *ISSUE_KEY).limit(size)


def false_alarm_rates(sample: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of false alarms among the labelled sample, per code and in all (null code)."""
    return by_issue(sample).join(by_issue(labels), list(ISSUE_KEY)).rollup("code").agg(
        F.count("*").alias("reviewed"), F.count_if("false_alarm").alias("false_alarms"),
        (F.count_if("false_alarm") / F.count("*")).alias("rate"),
    )


def rolling_quality(daily: DataFrame, days: int = 14, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over the last local calendar days up to each day.

    ``daily(keys, day, total_items, unsupported)``: one row per day, so the window holds days, not items.
    """
    number = F.date_diff(F.col("day"), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-(days - 1), 0)
    total, bad = F.sum("total_items").over(w), F.sum("unsupported").over(w)
    return daily.select(
        *keys, "day", total.alias("total_items"), bad.alias("unsupported"), F.try_divide(bad, total).alias("ratio")
    )
