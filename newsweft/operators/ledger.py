"""Ledgers of what was sent: memory, retention, once-only delivery, artifact status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules


def append_sent(ledger: DataFrame, keys: DataFrame, day: Column, retention_days: int = rules.SENT_RETENTION_DAYS) -> DataFrame:
    """``(day, key)`` with today's keys added once and days out of retention left out.

    The retention is a plain bound on ``day``, the partition column of a stored ledger.
    """
    cutoff = F.date_sub(day, retention_days)
    today = keys.select(day.alias("day"), "key")
    return ledger.select("day", "key").filter(F.col("day") >= cutoff).unionByName(today).distinct()


def should_skip_run(runs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Runs that have not been written yet."""
    return runs.join(done.select(key).distinct(), key, "left_anti")


def deliver_once(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """``run_id, status, count``: duplicate if the ledger closed the run, else empty or delivered.

    ``runs(run_id, count)``, ``ledger(run_id, status, count)``.
    """
    closed = ledger.filter(F.col("status").isin("delivered", "empty")).select(
        "run_id", F.coalesce("count", F.lit(0)).alias("old_count"), F.lit(True).alias("closed")
    )
    return runs.join(closed, "run_id", "left").select(
        "run_id",
        F.when(F.col("closed"), "duplicate").when(F.col("count") == 0, "empty").otherwise("delivered").alias("status"),
        F.when(F.col("closed"), F.col("old_count")).otherwise(F.col("count")).alias("count"),
    )


def message_digest(messages: DataFrame) -> DataFrame:
    return messages.withColumn("message_sha256", F.when(F.col("status") == "delivered", F.sha2("message", 256)).otherwise(""))


def proposal_status(proposals: DataFrame, run: str, most: int = rules.PROPOSALS_PER_RUN) -> DataFrame:
    """Per run: number of proposals, of incomplete ones, and whether the run may be announced."""
    filled = F.lit(True)
    for name in ("entry_id", "claim", "when_to_use", "when_not_to_use"):
        filled = filled & (F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "")
    cited = F.coalesce(F.exists("evidence", lambda e: F.trim(F.coalesce(e["url"], F.lit(""))) != ""), F.lit(False))
    out = proposals.groupBy(run).agg(F.count("*").alias("proposals"), F.count_if(~(filled & cited)).alias("incomplete"))
    return out.withColumn("valid", (F.col("proposals") <= most) & (F.col("incomplete") == 0))


def artifact_status(runs: DataFrame, evidence: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """present or missing for evidence, quality and the bundle of both."""
    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit("present"))

    joined = runs.join(mark(evidence, "e"), key, "left").join(mark(quality, "q"), key, "left")
    both = F.col("e").isNotNull() & F.col("q").isNotNull()
    return joined.select(
        *runs.columns, F.coalesce("e", F.lit("missing")).alias("evidence_status"),
        F.coalesce("q", F.lit("missing")).alias("quality_status"),
        F.when(both, "present").otherwise("missing").alias("artifact_bundle_status"),
    )


def channel_delivery(chunks: DataFrame, run: str, recipient: str, ok: str) -> DataFrame:
    """A recipient is served iff all chunks arrived, a run is delivered iff any recipient is served."""
    per = chunks.groupBy(run, recipient).agg(F.bool_and(ok).alias("served"))
    return per.groupBy(run).agg(
        F.count_if("served").alias("served"), F.count("*").alias("recipients"), F.bool_or("served").alias("delivered")
    )


def usage_counts(actions: DataFrame, as_of: Column, days: int = 7, ts: str = "ts",
                 keys: Sequence[str] = ("profile", "action")) -> DataFrame:
    """Actions of the last days per profile; rows without time or action do not count."""
    start = as_of - F.make_dt_interval(days=F.lit(days))
    recent = actions.filter((F.col(ts) >= start) & F.col(keys[-1]).isNotNull() & (F.col(keys[-1]) != ""))
    return recent.groupBy(*keys).agg(F.count("*").alias("count"))


def issue_changes(issues: DataFrame, key: str, at: str, issue: str) -> DataFrame:
    """States whose set of issues differs from the state before: ``key, at, signature``.

    ``issues`` holds one row per state and issue, a null issue for a state without any. An empty
    signature after another one means recovery; the very first state counts when it has issues.
    """
    states = issues.groupBy(key, at).agg(F.array_join(F.array_sort(F.collect_set(issue)), ",").alias("signature"))
    before = F.lag("signature", 1, "").over(Window.partitionBy(key).orderBy(at))
    return states.withColumn("before", before).filter(F.col("signature") != F.col("before")).drop("before")
