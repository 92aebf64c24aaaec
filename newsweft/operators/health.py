"""Checks over status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft import rules


def health_issues(profiles: DataFrame, jobs: DataFrame, sources: DataFrame, pipelines: DataFrame, now: Column) -> DataFrame:
    """All issues as ``code, source, detail``; everything is fine iff there is none.

    ``profiles(name, running, connected)``, ``jobs(profile, name, last_status, last_error)``,
    ``sources(name, status)``, ``pipelines(name, status, last_run)``.
    """
    def issue(df: DataFrame, code: Column | str, source: str, detail: Column) -> DataFrame:
        code = F.lit(code) if isinstance(code, str) else code
        return df.select(code.alias("code"), F.col(source).alias("source"), detail.alias("detail"))

    age = F.floor(F.timestamp_diff("SECOND", F.col("last_run"), now) / F.lit(3600))
    stale = F.timestamp_diff("SECOND", F.col("last_run"), now) > rules.STALE_HOURS * 3600
    down = profiles.filter(~(F.col("running") & F.col("connected")))
    parts = [
        issue(down, F.when(~F.col("running"), "process_down").otherwise("disconnected"), "name", F.lit("")),
        issue(jobs.filter((F.col("last_status") == "failed") | (F.coalesce("last_error", F.lit("")) != "")),
              "job_failed", "profile", F.col("name")),
        issue(sources.filter(~F.lower(F.coalesce("status", F.lit("missing"))).isin(*rules.HEALTHY_SOURCE_STATES)),
              "source_unavailable", "name", F.coalesce("status", F.lit("missing"))),
        issue(pipelines.filter(~F.upper(F.coalesce("status", F.lit("missing"))).isin(*rules.HEALTHY_JOB_STATES)),
              "pipeline_state", "name", F.coalesce("status", F.lit("missing"))),
        issue(pipelines.filter(stale), "pipeline_stale", "name", age.cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
