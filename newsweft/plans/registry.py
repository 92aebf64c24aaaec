"""Names, jobs and check statements of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Job], Job]:
    """Register a job under a name, with SQL over the same tables that gives the same rows."""

    def add(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = job
        if check is not None:
            CHECKS[name] = check
        return job

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it lies; the session's settings say how files are cut."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
