"""Links from the reports of a run to the most similar report of the runs before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.operators.vectors import nearest_earlier


def link_progress(today: DataFrame, past: DataFrame, run: str, snapshots: int = rules.RECENT_SNAPSHOTS,
                  threshold: float = rules.PROGRESS_SIMILARITY, **blocking: int) -> DataFrame:
    """``run, id, prev_id, cos`` for rows with a past row at or above the threshold.

    ``run`` is a running number; a past row is offered to the next ``snapshots`` runs, so the
    join stays an equality on the run.
    """
    ahead = past.withColumn(run, F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(snapshots)), lambda i: (F.col(run) + i).cast(past.schema[run].dataType)
    )))
    return nearest_earlier(today, ahead, [run], threshold, **blocking)


def tag_progress(reps: DataFrame, past: DataFrame, run: str, **options) -> DataFrame:
    """The representatives with ``progress_of`` = previous title, date and article id, or null."""
    links = link_progress(reps, past, run, **options)
    previous = past.select(
        F.col("id").alias("prev_id"),
        F.struct(
            F.coalesce("zh", "raw_title").alias("prev_zh"), F.col("date"), F.col("article_id")
        ).alias("progress_of"),
    )
    return reps.join(
        links.join(previous, "prev_id").select(run, "id", "progress_of"), [run, "id"], "left"
    )
