"""The given tables seen as articles, cards and runs of a news engine.

``documents`` has no titles and times, so the view derives them: the title is the first line, a document is published ``doc_id % 96`` hours before ``AS_OF`` and belongs to the
run (local day and half-day) of that time. The SQL fragments say the same for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.operators.sessions import logical_date, session_of
from newsweft.plans.registry import table
from newsweft.rules import ScoringRules, SelectionRules

AS_OF_TEXT = "2024-02-01 00:00:00"

# Word lists that occur in the given texts.
SCORING = ScoringRules(
    high=("attion", "eringble", "oure", "eauoué"),
    medium=("that", "con", "pour", "die"),
    low=("eriner", "stheit", "las"),
    personal=("thanedble", "ción", "mit"),
    trust={"src0": 2, "src1": 1, "src2": 3, "src5": 2, "src8": 1, "src13": 2},
)
SELECTION = SelectionRules(
    quota={"en": 6, "fr": 4, "de": 3}, floor={"en": 3, "de": 2},
    required=("en", "fr", "de"), default_category="en",
)


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hours = F.make_dt_interval(hours=(F.col("doc_id") % 96).cast("int"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.element_at(F.split("text", "\n", 2), 1).alias("title"),
        F.substring("text", 1, 500).alias("summary"),
        F.col("text").alias("fulltext"),
        "source",
        F.col("lang").alias("category"),
        F.col("source").isin("src0", "src1").alias("reference"),
        (as_of() - hours).alias("published"),
        F.concat(F.lit("https://example.org/d/"), F.col("doc_id").cast("string")).alias("link"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("feed_idx"),
        F.col("doc_id").alias("entry_idx"),
    ).withColumn(
        "run_key",
        F.concat(logical_date(F.col("published")).cast("string"), F.lit("-"), session_of(F.col("published"))),
    )


ARTICLES_SQL = f"""
art AS (
  SELECT *, strftime(published + INTERVAL 4 HOUR, '%Y-%m-%d') || '-' ||
    CASE WHEN hour(published + INTERVAL 8 HOUR) BETWEEN 4 AND 15 THEN 'AM' ELSE 'PM' END AS run_key
  FROM (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title,
    substr(text, 1, 500) AS summary, text AS fulltext, source, lang AS category,
    source IN ('src0', 'src1') AS reference,
    TIMESTAMP '{AS_OF_TEXT}' - to_hours(doc_id % 96) AS published,
    'https://example.org/d/' || doc_id AS link,
    CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS feed_idx, doc_id AS entry_idx
  FROM documents))"""


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
