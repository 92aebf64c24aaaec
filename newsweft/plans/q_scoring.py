"""Scoring queries over the article view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions import scoring as S
from newsweft.functions import text as T
from newsweft.plans.articles import ARTICLES_SQL, AS_OF_TEXT, SCORING, articles, as_of, sql_list
from newsweft.plans.registry import query, table



def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def hits_sql(x: str, terms) -> str:
    return f"list_distinct(list_filter({tokens_sql(x)}, lambda w: list_contains({sql_list(terms)}, w)))"


def keywords_sql(x: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), "
        f"lambda w: length(w) >= 3 AND NOT list_contains({sql_list(rules.TITLE_STOPWORDS)}, w))))"
    )


def nouns_sql(x: str) -> str:
    return (
        "list_sort(list_distinct(list_filter(list_concat(list_concat("
        f"list_transform(list_filter(regexp_extract_all({x}, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*'), "
        "lambda w: length(w) >= 3), lambda w: lower(w)), "
        f"list_transform(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda w: regexp_full_match(w, '[A-Z]{2,6}')), lambda w: lower(w))), "
        f"regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,6}}')), "
        f"lambda w: NOT list_contains({sql_list(rules.GENERIC_NAMES)}, w))))"
    )


_HARD = rules.HARD_NUMBER.replace("'", "''")
HARD_SQL = f"regexp_matches({{x}}, '(?i){_HARD}')"
_CLICK = "|".join(f"(?:{p})" for p in SCORING.clickbait).replace("'", "''")
_TRUST = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORING.trust.items()) + " ELSE 0 END"
_AGE = f"(epoch(TIMESTAMP '{AS_OF_TEXT}' - published) / 3600.0)"
_FRESH = f"CASE WHEN {_AGE} <= 6 THEN 3 WHEN {_AGE} <= 12 THEN 2 WHEN {_AGE} <= 24 THEN 1 ELSE 0 END"
_TEXT = "title || ' ' || summary"
SCORE_SQL = (
    f"CAST(3 * len({hits_sql(_TEXT, SCORING.high)}) + len({hits_sql(_TEXT, SCORING.medium)}) "
    f"- 2 * len({hits_sql(_TEXT, SCORING.low)}) + 4 * len({hits_sql(_TEXT, SCORING.personal)}) "
    f"+ {_FRESH} + {_TRUST} - CASE WHEN regexp_matches(lower(title), '{_CLICK}') THEN 2 ELSE 0 END "
    f"+ CASE WHEN {HARD_SQL.format(x='title')} THEN 1 ELSE 0 END "
    f"+ CASE WHEN len({nouns_sql('title')}) >= 2 THEN 1 ELSE 0 END AS DOUBLE)"
)
SCORED_SQL = f"{ARTICLES_SQL}, scored AS (SELECT *, {SCORE_SQL} AS score FROM art)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).withColumn(
        "score",
        S.score_importance(F.col("title"), F.col("summary"), F.col("published"), F.col("source"), as_of(), SCORING),
    )


@query("title_keywords", f"WITH {ARTICLES_SQL} SELECT id, array_to_string({keywords_sql('title')}, ' ') AS keywords FROM art")
def title_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("id", F.array_join(T.title_keywords(F.col("title")), " ").alias("keywords"))


@query("proper_nouns", f"SELECT doc_id, array_to_string({nouns_sql('text')}, '|') AS nouns FROM documents")
def proper_nouns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.proper_nouns(F.col("text")), "|").alias("nouns"))


@query("keyword_hits", f"""SELECT doc_id, len({hits_sql('text', SCORING.high)}) AS high,
  len({hits_sql('text', SCORING.medium)}) AS medium, len({hits_sql('text', SCORING.personal)}) AS personal FROM documents""")
def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", S.keyword_hits(text, SCORING.high).alias("high"),
        S.keyword_hits(text, SCORING.medium).alias("medium"), S.keyword_hits(text, SCORING.personal).alias("personal"),
    )


@query("keyword_hit_list", f"""SELECT doc_id,
  array_to_string(list_sort({hits_sql('text', SCORING.personal)}), ',') AS terms FROM documents""")
def keyword_hit_list(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.keyword_hit_list(F.col("text"), SCORING.personal)
    return table(spark, sf, "documents").select("doc_id", F.array_join(hits, ",").alias("terms"))


@query("hard_number", f"SELECT doc_id, {HARD_SQL.format(x='text')} AS hard FROM documents")
def hard_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.has_hard_number(F.col("text")).alias("hard"))


@query("score_importance", f"WITH {SCORED_SQL} SELECT id, score FROM scored")
def score_importance(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", "score")


@query("score_life_science", f"""WITH {ARTICLES_SQL} SELECT id, CAST(3 * len({hits_sql(_TEXT, SCORING.high)}) +
  CASE WHEN {_AGE} <= 24 THEN 2 WHEN {_AGE} <= 48 THEN 1 ELSE 0 END + {_TRUST} AS DOUBLE) AS score FROM art""")
def score_life_science(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return a.select("id", S.score_life_science(
        F.col("title"), F.col("summary"), F.col("published"), F.col("source"), as_of(), SCORING.high, SCORING.trust
    ).alias("score"))


@query("score_signal", f"""WITH {ARTICLES_SQL} SELECT id, CAST(3 * len(list_filter({tokens_sql(_TEXT)},
  lambda w: list_contains(['the', 'que', 'und', 'los'], w))) +
  CASE WHEN regexp_matches(lower({_TEXT}), 'github\\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+') THEN 2 ELSE 0 END
  AS DOUBLE) AS score FROM art""")
def score_signal(spark: SparkSession, sf: str) -> DataFrame:
    terms = ("the", "que", "und", "los")
    return articles(spark, sf).select("id", S.score_signal(F.col("title"), F.col("summary"), terms).alias("score"))


@query("min_signal_score", f"""WITH {ARTICLES_SQL}, s AS (SELECT id, run_key, feed_idx, entry_idx,
  CAST(3 * len(list_filter({tokens_sql(_TEXT)}, lambda w: list_contains(['the', 'que', 'und', 'los'], w))) AS DOUBLE) AS score
  FROM art) SELECT id, run_key, score FROM s WHERE score >= {rules.SIGNAL_MIN_SCORE}
  QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY score DESC, feed_idx, entry_idx) <= 6""")
def min_signal_score(spark: SparkSession, sf: str) -> DataFrame:
    from newsweft.operators.selection import top_k

    rows = articles(spark, sf).select(
        "id", "run_key", "feed_idx", "entry_idx",
        S.score_signal(F.col("title"), F.col("summary"), ("the", "que", "und", "los")).alias("score"),
    ).filter(F.col("score") >= rules.SIGNAL_MIN_SCORE)
    return top_k(rows, ["run_key"], "score", 6).select("id", "run_key", "score")


@query("length_bonus", f"""WITH {SCORED_SQL} SELECT id,
  CASE WHEN length(fulltext) >= 800 THEN score + 1.5::DOUBLE ELSE score END AS score FROM scored""")
def length_bonus(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", S.length_bonus(F.col("score"), F.col("fulltext")).alias("score"))


@query("source_trust_lookup", """WITH trust AS (SELECT d.source, CASE WHEN avg(l.quality) >= 0.8 THEN 2
    WHEN avg(l.quality) >= 0.6 THEN 1 ELSE 0 END AS trust FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source)
  SELECT d.doc_id, coalesce(t.trust, 0) AS trust, CASE WHEN coalesce(t.trust, 0) >= 2 THEN 'major_media'
    WHEN t.trust = 1 THEN 'secondary' ELSE 'unknown' END AS tier FROM documents d LEFT JOIN trust t USING (source)""")
def source_trust_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Trust per source measured from the labels, looked up for every document."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    mean = F.avg("quality")
    trust = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").groupBy("source").agg(
        F.when(mean >= 0.8, 2).when(mean >= 0.6, 1).otherwise(0).alias("trust")
    )
    points = F.coalesce("trust", F.lit(0))
    return docs.join(trust, "source", "left").select(
        "doc_id", points.alias("trust"), S.trust_tier(points).alias("tier")
    )


@query("content_level", f"""WITH {ARTICLES_SQL} SELECT id, CASE WHEN id % 11 = 0 THEN 'summary'
  WHEN id % 7 = 0 THEN 'summary' ELSE 'fulltext' END AS level FROM art""")
def content_level(spark: SparkSession, sf: str) -> DataFrame:
    fulltext = F.when(F.col("id") % 7 == 0, F.lit("")).otherwise(F.col("fulltext"))
    return articles(spark, sf).select(
        "id", S.content_level(fulltext, F.col("summary"), F.col("id") % 11 == 0).alias("level")
    )


@query("fulltext_coverage", """SELECT source, count(*) AS items, count(*) FILTER (WHERE text <> '') AS with_text,
  count(*) FILTER (WHERE length(text) >= 800) AS with_bonus FROM documents GROUP BY source""")
def fulltext_coverage(spark: SparkSession, sf: str) -> DataFrame:
    long_text = F.length("text") >= rules.FULLTEXT_BONUS_LENGTH
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("items"), F.count_if(F.col("text") != "").alias("with_text"),
        F.count_if(long_text).alias("with_bonus"),
    )
