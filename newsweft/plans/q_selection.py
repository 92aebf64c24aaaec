"""Selection queries: top-k per bucket, quotas, coverage, mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.operators import selection as K
from newsweft.plans.articles import SELECTION, sql_list
from newsweft.plans.q_scoring import SCORED_SQL, scored
from newsweft.plans.registry import query, table
from newsweft.session import durable

COLUMNS = ["id", "run_key", "category", "score", "feed_idx", "entry_idx"]
_QUOTA = "CASE category WHEN 'en' THEN 6 WHEN 'fr' THEN 4 WHEN 'de' THEN 3 END"
_ORDER = "score DESC, feed_idx, entry_idx"


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(*COLUMNS)


def stored_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The scored candidates as a small table, for jobs that look at them more than once."""
    return durable(pool(spark, sf))


@query("bucket_top_k", f"""WITH {SCORED_SQL} SELECT id, run_key, category, score FROM scored
  WHERE category IN ('en', 'fr', 'de')
  QUALIFY row_number() OVER (PARTITION BY run_key, category ORDER BY {_ORDER}) <= 3 * {_QUOTA}""")
def bucket_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return K.bucket_top_k(pool(spark, sf), "run_key", SELECTION).select("id", "run_key", "category", "score")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """One or two decisions per labelled document, kept for good quality; the second one counts."""
    labels = table(spark, sf, "labels")
    first = labels.select(
        F.col("doc_id").alias("id"), F.lit(1).alias("seq"), (F.col("quality") == 1).alias("keep"),
        (F.col("doc_id") % 10 + 1).cast("double").alias("score"), F.lit("first").alias("reason"),
    )
    again = labels.filter("doc_id % 5 = 0").select(
        F.col("doc_id").alias("id"), F.lit(2).alias("seq"), (F.col("quality") == 1).alias("keep"),
        (F.col("doc_id") % 7 + 1).cast("double").alias("score"), F.lit("again").alias("reason"),
    )
    return first.unionByName(again)


_KEPT = f"""{SCORED_SQL}, kept AS (SELECT s.*, CASE WHEN id % 5 = 0 THEN id % 7 + 1 ELSE id % 10 + 1 END::DOUBLE AS ai_score,
    CASE WHEN id % 5 = 0 THEN 'again' ELSE 'first' END AS ai_reason
  FROM scored s JOIN labels l ON s.id = l.doc_id WHERE l.quality = 1)"""


def kept(spark: SparkSession, sf: str, candidates: DataFrame) -> DataFrame:
    return K.apply_decisions(candidates, decisions(spark, sf), ["id"])


@query("apply_decisions", f"WITH {_KEPT} SELECT id, ai_score, ai_reason FROM kept")
def apply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, pool(spark, sf)).select("id", "ai_score", "ai_reason")


_CHOSEN = f"""{_KEPT},
chosen AS (SELECT run_key, id, category, score, ai_score, feed_idx, entry_idx FROM kept WHERE {_QUOTA} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_key, category ORDER BY ai_score DESC, {_ORDER}) <= {_QUOTA}),
have AS (SELECT run_key, category, count(*) AS n FROM chosen GROUP BY ALL),
fill AS (SELECT run_key, id, category, score, NULL::DOUBLE AS ai_score, feed_idx, entry_idx FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.run_key, s.category ORDER BY {_ORDER}) AS r FROM scored s
  WHERE category IN ('en', 'de') AND id NOT IN (SELECT id FROM chosen)) f
  LEFT JOIN have h USING (run_key, category)
  WHERE r <= CASE category WHEN 'en' THEN 3 ELSE 2 END - coalesce(h.n, 0)),
sel AS (SELECT * FROM chosen UNION ALL SELECT * FROM fill)"""


def selected(spark: SparkSession, sf: str) -> DataFrame:
    candidates = stored_pool(spark, sf)
    return K.quota_with_floor(kept(spark, sf, candidates), candidates, "run_key", SELECTION)


@query("quota_with_floor", f"WITH {_CHOSEN} SELECT id, run_key, category, ai_score FROM sel")
def quota_with_floor(spark: SparkSession, sf: str) -> DataFrame:
    return selected(spark, sf).select("id", "run_key", "category", "ai_score")


@query("fallback_rank", f"""WITH {SCORED_SQL} SELECT id, run_key, score AS ai_score, 'fallback' AS triage_mode FROM scored
  WHERE {_QUOTA} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_key, category ORDER BY {_ORDER}) <= {_QUOTA}""")
def fallback_rank(spark: SparkSession, sf: str) -> DataFrame:
    return K.fallback_selection(stored_pool(spark, sf), "run_key", SELECTION).select("id", "run_key", "ai_score", "triage_mode")


# Strict decisions leave some runs thin, which is what coverage repair is for.
_THIN = f"""{SCORED_SQL}, thin AS (SELECT run_key, id, category, score, (id % 10)::DOUBLE AS ai_score, feed_idx, entry_idx
  FROM scored JOIN labels l ON id = l.doc_id WHERE l.toxic = 1
  QUALIFY row_number() OVER (PARTITION BY run_key, category ORDER BY ai_score DESC, {_ORDER}) <= 2)"""


def thin(spark: SparkSession, sf: str, candidates: DataFrame) -> DataFrame:
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    rows = candidates.join(toxic, "id").withColumn("ai_score", (F.col("id") % 10).cast("double"))
    return K.top_k(rows, ["run_key", "category"], "ai_score", 2, [F.desc("score"), "feed_idx", "entry_idx"])


def coverage_sql(t: str) -> str:
    return f"""(SELECT r.run_key, count(s.id) AS items, list_filter({sql_list(SELECTION.required)},
      lambda c: NOT list_contains(coalesce(list(s.category), []), c)) AS missing
      FROM (SELECT DISTINCT run_key FROM scored) r LEFT JOIN {t} s USING (run_key) GROUP BY r.run_key)"""


@query("coverage_problems", f"""WITH {_THIN} SELECT run_key, items, array_to_string(missing, ',') AS missing,
  items >= 8 AND len(missing) = 0 AS covered FROM {coverage_sql('thin')}""")
def coverage_problems(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_pool(spark, sf)
    return K.coverage(thin(spark, sf, rows), rows, "run_key", SELECTION).withColumn("missing", F.array_join("missing", ","))


@query("coverage_backfill", f"""WITH RECURSIVE {_THIN}, cov AS {coverage_sql('thin')}, pcov AS {coverage_sql('scored')},
todo AS (SELECT c.* FROM cov c JOIN pcov p USING (run_key) WHERE (c.items < 8 OR len(c.missing) > 0)
  AND p.items >= 8 AND len(p.missing) = 0),
have AS (SELECT run_key, category, count(*) AS n FROM thin GROUP BY ALL),
c0 AS (SELECT s.*, t.items, t.missing, coalesce(h.n, 0) AS have,
    row_number() OVER (PARTITION BY s.run_key, s.category ORDER BY {_ORDER}) AS rc
  FROM scored s JOIN todo t USING (run_key) LEFT JOIN have h USING (run_key, category)
  WHERE {_QUOTA} IS NOT NULL AND s.id NOT IN (SELECT id FROM thin)),
c1 AS (SELECT *, rc = 1 AND list_contains(missing, category) AS musthave FROM c0 WHERE rc <= {_QUOTA} - have),
must AS (SELECT run_key, count(*) AS m FROM c1 WHERE musthave GROUP BY run_key),
rest AS (SELECT c1.*, row_number() OVER (PARTITION BY c1.run_key ORDER BY {_ORDER}) AS rg, coalesce(m, 0) AS m
  FROM c1 LEFT JOIN must USING (run_key) WHERE NOT musthave)
SELECT id, run_key, ai_score, 'selected' AS triage_mode FROM thin
UNION ALL SELECT id, run_key, score, 'coverage_backfill' FROM c1 WHERE musthave
UNION ALL SELECT id, run_key, score, 'coverage_backfill' FROM rest WHERE rg <= 8 - items - m""")
def coverage_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_pool(spark, sf)
    return K.coverage_backfill(thin(spark, sf, rows), rows, "run_key", SELECTION).select(
        "id", "run_key", "ai_score", "triage_mode"
    )


def repos(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as repositories: a brand is one edition, small parts are the new ones, price the stars."""
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"), F.when(F.col("p_size") <= 4, "rising").otherwise("veteran").alias("kind"),
        F.col("p_partkey").cast("string").alias("name"), F.col("p_retailprice").alias("stars"),
        F.col("p_partkey").alias("pos"),
    )


@query("select_mix", """WITH r AS (SELECT p_brand AS brand, CASE WHEN p_size <= 4 THEN 'rising' ELSE 'veteran' END AS kind,
    CAST(p_partkey AS VARCHAR) AS name, p_retailprice AS stars, p_partkey AS pos FROM part),
  a AS (SELECT *, row_number() OVER (PARTITION BY brand, kind ORDER BY pos) AS rk FROM r),
  c AS (SELECT * FROM a WHERE rk <= CASE kind WHEN 'rising' THEN 3 ELSE 2 END),
  h AS (SELECT brand, count(*) AS n FROM c GROUP BY brand),
  f AS (SELECT a.*, row_number() OVER (PARTITION BY brand ORDER BY stars DESC, kind <> 'rising', pos) AS rf FROM a
    WHERE name NOT IN (SELECT name FROM c))
  SELECT brand, kind, name, stars FROM c
  UNION ALL SELECT brand, kind, name, stars FROM f JOIN h USING (brand) WHERE rf <= 5 - n""")
def select_mix(spark: SparkSession, sf: str) -> DataFrame:
    return K.select_mix(repos(spark, sf), ["brand"])


@query("tier_fallback", """WITH t AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal >= 9000 THEN 0 WHEN s_acctbal >= 5000 THEN 1
    WHEN s_acctbal >= 100 THEN 2 END AS tier FROM supplier)
  SELECT s_suppkey, s_nationkey, tier FROM t WHERE tier IS NOT NULL
  QUALIFY tier = min(tier) OVER (PARTITION BY s_nationkey)""")
def tier_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return K.best_tier(rows, ["s_nationkey"], "s_acctbal", (9000, 5000, 100)).select("s_suppkey", "s_nationkey", "tier")


@query("one_per_category", f"""WITH {_CHOSEN},
  o AS (SELECT *, coalesce(ai_score, score) AS v FROM sel),
  a AS (SELECT *, row_number() OVER (PARTITION BY run_key, category ORDER BY v DESC, feed_idx, entry_idx) = 1 AS head FROM o),
  g AS (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY head DESC, v DESC, feed_idx, entry_idx) AS rg FROM a)
  SELECT id, run_key, category FROM g WHERE head OR rg <= 3""")
def one_per_category(spark: SparkSession, sf: str) -> DataFrame:
    return K.one_per_category(selected(spark, sf), "run_key", SELECTION.required).select("id", "run_key", "category")


@query("top_one", f"""WITH {SCORED_SQL} SELECT id, run_key, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY {_ORDER}) = 1""")
def top_one(spark: SparkSession, sf: str) -> DataFrame:
    return K.top_k(pool(spark, sf), ["run_key"], "score", 1).select("id", "run_key", "score")


@query("backfill_targets", f"""WITH {SCORED_SQL} SELECT id, run_key, score FROM scored
  WHERE reference AND length(fulltext) < 1000 AND score >= 3
  QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY feed_idx, entry_idx) <= 3""")
def backfill_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Short texts count as missing here, because every given document has a text."""
    text = F.when(F.length("fulltext") < 1000, F.lit("")).otherwise(F.col("fulltext"))
    rows = scored(spark, sf).select(
        "id", "run_key", "score", "reference", text.alias("fulltext"), F.struct("feed_idx", "entry_idx").alias("ord")
    )
    return K.backfill_targets(rows, "run_key", min_score=3.0).select("id", "run_key", "score")


@query("category_counts", f"""WITH {SCORED_SQL} SELECT run_key, category, source, count(*) AS items
  FROM scored GROUP BY run_key, category, source""")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).groupBy("run_key", "category", "source").agg(F.count("*").alias("items"))
