"""Streaming jobs over the event table, drained into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.plans.registry import query, table
from newsweft.streaming import jobs as J
from newsweft.streaming import state as K


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern as path lets the stream read a table that is one file as well as a folder of files."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def _memory_sql(days: int) -> str:
    """Each link's first time, then again and again the first one beyond the memory of the one before."""
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT user_id || '/' || event_type AS link, ts FROM events),
  r AS (SELECT link, min(ts) AS ts FROM e GROUP BY link
    UNION ALL SELECT r.link, min(e.ts) FROM r JOIN e ON e.link = r.link AND e.ts > r.ts + INTERVAL {days} DAY GROUP BY r.link)
  SELECT link, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM r"""


def remembered(spark: SparkSession, sf: str, days: int) -> DataFrame:
    rows = event_stream(spark, sf).select(F.concat_ws("/", "user_id", "event_type").alias("link"), "at")
    taken = J.drain(J.dedup_within(rows, "at", "link", days))
    return taken.select("link", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("stream_dedup_links", _memory_sql(rules.SENT_RETENTION_DAYS))
def stream_dedup_links(spark: SparkSession, sf: str) -> DataFrame:
    """The seven-day memory of sent links."""
    return remembered(spark, sf, rules.SENT_RETENTION_DAYS)


@query("stream_dedup_repositories", _memory_sql(rules.REPO_RETENTION_DAYS))
def stream_dedup_repositories(spark: SparkSession, sf: str) -> DataFrame:
    """The longer memory of repositories; an event's user and type stand for one."""
    return remembered(spark, sf, rules.REPO_RETENTION_DAYS)


@query("stream_sessions", """SELECT strftime(time_bucket(INTERVAL '12 hours', ts, INTERVAL '8 hours'), '%Y-%m-%d %H:%M') AS start,
  count(*) AS events FROM events GROUP BY time_bucket(INTERVAL '12 hours', ts, INTERVAL '8 hours')
  HAVING time_bucket(INTERVAL '12 hours', ts, INTERVAL '8 hours') + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Closed sessions; the last one stays open until later events arrive."""
    out = J.drain(J.session_counts(event_stream(spark, sf), "at"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "events")


@query("stream_usage", """WITH w AS (SELECT event_type, ts, date_trunc('day', ts) - to_days(k) AS start FROM events, range(0, 7) r(k))
  SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS count FROM w GROUP BY start, event_type
  HAVING start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_usage(spark: SparkSession, sf: str) -> DataFrame:
    out = J.drain(J.usage_windows(event_stream(spark, sf), "at", ["event_type"]))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "event_type", "count")


@query("stream_session_gate", """WITH RECURSIVE e AS (SELECT user_id, ts,
    CAST(floor(epoch(ts + INTERVAL 8 HOUR - TIMESTAMP '1970-01-01 04:00:00') / 43200) AS BIGINT) AS s FROM events),
  r AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
    UNION ALL
    SELECT r.user_id, min(e.ts) FROM r JOIN e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 3 HOUR
      AND e.s > CAST(floor(epoch(r.ts + INTERVAL 8 HOUR - TIMESTAMP '1970-01-01 04:00:00') / 43200) AS BIGINT) GROUP BY r.user_id)
  SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS accepted FROM r""")
def stream_session_gate(spark: SparkSession, sf: str) -> DataFrame:
    out = J.drain(K.session_gate(event_stream(spark, sf).select("user_id", "at"), "user_id", "at"))
    return out.select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("accepted"))


@query("stream_deliver_once", """SELECT user_id AS run_id, CASE WHEN max(value) > 20 THEN 'delivered' ELSE 'empty' END AS status
  FROM events GROUP BY user_id""")
def stream_deliver_once(spark: SparkSession, sf: str) -> DataFrame:
    stream = event_stream(spark, sf).select(
        F.col("user_id").alias("run_id"), F.when(F.col("value") > 20, 1).otherwise(0).cast("long").alias("count"), "at"
    )
    return J.drain(K.deliver_once(stream, "at")).select("run_id", "status")


@query("stream_issue_alerts", """SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS signature FROM events
  QUALIFY event_type <> coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts), '')""")
def stream_issue_alerts(spark: SparkSession, sf: str) -> DataFrame:
    stream = event_stream(spark, sf).select("user_id", "at", F.col("event_type").alias("signature"))
    return J.drain(K.issue_alerts(stream, "user_id", "at", "signature")).select(
        "user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "signature"
    )


ARCHIVE = ("event_id string, ord bigint, title string, first_seen date, latest_seen date, latest_title string, "
           "latest_raw_title string, key_facts array<string>, open_questions array<string>, sources array<string>, status string")


@query("stream_event_archive", """SELECT 'evt_20240130_' || substr(sha1('user' || user_id), 1, 12) AS event_id, 'User ' || user_id AS title
  FROM events GROUP BY user_id""")
def stream_event_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Every user is a running event, each of their rows an article about it."""
    base = J.work_folder(spark, "archive")
    stream = event_stream(spark, sf).select(
        F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("zh"), F.lit(None).cast("string").alias("prev_title"), F.array("event_type").alias("key_facts"),
        F.array(F.lit("?")).alias("open_questions"), F.array(F.lit("u")).alias("sources"),
    )
    schema = spark.createDataFrame([], ARCHIVE).schema
    state = J.StateTable(spark, f"{base}/state", lambda: spark.createDataFrame([], schema))
    J.drain_batches(stream, J.archive_batches(state, lambda b: F.lit("2024-01-30").cast("date")), base)
    return J.latest_version(spark, f"{base}/state", schema).select("event_id", "title")


_NOW = "2024-01-20 12:00:00"


@query("stream_fresh", f"""SELECT 'kept ' || event_type AS what, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM events
    WHERE event_id % 9 = 0 OR ts >= TIMESTAMP '{_NOW}' - INTERVAL {rules.WINDOW_HOURS} HOUR GROUP BY 1
  UNION ALL SELECT 'late', count(*), strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM events
    WHERE event_id % 9 <> 0 AND ts < TIMESTAMP '{_NOW}' - INTERVAL {rules.WINDOW_HOURS} HOUR""")
def stream_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Rows no older than a day at a given time, every ninth without a time of its own, and the number of those that are too old."""
    base = J.work_folder(spark, "fresh")
    stream = event_stream(spark, sf).withColumn("stated", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    now = lambda: F.lit(_NOW).cast("timestamp_ntz")
    J.drain_batches(stream, J.split_fresh(f"{base}/out", f"{base}/late", "stated", now), base)
    text = lambda c: F.date_format(F.min(c), "yyyy-MM-dd HH:mm:ss").alias("first")
    kept = spark.read.parquet(f"{base}/out").filter(F.col("fresh").cast("boolean")).groupBy(F.concat(F.lit("kept "), "event_type").alias("what")).agg(F.count("*").alias("n"), text("ts"))
    late = spark.read.parquet(f"{base}/late").agg(F.sum("late").alias("n"), text("oldest"))
    return kept.unionByName(late.withColumn("what", F.lit("late")))
