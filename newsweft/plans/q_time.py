"""Sessions, ledgers, events, weekly review and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.functions.text import event_title_key
from newsweft.operators import events as EV
from newsweft.operators import ledger as L
from newsweft.operators import rollup as R
from newsweft.operators import sessions as S
from newsweft.plans.articles import ARTICLES_SQL, articles
from newsweft.plans.q_scoring import SCORED_SQL, scored
from newsweft.plans.registry import query, table
from newsweft.session import durable

DAY = "2024-02-01"


def day_lit(text: str = DAY):
    return F.lit(text).cast("date")


@query("session_of", """SELECT strftime(ts + INTERVAL 4 HOUR, '%Y-%m-%d') AS day,
  CASE WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 4 AND 15 THEN 'AM' ELSE 'PM' END AS session, count(*) AS events,
  count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS users FROM events GROUP BY ALL""")
def session_of(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").groupBy(
        S.logical_date(ts).cast("string").alias("day"), S.session_of(ts).alias("session")
    ).agg(F.count("*").alias("events"), F.countDistinct(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("users"))


@query("session_windows", """SELECT strftime(time_bucket(INTERVAL '12 hours', ts, INTERVAL '8 hours'), '%Y-%m-%d %H:%M') AS start,
  count(*) AS events FROM events GROUP BY 1""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The same sessions as a 12-hour tumbling window."""
    events = table(spark, sf, "events").groupBy(F.window("ts", "12 hours", "12 hours", "8 hours")).agg(F.count("*").alias("events"))
    return events.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "events")


@query("logical_date", """SELECT strftime(ts + INTERVAL 4 HOUR, '%Y-%m-%d') AS logical_day,
  strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS calendar_day, strftime(ts + INTERVAL 8 HOUR, '%G-W%V') AS iso_week,
  count(*) AS events FROM events GROUP BY ALL""")
def logical_date(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").groupBy(
        S.logical_date(ts).cast("string").alias("logical_day"), S.calendar_date(ts).cast("string").alias("calendar_day"),
        S.iso_week(S.local_time(ts)).alias("iso_week"),
    ).agg(F.count("*").alias("events"))


@query("session_gate", """WITH RECURSIVE e AS (SELECT user_id, ts,
    CAST(floor(epoch(ts + INTERVAL 8 HOUR - TIMESTAMP '1970-01-01 04:00:00') / 43200) AS BIGINT) AS s FROM events),
  r AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
    UNION ALL
    SELECT r.user_id, min(e.ts) FROM r JOIN e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 3 HOUR
      AND e.s > CAST(floor(epoch(r.ts + INTERVAL 8 HOUR - TIMESTAMP '1970-01-01 04:00:00') / 43200) AS BIGINT) GROUP BY r.user_id)
  SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS accepted FROM r""")
def session_gate(spark: SparkSession, sf: str) -> DataFrame:
    triggers = table(spark, sf, "events").select("user_id", "ts")
    return S.session_gate(triggers, "user_id").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("accepted"))


@query("skip_session", """WITH d AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id),
  n AS (SELECT user_id, max(ts) AS now FROM events GROUP BY user_id)
  SELECT n.user_id, coalesce(epoch(now - last) < 10800 OR floor(epoch(now + INTERVAL 8 HOUR - TIMESTAMP '1970-01-01 04:00:00') / 43200)
    = floor(epoch(last + INTERVAL 8 HOUR - TIMESTAMP '1970-01-01 04:00:00') / 43200), false) AS skip FROM n LEFT JOIN d USING (user_id)""")
def skip_session(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event as trigger, the last purchase as last delivery."""
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.max("ts").alias("now"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last")
    )
    return per_user.select("user_id", S.should_skip(F.col("now"), F.col("last")).alias("skip"))


@query("usage_counts", """SELECT user_id % 5 AS profile, event_type AS action, count(*) AS count FROM events
  WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY GROUP BY ALL""")
def usage_counts(spark: SparkSession, sf: str) -> DataFrame:
    actions = table(spark, sf, "events").select("ts", (F.col("user_id") % 5).alias("profile"), F.col("event_type").alias("action"))
    return L.usage_counts(actions, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@query("issue_change", """WITH s AS (SELECT user_id, date_trunc('day', ts)::DATE AS day,
    coalesce(string_agg(DISTINCT CASE WHEN event_type IN ('error', 'purchase') THEN event_type END, ',' ORDER BY
      CASE WHEN event_type IN ('error', 'purchase') THEN event_type END), '') AS signature FROM events GROUP BY ALL)
  SELECT user_id, CAST(day AS VARCHAR) AS day, signature FROM s
  QUALIFY signature <> coalesce(lag(signature) OVER (PARTITION BY user_id ORDER BY day), '')""")
def issue_change(spark: SparkSession, sf: str) -> DataFrame:
    issue = F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type"))
    rows = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), issue.alias("issue"))
    return L.issue_changes(rows, "user_id", "day", "issue").withColumn("day", F.col("day").cast("string"))


@query("channel_delivery", """WITH p AS (SELECT conv_id, role, bool_and(length(text) < 900) AS served FROM conversations GROUP BY ALL)
  SELECT conv_id, count(*) FILTER (WHERE served) AS served, count(*) AS recipients, bool_or(served) AS delivered FROM p GROUP BY conv_id""")
def channel_delivery(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "conversations").select("conv_id", "role", (F.length("text") < 900).alias("ok"))
    return L.channel_delivery(chunks, "conv_id", "role", "ok")


@query("ledger_retention", """SELECT DISTINCT CAST(o_orderdate::DATE AS VARCHAR) AS day, o_custkey AS key FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1998-05-08' AND TIMESTAMP '1998-06-07'""")
def ledger_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one day appended to the ledger of the days before, 30 days kept."""
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf, "orders")
    today = F.lit("1998-06-07").cast("timestamp_ntz")
    history = orders.filter(F.col("o_orderdate") < today).select(day.alias("day"), F.col("o_custkey").alias("key"))
    new = orders.filter(F.col("o_orderdate") == today).select(F.col("o_custkey").alias("key"))
    return L.append_sent(history, new, day_lit("1998-06-07"), 30).withColumn("day", F.col("day").cast("string"))


@query("deliver_once", """WITH r AS (SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29') AS count
    FROM events GROUP BY user_id)
  SELECT run_id, CASE WHEN run_id % 4 = 0 THEN 'duplicate' WHEN count = 0 THEN 'empty' ELSE 'delivered' END AS status,
    CASE WHEN run_id % 4 = 0 THEN 7 ELSE count END AS count FROM r""")
def deliver_once(spark: SparkSession, sf: str) -> DataFrame:
    late = (F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    runs = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count_if(late).alias("count"))
    ledger = runs.filter("run_id % 2 = 0").select(
        "run_id", F.when(F.col("run_id") % 4 == 0, "delivered").otherwise("failed").alias("status"), F.lit(7).cast("long").alias("count")
    )
    return L.deliver_once(runs, ledger)


@query("unwritten_runs", """SELECT DISTINCT strftime(ts, '%G-W%V') AS week FROM events
  WHERE strftime(ts, '%G-W%V') NOT IN (SELECT strftime(ts, '%G-W%V') FROM events WHERE ts < TIMESTAMP '2024-01-15')""")
def unwritten_runs(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("ts", S.iso_week(F.col("ts")).alias("week"))
    done = events.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return L.should_skip_run(events.select("week").distinct(), done, "week")


@query("proposal_status", """WITH p AS (SELECT p_brand AS run, p_name, p_size, p_partkey, p_type FROM part)
  SELECT run, count(*) AS proposals, count(*) FILTER (WHERE p_size = 2 OR p_partkey % 10 = 0) AS incomplete,
    count(*) <= 5 AND count(*) FILTER (WHERE p_size = 2 OR p_partkey % 10 = 0) = 0 AS valid FROM p GROUP BY run""")
def proposal_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("run"), F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("claim"),
        F.col("p_type").alias("when_to_use"), F.when(F.col("p_size") == 2, " ").otherwise("never").alias("when_not_to_use"),
        F.array(F.struct(F.when(F.col("p_partkey") % 10 == 0, "").otherwise("https://e.org").alias("url"))).alias("evidence"),
    )
    return L.proposal_status(rows, "run")


# --------------------------------------------------------------------------- events

def archive_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Older articles as the archive, one event per title key; the newer ones as one run."""
    rows = durable(articles(spark, sf).select(
        "id", "title", "published", event_title_key(F.col("title")).alias("key"), (F.col("id") % 96).alias("age")
    ))
    old = rows.filter("age >= 48 and key <> ''")
    archive = old.groupBy("key").agg(
        F.min("id").alias("ord"), F.min_by("title", "id").alias("title"), F.max_by("title", "id").alias("latest_raw_title"),
        F.min(F.to_date("published")).alias("first_seen"), F.max(F.to_date("published")).alias("latest_seen"),
    ).select(
        F.concat(F.lit("evt_"), F.col("ord").cast("string")).alias("event_id"), "ord", "title", "first_seen", "latest_seen",
        F.concat(F.lit("zh "), "title").alias("latest_title"), "latest_raw_title",
        F.array(F.lit("fact")).alias("key_facts"), F.array(F.lit("?")).alias("open_questions"), F.array(F.lit("u")).alias("sources"),
    )
    # Every seventh new article carries a link to the event of the article 48 hours older.
    prev = old.select((F.col("id") - 48).alias("id"), F.concat(F.lit("zh "), "title").alias("prev_title")).filter("id % 7 = 0")
    batch = rows.filter("age < 48 and key <> ''").join(prev, "id", "left").select(
        "id", F.col("id").alias("ord"), "title", F.lit(None).cast("string").alias("zh"), "prev_title",
        F.array(F.concat(F.lit("fact "), F.col("id").cast("string"))).alias("key_facts"),
        F.array(F.lit("?"), F.lit("!")).alias("open_questions"), F.array(F.lit("n")).alias("sources"),
    )
    return archive, batch


_KEY = "regexp_replace(lower({x}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g')"
_EVENTS = f"""{ARTICLES_SQL}, k AS (SELECT id, title, published, id % 96 AS age, {_KEY.format(x='title')} AS key FROM art),
old AS (SELECT * FROM k WHERE age >= 48 AND key <> ''),
arch AS (SELECT 'evt_' || min(id) AS event_id, min(id) AS ord, arg_min(title, id) AS title, arg_max(title, id) AS latest_raw_title,
  'zh ' || arg_min(title, id) AS latest_title, min(published::DATE) AS first_seen, max(published::DATE) AS latest_seen FROM old GROUP BY key),
bat AS (SELECT n.id, n.title, n.key AS raw_key, coalesce({_KEY.format(x="'zh ' || o.title")}, '') AS prev_key FROM k n
  LEFT JOIN old o ON o.id = n.id + 48 AND n.id % 7 = 0 WHERE n.age < 48 AND n.key <> ''),
m0 AS (SELECT b.*, (SELECT min(a.ord) FROM arch a WHERE (b.prev_key <> '' AND b.prev_key IN ({_KEY.format(x='a.latest_title')}, {_KEY.format(x='a.title')}))
    OR b.raw_key = {_KEY.format(x='a.latest_raw_title')}) AS o FROM bat b),
m1 AS (SELECT *, arg_min(o, id) FILTER (WHERE o IS NOT NULL) OVER (PARTITION BY raw_key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead_o,
    row_number() OVER (PARTITION BY raw_key ORDER BY id) > 1 AS later FROM m0),
mt AS (SELECT id, title, CASE WHEN o IS NOT NULL THEN 'evt_' || o WHEN lead_o IS NOT NULL THEN 'evt_' || lead_o
    ELSE 'evt_20240201_' || substr(sha1(raw_key), 1, 12) END AS event_id, o IS NOT NULL OR lead_o IS NOT NULL OR later AS is_update FROM m1)"""


@query("event_match", f"WITH {_EVENTS} SELECT id, event_id, is_update FROM mt")
def event_match(spark: SparkSession, sf: str) -> DataFrame:
    archive, batch = archive_and_batch(spark, sf)
    return EV.match_events(batch, archive, F.lit(DAY))


@query("event_upsert", f"""WITH {_EVENTS}, n AS (SELECT event_id, arg_max(title, id) AS t, arg_min(title, id) AS f, max(id) AS last_id FROM mt GROUP BY event_id)
  SELECT coalesce(a.event_id, n.event_id) AS event_id, coalesce(a.title, f) AS title, CAST(coalesce(a.first_seen, DATE '{DAY}') AS VARCHAR) AS first_seen,
    CAST(CASE WHEN n.event_id IS NULL THEN a.latest_seen ELSE DATE '{DAY}' END AS VARCHAR) AS latest_seen,
    coalesce(t, a.latest_title) AS latest_title, CASE WHEN n.event_id IS NULL THEN 'fact' ELSE 'fact ' || last_id END AS facts
  FROM arch a FULL JOIN n ON a.event_id = n.event_id""")
def event_upsert(spark: SparkSession, sf: str) -> DataFrame:
    archive, batch = archive_and_batch(spark, sf)
    matches = EV.match_events(batch, archive, F.lit(DAY))
    out = EV.upsert_events(archive, batch, matches, day_lit())
    return out.select(
        "event_id", "title", F.col("first_seen").cast("string").alias("first_seen"),
        F.col("latest_seen").cast("string").alias("latest_seen"), "latest_title", F.array_join("key_facts", ";").alias("facts"),
    )


@query("event_updates", f"WITH {_EVENTS} SELECT DISTINCT event_id, id AS article_id, title FROM mt")
def event_updates(spark: SparkSession, sf: str) -> DataFrame:
    archive, batch = archive_and_batch(spark, sf)
    matches = EV.match_events(batch, archive, F.lit(DAY))
    empty = batch.join(matches.select("id", "event_id"), "id").filter(F.lit(False)).select(
        "event_id", day_lit().alias("date"), F.col("id").alias("article_id"), F.col("title"), F.col("title").alias("raw_title")
    )
    return EV.event_updates(empty, batch, matches, day_lit()).select("event_id", "article_id", "title")


@query("active_events", """SELECT user_id AS event_id, CAST(max(ts)::DATE AS VARCHAR) AS latest_seen FROM events
  GROUP BY user_id HAVING max(ts)::DATE >= DATE '2024-02-29' - 30""")
def active_events(spark: SparkSession, sf: str) -> DataFrame:
    archive = table(spark, sf, "events").groupBy(F.col("user_id").alias("event_id")).agg(
        F.max(F.to_date("ts")).alias("latest_seen")
    )
    return EV.active_events(archive, day_lit("2024-02-29")).withColumn("latest_seen", F.col("latest_seen").cast("string"))


# --------------------------------------------------------------------------- weekly

def weekly_inputs(spark: SparkSession, sf: str):
    """Runs of the article view with statuses drawn from their own articles."""
    rows = durable(scored(spark, sf).select(
        "id", "run_key", F.col("title").alias("headline"), F.col("score").alias("relevance_score"), "category",
        (F.length("fulltext") >= 300).alias("has_fulltext"),
        F.when(F.length("fulltext") < 1000, F.array(F.lit("?"))).otherwise(F.array().cast("array<string>")).alias("unknowns"),
    ))
    runs = rows.groupBy("run_key").agg(F.count("*").alias("n"), F.max("id").alias("last_id")).select(
        "run_key", F.when(F.col("last_id") % 5 != 0, "present").otherwise("missing").alias("artifact_bundle_status"),
        F.when(F.col("last_id") % 7 != 0, "2024-02-01").alias("delivered_at"),
    )
    quality = rows.filter("category = 'de'").select("run_key").distinct()
    digests = rows.filter("category = 'es'").select("run_key").distinct()
    return rows, runs, quality, digests


_WEEKLY = f"""{SCORED_SQL}, runs AS (SELECT run_key, max(id) AS last_id FROM scored GROUP BY run_key
    HAVING max(id) % 5 <> 0 AND max(id) % 7 <> 0 AND count(*) FILTER (WHERE category = 'de') > 0 AND count(*) FILTER (WHERE category = 'es') > 0),
  wi AS (SELECT id, run_key, title AS headline, score AS relevance_score, length(fulltext) >= 300 AS has_fulltext,
    length(fulltext) < 1000 AS unk FROM scored WHERE run_key IN (SELECT run_key FROM runs)
    AND substr(run_key, 1, 10) BETWEEN '2024-01-25' AND '2024-02-01')"""


@query("weekly_items", f"WITH {_WEEKLY} SELECT id, run_key FROM wi")
def weekly_items(spark: SparkSession, sf: str) -> DataFrame:
    rows, runs, quality, digests = weekly_inputs(spark, sf)
    return R.weekly_items(runs, rows, quality, digests, day_lit()).select("id", "run_key")


@query("weekly_review", f"""WITH {_WEEKLY}, {_EVENTS.replace(ARTICLES_SQL + ',', '')},
  rec AS (SELECT * FROM arch WHERE latest_seen >= DATE '{DAY}' - 7)
  SELECT 'changed' AS part, row_number() OVER (ORDER BY latest_seen DESC, ord)::INTEGER AS rank, event_id AS ref, latest_title AS title FROM rec QUALIFY rank <= 5
  UNION ALL SELECT 'worth_rereading', row_number() OVER (ORDER BY relevance_score DESC, run_key, id)::INTEGER AS rank, id::VARCHAR, headline FROM wi QUALIFY rank <= 5
  UNION ALL SELECT 'uncertain', row_number() OVER (ORDER BY run_key, id)::INTEGER AS rank, id::VARCHAR, headline FROM wi WHERE NOT has_fulltext OR unk QUALIFY rank <= 5
  UNION ALL SELECT 'watch', row_number() OVER (ORDER BY ord)::INTEGER AS rank, event_id, title FROM rec QUALIFY rank <= 5""")
def weekly_review(spark: SparkSession, sf: str) -> DataFrame:
    rows, runs, quality, digests = weekly_inputs(spark, sf)
    items = R.weekly_items(runs, rows, quality, digests, day_lit())
    return R.weekly_review(items, archive_and_batch(spark, sf)[0], day_lit())


# --------------------------------------------------------------------------- metrics

def month_artifacts(spark: SparkSession, sf: str):
    """Order months as runs: evidence when urgent orders exist on the first of the month, quality from shipped lines."""
    orders = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_key"), F.dayofmonth("o_orderdate").alias("d"), "o_orderpriority", "o_orderstatus"
    )
    runs = orders.select("run_key").distinct()
    evidence = orders.filter("d <= 2 and o_orderpriority = '1-URGENT'").select("run_key")
    quality = orders.filter("d >= 27 and o_orderstatus = 'P'").select("run_key")
    return runs, evidence, quality


_MONTHS = """m AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_key,
  bool_or(day(o_orderdate) <= 2 AND o_orderpriority = '1-URGENT') AS e, bool_or(day(o_orderdate) >= 27 AND o_orderstatus = 'P') AS q
  FROM orders GROUP BY 1)"""


@query("artifact_status", f"""WITH {_MONTHS} SELECT run_key, CASE WHEN e THEN 'present' ELSE 'missing' END AS evidence_status,
  CASE WHEN q THEN 'present' ELSE 'missing' END AS quality_status, CASE WHEN e AND q THEN 'present' ELSE 'missing' END AS artifact_bundle_status FROM m""")
def artifact_status(spark: SparkSession, sf: str) -> DataFrame:
    return L.artifact_status(*month_artifacts(spark, sf), "run_key")


@query("bundle_coverage", """WITH l AS (SELECT o_custkey, arg_max(o_totalprice > 100000 AND o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW', o_orderkey) AS c
    FROM orders GROUP BY o_custkey)
  SELECT count(*) AS eligible_runs, count(*) FILTER (WHERE c) AS covered_runs, count(*) FILTER (WHERE c) / count(*) AS coverage FROM l""")
def bundle_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A customer is a run, its orders are the attempts."""
    attempts = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_key"), F.col("o_orderkey").alias("attempt"), F.lit(True).alias("eligible"),
        (F.col("o_totalprice") > 100000).alias("evidence_ok"), (F.col("o_orderstatus") != "P").alias("quality_ok"),
        (F.col("o_orderpriority") != "5-LOW").alias("marked"),
    )
    return R.bundle_coverage(attempts)


@query("card_validity", """SELECT o_orderpriority AS grp, count(*) AS expected, count(*) FILTER (WHERE v) AS valid,
  count(*) FILTER (WHERE v) / count(*) AS validity FROM (SELECT o_orderkey, o_orderpriority,
    coalesce(bool_and(l_discount < 0.1), false) AS v FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY 1""")
def card_validity(spark: SparkSession, sf: str) -> DataFrame:
    expected = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("article_id"))
    problem = F.when(F.col("l_discount") >= 0.1, "discount")
    cards = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.collect_set(problem).alias("problems"))
    return R.card_validity(expected, cards, ["article_id"], ["grp"])


@query("render_completeness", """WITH w AS (SELECT DISTINCT o_custkey AS run, o_orderkey AS article_id FROM orders WHERE o_orderstatus <> 'P'),
  h AS (SELECT o_custkey AS run, CASE WHEN l_linenumber = 7 THEN -o_orderkey ELSE o_orderkey END AS article_id, count(*) AS times
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
  b AS (SELECT coalesce(w.run, h.run) AS run, w.article_id AS want, times FROM w FULL JOIN h ON w.run = h.run AND w.article_id = h.article_id)
  SELECT run, count(want) AS expected, count(*) FILTER (WHERE want IS NOT NULL AND times IS NOT NULL) AS rendered,
    count(*) FILTER (WHERE times IS NULL) AS missing, count(*) FILTER (WHERE want IS NULL) AS unexpected, count(*) FILTER (WHERE times > 1) AS repeated,
    count(*) FILTER (WHERE want IS NOT NULL AND times IS NOT NULL) / count(want) AS completeness FROM b GROUP BY run HAVING count(want) > 0""")
def render_completeness(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", "o_orderstatus")
    expected = orders.filter("o_orderstatus <> 'P'").select("run", F.col("o_orderkey").alias("article_id"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    found = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "run", F.when(F.col("l_linenumber") == 7, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("article_id")
    )
    return R.render_completeness(expected, found, "run")


@query("two_source_rate", """SELECT lang AS run, count(*) FILTER (WHERE doc_id % 3 = 0) AS backfilled,
  count(*) FILTER (WHERE doc_id % 6 = 0) AS labelled, CASE WHEN count(*) FILTER (WHERE doc_id % 3 = 0) > 0 THEN
  count(*) FILTER (WHERE doc_id % 6 = 0) / count(*) FILTER (WHERE doc_id % 3 = 0) END AS rate, 'measured' AS status FROM documents GROUP BY lang""")
def two_source_rate(spark: SparkSession, sf: str) -> DataFrame:
    role = lambda r: F.struct(F.lit(r).alias("role"))
    rows = table(spark, sf, "documents").select(
        F.col("lang").alias("run"), (F.col("doc_id") % 3 == 0).alias("backfilled"),
        F.when(F.col("doc_id") % 6 == 0, F.array(role("primary"), role("context"))).otherwise(F.array(role("primary"))).alias("sources"),
    )
    return R.two_source_rate(rows, "run")


def issues(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("run_key"), F.col("l_suppkey").alias("article_id"),
        F.col("l_returnflag").alias("code"), F.col("l_quantity").cast("int").alias("normalized_value"),
    )


@query("unique_issues", """SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS run_key, l_suppkey AS article_id, l_returnflag AS code,
  l_quantity::INTEGER AS normalized_value FROM lineitem""")
def unique_issues(spark: SparkSession, sf: str) -> DataFrame:
    return R.unique_issues(issues(spark, sf))


@query("seeded_review_sample", """WITH u AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS run_key, l_suppkey AS article_id, l_returnflag AS code,
  l_quantity::INTEGER AS normalized_value FROM lineitem)
  SELECT * FROM u ORDER BY md5(concat_ws('|', 7, run_key, article_id, code, normalized_value)) LIMIT 30""")
def seeded_review_sample(spark: SparkSession, sf: str) -> DataFrame:
    return R.review_sample(issues(spark, sf))


@query("false_alarm_rates", """WITH u AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS run_key, l_suppkey AS article_id, l_returnflag AS code,
  l_quantity::INTEGER AS v FROM lineitem) SELECT code, count(*) AS reviewed, count(*) FILTER (WHERE v % 3 = 0) AS false_alarms,
  count(*) FILTER (WHERE v % 3 = 0) / count(*) AS rate FROM u GROUP BY ROLLUP (code)""")
def false_alarm_rates(spark: SparkSession, sf: str) -> DataFrame:
    sample = R.unique_issues(issues(spark, sf))
    return R.false_alarm_rates(sample, sample.withColumn("false_alarm", F.col("normalized_value") % 3 == 0))


@query("rolling_14d_quality", """WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS bad
    FROM orders GROUP BY 1)
  SELECT CAST(day AS VARCHAR) AS day, (sum(total) OVER w)::BIGINT AS total_items, (sum(bad) OVER w)::BIGINT AS unsupported,
    sum(bad) OVER w / sum(total) OVER w AS ratio FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW)""")
def rolling_14d_quality(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("total_items"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("unsupported")
    )
    return R.rolling_quality(daily).withColumn("day", F.col("day").cast("string"))
