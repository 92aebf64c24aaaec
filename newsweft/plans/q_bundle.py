"""Export, bundle, context, hand-off, health and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions.text import first_line_after as first_after
from newsweft.functions.text import section_text as section
from newsweft.functions.text import strip_audit_block as strip_audit
from newsweft.operators import bundle as B
from newsweft.operators import chunking as C
from newsweft.operators import health as H
from newsweft.operators.evidence import primary_source as primary
from newsweft.plans.articles import ARTICLES_SQL, articles
from newsweft.plans.q_evidence import cards
from newsweft.plans.registry import query, table
from newsweft.plans.titles_sql import keep_first_sql, similar_sql, title_key_sql
from newsweft.plans.walks_sql import chunks_sql


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).groupBy("run_key").agg(F.max("id").alias("last_id")).select(
        "run_key", F.when(F.col("last_id") % 5 != 0, "present").otherwise("missing").alias("artifact_bundle_status"),
        F.when(F.col("last_id") % 7 != 0, "2024-02-01").alias("delivered_at"),
    )


_EXPORT = f"""{ARTICLES_SQL}, runs AS (SELECT run_key, max(id) % 7 <> 0 AS delivered FROM art GROUP BY run_key
    HAVING max(id) % 5 <> 0 AND count(*) FILTER (WHERE category = 'de') > 0 AND count(*) FILTER (WHERE category = 'es') > 0)"""


@query("export_items", f"""WITH {_EXPORT} SELECT id, run_key, 'a1_' || substr(sha256('url:' || link), 1, 24) AS article_id, title, link AS url,
  source AS publisher, delivered AS delivery_successful FROM art JOIN runs USING (run_key)""")
def export_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles(spark, sf).select("run_key", "category")
    out = B.export_items(
        cards(spark, sf).select("run_key", "card"), _runs(spark, sf),
        rows.filter("category = 'de'").select("run_key").distinct(), rows.filter("category = 'es'").select("run_key").distinct(),
    )
    return out.select(
        F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("id"), "run_key", "article_id", "title", "url", "publisher",
        "delivery_successful",
    )


@query("primary_source", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS publisher FROM documents""")
def primary_source(spark: SparkSession, sf: str) -> DataFrame:
    entry = lambda role, pub: F.struct(F.lit(role).alias("role"), pub.alias("publisher"))
    both = F.array(entry("context", F.lit("x")), entry("primary", F.col("source")), entry("primary", F.lit("y")))
    sources = F.when(F.col("doc_id") % 4 == 0, F.array(entry("context", F.lit("x")))).otherwise(both)
    return table(spark, sf, "documents").select("doc_id", primary(sources)["publisher"].alias("publisher"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select(day.alias("date")).distinct()


def radar(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of every other day, so that each target day without pages falls back by one day."""
    day = F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("page_id") % 3 * 2 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), day.alias("date"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), "url",
        (F.col("page_id") % 30).alias("score"), F.lit(False).alias("evidence_complete"), F.lit("radar").alias("source_system"),
        F.col("page_id").alias("pos"),
    )


_RADAR = """t AS (SELECT DISTINCT DATE '2024-02-01' - (doc_id % 5)::INTEGER AS date FROM documents),
  r AS (SELECT 'p' || page_id AS id, DATE '2024-02-01' - (page_id % 3 * 2 + 1)::INTEGER AS d, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages),
  o AS (SELECT t.date, r.*, t.date - r.d AS lag FROM t JOIN r ON t.date - r.d IN (0, 1) WHERE title <> '' AND url <> ''
    QUALIFY lag = min(lag) OVER (PARTITION BY t.date))"""


@query("bundle_union_fallback", f"""WITH {_RADAR} SELECT id, CAST(date AS VARCHAR) AS date, CAST(d AS VARCHAR) AS artifact_date,
  CASE WHEN lag = 0 THEN 'today' ELSE 'previous_night' END AS freshness FROM o""")
def bundle_union_fallback(spark: SparkSession, sf: str) -> DataFrame:
    out = B.with_previous_night(radar(spark, sf), targets(spark, sf))
    return out.select("id", F.col("date").cast("string").alias("date"), F.col("source_artifact_date").cast("string").alias("artifact_date"),
                      F.col("freshness_label").alias("freshness"))


@query("bundle_source_status", f"""WITH {_RADAR}, c AS (SELECT date, count(*) AS items, max(lag) AS lag FROM o GROUP BY date)
  SELECT CAST(t.date AS VARCHAR) AS date, s AS source_system, CASE WHEN s = 'radar' THEN coalesce(items, 0) ELSE 0 END AS items,
    CASE WHEN s <> 'radar' OR items IS NULL THEN 'missing' WHEN lag = 1 THEN 'previous_night' ELSE 'present' END AS status
  FROM t CROSS JOIN (VALUES ('radar'), ('review')) v(s) LEFT JOIN c USING (date)""")
def bundle_source_status(spark: SparkSession, sf: str) -> DataFrame:
    days = targets(spark, sf)
    out = B.source_status(B.with_previous_night(radar(spark, sf), days), days, ("radar", "review"))
    return out.withColumn("date", F.col("date").cast("string"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as review candidates that carry a score like ``25/30``."""
    c = table(spark, sf, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    return c.select(
        F.concat(F.lit("w"), key.cast("string")).alias("id"),
        F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("conv_id") % 5).cast("int")).alias("date"),
        F.element_at(F.split("text", "\n", 2), 1).alias("title"),
        F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit("https://w.org/"), key.cast("string"))).alias("url"),
        F.concat((key % 31).cast("string"), F.lit("/30")).alias("score"),
        F.when(F.col("role") == "system", "rejected").when(F.col("turn") % 2 == 1, "approved").alias("status"),
        F.lit(False).alias("evidence_complete"), F.lit("review").alias("source_system"), key.alias("pos"),
    )


@query("review_candidates", """SELECT 'w' || (conv_id * 100 + turn) AS id, ((conv_id * 100 + turn) % 31) || '/30' AS score FROM conversations
  WHERE role <> 'system' AND turn <> 0 AND (conv_id * 100 + turn) % 31 >= 23 AND split_part(text, chr(10), 1) <> ''""")
def review_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return B.review_candidates(candidates(spark, sf)).select("id", "score")


def bundle_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The three sources of a bundle by target date; a third of the daily articles share a URL with a page."""
    days = targets(spark, sf)
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("entry_idx"), "url")
    daily = articles(spark, sf).filter(F.col("run_key").endswith("AM")).join(pages, "entry_idx", "left").select(
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.to_date(F.substring("run_key", 1, 10)).alias("date"), "title",
        F.when(F.col("id") % 3 == 0, F.coalesce("url", "link")).otherwise(F.col("link")).alias("url"),
        (F.col("id") % 11).cast("string").alias("score"), (F.col("id") % 2 == 0).alias("evidence_complete"),
        F.lit("daily").alias("source_system"), F.col("id").alias("pos"),
    )
    night = B.with_previous_night(radar(spark, sf), days).withColumn("score", F.col("score").cast("string"))
    wiki = B.review_candidates(candidates(spark, sf))
    columns = ["id", "date", "title", "url", "score", "evidence_complete", "source_system", "pos"]
    return daily.select(*columns).unionByName(night.select(*columns)).unionByName(wiki.select(*columns)).join(
        days, "date", "left_semi"
    )


_POOL = f"""{ARTICLES_SQL}, {_RADAR},
  pool AS (SELECT 'd' || id AS id, CAST(substr(run_key, 1, 10) AS DATE) AS date, title,
      CASE WHEN id % 3 = 0 THEN coalesce(p.url, link) ELSE link END AS url, id % 11 AS score, id % 2 = 0 AS evidence, 'daily' AS source_system, id AS ord
    FROM art LEFT JOIN pages p ON p.page_id = art.id WHERE ends_with(run_key, 'AM')
    UNION ALL SELECT id, date, title, url, CAST(substr(id, 2) AS BIGINT) % 30, false, 'radar', CAST(substr(id, 2) AS BIGINT) FROM o
    UNION ALL SELECT 'w' || (conv_id * 100 + turn), DATE '2024-02-01' - (conv_id % 5)::INTEGER, split_part(text, chr(10), 1), 'https://w.org/' || (conv_id * 100 + turn),
      (conv_id * 100 + turn) % 31, false, 'review', conv_id * 100 + turn FROM conversations
      WHERE role <> 'system' AND turn <> 0 AND (conv_id * 100 + turn) % 31 >= 23 AND split_part(text, chr(10), 1) <> ''),
  item AS (SELECT pool.*, lower(trim(coalesce(url, ''))) AS url_key, {title_key_sql("coalesce(title, '')")} AS title_key FROM pool SEMI JOIN t USING (date))"""
_KEPT = f"""WITH RECURSIVE {_POOL}, title AS (SELECT DISTINCT date AS scope, title_key AS k FROM item WHERE title_key <> '' AND url_key <> ''),
  {similar_sql()},
  node AS (SELECT date AS scope, row_number() OVER (PARTITION BY date ORDER BY NOT evidence, source_system <> 'daily', -score, ord, id) AS pos, url_key, title_key, id, source_system
    FROM item WHERE url_key <> ''),
  {keep_first_sql()},
  ranked AS (SELECT id, CAST(scope AS VARCHAR) AS date, CAST(row_number() OVER (PARTITION BY scope ORDER BY pos) AS INTEGER) AS rank, source_system
    FROM node SEMI JOIN kept USING (scope, pos)) SELECT * FROM ranked"""


@query("bundle_kept", _KEPT)
def bundle_kept(spark: SparkSession, sf: str) -> DataFrame:
    """All items of each date that survive the URL and title rule, before the report limit."""
    out = B.dedupe_bundle(bundle_pool(spark, sf), "daily", limit=None)
    return out.select("id", F.col("date").cast("string").alias("date"), "rank", "source_system")


@query("bundle_kept_rounds", _KEPT)
def bundle_kept_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same by rounds of joins for every date, whatever its size."""
    out = B.dedupe_bundle(bundle_pool(spark, sf), "daily", limit=None, walk_limit=0)
    return out.select("id", F.col("date").cast("string").alias("date"), "rank", "source_system")


@query("bundle_items", f"{_KEPT} WHERE rank <= {rules.BUNDLE_LIMIT}")
def bundle_items(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle of each date: five items."""
    out = B.dedupe_bundle(bundle_pool(spark, sf), "daily")
    return out.select("id", F.col("date").cast("string").alias("date"), "rank", "source_system")


@query("enrich_context", f"""WITH RECURSIVE {_POOL},
  ctx AS (SELECT DATE '2024-02-01' - (page_id % 4)::INTEGER + lag::INTEGER AS date, page_id AS ref, lower(trim(url)) AS url_key, {title_key_sql("title")} AS title_key
    FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, unnest([0, 1]) AS lag FROM pages) WHERE title <> '' AND url <> ''),
  title AS (SELECT date AS scope, title_key AS k FROM item WHERE title_key <> '' UNION SELECT date, title_key FROM ctx WHERE title_key <> ''),
  {similar_sql()},
  by_url AS (SELECT date, url_key, min(ref) AS ref FROM ctx GROUP BY ALL),
  near AS (SELECT scope, a, b FROM sim UNION ALL SELECT scope, k, k FROM title),
  by_title AS (SELECT near.scope AS date, near.a AS title_key, min(ref) AS ref FROM near JOIN ctx ON ctx.date = near.scope AND ctx.title_key = near.b GROUP BY ALL)
  SELECT id, CAST(item.date AS VARCHAR) AS date, coalesce(by_url.ref, by_title.ref) AS ref FROM item LEFT JOIN by_url USING (date, url_key)
  LEFT JOIN by_title ON by_title.date = item.date AND by_title.title_key = item.title_key""")
def enrich_context(spark: SparkSession, sf: str) -> DataFrame:
    """Daily and night items with the page captured the same day or the day before."""
    contexts = table(spark, sf, "pages").select(
        F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("page_id") % 4).cast("int")).alias("captured"),
        F.col("page_id").alias("pos"), "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.col("page_id").alias("ref"),
    )
    out = B.enrich_context(bundle_pool(spark, sf).select("id", "date", "title", "url"), contexts)
    return out.select("id", F.col("date").cast("string").alias("date"), F.col("knowledge_context.ref").alias("ref"))


@query("handoffs", """WITH r AS (SELECT CAST(DATE '2024-02-01' AS VARCHAR) AS d, 'p' || page_id AS item, url, page_id FROM pages)
  SELECT 'curator-' || substr(sha256(d || ':' || item || ':' || url), 1, 16) AS handoff_id,
    3 AS schema_version, CASE WHEN page_id % 6 = 0 THEN 'consumed' ELSE 'pending' END AS status,
    CASE WHEN page_id % 3 = 0 THEN 'old' ELSE 'now' END AS created_at, CASE WHEN page_id % 6 = 0 THEN 'old' ELSE url END AS payload FROM r""")
def handoffs(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    item = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    hid = F.concat(F.lit("curator-"), B.handoff_fingerprint(F.lit("2024-02-01"), item, F.col("url"))).alias("handoff_id")
    requested = pages.select(hid, F.col("url").alias("payload"))
    existing = pages.filter("page_id % 3 = 0").select(
        hid, F.when(F.col("page_id") % 6 == 0, 3).otherwise(2).alias("schema_version"),
        F.when(F.col("page_id") % 6 == 0, "consumed").otherwise("pending").alias("status"), F.lit("old").alias("created_at"), F.lit("old").alias("payload"),
    )
    return B.upsert_handoffs(existing, requested, F.lit("now"))


@query("promotion_handoffs", """SELECT p_partkey, 'knowledge-' || substr(sha256(p_brand || ':' || p_partkey), 1, 16) AS handoff_id FROM part""")
def promotion_handoffs(spark: SparkSession, sf: str) -> DataFrame:
    key = B.promotion_fingerprint(F.col("p_brand"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("knowledge-"), key).alias("handoff_id"))


@query("health_issues", """WITH u AS (SELECT user_id, max(ts) AS last, count(*) FILTER (WHERE event_type = 'error') AS errors,
    arg_max(event_type, event_id) AS state FROM events GROUP BY user_id)
  SELECT CASE WHEN user_id % 4 = 0 THEN 'process_down' ELSE 'disconnected' END AS code, user_id::VARCHAR AS source, '' AS detail FROM u WHERE user_id % 4 = 0 OR user_id % 6 = 0
  UNION ALL SELECT 'job_failed', user_id::VARCHAR, 'errors' FROM u WHERE errors > 12
  UNION ALL SELECT 'source_unavailable', user_id::VARCHAR, state FROM u WHERE state NOT IN ('ok', 'success', 'available', 'present', 'previous_night', 'context_present')
  UNION ALL SELECT 'pipeline_state', user_id::VARCHAR, state FROM u
  UNION ALL SELECT 'pipeline_stale', user_id::VARCHAR, CAST(floor(epoch(TIMESTAMP '2024-01-31' - last) / 3600) AS BIGINT)::VARCHAR FROM u
    WHERE TIMESTAMP '2024-01-31' - last > INTERVAL 36 HOUR""")
def health_issues(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").groupBy("user_id").agg(
        F.max("ts").alias("last_run"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.max_by("event_type", "event_id").alias("status"),
    ).withColumn("name", F.col("user_id").cast("string"))
    profiles = users.select("name", (F.col("user_id") % 4 != 0).alias("running"), (F.col("user_id") % 6 != 0).alias("connected"))
    jobs = users.select(
        F.col("name").alias("profile"), F.lit("errors").alias("name"), F.when(F.col("errors") > 12, "failed").alias("last_status"),
        F.lit(None).cast("string").alias("last_error"),
    )
    return H.health_issues(profiles, jobs, users.select("name", "status"), users.select("name", "status", "last_run"),
                           F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


# The hex digits of a line tell where a character begins; a line is cut again and again at the last such place.
_BYTE_CUTS = """cuts AS (SELECT p AS whole, 0::BIGINT AS n, NULL::VARCHAR AS piece, hex(encode(p)) AS rest FROM
    (SELECT DISTINCT unnest(string_split(text, chr(10))) AS p FROM documents) WHERE strlen(p) > 2000
  UNION ALL SELECT whole, n + 1, decode(unhex(substr(rest, 1, 2 * e))), substr(rest, 2 * e + 1) FROM
    (SELECT *, CASE WHEN substr(rest, 4001, 2) NOT BETWEEN '80' AND 'BF' THEN 2000 WHEN substr(rest, 3999, 2) NOT BETWEEN '80' AND 'BF' THEN 1999
      WHEN substr(rest, 3997, 2) NOT BETWEEN '80' AND 'BF' THEN 1998 ELSE 1997 END AS e FROM cuts WHERE rest <> '')),
  cut AS (SELECT whole, list(piece ORDER BY n) AS pieces FROM cuts WHERE n > 0 GROUP BY whole)"""
_BYTE_CHUNKS = chunks_sql("documents", "doc_id", 2000, "strlen", "(SELECT pieces FROM cut WHERE whole = p)", tight=False)
_CHAR_CUT = f"list_transform(range(0, ceil(length(p) / {rules.CHUNK_CHARS}::DOUBLE)::BIGINT), lambda i: substr(p, i * {rules.CHUNK_CHARS} + 1, {rules.CHUNK_CHARS}))"


@query("chunk_by_bytes", f"WITH RECURSIVE {_BYTE_CUTS}, {_BYTE_CHUNKS} SELECT doc_id, no, strlen(chunk)::INTEGER AS bytes, sha256(chunk) AS sha256 FROM chunks")
def chunk_by_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, their lines as paragraphs, packed into messages of 2,000 bytes."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(C.chunk_by_bytes(text, 2000)).alias("no", "chunk"))
    return chunks.select("doc_id", "no", F.octet_length("chunk").alias("bytes"), F.sha2("chunk", 256).alias("sha256"))


@query("chunk_by_chars", f"""WITH RECURSIVE {chunks_sql('documents', 'doc_id', rules.CHUNK_CHARS, 'length', _CHAR_CUT, tight=True)}
  SELECT doc_id, no, length(chunk)::INTEGER AS chars, sha256(chunk) AS sha256 FROM chunks""")
def chunk_by_chars(spark: SparkSession, sf: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(C.chunk_by_chars(text)).alias("no", "chunk"))
    return chunks.select("doc_id", "no", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("sha256"))


@query("batch_ids", f"""WITH {ARTICLES_SQL} SELECT id, run_key, CAST(floor((row_number() OVER (PARTITION BY run_key ORDER BY feed_idx, entry_idx) - 1) / 7) AS INTEGER) AS batch FROM art""")
def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles(spark, sf).select("id", "run_key", "feed_idx", "entry_idx")
    return C.batch_ids(rows, ["run_key"], ["feed_idx", "entry_idx"]).select("id", "run_key", "batch")


@query("merge_sections", """WITH l AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
    FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?m)^((?:La|The|Der) .*)$', '## A \\1', 'g'), '(?m)^((?:El|Un|In) .*)$', '## B \\1', 'g') AS t FROM conversations)),
  h AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*##') AND contains(line, '## A') THEN 'A' WHEN regexp_matches(line, '^\\s*##') AND contains(line, '## B') THEN 'B' END AS hd FROM l),
  s AS (SELECT *, coalesce(last_value(hd IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'rest') AS sec FROM h)
  SELECT conv_id, CASE sec WHEN 'A' THEN '## A' WHEN 'B' THEN '## B' ELSE sec END AS section,
    regexp_replace(string_agg(line, chr(10) ORDER BY turn, pos), '^\\s+|\\s+$', '', 'g') AS content FROM s WHERE hd IS NULL GROUP BY conv_id, sec""")
def merge_sections(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace("text", r"(?m)^((?:La|The|Der) .*)$", "## A $1")
    text = F.regexp_replace(text, r"(?m)^((?:El|Un|In) .*)$", "## B $1")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))
    return C.merge_sections(rows, ["conv_id"], "turn", "text", sections=("## A", "## B"), other="rest")


@query("section_after_marker", """SELECT doc_id, CASE WHEN contains(t, '## Summary') THEN substr(trim(regexp_replace(string_split(
    substr(t, strpos(t, '## Summary') + 10), chr(10) || '## ')[1], '[\\s\\x{a0}\\x{85}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')), 1, 700) ELSE '' END AS summary
  FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\\n', chr(10) || '## Summary' || chr(10)), '(?m)^((?:La|The|Der) )', '## \\1', 'g') AS t FROM documents)""")
def section_after_marker(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws("\n## Summary\n", F.element_at(F.split("text", "\n", 2), 1), F.get(F.split("text", "\n", 2), F.lit(1)))
    text = F.regexp_replace(text, r"(?m)^((?:La|The|Der) )", "## $1")
    return table(spark, sf, "documents").select("doc_id", section(text, ("## Summary",)).alias("summary"))


@query("first_line_after_marker", """SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT x LIKE 'The%')[1], '') AS line FROM documents""")
def first_line_after_marker(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("head\n## One-line judgment\n"), F.regexp_replace("text", r"(?m)^The", "#The"))
    return table(spark, sf, "documents").select("doc_id", first_after(text).alias("line"))


@query("strip_audit_block", """SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || '## next' ELSE text END, '^\\s+|\\s+$', '', 'g') AS text FROM documents""")
def strip_audit_block(spark: SparkSession, sf: str) -> DataFrame:
    """Audits put behind each text, under a heading or in a fence, and removed again."""
    audit = F.lit(rules.AUDIT_WORD)
    under = F.concat("text", F.lit("\n## "), audit, F.lit("\nline one\nline two\n## next"))
    fenced = F.concat("text", F.lit("\n```"), audit, F.lit("\nline\n```\n"))
    text = F.when(F.col("doc_id") % 2 == 0, under).otherwise(fenced)
    return table(spark, sf, "documents").select("doc_id", strip_audit(text).alias("text"))
