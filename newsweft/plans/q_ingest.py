"""Ingest queries: cleaning, keys, filters and first-seen rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions import scoring as S
from newsweft.functions import text as T
from newsweft.functions import urls as U
from newsweft.operators import dedup
from newsweft.operators.events import event_id
from newsweft.plans.articles import ARTICLES_SQL, articles
from newsweft.plans.registry import query, table

_CLEAN = """regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"""
_WS = "trim(regexp_replace({x}, '[\\s\\x{{a0}}\\x{{85}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ' ', 'g'))"


@query("clean_html_pages", f"SELECT page_id, {_CLEAN.format(x='html')} AS clean FROM pages")
def clean_html_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.clean_html(F.col("html")).alias("clean"))


_MAIN = "regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "nav", "aside", "table", "footer", "header", "form", "noscript"):
    _MAIN = f"regexp_replace({_MAIN}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_MAIN = f"regexp_extract({_MAIN}, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)"
_MAIN = f"regexp_replace({_MAIN}, '(?i)<(?:br|/p|/h[1-6]|/li|/div)\\b[^>]*>', ' ', 'g')"


@query("main_text_pages", f"SELECT page_id, {_WS.format(x=_CLEAN.format(x=_MAIN))} AS body FROM pages")
def main_text_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.extract_main_text(F.col("html")).alias("body"))


# The page URLs carry plain parameters only, so the check can leave out decoding.
_URL_SQL = """
u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme,
    lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS netloc,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM pages),
n AS (SELECT page_id, url, regexp_replace(netloc, ':\\d*$', '') AS host,
    scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(netloc, ':80$', '')
      WHEN scheme = 'https' THEN regexp_replace(netloc, ':443$', '') ELSE netloc END ||
    CASE WHEN length(regexp_replace(path, '/+', '/', 'g')) > 1
      THEN regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '')
      ELSE regexp_replace(path, '/+', '/', 'g') END AS base,
    list_sort(list_filter(string_split(qs, '&'), lambda p: p <> '' AND
      NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|oc)$'))) AS ps FROM u),
c AS (SELECT page_id, url, host, base || CASE WHEN len(ps) > 0
    THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical FROM n)"""


@query("normalize_url_pages", f"WITH {_URL_SQL} SELECT page_id, canonical FROM c")
def normalize_url_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("canonical"))


@query("page_hostname", f"WITH {_URL_SQL} SELECT host, count(*) AS pages FROM c GROUP BY host")
def page_hostname(spark: SparkSession, sf: str) -> DataFrame:
    host = U.hostname(F.col("url")).alias("host")
    return table(spark, sf, "pages").groupBy(host).agg(F.count("*").alias("pages"))


@query("aggregator_pages", f"""WITH {_URL_SQL} SELECT page_id,
  host IN ('news.google.com', 'news.google.co.uk') AND canonical LIKE '%/rss/articles/%' AS aggregator FROM c""")
def aggregator_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.is_aggregator_url(F.col("url")).alias("aggregator"))


@query("article_id_pages", f"""WITH {_URL_SQL} SELECT page_id,
  'a1_' || substr(sha256('url:' || canonical), 1, 24) AS article_id FROM c""")
def article_id_pages(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.lit("")
    return table(spark, sf, "pages").select(
        "page_id", U.article_id(F.col("url"), empty, empty, empty).alias("article_id")
    )


@query("domain_allow_list", f"""WITH {_URL_SQL} SELECT page_id, host FROM c
  WHERE host = 'example.org' OR host LIKE '%.example.org' OR host = 'blog.example.net' OR host LIKE '%.tiontion.example.net'""")
def domain_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    host = U.hostname(F.col("url"))
    allowed = U.host_allowed(host, ("example.org", "blog.example.net", "tiontion.example.net"))
    return table(spark, sf, "pages").filter(allowed).select("page_id", host.alias("host"))


@query("content_hash_docs", f"SELECT doc_id, sha256({_WS.format(x='text')}) AS content_sha256 FROM documents")
def content_hash_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.content_sha256(F.col("text")).alias("content_sha256"))


@query("strip_suffix_titles", """SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3')
  THEN trim(regexp_replace(t, '\\s+-\\s+[^-]+$', '')) ELSE t END AS title FROM (
  SELECT doc_id, source, split_part(text, chr(10), 1) || ' - ' || source AS t FROM documents)""")
def strip_suffix_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.element_at(F.split("text", "\n", 2), 1), F.lit(" - "), F.col("source"))
    reference = F.col("source").isin("src0", "src1", "src2", "src3")
    return table(spark, sf, "documents").select("doc_id", T.strip_source_suffix(title, reference).alias("title"))


@query("event_title_keys", f"""WITH {ARTICLES_SQL} SELECT id,
  regexp_replace(lower(title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g') AS event_key,
  regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS bundle_key,
  'evt_20240201_' || substr(sha1(regexp_replace(lower(title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g')), 1, 12)
    AS event_id FROM art""")
def event_title_keys(spark: SparkSession, sf: str) -> DataFrame:
    title = F.col("title")
    return articles(spark, sf).select(
        "id", T.event_title_key(title).alias("event_key"), T.bundle_title_key(title).alias("bundle_key"),
        event_id(title, F.lit("2024-02-01")).alias("event_id"),
    )


@query("freshness_filter_events", f"""SELECT event_id, event_type FROM events
  WHERE ts IS NULL OR epoch(TIMESTAMP '2024-01-30 00:00:00' - ts) / 3600.0
    <= CASE WHEN event_type IN ('error', 'purchase') THEN {rules.SLOW_WINDOW_HOURS} ELSE {rules.WINDOW_HOURS} END""")
def freshness_filter_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    windows = F.create_map(F.lit("error"), F.lit(72), F.lit("purchase"), F.lit(72))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return dedup.fresh(
        events, F.col("ts"), now, F.try_element_at(windows, F.col("event_type")),
        earliest=F.lit("2024-01-27 00:00:00").cast("timestamp_ntz"),
    ).select("event_id", "event_type")


@query("skip_title_prefixes", f"""WITH {ARTICLES_SQL} SELECT id FROM art WHERE title <> ''
  AND NOT regexp_matches(lower(title), '^(the |la |der )')""")
def skip_title_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.without_prefixes(articles(spark, sf), "title", ("the ", "la ", "der ")).select("id")


@query("dedup_first_seen", f"""WITH {ARTICLES_SQL},
  t AS (SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY feed_idx, entry_idx) = 1)
  SELECT id, source FROM t QUALIFY row_number() OVER (PARTITION BY link ORDER BY feed_idx, entry_idx) = 1""")
def dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles(spark, sf).select("id", "source", "title", "link", "feed_idx", "entry_idx")
    return dedup.first_seen(rows, order=("feed_idx", "entry_idx")).select("id", "source")


@query("per_source_limit", f"""WITH {ARTICLES_SQL} SELECT id, source, run_key FROM art
  QUALIFY row_number() OVER (PARTITION BY run_key, source ORDER BY feed_idx, entry_idx) <= {rules.MAX_PER_FEED}""")
def per_source_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles(spark, sf).select("id", "source", "run_key", "feed_idx", "entry_idx")
    return dedup.limit_per(rows, ["run_key", "source"], ["feed_idx", "entry_idx"], rules.MAX_PER_FEED).select(
        "id", "source", "run_key"
    )


_TAKES = f"""NOT list_contains(titles, t) AND NOT list_contains(links, link)
        AND len(list_filter(feeds, lambda x: x = e.source)) < {rules.MAX_PER_FEED}"""
_ACCEPTED = f"""WITH RECURSIVE {ARTICLES_SQL},
  e AS (SELECT id, run_key, source, link, md5(lower(title)) AS t, row_number() OVER (PARTITION BY run_key ORDER BY feed_idx, entry_idx) AS pos
    FROM art WHERE title <> ''),
  walk AS (SELECT run_key, 0::BIGINT AS pos, NULL::BIGINT AS id, NULL::VARCHAR AS source, []::VARCHAR[] AS titles, []::VARCHAR[] AS links,
      []::VARCHAR[] AS feeds FROM e GROUP BY run_key
    UNION ALL SELECT run_key, pos, CASE WHEN ok THEN id END, source, CASE WHEN ok THEN list_append(titles, t) ELSE titles END,
      CASE WHEN ok THEN list_append(links, link) ELSE links END, CASE WHEN ok THEN list_append(feeds, source) ELSE feeds END
    FROM (SELECT e.*, titles, links, feeds, {_TAKES} AS ok FROM walk w JOIN e ON e.run_key = w.run_key AND e.pos = w.pos + 1))
  SELECT id, source, run_key FROM walk WHERE id IS NOT NULL"""


def accepted(spark: SparkSession, sf: str, **sizes: int) -> DataFrame:
    rows = articles(spark, sf).select("id", "source", "title", "link", "feed_idx", "entry_idx", "run_key")
    return dedup.accept_in_order(rows, "run_key", rules.MAX_PER_FEED, **sizes).select("id", "source", "run_key")


@query("feed_order_accept", _ACCEPTED)
def feed_order_accept(spark: SparkSession, sf: str) -> DataFrame:
    """The sequential rule: only rows taken mark their title and link as seen."""
    return accepted(spark, sf)


@query("feed_order_rounds", _ACCEPTED)
def feed_order_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the rounds of joins that a run beyond one task takes."""
    return accepted(spark, sf, limit=0)


@query("sent_left_anti", """WITH sent AS (SELECT DISTINCT o_custkey AS k FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 7 DAY AND o_orderdate < TIMESTAMP '1998-06-01')
  SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT k FROM sent)""")
def sent_left_anti(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate")
    ledger = table(spark, sf, "orders").filter(
        (day >= F.lit("1998-05-25").cast("timestamp_ntz")) & (day < F.lit("1998-06-01").cast("timestamp_ntz"))
    ).select(F.col("o_custkey").alias("key"))
    customers = table(spark, sf, "customer").withColumn("key", F.col("c_custkey"))
    return dedup.not_sent(customers, ledger, "key").select("c_custkey", "c_mktsegment")


_PATTERNS = (("triage", "triage"), ("tion was", "selection"), ("que", "fetch"), ("und", "link"), ("the", "write"))


@query("classify_by_pattern", "SELECT doc_id, CASE " + " ".join(
    f"WHEN contains(text, '{n}') THEN '{l}'" for n, l in _PATTERNS) + " ELSE 'unknown' END AS stage FROM documents")
def classify_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", S.classify_by_pattern(F.col("text"), _PATTERNS, "unknown").alias("stage")
    )


@query("leading_int_docs", """SELECT doc_id, coalesce(try_cast(regexp_extract(s, '^(\\d+)', 1) AS INTEGER), 0) AS score
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE n_chars || '/30' END AS s FROM documents)""")
def leading_int_docs(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(
        F.concat(F.col("n_chars").cast("string"), F.lit("/30"))
    )
    return table(spark, sf, "documents").select("doc_id", T.leading_int(text).alias("score"))


@query("search_results_union", """
  SELECT 'page' AS provider, CAST(page_id AS VARCHAR) AS ref, url, '' AS published,
    regexp_replace(html, '<[^>]+>', '', 'g') AS snippet FROM pages
  UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), '', '', text FROM benchmark""")
def search_results_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two result shapes brought to one."""
    pages = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("title"), "url",
        F.regexp_replace("html", "<[^>]+>", "").alias("text"),
    )
    bench = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("title"), F.col("text").alias("content")
    )
    both = dedup.normalize_search_results(pages, "page", snippet="text", published="publishedDate").unionByName(
        dedup.normalize_search_results(bench, "benchmark", snippet="content", published="published_date")
    )
    return both.select(F.col("source").alias("provider"), F.col("title").alias("ref"), "url", "published", "snippet")
