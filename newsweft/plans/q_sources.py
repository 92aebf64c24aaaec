"""Source queries: feeds, source lists, notes and artifacts made of the given tables and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.plans.articles import ARTICLES_SQL, articles
from newsweft.plans.q_ingest import _CLEAN
from newsweft.plans.registry import query, table
from newsweft.rules import SUMMARY_CHARS
from newsweft.sources import artifacts as A
from newsweft.sources import feeds as FD

#: Entries of one made feed.
FEED_ENTRIES = 200


def _escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def _element(name: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))


def feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """``name, content, kind``: feeds of at most 200 articles of a run of ids, in turn RSS, Atom and RDF.

    Atom entries have further links before and after the one to the page; RDF entries stand beside the channel.
    """
    rows = articles(spark, sf).select("id", "title", "summary", "link", "published").withColumn("number", F.floor(F.col("id") / FEED_ENTRIES))
    title, link = _element("title", _escaped(F.col("title"))), _escaped(F.col("link"))
    mail = F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    iso = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = _escaped(F.col("summary"))
    rss = _element("item", F.concat(title, _element("link", link), F.lit('<atom:link rel="self" href="https://x.org/"/>'), _element("description", text), _element("pubDate", mail)))
    atom = _element("entry", F.concat(
        title, F.lit('<link rel="enclosure" href="https://x.org/a.mp3"/><link rel="alternate" type="text/html" href="'), link,
        F.lit('"/><link rel="self" href="https://x.org/self"/>'), _element("content", text), _element("updated", iso),
    ))
    rdf = F.concat(F.lit('<item rdf:about="x">'), title, _element("link", link), _element("description", text), _element("dc:date", iso), F.lit("</item>"))
    kind = F.col("number") % 3
    entry = F.when(kind == 0, rss).when(kind == 1, atom).otherwise(rdf)
    items = rows.select("number", "id", entry.alias("entry")).groupBy("number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda x: x["entry"]), "").alias("items")
    )
    space = ' xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    content = (
        F.when(kind == 0, F.concat(F.lit(f'<rss version="2.0"{space}><channel><title>c</title>'), "items", F.lit("</channel></rss>")))
        .when(kind == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>c</title>'), "items", F.lit("</feed>")))
        .otherwise(F.concat(F.lit(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"{space}><channel rdf:about="y"><title>c</title></channel>'), "items", F.lit("</rdf:RDF>")))
    )
    return items.select(F.concat(F.lit("feed"), F.col("number").cast("string")).alias("name"), content.alias("content"), "number")


@query("feed_entries", f"""WITH {ARTICLES_SQL}, f AS (SELECT *, id // {FEED_ENTRIES} AS number FROM art),
  n AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY id) - 1 AS idx FROM f)
  SELECT 'feed' || number AS source, CAST(idx AS INTEGER) AS entry_idx, trim(title) AS title, link, substr({_CLEAN.format(x="summary")}, 1, {SUMMARY_CHARS}) AS summary,
    strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM n WHERE trim(title) <> ''""")
def feed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Articles written as feeds of three kinds and read again."""
    files = feed_files(spark, sf)
    sources = files.select(
        "name", F.lit("en").alias("category"), F.lit(False).alias("reference"), F.lit(5).alias("max_items"), F.lit(24).alias("window_hours"),
        F.col("number").cast("int").alias("feed_idx"),
    )
    out = FD.parse_feeds(files.select("name", "content"), sources)
    return out.select("source", "entry_idx", "title", "link", "summary", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("front_matter_notes", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN title ELSE trim(title) END AS title, url, 'topic ' || page_id % 7 AS topic
  FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""")
def front_matter_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as notes with a head of fields, some quoted, one repeated, and the fields read from the text."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    number = F.col("page_id").cast("string")
    quoted = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"'), title, F.lit('"'))).otherwise(title)
    note = F.concat(
        F.lit("---\ntopic: old\nno colon here\ntitle: "), quoted, F.lit("\nurl: "), F.col("url"), F.lit("\ntopic: topic "), (F.col("page_id") % 7).cast("string"),
        F.lit("\n---\n# "), number, F.lit("\ntopic: in the body\n"),
    )
    meta = table(spark, sf, "pages").select("page_id", FD.front_matter(note).alias("meta"))
    return meta.select("page_id", F.col("meta.title").alias("title"), F.col("meta.url").alias("url"), F.col("meta.topic").alias("topic"))


@query("parsed_times", """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE strftime(CASE event_id % 6 WHEN 3 THEN ts - INTERVAL 2 HOUR WHEN 1 THEN date_trunc('minute', ts)
    ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') END AS at FROM (SELECT event_id, CASE WHEN event_id % 6 = 3 THEN date_trunc('second', ts) ELSE ts END AS ts FROM events)""")
def parsed_times(spark: SparkSession, sf: str) -> DataFrame:
    """Event times in the spellings of feeds, one of them with an offset, and text that is no time; the second field counts where the first is none."""
    ts, kind = F.col("ts"), F.col("event_id") % 6
    published = (
        F.when(kind == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(kind == 1, F.date_format(ts, "dd MMM yyyy HH:mm 'UTC'"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(kind == 4, "soon").otherwise("13 Foo 2024")
    )
    updated = F.when(kind == 4, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss '+0000'"))
    rows = table(spark, sf, "events").select("event_id", FD.parse_published(published, updated).alias("at"))
    return rows.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


#: Documents of one made artifact.
PART = 100


def _damaged(text: Column, number: Column) -> Column:
    """Every fifth artifact was cut off while it was written."""
    return F.when(number % 5 == 4, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)


def quality_files(spark: SparkSession, sf: str) -> DataFrame:
    """A report per document, in the older form without the newer fields for every second one."""
    n = F.col("doc_id")
    day = F.date_format(F.date_sub(F.lit("2024-02-01").cast("date"), (n % 200).cast("int")), "yyyy-MM-dd")
    full = F.to_json(F.struct(
        F.col("n_chars").alias("total_items"), (n % 7).alias("items_with_unsupported_numbers"), F.array("source").alias("unmatched_evidence_ids"),
        (n % 3 == 0).alias("validation_complete"), F.lit("extra").alias("other"),
        F.date_format(F.date_sub(F.lit("2024-02-01").cast("date"), (n % 130).cast("int")), "yyyy-MM-dd'T'08:00:00").alias("generated"),
    ))
    old = F.to_json(F.struct(F.col("n_chars").alias("total_items")))
    path = F.concat(F.lit("/q/"), day, F.lit("-AM-"), n.cast("string"), F.lit(".json"))
    return table(spark, sf, "documents").select(
        path.alias("path"), _damaged(F.when(n % 2 == 0, full).otherwise(old), n).alias("value"), n.alias("doc_id")
    )


_DAY = "strftime(DATE '2024-02-01' - (doc_id % 200)::INTEGER, '%Y-%m-%d')"


@query("artifact_fields", f"""SELECT doc_id, {_DAY} || '-AM' AS run_key, CASE WHEN doc_id % 5 = 4 THEN 'invalid' ELSE 'present' END AS artifact_status,
    CASE WHEN doc_id % 5 <> 4 THEN n_chars END AS total_items, CASE WHEN doc_id % 5 <> 4 AND doc_id % 2 = 0 THEN doc_id % 7 END AS items_with_unsupported_numbers,
    CASE WHEN doc_id % 5 <> 4 AND doc_id % 2 = 0 THEN doc_id % 3 = 0 END AS validation_complete,
    CASE WHEN doc_id % 5 <> 4 AND doc_id % 2 = 0 THEN source END AS unmatched FROM documents""")
def artifact_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of two ages, some damaged, read with one schema."""
    found = A.parse_json_artifacts(quality_files(spark, sf), A.QUALITY_SCHEMA)
    return found.select(
        F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("doc_id"), "run_key", "artifact_status", "total_items",
        "items_with_unsupported_numbers", "validation_complete", F.array_join("unmatched_evidence_ids", "|").alias("unmatched"),
    )


@query("pruned_artifacts", f"""SELECT doc_id, both_days FROM documents, (VALUES (false), (true)) v(both_days)
  WHERE doc_id % 200 <= 90 OR (both_days AND doc_id % 5 <> 4 AND doc_id % 2 = 0 AND doc_id % 130 <= 90)""")
def pruned_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Reports kept for 90 days, by the day of their name alone and by both days."""
    files = quality_files(spark, sf).select("doc_id", A.run_key_of(F.col("path")).alias("run_key"), F.get_json_object("value", "$.generated").alias("generated"))
    today = F.lit("2024-02-01").cast("date")
    # A date inside a damaged report still stands before the cut, so it is read by the parser only.
    files = files.withColumn("generated", F.when(F.col("doc_id") % 5 != 4, F.col("generated")))
    one = A.within_retention(files, today, 90).select("doc_id", F.lit(False).alias("both_days"))
    return one.unionByName(A.within_retention(files, today, 90, inner=F.col("generated")).select("doc_id", F.lit(True).alias("both_days")))


def ledger_files(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger per hundred articles: keys by day, every third one in the older form of one list."""
    rows = articles(spark, sf).select("link", F.date_format("published", "yyyy-MM-dd").alias("day"), F.floor(F.col("id") / PART).alias("number"))
    days = rows.groupBy("number", "day").agg(F.collect_list("link").alias("links")).groupBy("number").agg(
        F.map_from_entries(F.collect_list(F.struct("day", "links"))).alias("history"), F.flatten(F.collect_list("links")).alias("links")
    )
    new = F.to_json(F.struct("history", F.lit(7).alias("retention_days")))
    old = F.to_json(F.struct("links", F.lit("2024-01-20 13:46").alias("ts")))
    n = F.col("number")
    return days.select(F.concat(F.lit("/l/"), n.cast("string"), F.lit(".json")).alias("path"), _damaged(F.when(n % 3 == 2, old).otherwise(new), n).alias("value"))


@query("ledger_entries", f"""WITH {ARTICLES_SQL}, l AS (SELECT *, id // {PART} AS number FROM art)
  SELECT DISTINCT CASE WHEN number % 3 = 2 THEN '2024-01-20' ELSE strftime(published, '%Y-%m-%d') END AS day, link AS key FROM l WHERE number % 5 <> 4""")
def ledger_entries(spark: SparkSession, sf: str) -> DataFrame:
    ledger = A.parse_json_artifacts(ledger_files(spark, sf), A.LEDGER_SCHEMA).filter("artifact_status = 'present'")
    return A.ledger_rows(ledger).select(F.col("day").cast("string").alias("day"), "key")


@query("ledger_sent_keys", f"""WITH {ARTICLES_SQL} SELECT DISTINCT link AS key FROM art WHERE id // {PART} % 5 <> 4""")
def ledger_sent_keys(spark: SparkSession, sf: str) -> DataFrame:
    return A.sent_keys(A.parse_json_artifacts(ledger_files(spark, sf), A.LEDGER_SCHEMA).filter("artifact_status = 'present'"))


def snapshot_files(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of each run, a file per hundred ids; files of other names beside them."""
    rows = articles(spark, sf).select("id", "run_key", "title", F.floor(F.col("id") / PART).alias("number"))
    rep = F.struct("title", F.concat(F.lit("a"), F.col("id").cast("string")).alias("article_id"))
    reps = rows.groupBy("run_key", "number").agg(F.array_sort(F.collect_list(rep)).alias("reps"))
    value = F.to_json(F.struct(
        F.substring("run_key", 1, 10).alias("date"), F.substring("run_key", 12, 2).alias("session"),
        F.transform("reps", lambda r: F.struct(r["title"].alias("raw_title"), r["article_id"].alias("article_id"))).alias("reps"),
    ))
    n = F.col("number")
    name = F.concat(F.lit("/meta/"), n.cast("string"), F.lit("/"), F.col("run_key"))
    real = reps.select(F.concat(name, F.lit(".json")).alias("path"), _damaged(value, n).alias("value"))
    return real.unionByName(reps.select(F.concat(F.lit("/meta/2025-12-31-PM-evidence-"), n.cast("string"), F.lit(".json")).alias("path"), value.alias("value")))


@query("snapshot_reps", f"""WITH {ARTICLES_SQL}, k AS (SELECT *, dense_rank() OVER (ORDER BY run_key DESC) AS r FROM art WHERE id // {PART} % 5 <> 4)
  SELECT run_key, substr(run_key, 1, 10) AS date, title AS raw_title, 'a' || id AS article_id FROM k WHERE r <= 3 AND title <> ''""")
def snapshot_reps(spark: SparkSession, sf: str) -> DataFrame:
    return A.recent_reps(snapshot_files(spark, sf), 3).select("run_key", "date", "raw_title", "article_id")


@query("digest_titles", f"""WITH {ARTICLES_SQL}, k AS (SELECT *, dense_rank() OVER (ORDER BY run_key DESC) AS r FROM art WHERE regexp_matches(title, '^[A-Za-z]') AND NOT contains(split_part(title, '.', 1), '*'))
  SELECT run_key, '🔥 ' || split_part(title, '.', 1) AS title, count(*) AS n FROM k WHERE r <= 3 AND id % 3 <> 0
  GROUP BY 1, 2""")
def digest_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Digests with a bold line per article, two of three marked; the titles of the newest three."""
    rows = articles(spark, sf).withColumn("line", F.element_at(F.split("title", r"\.", 2), 1)).filter("title rlike '^[A-Za-z]' and not contains(line, '*')")
    mark = F.when(F.col("id") % 3 == 0, "").otherwise("🔥 ")
    body = F.concat(F.lit("**"), mark, F.col("line"), F.lit("**\n"), F.col("link"), F.lit("\n"))
    files = rows.groupBy("run_key", F.floor(F.col("id") / PART).alias("number")).agg(F.array_join(F.array_sort(F.collect_list(body)), "").alias("value"))
    files = files.select(F.concat(F.lit("/d/"), F.col("run_key"), F.lit("-"), F.col("number").cast("string"), F.lit(".md")).alias("path"), "value")
    return A.archive_titles(files, 3).groupBy("run_key", "title").agg(F.count("*").alias("n"))


@query("source_lines", """WITH l AS (SELECT DISTINCT c_name, c_mktsegment, c_custkey FROM customer)
  SELECT c_name AS name, 'https://e.org/' || c_custkey || '|x' AS url FROM l WHERE c_custkey % 4 IN (0, 1)""")
def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as lines of a source list: whole ones, comments, and lines without a name or an address."""
    n, name = F.col("c_custkey"), F.col("c_name")
    url = F.concat(F.lit("https://e.org/"), n.cast("string"), F.lit("|x"))
    line = (
        F.when(n % 4 == 0, F.concat(name, F.lit("|"), url)).when(n % 4 == 1, F.concat(F.lit("  "), name, F.lit(" | "), url, F.lit("  ")))
        .when(n % 4 == 2, F.concat(F.lit("# "), name, F.lit("|"), url)).otherwise(F.when(n % 8 == 3, F.concat(F.lit(" | "), url)).otherwise(name))
    )
    return FD.parse_source_list(table(spark, sf, "customer").select(line.alias("value")))
