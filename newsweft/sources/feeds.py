"""Landed feeds, source lists and front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.functions.text import clean_html, let, strip, strip_source_suffix, truncate
from newsweft.rules import SUMMARY_CHARS

_LINKS = "array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>"
_ENTRY = (
    f"array<struct<title:string,link:{_LINKS},description:string,summary:string,content:string,"
    "pubDate:string,published:string,updated:string,date:string>>"
)
#: Entries stand in the channel (RSS), beside it (RDF) or in the feed itself (Atom).
_FEED = f"channel struct<item:{_ENTRY}>, item {_ENTRY}, entry {_ENTRY}"


def parse_time(c: Column) -> Column:
    """A feed's time in one of its usual spellings, as UTC; null when it is none."""
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")
    text = F.regexp_replace(text, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    mail = F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm xx"))
    )
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_timestamp(text))
    return F.coalesce(mail, iso)


def parse_published(published: Column, updated: Column) -> Column:
    return F.coalesce(parse_time(published), parse_time(updated))


def entry_link(links: Column) -> Column:
    """The page of an entry: the text of a link element, else the first link that names a page as its alternate form, else the first
    that is no part of the feed's own machinery."""
    text = F.filter(links, lambda x: F.trim(F.coalesce(x["_VALUE"], F.lit(""))) != "")
    named = F.filter(links, lambda x: F.coalesce(x["_href"], F.lit("")) != "")
    page = F.filter(named, lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate") & F.coalesce(
        x["_type"], F.lit("text/html")).isin("text/html", "application/xhtml+xml"))
    other = F.filter(named, lambda x: ~F.coalesce(x["_rel"], F.lit("")).isin("self", "enclosure", "edit", "hub"))
    first = lambda found, field: F.get(found, F.lit(0))[field]
    return F.trim(F.coalesce(first(text, "_VALUE"), first(page, "_href"), first(other, "_href"), F.lit("")))


def parse_feeds(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries of ``files(name, content)`` in feed order; RSS, RDF and Atom are told by where the entries stand.

    ``sources(name, category, reference, max_items, window_hours, feed_idx)``. A feed is parsed once, as a whole; what is no feed gives
    no entries, and entries without a title are left out but keep the others' places.
    """
    parsed = F.from_xml("content", F.lit(_FEED), {"ignoreNamespace": "true", "attributePrefix": "_"})
    items = F.coalesce(F.col("feed.channel.item"), F.col("feed.item"), F.col("feed.entry"))
    entries = files.select("name", parsed.alias("feed")).select("name", F.posexplode(items).alias("entry_idx", "e")).join(sources, "name")
    title = strip(F.coalesce("e.title", F.lit("")))
    reference = F.coalesce("reference", F.lit(False))
    return entries.select(
        F.col("name").alias("source"), "category", reference.alias("reference"), "max_items", "window_hours", "feed_idx", "entry_idx",
        strip_source_suffix(title, reference).alias("title"), entry_link(F.col("e.link")).alias("link"),
        truncate(clean_html(F.coalesce("e.summary", "e.description", "e.content", F.lit(""))), SUMMARY_CHARS).alias("summary"),
        parse_published(F.coalesce("e.published", "e.pubDate"), F.coalesce("e.updated", "e.date")).alias("published"),
    ).filter("title <> ''")


def read_feeds(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Entries of landed feed files, each read once and named after its feed (``<name>.xml``); as ``parse_feeds``."""
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1), "%20", " ")
    return parse_feeds(spark.read.text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("content")), sources)


def parse_source_list(lines: DataFrame) -> DataFrame:
    """``name | url`` lines (``value``); blank lines, comments and incomplete lines are skipped."""
    line = F.trim("value")
    parts = F.split(line, r"\|", 2)
    rows = lines.filter((line != "") & ~F.startswith(line, F.lit("#"))).select(
        F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("url")
    )
    return rows.filter((F.col("name") != "") & (F.col("url") != ""))


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_source_list(spark.read.text(path))


def front_matter(text: Column) -> Column:
    """Scalars between the two ``---`` lines at the top of a note, as a map without quotes."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(
        pairs,
        lambda x, i: F.struct(
            F.trim(F.element_at(F.split(x, ":", 2), 1)).alias("key"),
            F.regexp_replace(F.trim(F.element_at(F.split(x, ":", 2), 2)), r'^"+|"+$', "").alias("value"),
            i.alias("i"),
        ),
    )
    # The last line of a repeated key counts.
    last = let(entries, lambda found: F.filter(
        found, lambda e: ~F.exists(found, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"]))
    ))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes: ``path, meta, body``."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return text.select(
        F.input_file_name().alias("path"), front_matter(F.col("value")).alias("meta"), F.col("value").alias("body")
    )
