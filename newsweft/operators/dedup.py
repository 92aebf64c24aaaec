"""Ingest filters and first-seen rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.operators.greedy import accept_in_feed_order


def fresh(df: DataFrame, published: Column, as_of: Column, window_hours: Column | None = None,
          earliest: Column | None = None) -> DataFrame:
    """Rows without a time, or not older than the window of their source.

    ``earliest``, the start of the longest window, is a plain bound that the scan can use.
    """
    window = F.lit(rules.WINDOW_HOURS) if window_hours is None else F.coalesce(window_hours, F.lit(rules.WINDOW_HOURS))
    age = F.timestamp_diff("MICROSECOND", published, as_of) / F.lit(3.6e9)
    keep = published.isNull() | (age <= window)
    if earliest is not None:
        df = df.filter(published.isNull() | (published >= earliest))
    return df.filter(keep)


def without_prefixes(df: DataFrame, title: str, prefixes: Sequence[str] = rules.SKIP_TITLE_PREFIXES) -> DataFrame:
    lowered = F.lower(F.col(title))
    test = F.lit(False)
    for p in prefixes:
        test = test | F.startswith(lowered, F.lit(p))
    return df.filter((F.col(title) != "") & ~test)


def not_sent(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the ledger; an empty key never matches."""
    known = ledger.select(key).filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).distinct()
    return df.join(known, key, "left_anti")


def _first_by(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """First row per key as a partial aggregate, so a frequent key is reduced before the shuffle."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(key.alias("k")).agg(best).select("r.*")


def first_seen(df: DataFrame, title: str = "title", link: str = "link",
               order: Sequence[str] = ("feed_idx", "entry_idx")) -> DataFrame:
    """First row per lower-cased title, then first row per link; empty links are all kept."""
    titles = _first_by(df, F.lower(F.col(title)), order)
    has_link = F.coalesce(F.col(link), F.lit("")) != ""
    return _first_by(titles.filter(has_link), F.col(link), order).unionByName(titles.filter(~has_link))


def limit_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int) -> DataFrame:
    """First ``limit`` rows per key; the rank filter also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def accept_in_order(df: DataFrame, scope: str, cap: int | Column = rules.MAX_PER_FEED, **sizes: int) -> DataFrame:
    """The sequential ingest rule of each run over ``source``, ``title``, ``link``."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    entries = df.select(
        scope, "id", F.struct("feed_idx", "entry_idx").alias("ord"), F.col("source").alias("feed"),
        cap.alias("cap"), F.lower("title").alias("title_key"), F.coalesce("link", F.lit("")).alias("link_key"),
    ).filter(F.col("title_key") != "")
    return df.join(accept_in_feed_order(entries, scope, **sizes), "id", "left_semi")


def normalize_search_results(df: DataFrame, source: str, snippet: str, published: str) -> DataFrame:
    """One shape for the results of any search provider; what is missing becomes ''."""

    def pick(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    return df.select(
        pick("title").alias("title"), pick("url").alias("url"), pick(snippet).alias("snippet"),
        pick(published).alias("published"), F.lit(source).alias("source"),
    )
