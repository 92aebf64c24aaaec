"""URL canonical form, host tests and article ids as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft import rules

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(url, r"[\t\r\n]", ""), _URL, group), F.lit(""))


def hostname(url: Column) -> Column:
    """Lower-cased host without user info and port."""
    netloc = F.regexp_replace(url_part(url, 2), r"^.*@", "")
    return F.lower(F.regexp_replace(netloc, r":\d*$", ""))


def _decode(c: Column) -> Column:
    """Percent and plus decoding; text that is not valid encoding is kept."""
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    """Form encoding that leaves letters, digits and ``_ . - ~`` as they are."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """Canonical form: lower scheme and host, no default port, no fragment, no tracking
    parameters, single slashes, no trailing slash, parameters in stable order of their names."""
    scheme = F.lower(url_part(url, 1))
    netloc = F.lower(url_part(url, 2))
    netloc = (
        F.when((scheme == "http") & netloc.endswith(":80"), F.regexp_replace(netloc, r":80$", ""))
        .when((scheme == "https") & netloc.endswith(":443"), F.regexp_replace(netloc, r":443$", ""))
        .otherwise(netloc)
    )
    path = F.regexp_replace(url_part(url, 3), r"/+", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/$", "")).otherwise(path)

    pairs = F.filter(F.split(url_part(url, 4), "&"), lambda p: p != "")
    pairs = F.transform(
        pairs,
        lambda p, i: F.struct(
            _decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
            i.alias("i"),
            _decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["k"]).startswith(rules.TRACKING_PREFIX)
        & ~F.lower(p["k"]).isin(*rules.TRACKING_PARAMS),
    )
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))),
        "&",
    )
    out = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.coalesce(out, url))


def is_aggregator_url(url: Column) -> Column:
    return hostname(url).isin(*rules.AGGREGATOR_HOSTS) & url_part(url, 3).startswith(rules.AGGREGATOR_PATH)


def article_id(link: Column, source: Column, title: Column, day: Column,
               canonical_url: Column | None = None) -> Column:
    """Stable id from the canonical URL, or from source, title and day when there is none."""
    empty = F.lit("")
    canonical = F.coalesce(canonical_url, empty) if canonical_url is not None else empty
    normalized = normalize_url(F.coalesce(link, empty))
    fallback = F.concat(
        F.lit("fallback:"), F.trim(F.lower(F.coalesce(source, empty))), F.lit("|"),
        F.trim(F.lower(F.coalesce(title, empty))), F.lit("|"), F.coalesce(day.cast("string"), empty),
    )
    key = (
        F.when(canonical != "", F.concat(F.lit("url:"), canonical))
        .when((normalized != "") & ~is_aggregator_url(F.coalesce(link, empty)),
              F.concat(F.lit("url:"), normalized))
        .otherwise(fallback)
    )
    return F.concat(F.lit("a1_"), F.substring(F.sha2(key, 256), 1, 24))


def host_suffixes(host: Column) -> Column:
    """Every dot-separated suffix of a host, the host itself first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def host_allowed(host: Column, domains: Sequence[str] = rules.FULLTEXT_DOMAINS) -> Column:
    """The host is one of ``domains`` or below one of them."""
    return F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(d) for d in domains]))
