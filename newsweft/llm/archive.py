"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256, which is checked when they are read. The exact header of every record is
stored apart. A record is its header and, unless it is a revisit, its payload; it is put together again by a join on the digest.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.session import ensure_checkpoint_dir

#: Payloads from so many bytes on are stored once for all records that share them.
LEAST_SHARED = 1000
#: Fixed values of the format.
CRLF = "\r\n"
CONTROLS = [*range(0x20), 0x7F]
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_rows(pages: DataFrame) -> DataFrame:
    """``record`` (a key of the row), ``page_id``, ``url`` and ``payload``."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )


def one_line(url: F.Column) -> F.Column:
    """A url whose control characters, which would end the line of a header, are percent-encoded."""
    encoded = reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(f"%{k:02X}")), CONTROLS, url)
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), encoded).otherwise(url)


def write_archive(pages: DataFrame, path: str, least_shared: int = LEAST_SHARED, written_at: datetime | None = None) -> None:
    """Writes ``path/payloads`` and ``path/headers``. All records have one date, ``written_at`` or the time of the call.

    Records of one payload of at least ``least_shared`` bytes revisit the one with the largest ``page_id``; shorter payloads are
    responses, though their bytes are stored once too. A null ``page_id`` is smaller than all others.
    """
    rows = record_rows(pages)
    date = (written_at or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    slim = rows.select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("sha256")
    )
    first = slim.groupBy("sha256").agg(F.max("page_id").alias("response_id"))
    headers = slim.join(first, "sha256").withColumn(
        "revisits", (F.col("payload_bytes") >= least_shared) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    )
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisits"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uri("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce(one_line(F.col("url")), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisits"), F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", uri("response_id")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisits"), F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    headers.select("page_id", F.encode(header, "UTF-8").alias("header"), "sha256").write.parquet(f"{path}/headers")
    # One row of each payload: that of its response. Page ids are told apart, so no payload is gathered with its copies;
    # rows that share a page id as well are left to the last step.
    key = ["page_id", "sha256"]
    named = rows.select("page_id", "payload", F.unhex(F.sha2("payload", 256)).alias("sha256"))
    wanted = first.select(F.col("response_id").alias("page_id"), "sha256")
    null_safe = named.alias("a").join(wanted.alias("b"), (F.col("a.sha256") == F.col("b.sha256")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id")), "left_semi")
    null_safe.dropDuplicates(key).select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, the exact ``header``, ``sha256`` and the ``payload`` that the header's record stands for.

    A payload that does not have its digest stops the job.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    intact = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    checked = payloads.withColumn("payload", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")))
    return spark.read.parquet(f"{path}/headers").join(checked, "sha256")


def field(name: str) -> F.Column:
    """Value of a line of the header; only a line feed ends a line."""
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?md)^{name}: ([^\r\n]*)", 1)


def warc_record(header: str = "header", payload: str = "payload") -> F.Column:
    """The bytes of a whole record."""
    body = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col(payload))
    return F.concat(F.col(header), body, F.lit(b"\r\n\r\n"))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive, reads it back and returns what its records say.

    A null html is an empty payload. Repeated rows are records of their own; those that share the largest ``page_id`` of a payload are
    all responses. An empty table gives no rows. Columns besides ``page_id``, ``url`` and ``html`` are not looked at.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    kind = field("WARC-Type")
    return read_records(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        kind.alias("record_type"), F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
    )
