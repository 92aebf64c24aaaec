"""Artifacts of runs: snapshots, cards, reports, digests and ledgers as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsweft import rules

LEDGER_SCHEMA = (
    "delivery_runs map<string,struct<delivered_at:string,evidence_status:string,quality_status:string,"
    "artifact_bundle_status:string>>, updated string, retention_days int, last_session string, "
    "last_push_timestamp double, history map<string,array<string>>, links array<string>, repos array<string>, ts string"
)
SNAPSHOT_SCHEMA = "date string, session string, reps array<struct<raw_title:string,zh:string,emoji:string,article_id:string>>"
QUALITY_SCHEMA = (
    "total_items bigint, items_with_unsupported_numbers bigint, items_with_missing_evidence bigint, "
    "unmatched_evidence_ids array<string>, validation_complete boolean, unsupported_ratio double"
)


def run_key_of(path: Column) -> Column:
    """``YYYY-MM-DD-AM`` or ``-PM`` at the head of a file name."""
    return F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2}-(?:AM|PM))[^/]*$", 1)


def text_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Whole files: ``path, value``."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), "value")


def parse_json_artifacts(files: DataFrame, schema: str) -> DataFrame:
    """The fields of one JSON object per row of ``files(path, value)`` with ``path, run_key, artifact_status``; damaged text has
    status ``invalid`` and null fields. Older objects may lack fields, which are null too."""
    fields = StructType([*StructType.fromDDL(schema).fields, StructField("_corrupt", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = files.select(F.from_json("value", fields, options).alias("j"), "path")
    return parsed.select(
        "j.*", "path", run_key_of(F.col("path")).alias("run_key"),
        F.when(F.col("j").isNull() | F.col("j._corrupt").isNotNull(), "invalid").otherwise("present").alias("artifact_status"),
    ).drop("_corrupt")


def read_json_artifacts(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """``parse_json_artifacts`` of the files of a folder."""
    return parse_json_artifacts(text_files(spark, path, pattern), schema)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_json_artifacts(spark, path, LEDGER_SCHEMA).filter("artifact_status = 'present'")


def sent_keys(ledger: DataFrame) -> DataFrame:
    """All keys of a ledger, of the daily form or the older one-list form; none if unreadable."""
    daily = ledger.select(F.explode("history").alias("day", "keys")).select(F.explode("keys").alias("key"))
    old_list = F.coalesce("links", "repos")
    legacy = ledger.filter(F.col("history").isNull() & old_list.isNotNull()).select(F.explode(old_list).alias("key"))
    return daily.unionByName(legacy).distinct()


def ledger_rows(ledger: DataFrame, today: Column | None = None) -> DataFrame:
    """Ledger as ``(day, key)``; the older form goes to the day of its time stamp, or to ``today``."""
    daily = ledger.select(F.explode("history").alias("day", "keys")).select(
        F.to_date("day").alias("day"), F.explode("keys").alias("key")
    )
    old_list = F.coalesce("links", "repos")
    day = today if today is not None else F.try_to_date(F.substring("ts", 1, 10), "yyyy-MM-dd")
    legacy = ledger.filter(F.col("history").isNull() & old_list.isNotNull()).select(
        day.alias("day"), F.explode(old_list).alias("key")
    )
    return daily.unionByName(legacy).distinct()


def delivery_runs(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.explode("delivery_runs").alias("run_key", "r")).select("run_key", "r.*")


def write_partitions(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """Replace the partitions that ``df`` holds and leave the others; all or nothing per job."""
    df.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt).save(path)


def read_partitions(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def write_with_latest(df: DataFrame, path: str, key: str) -> None:
    """Runs as partitions below ``runs`` and a copy of the newest run of ``df`` in ``latest``."""
    write_partitions(df, f"{path}/runs", key)
    newest = df.agg(F.max(key).alias(key))
    df.join(newest, key, "left_semi").write.mode("overwrite").parquet(f"{path}/latest")


def recent_snapshots(snapshots: DataFrame, count: int = rules.RECENT_SNAPSHOTS, key: str = "run_key") -> DataFrame:
    """Rows of the newest runs."""
    newest = snapshots.filter(F.col(key) != "").select(key).distinct().orderBy(F.desc(key)).limit(count)
    return snapshots.join(newest, key, "left_semi")


def recent_reps(files: DataFrame, count: int = rules.RECENT_SNAPSHOTS) -> DataFrame:
    """Representatives of the newest readable snapshots of ``files(path, value)``, one row each with the run's date.

    Only real run files count, so other files take no place among the newest.
    """
    runs = parse_json_artifacts(files, SNAPSHOT_SCHEMA).filter(F.rlike("path", F.lit(r"/\d{4}-\d{2}-\d{2}-(?:AM|PM)\.json$")))
    newest = recent_snapshots(runs.filter("artifact_status = 'present'"), count)
    return newest.select("run_key", F.substring("run_key", 1, 10).alias("date"), F.explode("reps").alias("r")).select(
        "run_key", "date", "r.*"
    ).filter(F.coalesce("raw_title", F.lit("")) != "")


def read_recent_reps(spark: SparkSession, path: str, count: int = rules.RECENT_SNAPSHOTS) -> DataFrame:
    return recent_reps(text_files(spark, path), count)


def marked_titles(body: Column) -> Column:
    """Bold titles of a digest that begin with a mark."""
    return F.regexp_extract_all(body, F.lit(rf"(?m)^\*\*\s*((?:[{rules.TITLE_MARKS}][{rules.TITLE_MARKS}\s]*).+?)\*\*"), F.lit(1))


def archive_titles(files: DataFrame, count: int = 3) -> DataFrame:
    """Marked bold titles of the newest digests of ``files(path, value)``: ``run_key, pos, title``."""
    text = files.select(run_key_of(F.col("path")).alias("run_key"), F.col("value").alias("body"))
    return recent_snapshots(text, count).select("run_key", F.posexplode(marked_titles(F.col("body"))).alias("pos", "title"))


def read_archive_titles(spark: SparkSession, path: str, count: int = 3) -> DataFrame:
    """The same of a folder, oldest digest first."""
    return archive_titles(text_files(spark, path, "*.md"), count).orderBy("run_key", "pos")


def within_retention(df: DataFrame, as_of_day: Column, days: int, key: str = "run_key", inner: Column | None = None) -> DataFrame:
    """Runs not older than ``days``, by the day in their key; a key without a day is kept.

    With ``inner``, a text that begins with the artifact's own date, both days have to be too old; one that is no date does not save it.
    """
    first = F.date_sub(as_of_day, days)
    day = F.try_to_date(F.substring(key, 1, 10), "yyyy-MM-dd")
    fresh = day.isNull() | (day >= first)
    if inner is not None:
        fresh = fresh | F.coalesce(F.try_to_date(F.substring(inner, 1, 10), "yyyy-MM-dd") >= first, F.lit(False))
    return df.filter(fresh)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """A whole table under a version number; readers keep the old version until they change over."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if version is not None:
        return table.filter(F.col("version") == version).drop("version")
    newest = table.agg(F.max("version").alias("version"))
    return table.join(F.broadcast(newest), "version", "left_semi").drop("version")
