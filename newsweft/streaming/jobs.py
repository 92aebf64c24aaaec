"""The ledger and session rules as Structured Streaming jobs.

Sources are any streaming DataFrames with an event time. Rules that need exact order per key
or an upsert run per micro-batch with the batch operators, against a state table whose version
is named after the batch, so a repeated batch writes the same version again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from newsweft import rules
from newsweft.operators import events as EV
from newsweft.session import ensure_checkpoint_dir
from newsweft.streaming.state import HOUR, STORE, keyed, taken


def dedup_within(stream: DataFrame, ts: str, key: str, days: int = rules.SENT_RETENTION_DAYS) -> DataFrame:
    """Rows ``key, ts`` taken: those with no row of the same key taken within the ``days`` before.

    A refused row does not lengthen the memory. The state of a key is the time of its last taken row, so
    the result does not depend on how the stream is cut; it goes when no row in time can fall into it. A row later than
    the watermark, or not after its key's last taken one when it comes, is late and refused.
    """
    span = days * 24 * HOUR
    rows = stream.filter(F.col(ts).isNotNull())
    out = keyed(rows, key, ts, {}, taken(lambda last, when: when > last + span), f"{days} days", 24 * days)
    return out.select(key, F.timestamp_micros("number").cast(stream.schema[ts].dataType).alias(ts))


def session_counts(stream: DataFrame, ts: str, delay: str = "1 hour",
                   offset_hours: int = rules.LOCAL_OFFSET_HOURS) -> DataFrame:
    """Rows per half-day session; a session is emitted once when it is over."""
    start = (4 - offset_hours) % 12
    window = F.window(ts, "12 hours", "12 hours", f"{start} hours")
    return stream.withWatermark(ts, delay).groupBy(window).agg(F.count("*").alias("events")).select(
        F.col("window.start").alias("start"), "events"
    )


def usage_windows(stream: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Actions of seven days, every day."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, "7 days", "1 day"), *keys).agg(F.count("*").alias("count"))


def is_fresh(at: Column, now: Column, hours: Column | int = rules.WINDOW_HOURS) -> Column:
    """Whether a row's time is no more than ``hours`` before ``now``; a row without a time is kept, one of the future as well."""
    age = F.timestamp_diff("MICROSECOND", at, now)
    return F.coalesce(age <= F.lit(hours) * F.lit(3_600_000_000), F.lit(True))


def split_fresh(out: str, late: str, at: str, now: Callable[[], Column], hours: Column | int = rules.WINDOW_HOURS) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: fresh rows to ``out``, and to ``late`` how many rows were too old, with the oldest one's time.

    The test needs no state, so a row's verdict does not depend on others. Each batch writes its own folder, so one that is repeated
    writes the same again; the batch is read once and stored before it is split.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("fresh", is_fresh(F.col(at), now(), hours))
        judged.write.mode("overwrite").partitionBy("fresh").parquet(f"{out}/batch={batch_id}")
        again = batch.sparkSession.read.schema(judged.schema).parquet(f"{out}/batch={batch_id}")
        old = again.filter("not fresh").agg(F.count("*").alias("late"), F.min(at).alias("oldest"))
        old.write.mode("overwrite").parquet(f"{late}/batch={batch_id}")

    return run


class StateTable:
    """A table with one version per micro-batch below a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, empty: Callable[[], DataFrame]):
        self.spark, self.path, self.empty = spark, path, empty

    def _version(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id}"

    def before(self, batch_id: int) -> DataFrame:
        """State left by the batch before; empty for the first one."""
        schema = self.empty().schema
        if batch_id == 0:
            return self.empty()
        return self.spark.read.schema(schema).parquet(self._version(batch_id - 1))

    def write(self, batch_id: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._version(batch_id))
        return self.spark.read.schema(df.schema).parquet(self._version(batch_id))


def archive_batches(state: StateTable, day_of: Callable[[DataFrame], Column],
                    days: int = rules.ACTIVE_EVENT_DAYS) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: match the articles to the archive, upsert it, and drop what is long inactive."""
    def run(batch: DataFrame, batch_id: int) -> None:
        archive = state.before(batch_id)
        day = day_of(batch)
        matches = EV.match_events(batch, archive, day.cast("string"))
        state.write(batch_id, EV.active_events(EV.upsert_events(archive, batch, matches, day), day, days))

    return run


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in the store on disk; a running stream keeps the one it began with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all data there is into a table and read the table."""
    spark = stream.sparkSession
    base = work_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
    with state_store(spark):
        query = writer.trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_batches(stream: DataFrame, run: Callable[[DataFrame, int], None], base: str) -> None:
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()


def latest_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of a state table."""
    versioned = StructType([*schema.fields, StructField("batch", IntegerType())])
    table = spark.read.schema(versioned).parquet(path)
    last = table.agg(F.max("batch").alias("batch"))
    return table.join(F.broadcast(last), "batch", "left_semi").drop("batch")
