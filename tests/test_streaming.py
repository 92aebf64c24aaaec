"""Streams cut into many micro-batches give what one batch gives."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsweft.operators import sessions
from newsweft.plans.registry import table
from newsweft.streaming import jobs as J
from newsweft.streaming import state as K


@pytest.fixture(scope="module")
def daily(spark, sf_dir, tmp_path_factory):
    """The event table as one file per day, in time order."""
    folder = tmp_path_factory.mktemp("events")
    events = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    for day in sorted(r.day for r in events.select("day").distinct().collect())[:8]:
        events.filter(F.col("day") == day).drop("day").coalesce(1).write.mode("append").parquet(str(folder / "t"))
    return str(folder / "t")


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def test_sessions(spark, daily):
    got = {(r.start, r.events) for r in J.drain(J.session_counts(stream(spark, daily), "at")).collect()}
    batch = spark.read.parquet(daily).withColumn("at", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.window("at", "12 hours", "12 hours", "8 hours")).count().select("window.start", "count").collect()
    last = max(r.start for r in want)
    assert got == {(r.start, r["count"]) for r in want if r.start < last}


MEMORY_CASES = ((1, "a"), (3, "a"), (8, "a"), (9, "a"), (9, "b"), (17, "x"), (17, "a"), (20, "a"), (25, "a"), (25, "a"))


@pytest.mark.parametrize("days_a_file", [1, 31])
def test_link_memory_does_not_depend_on_the_cut(spark, tmp_path, days_a_file):
    """Taken on days 1, 9 and 17: day 8 is still within seven days of day 1; a refused row does not lengthen the memory."""
    schema = "at timestamp, link string"
    files = {}
    for day, link in MEMORY_CASES:
        files.setdefault(day // days_a_file, []).append((datetime(2026, 1, day), link))
    for _, rows in sorted(files.items()):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.link, r["at"].day) for r in J.drain(J.dedup_within(source, "at", "link")).collect())
    assert got == [("a", 1), ("a", 9), ("a", 17), ("a", 25), ("b", 9), ("x", 17)]


def test_gate(spark, daily):
    got = {(r.user_id, r["at"]) for r in J.drain(K.session_gate(stream(spark, daily), "user_id", "at")).collect()}
    want = sessions.session_gate(spark.read.parquet(daily).select("user_id", "ts"), "user_id")
    assert got == {(r.user_id, r.ts) for r in want.collect()}


def test_alerts(spark, daily):
    source = stream(spark, daily).select("user_id", "at", F.col("event_type").alias("signature"))
    got = {(r.user_id, r["at"], r.signature) for r in J.drain(K.issue_alerts(source, "user_id", "at", "signature")).collect()}
    want, last = set(), {}
    for r in spark.read.parquet(daily).orderBy("ts").collect():
        if last.get(r.user_id) != r.event_type:
            want.add((r.user_id, r.ts, r.event_type))
        last[r.user_id] = r.event_type
    assert got == want


def test_state_of_silent_keys_goes(spark, tmp_path):
    """Key a is told again after its memory; b comes often and its change is told once."""
    schema = "at timestamp, k string, sig string"
    for day in range(1, 16):
        rows = [(datetime(2026, 1, day, 1), "b", "same")] + [(datetime(2026, 1, day, 2), "a", "same")] * (day in (1, 14))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = J.drain(K.issue_alerts(source, "k", "at", "sig", delay="1 hour", memory_days=3))
    assert sorted((r.k, r["at"].day) for r in out.collect()) == [("a", 1), ("a", 14), ("b", 1)]


def test_deliveries(spark, daily):
    source = stream(spark, daily).select(F.col("user_id").alias("run_id"), (F.col("event_id") % 2).alias("count"), "at")
    out = J.drain(K.deliver_once(source, "at")).collect()
    first = {}
    for r in spark.read.parquet(daily).select("user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 2).alias("count")).collect():
        day, n = first.get(r.user_id, (r.day, 0))
        first[r.user_id] = (min(day, r.day), max(n, r["count"]) if day == r.day else n if day < r.day else r["count"])
    assert {r.run_id: r.status for r in out} == {u: "delivered" if n else "empty" for u, (_, n) in first.items()}
    assert len(out) == len(first)


@pytest.mark.parametrize("files", [1, 5])
def test_fresh(spark, tmp_path, files):
    rows = [(i, datetime(2026, 1, 1 + i % 10) if i % 4 else None) for i in range(40)]
    spark.createDataFrame(rows, "id long, at timestamp_ntz").repartition(files).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    now = lambda: F.lit("2026-01-09 00:00:00").cast("timestamp_ntz")
    base = str(tmp_path)
    J.drain_batches(source, J.split_fresh(f"{base}/out", f"{base}/late", "at", now, 48), base)
    keep = {i for i, t in rows if t is None or t >= datetime(2026, 1, 7)}
    assert {r.id for r in spark.read.parquet(f"{base}/out").filter(F.col("fresh").cast("boolean")).collect()} == keep
    late = spark.read.parquet(f"{base}/late").collect()
    assert sum(r.late for r in late) == 40 - len(keep)
    assert min(r.oldest for r in late if r.oldest) == min(t for i, t in rows if t and i not in keep)


@pytest.mark.parametrize("rule", ["memory", "alerts"])
def test_many_keys_share_calls_and_state(spark, tmp_path, rule):
    """Keys share the rows of the state; large keys and null ones stay apart, whatever the micro-batches, and repeated rows tell nothing."""
    keys = [*range(K.BUCKETS), 2**53, 2**53 + 1, None]
    for day in (1, 3, 9):
        rows = [(datetime(2026, 1, day), k, None if day == 3 else "s") for k in keys] * 2
        spark.createDataFrame(rows, "at timestamp, k long, sig string").coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("at timestamp, k long, sig string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = J.dedup_within(source, "at", "k") if rule == "memory" else K.issue_alerts(source, "k", "at", "sig")
    with J.state_store(spark):
        stream = out.writeStream.option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True)
        query = stream.format("parquet").start()
    query.awaitTermination()
    assert 0 < max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) <= K.BUCKETS + 1
    got = sorted(((r.k is None, r.k or 0, r["at"].day, r.sig if rule == "alerts" else "") for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    told = [(1, ""), (9, "")] if rule == "memory" else [(1, "s"), (3, None), (9, "s")]
    assert got == sorted(((k is None, k or 0, day, sig) for k in keys for day, sig in told), key=repr)
