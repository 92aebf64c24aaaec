"""Local days, half-day sessions and the gate that keeps a session from running twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.session import durable


PIECES_PER_TASK = 512


def local_time(ts: Column, offset_hours: int = rules.LOCAL_OFFSET_HOURS) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(offset_hours))


def session_of(ts: Column, offset_hours: int = rules.LOCAL_OFFSET_HOURS) -> Column:
    """AM from 04:00 to 15:59 local time, else PM."""
    return F.when(F.hour(local_time(ts, offset_hours)).between(4, 15), "AM").otherwise("PM")


def logical_date(ts: Column, offset_hours: int = rules.LOCAL_OFFSET_HOURS) -> Column:
    """Local day; the hours before 04:00 belong to the day before."""
    return F.to_date(local_time(ts, offset_hours - 4))


def calendar_date(ts: Column, offset_hours: int = rules.LOCAL_OFFSET_HOURS) -> Column:
    return F.to_date(local_time(ts, offset_hours))


def iso_week(ts: Column) -> Column:
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"),
        F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
    )


def session_number(ts: Column, offset_hours: int = rules.LOCAL_OFFSET_HOURS) -> Column:
    """Running number of the half-day session; two times are in one session iff it is equal."""
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 04:00:00").cast("timestamp_ntz"),
                                    local_time(ts, offset_hours)) / F.lit(12 * 3600)).cast("long")


def should_skip(now: Column, last: Column, guard_hours: int = rules.GUARD_HOURS) -> Column:
    """Skip when the last delivery is closer than the guard or in the same session."""
    close = F.timestamp_diff("SECOND", last, now) < guard_hours * 3600
    return F.coalesce(close | (session_number(last) == session_number(now)), F.lit(False))


def _seconds_into_session(ts: Column, session: Column) -> Column:
    epoch = F.lit("1970-01-01 04:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, local_time(ts)) / F.lit(1e6) - session * 12 * 3600


def session_gate(triggers: DataFrame, key: str, ts: str = "ts", guard_hours: int = rules.GUARD_HOURS) -> DataFrame:
    """Run the gate over a log of triggers: ``key, session, ts`` of the accepted ones.

    Only accepted triggers count as deliveries. A session accepts its first trigger unless the
    one accepted in the session right before is so late that the guard reaches over. That cannot
    happen when the session before has a trigger between the guard and its last guard-long part,
    so such sessions cut the log of a key into independent pieces. Only pieces of more than one
    session are walked, on the few triggers that can matter.
    """
    guard = guard_hours * 3600
    log = triggers.select(key, F.col(ts).alias("ts")).withColumn("session", session_number(F.col("ts")))
    log = log.withColumn("into", _seconds_into_session(F.col("ts"), F.col("session")))
    # One row per key and session, stored because every part below starts from it.
    per_session = log.groupBy(key, "session").agg(
        F.min("ts").alias("first"),
        F.min(F.when(F.col("into") >= guard, F.col("ts"))).alias("late"),
        F.coalesce(F.bool_or((F.col("into") >= guard) & (F.col("into") <= 12 * 3600 - guard)), F.lit(False))
        .alias("settles"),
    )
    by_key = Window.partitionBy(key).orderBy("session")
    cut = (F.lag("session").over(by_key) == F.col("session") - 1) & ~F.lag("settles").over(by_key)
    per_session = per_session.withColumn("free", ~F.coalesce(cut, F.lit(False))).withColumn(
        "piece", F.sum(F.col("free").cast("int")).over(by_key)
    )
    lengths = Window.partitionBy(key, "piece")
    per_session = per_session.withColumn("length", F.count("*").over(lengths)).withColumn(
        # Pieces are independent, so any run of whole pieces may be walked together.
        "piece", F.floor(F.col("piece") / PIECES_PER_TASK)
    )
    per_session = durable(per_session)
    simple = per_session.filter("length = 1").select(key, "session", F.col("first").alias("ts"))
    chained = per_session.filter("length > 1")
    early = log.filter(F.col("into") < guard).join(
        chained.filter("not free").select(key, "session", "piece"), [key, "session"]
    ).select(key, "piece", "session", "ts").distinct()
    cands = (
        early.unionByName(chained.filter("free").select(key, "piece", "session", F.col("first").alias("ts")))
        .unionByName(chained.filter("not free and late is not null").select(key, "piece", "session", F.col("late").alias("ts")))
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by key, piece and time; what a piece has accepted carries over batches.
        place, last, last_session = None, 0, -1
        for rows in batches:
            keep = []
            micros = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            sessions = rows["session"].tolist()
            for i, here in enumerate(zip(rows[key].tolist(), rows["piece"].tolist())):
                session = sessions[i]
                if here == place and (session == last_session or micros[i] - last < guard * 1_000_000):
                    continue
                keep.append(i)
                place, last, last_session = here, micros[i], session
            yield rows.iloc[keep][[key, "session", "ts"]]

    schema = f"{key} {triggers.schema[key].dataType.simpleString()}, session long, ts timestamp_ntz"
    sorted_pieces = cands.repartition(key, "piece").sortWithinPartitions(key, "piece", "ts")
    return simple.unionByName(sorted_pieces.mapInPandas(walk, schema))
