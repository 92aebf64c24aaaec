"""Rules that remember something of each key, with the engine's state and timers.

Keys are dealt into buckets by their hash, and a call sees the rows of a bucket in a micro-batch and the few values that are kept of
its keys, so the cost of a call is shared by all of them. Values go by event time, once the watermark says that no row in time can
need them. The state is kept by the store below the stream's checkpoint, so an executor that is lost takes nothing with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsweft import rules

#: The store that holds large state on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000
#: Buckets of a stream's keys. A checkpoint holds its state by them, so a stream keeps the number it began with.
BUCKETS = 1024
#: Rows of a bucket that are held before repeated ones are left out.
HELD = 100_000

#: What is kept of each key: the time in microseconds its memory counts from, and a text.
Known = dict[str | None, tuple[int, str | None]]
#: Told rows of key, number and text, from a bucket's rows in order; what is kept is changed in place. A repeated row tells nothing.
Rule = Callable[[Iterator[tuple], Known], list[tuple]]


def in_order(parts: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """A bucket's rows by the columns after the key, the time first; of many rows, repeated ones are held once."""
    held, most = [], HELD
    for part in parts:
        held.append(part[columns])
        if sum(map(len, held)) > most:
            held = [pd.concat(held).drop_duplicates()]
            most = max(HELD, 2 * len(held[0]))
    one = held[0] if len(held) == 1 else pd.concat(held)
    return one.sort_values(columns[1:], kind="stable")


def keyed(stream: DataFrame, key: str, at: str, others: dict[str, Column], rule: Rule, delay: str, memory_hours: int,
          buckets: int = BUCKETS) -> DataFrame:
    """``key, number, note`` as the rule tells them; a key's value is dropped ``memory_hours`` of event time after its time.

    Keys travel as text and come back in their type; null is a key with a bucket of its own.
    """
    kind, memory = stream.schema[key].dataType, memory_hours * 3_600_000
    columns = ["_key", "_time", *others]

    def update(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: Known = {k: (seen, note) for k, seen, note in zip(*state.get)} if state.exists else {}
        told = []
        if not state.hasTimedOut:
            rows = in_order(parts, columns)
            told = rule(zip(*[rows[c].tolist() for c in columns]), known)
        watermark = state.getCurrentWatermarkMs()
        left = {k: v for k, v in known.items() if v[0] // 1000 + memory >= watermark}
        if left:
            state.update((list(left), [seen for seen, _ in left.values()], [note for _, note in left.values()]))
            state.setTimeoutTimestamp(min(seen for seen, _ in left.values()) // 1000 + memory)
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["_key", "number", "note"], dtype=object)

    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    # The event time itself comes along, for Spark leaves late rows out by it.
    rows = stream.withWatermark(at, delay).select(
        bucket.alias("_bucket"), F.col(key).cast("string").alias("_key"), F.coalesce(F.unix_micros(at), F.lit(0)).alias("_time"), at,
        *[c.alias(name) for name, c in others.items()],
    )
    out = rows.groupBy("_bucket").applyInPandasWithState(
        update, "_key string, number long, note string", "keys array<string>, seen array<bigint>, notes array<string>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return out.select(F.col("_key").cast(kind).alias(key), "number", "note")


def taken(accept: Callable[[int, int], bool]) -> Rule:
    """Tells each row that is the first of its key or accepted after the key's last one told."""
    def rule(rows: Iterator[tuple], known: Known) -> list[tuple]:
        told = []
        for key, when in rows:
            if key not in known or accept(known[key][0], when):
                told.append((key, when, None))
                known[key] = (when, None)
        return told

    return rule


def changes(rows: Iterator[tuple], known: Known) -> list[tuple]:
    """Tells each row whose signature differs from the one before; rows not after the last one seen are late and ignored."""
    told = []
    for key, when, signature in rows:
        seen, last = known.get(key, (None, ""))
        if seen is None or when > seen:
            if signature != last:
                told.append((key, when, signature))
            known[key] = (when, signature)
    return told


def closed(rows: Iterator[tuple], known: Known) -> list[tuple]:
    """A run is closed by the first micro-batch that brings it: delivered if any of its rows counts something, else empty."""
    new: dict[str | None, tuple[int, int]] = {}
    for key, when, count in rows:
        if key not in known:
            last, best = new.get(key, (0, 0))
            new[key] = (max(when, last), max(count, best))
    status = {key: "delivered" if best else "empty" for key, (_, best) in new.items()}
    known |= {key: (last, status[key]) for key, (last, _) in new.items()}
    return [(key, best, status[key]) for key, (_, best) in new.items()]


def session_gate(stream: DataFrame, key: str, at: str, delay: str = "1 hour", guard_hours: int = rules.GUARD_HOURS,
                 offset_hours: int = rules.LOCAL_OFFSET_HOURS) -> DataFrame:
    """``key, at`` of the accepted triggers; what the batch gate gives for triggers that come in time.

    A trigger is accepted unless it is within the guard after the last accepted one or in the same half-day session. Triggers not
    after the last accepted one are late and refused. A day after it, the last one can refuse nothing in time.
    """
    guard, shift = guard_hours * HOUR, (offset_hours - 4) * HOUR

    def accept(last: int, when: int) -> bool:
        return when - last >= guard and (when + shift) // (12 * HOUR) != (last + shift) // (12 * HOUR)

    out = keyed(stream.filter(F.col(at).isNotNull()), key, at, {}, taken(accept), delay, 24 + guard_hours)
    return out.select(key, F.timestamp_micros("number").alias(at))


def issue_alerts(stream: DataFrame, key: str, at: str, signature: str, delay: str = "1 day", memory_days: int = rules.REPO_RETENTION_DAYS) -> DataFrame:
    """``key, at, signature`` whenever the signature of a key differs from the one before.

    A key that is silent for ``memory_days`` is forgotten and starts anew.
    """
    rows = stream.filter(F.col(at).isNotNull())
    out = keyed(rows, key, at, {"_signature": F.col(signature)}, changes, delay, 24 * memory_days)
    return out.select(key, F.timestamp_micros("number").alias(at), F.col("note").alias(signature))


def deliver_once(stream: DataFrame, at: str, delay: str = "1 day", memory_days: int = 365) -> DataFrame:
    """``run_id, status, count`` of each run once, of ``stream(run_id, count, <at>)``; later rows of a closed run give nothing, until
    it is forgotten ``memory_days`` of event time after it was closed."""
    count = F.coalesce(F.col("count").cast("long"), F.lit(0))
    out = keyed(stream, "run_id", at, {"_count": count}, closed, delay, 24 * memory_days)
    return out.select("run_id", F.col("note").alias("status"), F.col("number").alias("count"))
