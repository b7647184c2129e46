"""Structured Streaming forms of the job log: tailing, heartbeats, failures and daily spending. Additions to the batch forms, which stay the reference."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.functions.text import log_level


def tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New rows of a folder of JSON lines, each with its level; the checkpoint of the query that writes them holds the place."""
    return spark.readStream.schema(schema).json(path).withColumn("level", log_level("message"))


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has come since the last call and stops: for a scheduler's jobs."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def quiet_jobs(heartbeats: DataFrame, job: str = "job", ts: str = "ts", minutes: int = 5) -> DataFrame:
    """Stretches of a job's heartbeats that ended in silence of so many minutes."""
    w = F.session_window(ts, f"{minutes} minutes")
    return heartbeats.withWatermark(ts, f"{minutes} minutes").groupBy(job, w).agg(F.count(F.lit(1)).alias("beats")).select(job, F.col("session_window.start").alias("first_beat"), F.col("session_window.end").alias("silent_at"), "beats")


def failure_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", failed: str = "error", minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Failures in each window of time; rows later than the watermark are left out."""
    return events.where(F.col(kind) == failed).withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("failures")).select(F.col("w.start").alias("start"), "failures")


def daily_spend(calls: DataFrame, ts: str = "ts", cost: str = "cost", late: str = "1 day") -> DataFrame:
    """Spending by day."""
    return calls.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.sum(cost).alias("spent")).select(F.to_date("w.start").alias("day"), "spent")


def unique_events(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def breaker(events: DataFrame, key: str, ts: str = "ts", kind: str = "event_type", failed: str = "error", seconds: int = 60, threshold: int = 8, cool_down: int = 120, late: str = "10 minutes") -> DataFrame:
    """Rows (key, opened_at, open_until): a key had threshold failures within seconds. While it is open, failures do not count.

    State is at most threshold times of failures and one time for each key; it goes an hour of event time after its last row.
    """

    def run(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for t in sorted(int(x.value // 1000) for b in batches for x in b[ts]):
            if t < until:
                continue
            times = [x for x in times if x > t - seconds * 1_000_000][-(threshold - 1) :] + [t]
            if len(times) >= threshold:
                until, times = t + cool_down * 1_000_000, []
                out.append((k[0], pd.Timestamp(t, unit="us"), pd.Timestamp(until, unit="us")))
        state.update((times, until))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), max([*times, until]) // 1000) + 3_600_000)
        if out:
            yield pd.DataFrame(out, columns=[key, "opened_at", "open_until"])

    kept = events.where(F.col(kind) == failed).select(key, ts).withWatermark(ts, late)
    kind_of = dict(events.dtypes)[key]
    return kept.groupBy(key).applyInPandasWithState(run, f"{key} {kind_of}, opened_at timestamp, open_until timestamp", "times array<long>, until long", "append", GroupStateTimeout.EventTimeTimeout)


class _Cache(StatefulProcessor):
    """A key's value with the time that it expires at; a timer takes it out of the state when the watermark has passed that."""

    def __init__(self, minutes: int) -> None:
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "value string, expires_at timestamp")

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        value, until = self.held.get() if self.held.exists() else (None, None)
        out, before = [], until
        for ts, found in sorted((x.ts, x.value) for b in rows for x in b.itertuples()):
            hit = until is not None and until > ts
            if not hit:
                # What is empty is not kept: the next one asks again.
                value, until = (found, ts + pd.Timedelta(minutes=self.minutes)) if found else (None, None)
            out.append((key[0], ts, hit, value if hit else found))
        if until != before:
            if before is not None:
                self.handle.deleteTimer(int(pd.Timestamp(before, tz="UTC").value // 1_000_000))
            if until is None:
                self.held.clear()
            else:
                self.held.update((value, until))
                self.handle.registerTimer(int(pd.Timestamp(until, tz="UTC").value // 1_000_000))
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "ts": pd.Series([], dtype="datetime64[us]"), "hit": pd.Series([], dtype="bool"), "value": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def cached_reads(reads: DataFrame, key: str, value: str, ts: str = "ts", minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Rows (key, ts, hit, value): whether a read finds its key's value, kept for so many minutes after the read that fetched it; a read that does not keeps its own.

    Empty values are not kept. A kept value leaves the state when the watermark passes its end, so state holds the keys of that time only. The session needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass); rows later than the watermark are left out.
    """
    rows = reads.select(F.col(key).cast("string").alias("key"), F.coalesce(F.nullif(F.col(value).cast("string"), F.lit("")), F.lit("")).alias("value"), F.col(ts).alias("ts"))
    grouped = rows.withWatermark("ts", late).groupBy("key")
    return grouped.transformWithStateInPandas(_Cache(minutes), "key string, ts timestamp, hit boolean, value string", "Append", "EventTime")
