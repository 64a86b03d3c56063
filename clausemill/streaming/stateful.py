"""Keyed state in Structured Streaming, with batch forms of the same state machines."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALLOWED = "user_id long, event_id long, allowed boolean, wait_seconds double"
BREAKER = "user_id long, event_id long, state string, passed boolean"
CACHE = "user_id long, event_id long, hit boolean, accesses long, age_seconds double"


class AllowanceWindow:
    """Allows an event while fewer than ``limit`` were allowed in the last ``window`` seconds;
    only allowed ones count."""

    def __init__(self, limit: int, window: float, times: Iterable[float] = ()):
        self.limit, self.window, self.times = limit, window, deque(times)

    def offer(self, at: float) -> tuple[bool, float]:
        while self.times and self.times[0] <= at - self.window:
            self.times.popleft()
        if len(self.times) < self.limit:
            self.times.append(at)
            return True, 0.0
        return False, self.window - (at - self.times[0])


class FailureGate:
    """closed: passes all, opens at ``threshold`` failures. open: passes none until ``timeout``
    seconds after the last failure. Then half_open: one success closes it, a failure reopens."""

    def __init__(self, threshold: int, timeout: float, state: str = "closed", failures: int = 0, last: float = 0.0):
        self.threshold, self.timeout, self.state, self.failures, self.last = threshold, timeout, state, failures, last

    def offer(self, at: float, failed: bool) -> tuple[str, bool]:
        if self.state == "open":
            if at - self.last < self.timeout:
                return self.state, False
            self.state = "half_open"
        if failed:
            self.failures += 1
            self.last = at
            if self.state == "half_open" or self.failures >= self.threshold:
                self.state = "open"
        elif self.state == "half_open":
            self.state, self.failures = "closed", 0
        return self.state, True


class CacheEntry:
    """A cached value: a read within ``ttl`` seconds of its making is a hit and counts; a later one
    finds it expired and makes it anew. Hits don't make it younger."""

    def __init__(self, ttl: float, created: float | None = None, accesses: int = 0):
        self.ttl, self.created, self.accesses = ttl, created, accesses

    def offer(self, at: float) -> tuple[bool, int, float]:
        """Hit or not, the hits of this entry so far, and its age."""
        if self.created is not None and at - self.created < self.ttl:
            self.accesses += 1
            return True, self.accesses, at - self.created
        self.created, self.accesses = at, 0
        return False, 0, 0.0


def _seconds(ts: pd.Series) -> pd.Series:
    return (ts.astype("datetime64[us]") - pd.Timestamp(0)) / pd.Timedelta(seconds=1)


def _broken(key, rows: pd.DataFrame, breaker: FailureGate) -> pd.DataFrame:
    rows = rows.sort_values(["ts", "event_id"])
    got = [breaker.offer(t, e == "error") for t, e in zip(_seconds(rows["ts"]), rows["event_type"])]
    return pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "state": [g[0] for g in got], "passed": [g[1] for g in got]})


def _by_user(events: DataFrame, offer, fresh, schema: str) -> DataFrame:
    """A state machine over each user's events in order. Spark sorts the rows; tasks go through
    them batch by batch and keep the present user's machine alone, so a user with any share of
    the rows needs no more memory. Null users are one user; null times come first, as time 0."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, machine = object(), None
        for f in frames:
            out = []
            times = _seconds(f["ts"]).fillna(0.0)
            for u, e, t, kind in zip(f["user_id"], f["event_id"], times, f["event_type"]):
                u = None if pd.isna(u) else u
                if machine is None or u != user:
                    user, machine = u, fresh()
                out.append((u, e, *offer(machine, t, kind)))
            yield pd.DataFrame(out, columns=names).astype({"user_id": "Int64", "event_id": "Int64"})

    rows = events.select("user_id", "event_id", "ts", "event_type")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, schema)


def rate_limit_batch(events: DataFrame, limit: int, window: float) -> DataFrame:
    """The limiter over a finished table."""
    return _by_user(events, lambda m, t, kind: m.offer(t), lambda: AllowanceWindow(limit, window), ALLOWED)


def circuit_breaker_batch(events: DataFrame, threshold: int, timeout: float) -> DataFrame:
    """The breaker over a finished table; events of type error are failures."""
    return _by_user(events, lambda m, t, kind: m.offer(t, kind == "error"), lambda: FailureGate(threshold, timeout), BREAKER)


def cache_batch(events: DataFrame, ttl: float) -> DataFrame:
    """Reads of a cache keyed by user over a finished table, in order of time."""
    return _by_user(events, lambda m, t, kind: m.offer(t), lambda: CacheEntry(ttl), CACHE)


class _CacheReads(StatefulProcessor):
    """One entry for each key; a timer at the end of its life removes it when the watermark gets
    there, which changes no result, since every later read would find it expired."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created double, accesses long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.entry.get()
        entry, timer = (CacheEntry(self.ttl, kept[0], kept[1]), kept[2]) if kept is not None else (CacheEntry(self.ttl), None)
        reads = sorted(r for f in rows for r in zip(_seconds(f["ts"]).tolist(), f["event_id"].tolist()))
        got = [(key[0], e, *entry.offer(t)) for t, e in reads]
        ends = int((entry.created + self.ttl) * 1000) + 1
        if timer != ends:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.entry.update((entry.created, entry.accesses, ends))
        yield pd.DataFrame(got, columns=[c.split()[0] for c in CACHE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield pd.DataFrame({c.split()[0]: [] for c in CACHE.split(", ")}).astype({"user_id": "int64", "event_id": "int64", "hit": "bool", "accesses": "int64", "age_seconds": "float64"})

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, ttl: float, late: str = "10 minutes") -> DataFrame:
    """The same reads as a stream. State holds one entry a key and falls as entries expire; rows
    later than ``late`` are dropped. Needs the RocksDB state store."""
    rows = events.select("user_id", "event_id", "ts").filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_CacheReads(ttl), CACHE, "Append", "eventTime")


def rate_limit_stream(events: DataFrame, limit: int, window: float, late: str = "10 minutes") -> DataFrame:
    """The limiter over a stream; its state is the times of at most ``limit`` allowed events and goes
    once the watermark has passed the last of them by ``window``, when none counts any more. Rows
    later than ``late`` are dropped."""
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = AllowanceWindow(limit, window, state.get[0] if state.exists else ())
        reads = sorted(r for f in frames for r in zip(_seconds(f["ts"]).tolist(), f["event_id"].tolist()))
        got = [(key[0], e, *limiter.offer(t)) for t, e in reads]
        state.update((list(limiter.times),))
        ends = int(((limiter.times[-1] if limiter.times else reads[-1][0]) + window) * 1000) + 1
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(got, columns=[c.split()[0] for c in ALLOWED.split(", ")])

    rows = events.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(run, ALLOWED, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def circuit_breaker_stream(events: DataFrame, threshold: int, timeout: float) -> DataFrame:
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = FailureGate(threshold, timeout, *(state.get if state.exists else ()))
        out = _broken(key, pd.concat(list(frames)), breaker)
        state.update((breaker.state, breaker.failures, breaker.last))
        yield out

    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(run, BREAKER, "state string, failures long, last double", "append", GroupStateTimeout.NoTimeout)


def usage_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by hour and type; events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def distinct_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
