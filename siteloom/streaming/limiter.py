"""A sliding-log rate limiter over a stream of requests.

A request is allowed if fewer than max_requests allowed ones of its key lie within the window
before it; refused requests leave no trace, so a count over all requests would be wrong. The
state of a key is the list of its allowed times in the window, never more than max_requests.

What comes first decides, so the requests of one key are judged one after another in one task; of a
key that holds a third of all requests, that task reads a third. limit_stream() judges in the order
of arrival, batch by batch. limit_ordered() judges in the order of time, whatever the batches."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_REQUESTS, WINDOW_MS = 10, 600_000
COLUMNS = ["key", "request_id", "at_ms", "allowed", "remaining", "reset_ms"]
OUT = "key string, request_id long, at_ms long, allowed boolean, remaining int, reset_ms long"
STATE = "times array<long>"
WAITING = "times array<long>, waiting array<struct<at_ms:long,request_id:long>>"
BUCKET = "keys array<string>, n_times array<int>, times array<long>, n_waiting array<int>, at_ms array<long>, request_id array<long>"
#: Keys of a bucket: many more than a call is worth, and few enough for one state.
KEYS_IN_BUCKET = 256


def decide(times: list[int], at: int, limit: int, window: int) -> tuple[bool, int, int, list[int]]:
    """(allowed, remaining, ms until a place is free, the times that stay)."""
    kept = [t for t in times if t > at - window]
    if len(kept) >= limit:
        return False, 0, kept[0] + window - at, kept
    kept.append(at)
    return True, limit - len(kept), window, kept


def _judge(key: str, frame: pd.DataFrame, times: list[int], limit: int, window: int) -> tuple[pd.DataFrame, list[int]]:
    rows = []
    for at, ident in sorted(zip(frame["at_ms"].tolist(), frame["request_id"].tolist())):
        allowed, left, reset, times = decide(times, at, limit, window)
        rows.append((key, ident, at, allowed, left, reset))
    return pd.DataFrame(rows, columns=COLUMNS), times


def requests(events: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias("request_id"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"))


def limit_stream(stream: DataFrame, max_requests: int = MAX_REQUESTS, window_ms: int = WINDOW_MS, expire_idle: bool = True) -> DataFrame:
    """Decisions over a streaming DataFrame of requests(). Keys idle for a window lose their
    state (processing time); a trigger that ends when the input does needs expire_idle=False."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames))
        out, times = _judge(key[0], frame, times, max_requests, window_ms)
        state.update((times,))
        if expire_idle:
            state.setTimeoutDuration(max(window_ms, 1000))
        yield out

    return stream.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire_idle else GroupStateTimeout.NoTimeout)


def _turn(times: list[int], waiting: list[tuple[int, int]], now: int, limit: int, window: int) -> tuple[list[tuple], list[int], list[tuple[int, int]], int]:
    """Judges what waits before now: (decisions, times, what still waits, when to look again; that is
    not behind now once the key may be forgotten)."""
    waiting.sort()
    ready = bisect_left(waiting, (now,))
    rows = []
    for at, ident in waiting[:ready]:
        allowed, left, reset, times = decide(times, at, limit, window)
        rows.append((ident, at, allowed, left, reset))
    waiting = waiting[ready:]
    return rows, times, waiting, waiting[0][0] if waiting else times[-1] + window if times else 0


def limit_ordered(stream: DataFrame, max_requests: int = MAX_REQUESTS, window_ms: int = WINDOW_MS, late_ms: int = 60_000, buckets: int | None = None) -> DataFrame:
    """Decisions over a streaming DataFrame of requests() in the order of their times. A request
    waits in its key's state until the watermark, late_ms behind the newest request, is past it,
    and is then judged, so batches may come in any order within late_ms. Requests at or before the
    watermark when they come are late: they are left out, and Spark counts them
    (numRowsDroppedByWatermark). A key's state goes when nothing waits and the watermark is past
    the window of its last allowed request. What lies within late_ms of the newest request is told
    once later ones have come.

    Spark hands over each state by itself, which takes milliseconds. For many keys with few requests
    in a batch, buckets deals the keys to so many states, which hold all that their keys hold
    (see buckets_for()); it stays the same for all runs of a stream."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, waiting = state.get if state.exists else ([], [])
        times, waiting = list(times or ()), [tuple(w) for w in waiting or ()]
        for frame in frames:
            waiting.extend(zip(frame["at_ms"].tolist(), frame["request_id"].tolist()))
        now = state.getCurrentWatermarkMs()
        rows, times, waiting, wake = _turn(times, waiting, now, max_requests, window_ms)
        if waiting or wake > now:
            state.update((times, waiting))
            state.setTimeoutTimestamp(max(wake, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *row) for row in rows], columns=COLUMNS)

    def step_bucket(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(*state.get) if state.exists else {}
        for frame in frames:
            for key, at, ident in zip(frame["key"].tolist(), frame["at_ms"].tolist(), frame["request_id"].tolist()):
                if key not in held:
                    held[key] = [], []
                held[key][1].append((at, ident))
        now, wakes, rows = state.getCurrentWatermarkMs(), [], []
        for key, (times, waiting) in list(held.items()):
            told, times, waiting, wake = _turn(times, waiting, now, max_requests, window_ms)
            rows += [(key, *row) for row in told]
            if waiting or wake > now:
                held[key] = times, waiting
                wakes.append(wake)
            else:
                del held[key]
        if held:
            state.update(_packed(held))
            state.setTimeoutTimestamp(max(min(wakes), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=COLUMNS)

    timed = stream.withColumn("_time", F.timestamp_millis("at_ms")).withWatermark("_time", f"{late_ms} milliseconds")
    if buckets is None:
        return timed.groupBy("key").applyInPandasWithState(step, OUT, WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step_bucket, OUT, BUCKET, "append", GroupStateTimeout.EventTimeTimeout)


def buckets_for(stored: DataFrame) -> int:
    """A number of buckets for as many keys as these requests have, with about KEYS_IN_BUCKET each;
    for few keys, enough for all cores."""
    keys = stored.agg(F.approx_count_distinct("key")).first()[0]
    return max(keys // KEYS_IN_BUCKET, 4 * stored.sparkSession.sparkContext.defaultParallelism)


def _packed(held: dict) -> tuple:
    """A bucket's state as BUCKET: lists of plain values, which Spark passes on as they are."""
    each = held.values()
    waiting = [w for _, ws in each for w in ws]
    return list(held), [len(ts) for ts, _ in each], [t for ts, _ in each for t in ts], [len(ws) for _, ws in each], [at for at, _ in waiting], [ident for _, ident in waiting]


def _unpacked(keys, n_times, times, n_waiting, at_ms, request_id) -> dict:
    times, waiting = iter(times), iter(zip(at_ms, request_id))
    return {key: (list(islice(times, n)), list(islice(waiting, m))) for key, n, m in zip(keys, n_times, n_waiting)}


def limit_batch(stored: DataFrame, max_requests: int = MAX_REQUESTS, window_ms: int = WINDOW_MS) -> DataFrame:
    """The same decisions over stored requests: rows come sorted by key and time, so only the
    state of one key is held, however many requests it has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, times = None, []
        for frame in frames:
            rows = []
            for key, ident, at in zip(frame["key"].tolist(), frame["request_id"].tolist(), frame["at_ms"].tolist()):
                if key != now:
                    now, times = key, []
                allowed, left, reset, times = decide(times, at, max_requests, window_ms)
                rows.append((key, ident, at, allowed, left, reset))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return stored.repartition("key").sortWithinPartitions("key", "at_ms", "request_id").mapInPandas(run, OUT)


def expire(log: DataFrame, now_ms: int, keep_ms: int = 3_600_000) -> DataFrame:
    """Log entries that are not older than keep_ms."""
    return log.where(F.col("at_ms") >= now_ms - keep_ms)


def run_due(spark, schedules: DataFrame, now, write) -> None:
    """One hourly turn: hands due schedules with their next run times to write()."""
    from siteloom.functions.labels import next_run
    from siteloom.operators.history import due

    ready = due(schedules, now)
    write(ready.withColumn("next_run_at", next_run(F.col("frequency"), now)))
