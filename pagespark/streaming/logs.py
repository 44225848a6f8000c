"""Streaming forms of the log operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.skew import topk_per_key
from ..operators.calls import redact_args
from ..operators.state import COOKIE, COOKIE_REST, STORE, cookie_changes
from .keyed import OncePerKey, latest_entries, use_state_store
from .runs import fold_batches


def stream_ring(log: DataFrame, n: int, key: str = "profile", name: str = "ring", home: str | None = None) -> DataFrame:
    """Last ``n`` rows per key of a stream.

    Each micro-batch is cut to ``n`` rows per key with the salted top-k and merged with the
    rows kept so far, so the state holds ``n`` rows per key and a busy key is split up. With a ``home`` it goes on from there.
    """

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if old is None else old.unionByName(batch)
        return topk_per_key(rows, [key], [F.col("seq").desc()], n, salt_on=["seq"])

    kept = fold_batches(log, name, merge, home)
    return kept.withColumn("total", F.count("*").over(Window.partitionBy(key)))


def stream_pairs(
    starts: DataFrame, ends: DataFrame, delay: str = "10 minutes", longest: str = "10 minutes"
) -> DataFrame:
    """Finished requests joined to their starts (req_id; event-time column ``at``).

    Starts may precede their end by at most ``longest``. Ends without a start come out with
    a null duration once the watermark has passed them.
    """
    s = starts.select("req_id", F.col("at").alias("start_at"), F.col("ts_ms").alias("start_ms")).withWatermark("start_at", delay)
    e = ends.withWatermark("at", delay)
    both = e.alias("e").join(
        s.alias("s"),
        (F.col("e.req_id") == F.col("s.req_id"))
        & (F.col("s.start_at") <= F.col("e.at"))
        & (F.col("s.start_at") >= F.col("e.at") - F.expr(f"INTERVAL {longest}")),
        "left_outer",
    )
    timing = F.col("timing_ms")
    return both.select(
        "e.req_id", "profile", "tab_id", F.coalesce("start_ms", "e.ts_ms").alias("ts_ms"),
        F.when(timing >= 0, F.floor(timing + 0.5)).otherwise(F.col("e.ts_ms") - F.col("start_ms")).alias("duration_ms"),
    )


def stream_sessions(activity: DataFrame, keys: Sequence[str] = ("user_id",), ttl: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Idle-TTL sessions of a stream (event-time column ``at``); later rows than the delay are dropped."""
    return (
        activity.withWatermark("at", delay)
        .groupBy(*keys, F.session_window("at", ttl).alias("w"))
        .agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n_events"))
        .drop("w")
    )


KEEP_MS = 3_600_000


def stream_settle(events: DataFrame, idle_ms: int = 500, cap_ms: int = 3000, delay: str = "10 seconds", keep_ms: int = KEEP_MS) -> DataFrame:
    """Settle time per page load (load_id, at, t0_ms, ts_ms, delta, seq; ``at`` is the event's time as a timestamp).

    A load's first seconds are kept until the watermark passes its cap; then its result comes out, once. Events that follow change
    nothing, as long as the load is not silent for ``keep_ms``.
    """

    def take(state, row):
        t0, at, delta, seq = state or (row["t0_ms"], [], [], [])
        if row["delta"] is not None and row["ts_ms"] <= t0 + cap_ms:
            at.append(row["ts_ms"])
            delta.append(row["delta"])
            seq.append(row["seq"])
        return (t0, at, delta, seq), t0 + cap_ms + 1

    def result(key, state):
        t0, at, delta, seq = state
        return Row(load_id=key[0], t0_ms=t0, settled_ms=_settled(t0, zip(at, seq, delta), idle_ms, cap_ms))

    use_state_store(events.sparkSession)
    worker = OncePerKey("t0 long, at array<long>, delta array<int>, seq array<long>", take, result, lambda row: row["ts_ms"], keep_ms)
    return events.withWatermark("at", delay).groupBy("load_id").transformWithState(
        worker, "load_id string, t0_ms long, settled_ms long", "append", "eventTime")


def stream_wait(versions: DataFrame, predicate: Column, timeout_ms: int = 10_000, delay: str = "10 seconds", keep_ms: int = KEEP_MS) -> DataFrame:
    """First time the predicate held after ``t0_ms`` and within the timeout, per ``key`` (key, at, t0_ms, ts_ms and the predicate's columns).

    A key that met it comes out as soon as the watermark passes that moment (nothing earlier can follow), others when it passes
    the timeout, with a null ``met_ms``; each once.
    """

    def take(state, row):
        t0, met = state or (row["t0_ms"], None)
        if row["_hit"] and t0 <= row["ts_ms"] <= t0 + timeout_ms:
            met = row["ts_ms"] if met is None else min(met, row["ts_ms"])
        return (t0, met), (t0 + timeout_ms if met is None else met) + 1

    def result(key, state):
        return Row(key=key[0], met_ms=state[1], met=state[1] is not None)

    use_state_store(versions.sparkSession)
    kind = versions.schema["key"].dataType.simpleString()
    rows = versions.select("key", "at", "t0_ms", "ts_ms", F.coalesce(predicate, F.lit(False)).alias("_hit"))
    worker = OncePerKey("t0 long, met long", take, result, lambda row: row["ts_ms"], keep_ms)
    return rows.withWatermark("at", delay).groupBy("key").transformWithState(worker, f"key {kind}, met_ms long, met boolean", "append", "eventTime")


def _settled(t0: int, events, idle_ms: int, cap_ms: int) -> int:
    in_flight, due = 0, t0 + idle_ms
    for at, _, delta in sorted(events):
        if due is not None and at >= due:
            break
        in_flight = max(0, in_flight + delta)
        due = at + idle_ms if delta < 0 and in_flight == 0 else None
    return min(due, t0 + cap_ms) if due is not None else t0 + cap_ms


def kv_changes(log: DataFrame) -> DataFrame:
    """A storage log as changes of entries; reads are left out. A set without a value stores an empty text."""
    action = F.col("action")
    return log.filter(action.isin("set", "remove", "clear")).select(
        *STORE, "key", F.coalesce("value", F.lit("")).alias("value"), "seq", F.lit(0).cast("long").alias("pos"),
        (action == "clear").alias("clears"), (action == "set").alias("live"))


def stream_kv(log: DataFrame) -> DataFrame:
    """Changes of storage entries; the live ones are the stream's state (``keyed.entries_of``)."""
    return latest_entries(kv_changes(log), STORE, ["key"], ["value"])


def stream_cookies(calls: DataFrame) -> DataFrame:
    """Changes of the profiles' cookie jars; the jars are the stream's state (``keyed.entries_of``)."""
    changes = cookie_changes(calls).withColumn("pos", F.col("pos").cast("long"))
    return latest_entries(changes, ["profile"], list(COOKIE), COOKIE_REST)


def stream_redacted(calls: DataFrame) -> DataFrame:
    """Redaction is stateless: the batch operator runs on the stream as it is."""
    return redact_args(calls)
