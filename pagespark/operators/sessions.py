"""Session windows, busy intervals, concurrency and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import HOUR_MS, Run, merged_runs, running

SESSION_TTL_MS = 1_800_000
SESSION_CAP = 50


def sessionize(
    activity: DataFrame,
    keys: Sequence[str] = ("user_id",),
    ttl_ms: int = SESSION_TTL_MS,
    chunk_ms: int = HOUR_MS * 24,
) -> DataFrame:
    """Idle-TTL sessions: a gap longer than the TTL (strictly) starts a new one.

    Chunks of a user's time are summarised on their own and merged at their borders, so a busy user's rows are never sorted in one task.
    """
    runs = merged_runs(activity, keys, "ts_ms", "ts_ms", ttl_ms, chunk_ms)
    return runs.select(*keys, F.col("run_start").alias("start_ms"), F.col("run_end").alias("last_ms"), F.col("run_rows").alias("n_events"),
                       (F.col("run_end") + ttl_ms).alias("expires_ms"))


def busy_intervals(
    sessions: DataFrame, key: str = "profile", chunk_ms: int = HOUR_MS * 24
) -> DataFrame:
    """Maximal intervals during which at least one session holds the profile.

    ``sessions``: key, start_ms, end_ms. Touching sessions belong together.
    """
    runs = merged_runs(sessions, [key], "start_ms", "end_ms", 0, chunk_ms)
    return runs.select(key, F.col("run_start").alias("busy_from"), F.col("run_end").alias("busy_to"), F.col("run_rows").alias("n_sessions"))


def concurrency(
    sessions: DataFrame, cap: int = SESSION_CAP, id_col: str = "session_id", chunk_ms: int = HOUR_MS
) -> DataFrame:
    """Offered load at each session start: live sessions before it, and whether the cap was full.

    Sessions that end at a moment free their slot before one that starts at it. The global
    running sum goes through time chunks, so no task sees the whole log.
    """
    holds = (F.col("end_ms") > F.col("start_ms")).cast("long")
    starts = sessions.select(
        F.col(id_col).alias("sid"), F.col("start_ms").alias("at_ms"), F.lit(1).alias("step"), holds.alias("n")
    )
    ends = sessions.select(
        F.col(id_col).alias("sid"), F.col("end_ms").alias("at_ms"), F.lit(-1).alias("step"), (-holds).alias("n")
    )
    walked = running(
        starts.unionByName(ends), [], ["at_ms", "step", "sid"],
        [Run("live", "sum", F.col("n"), inclusive=False)], "at_ms", chunk_ms,
    )
    return walked.filter(F.col("step") == 1).select(
        F.col("sid").alias(id_col), F.col("at_ms").alias("start_ms"), F.col("live").alias("live_before"),
        (F.col("live") >= cap).alias("over_cap"),
    )


def live_sessions(sessions: DataFrame, now_ms: int, ttl_ms: int = SESSION_TTL_MS) -> DataFrame:
    """Sessions that started by ``now_ms`` and were used within the TTL before it."""
    return sessions.filter(
        (F.col("start_ms") <= now_ms) & (F.lit(now_ms) - F.col("last_ms") <= ttl_ms)
    )


def health(sessions: DataFrame, now_ms: int, started_ms: int, ttl_ms: int = SESSION_TTL_MS) -> DataFrame:
    """One row: status, uptime, live sessions and the distinct profiles they hold."""
    return live_sessions(sessions, now_ms, ttl_ms).agg(
        F.lit("ok").alias("status"),
        F.lit(now_ms - started_ms).cast("long").alias("uptime_ms"),
        F.count("*").alias("sessions"),
        F.count_distinct("profile").alias("profiles"),
    )


def sessions_per_profile(sessions: DataFrame, now_ms: int, ttl_ms: int = SESSION_TTL_MS) -> DataFrame:
    return live_sessions(sessions, now_ms, ttl_ms).groupBy("profile").agg(F.count("*").alias("sessions"))
