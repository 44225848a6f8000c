"""Tab state as of any moment: active tab, open tabs, history neighbours, waits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import HOUR_MS, Run, running

ACTIVATING = ("navigate", "switch", "open")


def _activates() -> Column:
    return F.col("action").isin(*ACTIVATING)


def active_tab_as_of(calls: DataFrame, tab_events: DataFrame, chunk_ms: int = HOUR_MS * 24) -> DataFrame:
    """The session's active tab at each call: the last one it opened, switched to or navigated,
    or null once anybody closed that tab.

    ``calls``: profile, session, ts_ms, seq. ``tab_events``: the same plus tab_id and action.
    """
    per_tab = running(
        tab_events, ["profile", "tab_id"], ["ts_ms", "seq"],
        [Run("closed_seq", "next", F.when(F.col("action") == "close", F.col("seq")))], "ts_ms", chunk_ms,
    ).filter(_activates())
    set_to = per_tab.select(
        "profile", "session", "ts_ms", "seq", F.lit(False).alias("is_call"),
        F.struct("tab_id", "closed_seq").alias("target"),
    )
    asked = calls.select(
        "profile", "session", "ts_ms", "seq", F.lit(True).alias("is_call"),
        F.lit(None).cast(set_to.schema["target"].dataType).alias("target"),
    )
    both = running(
        set_to.unionByName(asked), ["profile", "session"], ["ts_ms", "seq"],
        [Run("now", "last", F.col("target"))], "ts_ms", chunk_ms,
    )
    still_open = F.col("now.closed_seq").isNull() | (F.col("now.closed_seq") > F.col("seq"))
    return both.filter("is_call").select(
        "profile", "session", "seq", "ts_ms", F.when(still_open, F.col("now.tab_id")).alias("active_tab")
    )


def tab_lives(tab_events: DataFrame, chunk_ms: int = HOUR_MS * 24) -> DataFrame:
    """One row per life of a tab: first event after the previous close, and the closing event."""
    closing = F.when(F.col("action") == "close", F.col("seq"))
    walked = running(
        tab_events.select("profile", "tab_id", "ts_ms", "seq", "action"),
        ["profile", "tab_id"], ["ts_ms", "seq"],
        [
            Run("prev_close", "last", closing, inclusive=False),
            Run("next_close", "next", closing),
        ],
        "ts_ms", chunk_ms,
    ).filter(_activates())
    return walked.groupBy("profile", "tab_id", "prev_close").agg(
        F.min("seq").alias("opened_seq"), F.max("next_close").alias("closed_seq")
    ).drop("prev_close")


def profile_active_tab(tab_events: DataFrame, chunk_ms: int = HOUR_MS * 24) -> DataFrame:
    """A profile's active tab after all given events.

    It is the tab activated last; once that tab is closed, the oldest tab still open, else null.
    Filter the events by time for the state at an earlier moment.
    """
    last_set = tab_events.filter(_activates()).groupBy("profile").agg(
        F.max_by("tab_id", "seq").alias("tab_id")
    )
    open_now = tab_lives(tab_events, chunk_ms).filter(F.col("closed_seq").isNull())
    oldest = open_now.groupBy("profile").agg(F.min_by("tab_id", "opened_seq").alias("oldest"))
    live = open_now.select("profile", "tab_id", F.lit(True).alias("live"))
    return (
        last_set.join(live, ["profile", "tab_id"], "left")
        .join(oldest, "profile", "left")
        .select("profile", F.when(F.col("live"), F.col("tab_id")).otherwise(F.col("oldest")).alias("active_tab"))
    )


def tabs_list(tab_events: DataFrame, chunk_ms: int = HOUR_MS * 24) -> DataFrame:
    """Open tabs with their latest title and url; ``active`` marks the profile's active tab."""
    latest = tab_events.filter(F.col("url").isNotNull()).groupBy("profile", "tab_id").agg(
        F.max_by(F.struct("title", "url"), "seq").alias("page")
    )
    open_now = tab_lives(tab_events, chunk_ms).filter(F.col("closed_seq").isNull())
    active = profile_active_tab(tab_events, chunk_ms).select(
        "profile", F.col("active_tab").alias("tab_id"), F.lit(True).alias("active")
    )
    return (
        open_now.join(latest, ["profile", "tab_id"], "left")
        .join(active, ["profile", "tab_id"], "left")
        .select(
            "profile", "tab_id", "opened_seq",
            F.col("page.title").alias("title"), F.col("page.url").alias("url"),
            F.coalesce("active", F.lit(False)).alias("active"),
        )
    )


def tab_line() -> Column:
    mark = F.when(F.col("active"), "→ ").otherwise("  ")
    return F.concat(mark, F.concat_ws("  ", F.col("tab_id"), F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))))


def nav_neighbors(navs: DataFrame, chunk_ms: int = HOUR_MS * 24) -> DataFrame:
    """Previous and next url in each tab's history; the ends say that there is no history."""
    around = running(
        navs.select("profile", "tab_id", "ts_ms", "seq", "url"), ["profile", "tab_id"], ["ts_ms", "seq"],
        [
            Run("back_url", "last", F.col("url"), inclusive=False),
            Run("forward_url", "next", F.col("url"), inclusive=False),
        ],
        "ts_ms", chunk_ms,
    )
    back = F.when(
        F.col("back_url").isNull(), F.concat(F.lit("Already at earliest history entry — "), F.col("url"))
    ).otherwise(F.concat(F.lit("Back → "), F.col("back_url")))
    forward = F.when(
        F.col("forward_url").isNull(), F.concat(F.lit("Already at latest history entry — "), F.col("url"))
    ).otherwise(F.concat(F.lit("Forward → "), F.col("forward_url")))
    return around.withColumn("back_text", back).withColumn("forward_text", forward)


def first_satisfied(
    versions: DataFrame, predicate: Column, timeout_ms: int = 10_000, keys: Sequence[str] = ("key",)
) -> DataFrame:
    """Per key, the first time the predicate held within the timeout after ``t0_ms``, if any."""
    in_time = F.col("ts_ms").between(F.col("t0_ms"), F.col("t0_ms") + timeout_ms)
    return versions.groupBy(*keys).agg(
        F.min(F.when(in_time & predicate, F.col("ts_ms"))).alias("met_ms")
    ).withColumn("met", F.col("met_ms").isNotNull())
