"""Queries over network, console and body logs: retention, filters, tails, pairing, settling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import clock_text
from ..functions.patterns import require_pattern
from ..functions.skew import topk_per_key
from ..functions.text import MAX_CHARS, pad_end, round_half_up, truncate_col

NET_RING = 500
CONSOLE_RING = 500
BODY_RING = 50
NO_BODY = "(no captured response body matches — only small texty/JSON responses are captured, last 50)"


def ring(df: DataFrame, n: int, key: str = "profile") -> DataFrame:
    """Last ``n`` rows per key by arrival, with ``total``, the number of rows kept for the key."""
    kept = topk_per_key(df, [key], [F.col("seq").desc()], n, salt_on=["seq"])
    # At most n rows per key are left, so this window is bounded.
    return kept.withColumn("total", F.count("*").over(Window.partitionBy(key)))


def _tail(df: DataFrame, limit: int, key: str) -> DataFrame:
    last_first = Window.partitionBy(key).orderBy(F.col("seq").desc())
    ranked = df.withColumn("_back", F.row_number().over(last_first))
    return ranked.filter(F.col("_back") <= limit).drop("_back")


def net_query(
    df: DataFrame,
    tab: str | None = None,
    method: str | None = None,
    failed_only: bool = False,
    min_status: int | None = None,
    url_regex: str | None = None,
    limit: int = 100,
    ring_size: int = NET_RING,
    key: str = "profile",
) -> DataFrame:
    """Filtered tail of each profile's network ring. The ring is cut first, filters see only it.

    Rows come with ``seq``; sort by it to print oldest first.
    """
    require_pattern(df.sparkSession, url_regex)
    hits = ring(df, ring_size, key)
    if tab:
        hits = hits.filter(F.col("tab_id") == tab)
    if method:
        hits = hits.filter(F.upper("method") == method.upper())
    if failed_only:
        hits = hits.filter(F.length("failed") > 0)
    if min_status is not None:
        hits = hits.filter(F.coalesce("status", F.lit(0)) >= min_status)
    if url_regex:
        hits = hits.filter(F.col("url").rlike(url_regex))
    return _tail(hits, limit, key)


def console_query(
    df: DataFrame,
    tab: str | None = None,
    level: str | None = None,
    text_regex: str | None = None,
    limit: int = 100,
    ring_size: int = CONSOLE_RING,
    key: str = "profile",
) -> DataFrame:
    require_pattern(df.sparkSession, text_regex)
    hits = ring(df, ring_size, key)
    if tab:
        hits = hits.filter(F.col("tab_id") == tab)
    if level:
        hits = hits.filter(F.col("level") == level)
    if text_regex:
        hits = hits.filter(F.col("text").rlike(text_regex))
    return _tail(hits, limit, key)


def body_query(
    df: DataFrame,
    url_regex: str | None = None,
    method: str | None = None,
    index: int = 0,
    ring_size: int = BODY_RING,
    max_chars: int = MAX_CHARS,
    key: str = "profile",
) -> DataFrame:
    """One row per profile: the match ``index`` back from the newest, or why there is none."""
    require_pattern(df.sparkSession, url_regex)
    match = F.lit(True)
    if method:
        match = match & (F.upper("method") == method.upper())
    if url_regex:
        match = match & F.col("url").rlike(url_regex)
    kept = ring(df, ring_size, key).withColumn("_hit", match)
    back = Window.partitionBy(key, "_hit").orderBy(F.col("seq").desc())
    picked = kept.withColumn("_back", F.row_number().over(back))
    is_pick = F.col("_hit") & (F.col("_back") == index + 1)
    per_key = picked.groupBy(key).agg(
        F.count_if("_hit").alias("match_count"),
        F.max(F.when(is_pick, F.struct("seq", "method", "url", "status", "content_type", "body"))).alias("e"),
    )
    at = F.col("match_count") - index
    header = F.concat(
        F.col("e.method"), F.lit(" "), F.col("e.url"),
        F.lit("\nstatus: "), F.coalesce(F.col("e.status").cast("string"), F.lit("—")),
        F.lit("  content-type: "), F.col("e.content_type"),
        F.lit("  (match "), at.cast("string"), F.lit("/"), F.col("match_count").cast("string"), F.lit(")\n\n"),
    )
    plural = F.when(F.col("match_count") == 1, "").otherwise("es")
    out_of_range = F.concat(
        F.lit(f"(index {index} out of range — "), F.col("match_count").cast("string"),
        F.lit(" match"), plural, F.lit(")"),
    )
    text = (
        F.when(F.col("match_count") == 0, NO_BODY)
        .when(F.col("e").isNull(), out_of_range)
        .otherwise(truncate_col(F.concat(header, F.col("e.body")), max_chars))
    )
    return per_key.select(
        key,
        F.col("e.seq").alias("seq"),
        F.when(F.col("e").isNotNull(), at).alias("match_index"),
        "match_count",
        text.alias("text"),
    )


def net_line() -> Column:
    outcome = (
        F.when(F.length("failed") > 0, F.concat(F.lit("FAIL("), F.col("failed"), F.lit(")")))
        .when(F.col("status").isNotNull(), F.col("status").cast("string"))
        .otherwise("—")
    )
    took = F.coalesce(F.concat(F.col("duration_ms").cast("string"), F.lit("ms")), F.lit("—"))
    return F.concat(
        clock_text(F.col("ts_ms")), F.lit("  "), pad_end(outcome, 10), F.lit("  "),
        pad_end(F.col("method"), 7), F.lit(" "), F.col("url"),
        F.lit("  ["), F.col("resource_type"), F.lit(", "), took, F.lit("]"),
    )


def console_line() -> Column:
    where = F.when(F.length("location") > 0, F.concat(F.lit("  ("), F.col("location"), F.lit(")")))
    return F.concat(
        clock_text(F.col("ts_ms")), F.lit("  "), pad_end(F.upper("level"), 9), F.lit(" "),
        F.col("text"), F.coalesce(where, F.lit("")),
    )


def format_net(df: DataFrame) -> DataFrame:
    return df.withColumn("line", net_line())


def format_console(df: DataFrame) -> DataFrame:
    return df.withColumn("line", console_line())


def log_report(lines: DataFrame, noun: str, rings: DataFrame, key: str = "profile") -> DataFrame:
    """One text per key: header and the (ring-bounded) lines, or the "no match" sentence.

    ``lines`` has key, seq, line; ``rings`` has key, total.
    """
    per_key = lines.groupBy(key).agg(
        F.count("*").alias("n"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n"
        ).alias("body"),
    )
    total = F.col("total").cast("string")
    some = F.concat(
        F.lit("── "), F.col("n").cast("string"), F.lit(" entries (of "), total, F.lit(" in ring) ──\n"),
        F.col("body"),
    )
    none = F.concat(F.lit(f"(no {noun} entries match; ring has "), total, F.lit(" total)"))
    return rings.join(per_key, key, "left").select(
        key, "total", F.when(F.col("n") > 0, some).otherwise(none).alias("text")
    )


def ring_totals(df: DataFrame, n: int, key: str = "profile") -> DataFrame:
    return df.groupBy(key).agg(F.least(F.count("*"), F.lit(n)).alias("total"))


def pair_requests(starts: DataFrame, ends: DataFrame, id_col: str = "req_id") -> DataFrame:
    """Join finished / failed requests to their starts.

    The start time wins; without a start the end time stands in. Duration is the
    browser's own timing when it is not negative, else end minus start, else null.
    Requests that never ended do not appear.
    """
    begun = starts.select(id_col, F.col("ts_ms").alias("start_ms"))
    timing = F.col("timing_ms")
    return (
        ends.withColumnRenamed("ts_ms", "end_ms")
        .join(begun, id_col, "left")
        .withColumn("ts_ms", F.coalesce("start_ms", "end_ms"))
        .withColumn(
            "duration_ms",
            F.when(timing >= 0, round_half_up(timing)).otherwise(F.col("end_ms") - F.col("start_ms")),
        )
    )


def settle_time(
    events: DataFrame, keys: Sequence[str] = ("load_id",), idle_ms: int = 500, cap_ms: int = 3000
) -> DataFrame:
    """When each page load became quiet.

    ``events``: keys, t0_ms, ts_ms, delta (+1 request, -1 finished or failed), seq; a load
    without requests has one row with a null delta. The in-flight count never drops below
    zero. Settled = first moment with nothing in flight and ``idle_ms`` without any request
    event, at the latest ``cap_ms`` after t0. Rows after the cap are dropped before the
    shuffle, so a load's window holds three seconds of events.
    """
    seen = events.filter(
        F.col("delta").isNull() | F.col("ts_ms").between(F.col("t0_ms"), F.col("t0_ms") + cap_ms)
    )
    order = Window.partitionBy(*keys).orderBy("ts_ms", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce("delta", F.lit(0))
    walked = (
        seen.withColumn("_sum", F.sum(step).over(upto))
        .withColumn("_low", F.least(F.lit(0), F.min("_sum").over(upto)))
        .withColumn("_next", F.lead("ts_ms").over(order))
    )
    quiet_after = F.col("_next").isNull() | (F.col("_next") >= F.col("ts_ms") + idle_ms)
    ended_idle = (F.col("delta") == -1) & (F.col("_sum") - F.col("_low") <= 0) & quiet_after
    per_load = walked.groupBy(*keys).agg(
        F.min("t0_ms").alias("t0_ms"),
        F.min(F.when(F.col("delta").isNotNull(), F.col("ts_ms"))).alias("_first"),
        F.min(F.when(ended_idle, F.col("ts_ms"))).alias("_idle"),
    )
    never_busy = F.col("_first").isNull() | (F.col("_first") >= F.col("t0_ms") + idle_ms)
    idle_from = F.when(never_busy, F.col("t0_ms")).otherwise(F.col("_idle"))
    return per_load.select(
        *keys, "t0_ms",
        F.least(idle_from + idle_ms, F.col("t0_ms") + cap_ms).alias("settled_ms"),
    )


def idle_tabs(usage: DataFrame, active: DataFrame, now_ms: int, ttl_s: int = 600) -> DataFrame:
    """Tabs unused for more than the TTL at ``now_ms``; the active tab of a profile is spared."""
    last = usage.filter(F.col("ts_ms") <= now_ms).groupBy("profile", "tab_id").agg(
        F.max("ts_ms").alias("last_used_ms")
    )
    stale = last.filter(F.lit(now_ms) - F.col("last_used_ms") > ttl_s * 1000)
    return stale.join(active.select("profile", "tab_id"), ["profile", "tab_id"], "left_anti")
