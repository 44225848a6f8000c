"""Registered streaming queries: the event table replayed as a file stream until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import url_verdict
from ..operators import tabs
from ..session import shared_dir
from ..sources.logs import capture_bodies, console_log, net_log
from ..streaming import logs
from ..streaming.keyed import entries_of
from ..streaming.runs import run, run_to_table
from . import feeds
from .feeds_sql import BASE, BODIES, CONSOLE, NET
from .log_queries import _RING
from .registry import CATALOG, query
from .rule_queries import CALLS, URLS
from .state_queries import COOKIES, KV, _JAR, _LIVE


CLOSING_DAYS = 30


class _Replay:
    """Stands in for a session so that a feed reads its table as a stream.

    With ``closing`` one more event follows, far behind the newest one, so that the watermark passes every real event
    and nothing waits for more. Its results lie at or after ``_end`` and are no part of the answer.
    """

    def __init__(self, spark, closing=False):
        self.spark, self.closing = spark, closing

    @property
    def read(self):
        return self

    def parquet(self, path):
        table = self.spark.read.parquet(path)
        # As a pattern the path may name one file or a folder of files.
        events = self.spark.readStream.schema(table.schema).parquet(f"{path[:-1]}[{path[-1]}]")
        if not self.closing:
            return events
        home = f"{shared_dir(self.spark, 'closing')}/event"
        # Its value lets it be both the start and the end of a request.
        late = table.agg(F.max("ts").alias("newest")).filter("newest IS NOT NULL").select(
            F.lit(-1).alias("event_id"), (F.col("newest") + F.expr(f"INTERVAL {CLOSING_DAYS} DAYS")).alias("ts"),
            F.lit("view").alias("event_type"), F.lit(100.0).alias("value"), F.lit('{"k": 1}').alias("props"))
        late.select(*[
            (F.col(f.name) if f.name in late.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema
        ]).write.parquet(home)
        return events.unionByName(self.spark.readStream.schema(table.schema).parquet(home))


def _end(spark, sf):
    """A moment behind all real events, their ends and their spells, and before those of the closing event."""
    return feeds.base(spark, sf).agg((F.max("ts_ms") + CLOSING_DAYS * 43_200_000).alias("end_ms"))


def _real(df, ts_ms, end):
    return df.join(F.broadcast(end), F.col(ts_ms) < F.col("end_ms")).drop("end_ms")


@query("stream_network_ring", f"""WITH {NET}, {_RING.format(n=40, t='net')} SELECT seq, profile, url, total FROM ring""")
def stream_network_ring(spark, sf):
    log = net_log(feeds.raw_requests(_Replay(spark), sf))
    return logs.stream_ring(log, 40).select("seq", "profile", "url", "total")


def _columns(batch, columns):
    """The SQL of a batch query, cut to the columns that its stream gives."""
    return f"SELECT {columns} FROM ({CATALOG[batch].sql})"


@query("stream_paired_requests", _columns("paired_requests", "req_id, profile, tab_id, ts_ms, duration_ms"))
def stream_paired_requests(spark, sf):
    def timed(df):
        return df.withColumn("at", F.timestamp_millis("ts_ms"))

    replay = _Replay(spark, closing=True)
    pairs = logs.stream_pairs(timed(feeds.request_starts(replay, sf)), timed(feeds.request_ends(replay, sf)))
    return _real(run_to_table(pairs, "pairs"), "ts_ms", _end(spark, sf))


@query("stream_sessions", _columns("sessions_six_hours", "user_id, start_ms, last_ms, n_events"))
def stream_sessions(spark, sf):
    activity = feeds.base(_Replay(spark, closing=True), sf).withColumn("at", F.timestamp_millis("ts_ms"))
    closed = run_to_table(logs.stream_sessions(activity, ttl="6 hours"), "sessions")
    return _real(closed, "last_ms", _end(spark, sf))


@query("stream_settle_times", _columns("settle_times", "load_id, settled_ms"))
def stream_settle_times(spark, sf):
    ev = feeds.base(_Replay(spark, closing=True), sf)
    begin = F.col("k") * 25
    end = begin + F.floor("value") * 4
    t0 = F.floor(F.col("ts_ms") / SPELL_MS) * SPELL_MS

    def entry(keep, delta, off, seq):
        return F.when(keep, F.struct(F.lit(delta).cast("int").alias("delta"), off.cast("long").alias("off"), seq.cast("long").alias("seq")))

    steps = F.array(
        entry(F.col("event_type") != "click", 1, begin, F.col("seq") * 2),
        entry(F.col("event_type") != "error", -1, end, F.col("seq") * 2 + 1))
    rows = ev.select(_spell_key().alias("load_id"), t0.cast("long").alias("t0_ms"), F.explode(F.array_compact(steps)).alias("s"))
    timed = rows.select("load_id", "t0_ms", (F.col("t0_ms") + F.col("s.off")).alias("ts_ms"), "s.delta", "s.seq").withColumn("at", F.timestamp_millis("ts_ms"))
    settled = run_to_table(logs.stream_settle(timed), "settle")
    return _real(settled, "t0_ms", _end(spark, sf)).select("load_id", (F.col("settled_ms") - F.col("t0_ms")).alias("settled_ms"))


SPELL_MS = 5 * 86_400_000
WAIT_MS = 2 * 86_400_000


def _spell_key():
    return F.concat_ws("-", "tab_id", F.floor(F.col("ts_ms") / SPELL_MS).cast("string"))


def _waits(spark, sf):
    """Each tab waits, from the start of a five-day spell, for a value above 100."""
    return feeds.base(spark, sf).select(
        _spell_key().alias("key"), (F.floor(F.col("ts_ms") / SPELL_MS) * SPELL_MS).cast("long").alias("t0_ms"), "ts_ms", "value")


WAITS = f"""WITH {BASE}, m AS (SELECT tab_id || '-' || CAST(ts_ms // {SPELL_MS} AS VARCHAR) AS key,
    min(ts_ms) FILTER (WHERE value > 100 AND ts_ms % {SPELL_MS} <= {WAIT_MS}) AS met_ms FROM base GROUP BY 1)
SELECT key, met_ms, met_ms IS NOT NULL AS met FROM m"""


@query("waits_in_time", WAITS)
def waits_in_time(spark, sf):
    return tabs.first_satisfied(_waits(spark, sf), F.expr("value > 100"), WAIT_MS)


@query("stream_waits", WAITS)
def stream_waits(spark, sf):
    versions = _waits(_Replay(spark, closing=True), sf).withColumn("at", F.timestamp_millis("ts_ms"))
    met = run_to_table(logs.stream_wait(versions, F.expr("value > 100"), WAIT_MS), "waits")
    spells = F.broadcast(_end(spark, sf).select(F.floor(F.col("end_ms") / SPELL_MS).alias("after")))
    return met.join(spells, F.element_at(F.split("key", "-"), -1).cast("long") < F.col("after")).drop("after")


@query("stream_storage_state", f"WITH {KV}, {_LIVE.format(upto=10**15)} SELECT * FROM live")
def stream_storage_state(spark, sf):
    done = run(logs.stream_kv(feeds.kv_log(_Replay(spark), sf)), "kv")
    return entries_of(spark, done.checkpoint).drop("pos")


@query("stream_cookie_jar", f"WITH {COOKIES} SELECT {_JAR} FROM jar")
def stream_cookie_jar(spark, sf):
    done = run(logs.stream_cookies(feeds.cookie_calls(_Replay(spark), sf)), "cookies")
    return entries_of(spark, done.checkpoint).drop("pos")


@query("stream_console_log", f"WITH {CONSOLE} SELECT seq, ts_ms, profile, tab_id, level, text, location FROM console")
def stream_console_log(spark, sf):
    return run_to_table(console_log(feeds.raw_console(_Replay(spark), sf)), "console")


@query("stream_bodies", f"WITH {BODIES} SELECT seq, profile, content_type, length(body) AS body_chars FROM bodies")
def stream_bodies(spark, sf):
    kept = capture_bodies(feeds.raw_bodies(_Replay(spark), sf))
    return run_to_table(kept.select("seq", "profile", "content_type", F.length("body").alias("body_chars")), "bodies")


@query("stream_redacted_calls", f"WITH {CALLS} SELECT seq, name, redacted FROM red")
def stream_redacted_calls(spark, sf):
    calls = logs.stream_redacted(feeds.tool_calls(_Replay(spark), sf))
    return run_to_table(calls.select("seq", "name", "redacted"), "redacted")


@query("stream_url_verdicts", f"WITH {URLS} SELECT seq, url, host, reason, reason IS NULL AS safe FROM v")
def stream_url_verdicts(spark, sf):
    return run_to_table(url_verdict(feeds.checked_urls(_Replay(spark), sf)).drop("k"), "verdicts")


@query("stream_failed_requests", f"WITH {NET} SELECT seq, profile, url, failed FROM net WHERE failed IS NOT NULL")
def stream_failed_requests(spark, sf):
    log = net_log(feeds.raw_requests(_Replay(spark), sf)).filter(F.length("failed") > 0)
    return run_to_table(log.select("seq", "profile", "url", "failed"), "failed")
