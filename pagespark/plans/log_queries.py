"""Registered queries over the telemetry logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs, sessions, tabs
from ..sources.logs import capture_bodies, console_log, net_log
from . import feeds
from .feeds_sql import BASE, BODIES, CONSOLE, HELD, LOADS, NET, TABS
from .registry import query

DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01, the first day of the event table
MID = T0 + 15 * DAY

NET_COLS = "seq, ts_ms, profile, tab_id, method, url, resource_type, status, duration_ms, from_cache, failed"


def _net(spark, sf):
    return net_log(feeds.raw_requests(spark, sf))


def _console(spark, sf):
    return console_log(feeds.raw_console(spark, sf))


def _bodies(spark, sf):
    return capture_bodies(feeds.raw_bodies(spark, sf))


@query("network_log", f"WITH {NET} SELECT {NET_COLS} FROM net")
def network_log(spark, sf):
    return _net(spark, sf)


@query("console_log", f"WITH {CONSOLE} SELECT seq, ts_ms, profile, tab_id, level, text, location FROM console")
def console_log_rows(spark, sf):
    return _console(spark, sf)


@query("captured_bodies", f"""WITH {BODIES}
SELECT seq, profile, url, method, status, content_type, md5(body) AS body_md5, length(body) AS body_chars FROM bodies""")
def captured_bodies(spark, sf):
    return _bodies(spark, sf).select(
        "seq", "profile", "url", "method", "status", "content_type",
        F.md5(F.encode("body", "UTF-8")).alias("body_md5"), F.length("body").alias("body_chars"))


@query("network_ring", f"""WITH {NET}
SELECT n.seq, n.profile, n.url, t.total FROM net n
JOIN (SELECT profile, least(count(*), 500) AS total FROM net GROUP BY 1) t ON n.profile = t.profile
WHERE (SELECT count(*) FROM net m WHERE m.profile = n.profile AND m.seq > n.seq) < 500""")
def network_ring(spark, sf):
    return logs.ring(_net(spark, sf), 500).select("seq", "profile", "url", "total")


_RING = """ring AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY seq DESC) AS back,
                        least(count(*) OVER (PARTITION BY profile), {n}) AS total FROM {t}) WHERE back <= {n})"""


@query("network_errors", f"""WITH {NET}, {_RING.format(n=500, t='net')},
hits AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY seq DESC) AS r FROM ring
         WHERE coalesce(status, 0) >= 400 AND upper(method) = 'GET' AND regexp_matches(url, 'view/[0-9]+$'))
SELECT {NET_COLS}, total FROM hits WHERE r <= 100""")
def network_errors(spark, sf):
    return logs.net_query(_net(spark, sf), method="get", min_status=400, url_regex="view/[0-9]+$")


@query("network_failed", f"""WITH {NET}, {_RING.format(n=500, t='net')},
hits AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY seq DESC) AS r FROM ring WHERE failed IS NOT NULL)
SELECT {NET_COLS}, total FROM hits WHERE r <= 25""")
def network_failed(spark, sf):
    return logs.net_query(_net(spark, sf), failed_only=True, limit=25)


@query("console_errors", f"""WITH {CONSOLE}, {_RING.format(n=500, t='console')},
hits AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY seq DESC) AS r FROM ring
         WHERE level = 'pageerror' AND regexp_matches(text, 'failed [1-5]'))
SELECT seq, ts_ms, profile, tab_id, level, text, location, total FROM hits WHERE r <= 100""")
def console_errors(spark, sf):
    return logs.console_query(_console(spark, sf), level="pageerror", text_regex="failed [1-5]")


def _body_sql(index: int, pattern: str) -> str:
    return f"""WITH {BODIES}, {_RING.format(n=50, t='bodies')},
hits AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY seq DESC) AS r,
                count(*) OVER (PARTITION BY profile) AS n
         FROM ring WHERE regexp_matches(url, '{pattern}')),
profiles AS (SELECT profile, (SELECT count(*) FROM hits h WHERE h.profile = p.profile) AS n
             FROM (SELECT DISTINCT profile FROM bodies) p),
picked AS (
  SELECT profile, seq, method || ' ' || url || chr(10) || 'status: ' || coalesce(CAST(status AS VARCHAR), '—')
    || '  content-type: ' || content_type || '  (match ' || CAST(n - {index} AS VARCHAR) || '/' || CAST(n AS VARCHAR)
    || ')' || chr(10) || chr(10) || body AS full_text, n - {index} AS i
  FROM hits WHERE r = {index} + 1)
SELECT p.profile, k.seq, k.i AS match_index, p.n AS match_count,
  CASE WHEN p.n = 0 THEN '(no captured response body matches — only small texty/JSON responses are captured, last 50)'
       WHEN k.seq IS NULL THEN '(index {index} out of range — ' || CAST(p.n AS VARCHAR) || ' match'
            || CASE WHEN p.n = 1 THEN '' ELSE 'es' END || ')'
       WHEN length(full_text) > 400 THEN substr(full_text, 1, 400) || chr(10) || chr(10) || '[...truncated, '
            || CAST(length(full_text) - 400 AS VARCHAR) || ' more chars]'
       ELSE full_text END AS text
FROM profiles p LEFT JOIN picked k ON p.profile = k.profile"""


@query("body_latest", _body_sql(0, "api.*/view/"))
def body_latest(spark, sf):
    return logs.body_query(_bodies(spark, sf), url_regex="api.*/view/", max_chars=400)


@query("body_older", _body_sql(8, "/(view|click)/"))
def body_older(spark, sf):
    return logs.body_query(_bodies(spark, sf), url_regex="/(view|click)/", index=8, max_chars=400)


_CLOCK = """lpad(CAST(ts_ms // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ts_ms // 60000 % 60 AS VARCHAR), 2, '0')
  || ':' || lpad(CAST(ts_ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ts_ms % 1000 AS VARCHAR), 3, '0')"""
_STATUS = "CASE WHEN failed IS NOT NULL THEN 'FAIL(' || failed || ')' WHEN status IS NOT NULL THEN CAST(status AS VARCHAR) ELSE '—' END"


@query("network_lines", f"""WITH {NET}, texts AS (SELECT *, {_STATUS} AS st FROM net)
SELECT seq, strftime(make_timestamp(ts_ms * 1000), '%H:%M:%S.%g') || '  '
  || CASE WHEN length(st) < 10 THEN rpad(st, 10, ' ') ELSE st END || '  ' || rpad(method, 7, ' ') || ' ' || url
  || '  [' || resource_type || ', ' || coalesce(CAST(duration_ms AS VARCHAR) || 'ms', '—') || ']' AS line
FROM texts""")
def network_lines(spark, sf):
    return logs.format_net(_net(spark, sf)).select("seq", "line")


@query("console_lines", f"""WITH {CONSOLE}
SELECT seq, strftime(make_timestamp(ts_ms * 1000), '%H:%M:%S.%g') || '  ' || rpad(upper(level), 9, ' ') || ' ' || text
  || coalesce('  (' || location || ')', '') AS line FROM console""")
def console_lines(spark, sf):
    return logs.format_console(_console(spark, sf)).select("seq", "line")


@query("network_report", f"""WITH {NET}, {_RING.format(n=500, t='net')},
hits AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY seq DESC) AS r, {_STATUS} AS st FROM ring
         WHERE coalesce(status, 0) >= 503),
lines AS (
  SELECT profile, seq, {_CLOCK} || '  ' || rpad(st, 10, ' ') || '  ' || rpad(method, 7, ' ') || ' ' || url
    || '  [' || resource_type || ', ' || CAST(duration_ms AS VARCHAR) || 'ms]' AS line FROM hits WHERE r <= 5),
body AS (SELECT profile, count(*) AS n, string_agg(line, chr(10) ORDER BY seq) AS body FROM lines GROUP BY 1)
SELECT t.profile, t.total, CASE WHEN n > 0 THEN '── ' || CAST(n AS VARCHAR) || ' entries (of ' || CAST(t.total AS VARCHAR)
    || ' in ring) ──' || chr(10) || body
  ELSE '(no network entries match; ring has ' || CAST(t.total AS VARCHAR) || ' total)' END AS text
FROM (SELECT DISTINCT profile, total FROM ring) t LEFT JOIN body b ON t.profile = b.profile""")
def network_report(spark, sf):
    log = _net(spark, sf)
    lines = logs.format_net(logs.net_query(log, min_status=503, limit=5)).select("profile", "seq", "line")
    return logs.log_report(lines, "network", logs.ring_totals(log, 500))


@query("paired_requests", f"""WITH {BASE},
s AS (SELECT seq AS req_id, ts_ms FROM base WHERE value >= 5),
e AS (SELECT seq AS req_id, ts_ms + CAST(floor(value) AS BIGINT) AS end_ms,
             CASE WHEN k % 5 = 0 THEN -1.0 ELSE value END AS timing, profile, tab_id FROM base WHERE value < 200)
SELECT e.req_id, e.profile, e.tab_id, coalesce(s.ts_ms, e.end_ms) AS ts_ms,
  CASE WHEN timing >= 0 THEN CAST(floor(timing + 0.5) AS BIGINT) WHEN s.req_id IS NULL THEN NULL
       ELSE e.end_ms - s.ts_ms END AS duration_ms
FROM e LEFT JOIN s ON e.req_id = s.req_id""")
def paired_requests(spark, sf):
    return logs.pair_requests(feeds.request_starts(spark, sf), feeds.request_ends(spark, sf)).select(
        "req_id", "profile", "tab_id", "ts_ms", "duration_ms")


@query("settle_times", f"""WITH {LOADS},
sums AS (
  SELECT a.load_id, a.ts_ms, a.seq, a.delta,
    (SELECT sum(b.delta) FROM steps b WHERE b.load_id = a.load_id AND (b.ts_ms, b.seq) <= (a.ts_ms, a.seq)) AS s
  FROM steps a),
clamped AS (
  SELECT a.*, a.s - least(0, (SELECT min(b.s) FROM sums b WHERE b.load_id = a.load_id
                              AND (b.ts_ms, b.seq) <= (a.ts_ms, a.seq))) AS inflight
  FROM sums a),
moments AS (
  SELECT load_id, ts_ms, seq FROM clamped WHERE delta = -1 AND inflight = 0
  UNION ALL SELECT DISTINCT load_id, 0, -1 FROM ev)
SELECT l.load_id, CAST(0 AS BIGINT) AS t0_ms,
  coalesce(least(3000, (SELECT min(m.ts_ms) + 500 FROM moments m WHERE m.load_id = l.load_id
    AND NOT EXISTS (SELECT 1 FROM steps x WHERE x.load_id = l.load_id AND (x.ts_ms, x.seq) > (m.ts_ms, m.seq)
                    AND x.ts_ms < m.ts_ms + 500))), 3000) AS settled_ms
FROM (SELECT DISTINCT load_id FROM ev) l""")
def settle_times(spark, sf):
    return logs.settle_time(feeds.load_events(spark, sf))


@query("idle_tabs", f"""WITH {BASE},
seen AS (SELECT profile, tab_id, max(ts_ms) AS last_used_ms FROM base WHERE ts_ms <= {MID} GROUP BY 1, 2),
active AS (SELECT profile, arg_max(tab_id, seq) AS tab_id FROM base WHERE ts_ms <= {MID} GROUP BY 1)
SELECT s.* FROM seen s WHERE {MID} - last_used_ms > 600000
  AND NOT EXISTS (SELECT 1 FROM active a WHERE a.profile = s.profile AND a.tab_id = s.tab_id)""")
def idle_tabs(spark, sf):
    usage = feeds.base(spark, sf).filter(F.col("ts_ms") <= MID)
    active = usage.groupBy("profile").agg(F.max_by("tab_id", "seq").alias("tab_id"))
    return logs.idle_tabs(usage, active, MID)


def _session_sql(ttl: int) -> str:
    return f"""WITH {BASE},
m AS (SELECT user_id, ts_ms, seq, CASE WHEN ts_ms - lag(ts_ms) OVER w <= {ttl} THEN 0 ELSE 1 END AS fresh
      FROM base WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_ms, seq) AS g FROM m)
SELECT user_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n_events, max(ts_ms) + {ttl} AS expires_ms
FROM g GROUP BY user_id, g"""


@query("sessions_half_hour", _session_sql(1_800_000))
def sessions_half_hour(spark, sf):
    return sessions.sessionize(feeds.base(spark, sf))


@query("sessions_six_hours", _session_sql(21_600_000))
def sessions_six_hours(spark, sf):
    return sessions.sessionize(feeds.base(spark, sf), ttl_ms=21_600_000)


@query("active_tab_per_call", f"""WITH {TABS},
sets AS (SELECT c.profile, c.session, c.seq, c.ts_ms,
           (SELECT max(t.seq) FROM tabs t WHERE t.session = c.session AND t.action <> 'close' AND t.seq < c.seq) AS set_seq
         FROM calls c)
SELECT s.profile, s.session, s.seq, s.ts_ms,
  CASE WHEN EXISTS (SELECT 1 FROM tabs x WHERE x.profile = s.profile AND x.tab_id = t.tab_id AND x.action = 'close'
                    AND x.seq > s.set_seq AND x.seq < s.seq) THEN NULL ELSE t.tab_id END AS active_tab
FROM sets s LEFT JOIN tabs t ON t.seq = s.set_seq""")
def active_tab_per_call(spark, sf):
    return tabs.active_tab_as_of(feeds.tab_calls(spark, sf), feeds.tab_events(spark, sf))


_OPEN = """last_close AS (SELECT profile, tab_id, max(seq) AS c FROM tabs WHERE action = 'close' GROUP BY 1, 2),
open_now AS (
  SELECT t.profile, t.tab_id, min(t.seq) AS opened_seq FROM tabs t
  LEFT JOIN last_close c ON c.profile = t.profile AND c.tab_id = t.tab_id
  WHERE t.action <> 'close' AND t.seq > coalesce(c.c, -1) GROUP BY 1, 2),
last_set AS (SELECT profile, arg_max(tab_id, seq) AS tab_id FROM tabs WHERE action <> 'close' GROUP BY 1),
act AS (
  SELECT l.profile, CASE WHEN EXISTS (SELECT 1 FROM open_now o WHERE o.profile = l.profile AND o.tab_id = l.tab_id)
    THEN l.tab_id
    ELSE (SELECT arg_min(o.tab_id, o.opened_seq) FROM open_now o WHERE o.profile = l.profile) END AS active_tab
  FROM last_set l)"""


@query("profile_active_tab", f"WITH {TABS}, {_OPEN} SELECT profile, active_tab FROM act")
def profile_active_tab(spark, sf):
    return tabs.profile_active_tab(feeds.tab_events(spark, sf))


@query("open_tabs", f"""WITH {TABS}, {_OPEN},
page AS (SELECT profile, tab_id, arg_max(title, seq) AS title, arg_max(url, seq) AS url
         FROM tabs WHERE url IS NOT NULL GROUP BY 1, 2)
SELECT o.profile, o.tab_id, o.opened_seq, p.title, p.url, coalesce(a.active_tab = o.tab_id, FALSE) AS active,
  CASE WHEN a.active_tab = o.tab_id THEN '→ ' ELSE '  ' END || o.tab_id || '  ' || coalesce(p.title, '') || '  '
    || coalesce(p.url, '') AS line
FROM open_now o LEFT JOIN page p ON p.profile = o.profile AND p.tab_id = o.tab_id
LEFT JOIN act a ON a.profile = o.profile""")
def open_tabs(spark, sf):
    return tabs.tabs_list(feeds.tab_events(spark, sf)).withColumn("line", tabs.tab_line())


@query("history_neighbors", f"""WITH {TABS}, n AS (SELECT * FROM tabs WHERE action = 'navigate'),
w AS (SELECT profile, tab_id, ts_ms, seq, url, lag(url) OVER o AS back_url, lead(url) OVER o AS forward_url
      FROM n WINDOW o AS (PARTITION BY profile, tab_id ORDER BY ts_ms, seq))
SELECT *, coalesce('Back → ' || back_url, 'Already at earliest history entry — ' || url) AS back_text,
  coalesce('Forward → ' || forward_url, 'Already at latest history entry — ' || url) AS forward_text FROM w""")
def history_neighbors(spark, sf):
    navs = feeds.tab_events(spark, sf).filter(F.col("action") == "navigate")
    return tabs.nav_neighbors(navs)


@query("busy_intervals", f"""WITH {HELD},
heads AS (SELECT profile, start_ms FROM held h WHERE NOT EXISTS (
  SELECT 1 FROM held o WHERE o.profile = h.profile AND (o.start_ms, o.session_id) < (h.start_ms, h.session_id)
    AND o.end_ms >= h.start_ms)),
owned AS (SELECT h.profile, h.end_ms, (SELECT max(s.start_ms) FROM heads s WHERE s.profile = h.profile
            AND s.start_ms <= h.start_ms) AS busy_from FROM held h)
SELECT profile, busy_from, max(end_ms) AS busy_to, count(*) AS n_sessions FROM owned GROUP BY 1, 2""")
def busy_intervals(spark, sf):
    return sessions.busy_intervals(feeds.held_sessions(spark, sf))


@query("session_load", f"""WITH {HELD}, n AS (
  SELECT h.session_id, h.start_ms, (SELECT count(*) FROM held o
    WHERE (o.start_ms, o.session_id) < (h.start_ms, h.session_id) AND o.end_ms > h.start_ms) AS live_before FROM held h)
SELECT *, live_before >= 3 AS over_cap FROM n""")
def session_load(spark, sf):
    return sessions.concurrency(feeds.held_sessions(spark, sf), cap=3)


@query("health", f"""WITH {HELD}
SELECT 'ok' AS status, CAST({MID - T0} AS BIGINT) AS uptime_ms, count(*) AS sessions, count(DISTINCT profile) AS profiles
FROM held WHERE start_ms <= {MID} AND {MID} - last_ms <= 1800000""")
def health(spark, sf):
    return sessions.health(feeds.held_sessions(spark, sf), MID, T0)


@query("sessions_per_profile", f"""WITH {HELD}
SELECT profile, count(*) AS sessions FROM held WHERE start_ms <= {MID} AND {MID} - last_ms <= 1800000 GROUP BY 1""")
def sessions_per_profile(spark, sf):
    return sessions.sessions_per_profile(feeds.held_sessions(spark, sf), MID)


@query("first_satisfied", f"""WITH {BASE}
SELECT CAST(user_id AS VARCHAR) AS key, min(ts_ms) FILTER (WHERE k > 60 AND event_type = 'purchase'
    AND ts_ms - {T0} BETWEEN 0 AND {4 * DAY}) AS met_ms,
  count(*) FILTER (WHERE k > 60 AND event_type = 'purchase' AND ts_ms - {T0} BETWEEN 0 AND {4 * DAY}) > 0 AS met
FROM base GROUP BY 1""")
def first_satisfied(spark, sf):
    versions = feeds.base(spark, sf).select(
        F.col("user_id").cast("string").alias("key"), "ts_ms", "k", "event_type",
        F.lit(T0).cast("long").alias("t0_ms"))
    return tabs.first_satisfied(versions, F.expr("k > 60 AND event_type = 'purchase'"), 4 * DAY)
