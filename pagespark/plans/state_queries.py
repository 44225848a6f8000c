"""Registered queries that replay state from change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import settings, state
from . import feeds
from .feeds_sql import BASE
from .registry import query

KV = BASE + """,
kv AS (
  SELECT profile, 'o' || CAST(user_id % 5 AS VARCHAR) AS origin, CASE WHEN k % 2 = 0 THEN 'local' ELSE 'session' END AS area,
    CASE WHEN event_type = 'view' THEN 'get' WHEN event_type = 'purchase' THEN 'remove'
         WHEN event_type = 'error' AND k % 20 = 0 THEN 'clear' ELSE 'set' END AS action,
    'key' || CAST(k % 5 AS VARCHAR) AS key, CASE WHEN k % 13 <> 0 THEN CAST(k AS VARCHAR) END AS value, seq
  FROM base)"""

_LIVE = """live AS (
  SELECT s.profile, s.origin, s.area, s.key, coalesce(s.value, '') AS value, s.seq FROM kv s
  WHERE s.action = 'set' AND s.seq <= {upto} AND NOT EXISTS (
    SELECT 1 FROM kv n WHERE n.seq > s.seq AND n.seq <= {upto} AND n.profile = s.profile AND n.origin = s.origin
      AND n.area = s.area AND (n.action = 'clear' OR (n.action IN ('set', 'remove') AND n.key = s.key))))"""


@query("storage_state", f"WITH {KV}, {_LIVE.format(upto=10**15)} SELECT * FROM live")
def storage_state(spark, sf):
    return state.kv_state(feeds.kv_log(spark, sf))


@query("storage_state_early", f"WITH {KV}, {_LIVE.format(upto="(SELECT max(seq) // 2 FROM kv)")} SELECT * FROM live")
def storage_state_early(spark, sf):
    log = feeds.kv_log(spark, sf)
    return state.kv_state(log, as_of=(log.agg(F.max("seq")).first()[0] or 0) // 2)


@query("storage_all_entries", f"""WITH {KV}, {_LIVE.format(upto=10**15)}
SELECT profile, origin, area, string_agg(key || ' = ' || value, chr(10) ORDER BY key) AS text FROM live GROUP BY 1, 2, 3""")
def storage_all_entries(spark, sf):
    got = state.kv_get(state.kv_state(feeds.kv_log(spark, sf)))
    lines = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))
    return got.select("profile", "origin", "area", F.array_join(lines, "\n").alias("text"))


@query("storage_one_key", f"""WITH {KV}, {_LIVE.format(upto=10**15)}
SELECT profile, origin, area, max(value) FILTER (WHERE key = 'key3') AS value FROM live GROUP BY 1, 2, 3""")
def storage_one_key(spark, sf):
    return state.kv_get(state.kv_state(feeds.kv_log(spark, sf)), key="key3")


@query("storage_reads", f"""WITH {KV}, reads AS (
  SELECT g.*, (SELECT max(s.seq) FROM kv s WHERE s.seq < g.seq AND s.profile = g.profile AND s.origin = g.origin
    AND s.area = g.area AND (s.action = 'clear' OR (s.action IN ('set', 'remove') AND s.key = g.key))) AS cause
  FROM kv g WHERE g.action = 'get')
SELECT r.profile, r.origin, r.area, r.key, r.seq, CASE WHEN c.action = 'set' THEN coalesce(c.value, '') END AS value
FROM reads r LEFT JOIN kv c ON c.seq = r.cause""")
def storage_reads(spark, sf):
    return state.kv_reads(feeds.kv_log(spark, sf))


COOKIES = BASE + """,
calls AS (SELECT profile, seq, k, value, url, event_type,
            CASE WHEN event_type = 'error' AND k % 25 = 0 THEN 'clear' ELSE 'set' END AS action
          FROM based WHERE event_type <> 'view'),
put AS (
  SELECT profile, seq, 0 AS pos, 'c' || CAST(k % 7 AS VARCHAR) AS name, 'v' || CAST(k AS VARCHAR) AS value,
    CASE k % 3 WHEN 0 THEN '.example.com' WHEN 1 THEN 'api.example.com' ELSE 'www.example.com' END AS domain,
    CASE WHEN k % 4 = 0 THEN '/view' ELSE '/' END AS path,
    CASE k % 5 WHEN 0 THEN -1 WHEN 1 THEN NULL ELSE 1704067200 + k * 86400 END AS expires,
    k % 2 = 0 AS httpOnly, k % 3 = 0 AS secure, CASE k % 4 WHEN 1 THEN 'Lax' WHEN 2 THEN 'Strict' END AS sameSite
  FROM calls WHERE action = 'set' AND event_type <> 'purchase'
  UNION ALL
  SELECT profile, seq, 1, 'u' || CAST(k % 3 AS VARCHAR), CAST(value AS VARCHAR), split_part(url, '/', 3),
    '/' || event_type || '/', NULL, FALSE, FALSE, NULL
  FROM calls WHERE action = 'set' AND event_type <> 'purchase'),
jar AS (
  SELECT p.* FROM put p WHERE NOT EXISTS (SELECT 1 FROM put n WHERE n.profile = p.profile AND n.name = p.name
      AND n.domain = p.domain AND n.path = p.path AND n.seq > p.seq)
    AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.profile = p.profile AND c.action = 'clear' AND c.seq > p.seq))"""

_JAR = "profile, name, domain, path, value, CAST(expires AS DOUBLE) AS expires, httpOnly, secure, sameSite, seq"


@query("cookie_jar", f"WITH {COOKIES} SELECT {_JAR} FROM jar")
def cookie_jar(spark, sf):
    return state.cookie_state(feeds.cookie_calls(spark, sf))


@query("cookies_for_urls", f"""WITH {COOKIES}
SELECT {_JAR} FROM jar WHERE EXISTS (SELECT 1 FROM based u
  WHERE ('.' || split_part(u.url, '/', 3)) LIKE ('%' || CASE WHEN domain[1] = '.' THEN domain ELSE '.' || domain END)
    AND starts_with(substr(u.url, length('https://' || split_part(u.url, '/', 3)) + 1), path))""")
def cookies_for_urls(spark, sf):
    urls = feeds.raw_requests(spark, sf).select("url")
    return state.cookies_for(state.cookie_state(feeds.cookie_calls(spark, sf)), urls)


@query("cookie_lines", f"""WITH {COOKIES}
SELECT profile, seq, name, name || ' (' || domain || path || ') = ' || value || '  ['
  || concat_ws(' ', CASE WHEN secure THEN 'Secure' END, CASE WHEN httpOnly THEN 'HttpOnly' END, 'SameSite=' || sameSite)
  || '] expires=' || CASE WHEN expires > 0 THEN strftime(make_timestamp(CAST(expires AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') ELSE 'session' END AS line
FROM jar""")
def cookie_lines(spark, sf):
    jar = state.cookie_state(feeds.cookie_calls(spark, sf))
    return jar.select("profile", "seq", "name", state.format_cookie().alias("line"))


@query("dialog_outcomes", f"""WITH {BASE},
p AS (SELECT profile, seq, CASE WHEN k % 3 = 0 THEN 'dismiss' ELSE 'accept' END AS action,
        CASE WHEN k % 4 <> 0 THEN 'answer ' || CAST(k AS VARCHAR) END AS prompt_text, k % 2 = 1 AS persist
      FROM base WHERE event_type IN ('signup', 'purchase')),
d AS (SELECT b.profile, b.seq, b.ts_ms, (SELECT max(p.seq) FROM p WHERE p.profile = b.profile AND p.seq < b.seq) AS rule_seq
      FROM base b WHERE event_type = 'click'),
n AS (SELECT *, row_number() OVER (PARTITION BY profile, rule_seq ORDER BY seq) AS nth FROM d)
SELECT n.profile, n.seq, n.ts_ms,
  CASE WHEN p.action = 'accept' AND (p.persist OR nth = 1) THEN 'accept' ELSE 'dismiss' END AS outcome,
  CASE WHEN p.action = 'accept' AND (p.persist OR nth = 1) THEN p.prompt_text END AS prompt_text
FROM n LEFT JOIN p ON p.seq = n.rule_seq""")
def dialog_outcomes(spark, sf):
    return state.dialog_outcomes(feeds.dialog_policies(spark, sf), feeds.dialogs(spark, sf))


_ALL = ", ".join(f"'{p}'" for p in state.PERMISSIONS)


@query("permissions_granted", f"""WITH {BASE},
g AS (SELECT profile, seq, k,
    CASE WHEN event_type = 'error' AND k % 30 = 0 THEN 'none' WHEN k % 3 = 0 THEN 'all' ELSE 'list' END AS what,
    CASE WHEN k % 4 = 1 THEN 'https://o' || CAST(k % 9 AS VARCHAR) || '.example.com'
         WHEN k % 8 = 0 OR k % 5 = 0 THEN '*'
         ELSE 'https://' || split_part(url, '/', 3) END AS origin
  FROM based WHERE event_type <> 'view' AND k % 4 <> 2 OR (event_type = 'error' AND k % 30 = 0)),
act AS (SELECT * FROM g WHERE what <> 'none' AND NOT EXISTS (
  SELECT 1 FROM g n WHERE n.profile = g.profile AND n.seq > g.seq AND (n.what = 'none' OR n.origin = g.origin)))
SELECT profile, origin, unnest(CASE WHEN what = 'all' THEN [{_ALL}] WHEN k % 2 = 0 THEN ['camera', 'midi']
  ELSE ['geolocation'] END) AS permission FROM act""")
def permissions_granted(spark, sf):
    return state.permission_state(feeds.permission_log(spark, sf))


@query("geolocation", f"""WITH {BASE},
g AS (SELECT profile, seq, CASE WHEN k = 0 THEN 95.0 ELSE k - 50.0 END AS latitude, CAST(k * 2 - 100 AS DOUBLE) AS longitude,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 1 THEN -1.0 ELSE CAST(k AS DOUBLE) END AS accuracy FROM base)
SELECT profile, seq, CAST(latitude AS DOUBLE) AS latitude, longitude, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY profile ORDER BY seq DESC) AS r FROM g
  WHERE abs(latitude) <= 90 AND abs(longitude) <= 180 AND (accuracy IS NULL OR accuracy >= 0)) WHERE r = 1""")
def geolocation(spark, sf):
    return state.geo_as_of(feeds.geo_log(spark, sf))


def _values(text: str, row) -> str:
    return ", ".join(row(line) for line in text.strip().splitlines())


_VP = _values(settings.VIEWPORTS, lambda s: "('{}', {}, {})".format(*s.split()))
_UA = _values(settings.USER_AGENTS, lambda s: "('{}', '{}')".format(*[p.strip() for p in s.split("|")]))
_DEV = _values(settings.DEVICES, lambda s: "('{0}', {2}, {3}, {4}, {5}, {6}, '{1}')".format(
    s.split("|")[0].strip(), s.split("|")[2].strip(), *s.split("|")[1].split()))

# The twin walks each profile's log with a sorted list fold in chunks of two windows: the running
# "last set before" per field, restarted at every browser restart.
SETTINGS = BASE + f""",
vp(name, w, h) AS (VALUES {_VP}), ua(name, agent) AS (VALUES {_UA}),
dev(name, w, h, scale, mobile, touch, agent) AS (VALUES {_DEV}),
raw AS (
  SELECT profile, seq, k, event_type AS e,
    CASE WHEN event_type = 'purchase' AND k % 9 = 0 THEN ['iphone-15','iphone-se','ipad','ipad-pro','pixel-8','galaxy-s24','desktop-retina'][k % 7 + 1] END AS device,
    CASE WHEN event_type = 'view' THEN ['mobile','tablet','desktop','desktop-hd','desktop-2k'][k % 5 + 1] END AS vpn,
    CASE WHEN event_type = 'error' AND k % 10 = 0 THEN k / 10.0 + 1 END AS scale,
    CASE WHEN event_type = 'error' AND k % 14 = 0 THEN k % 4 = 0 END AS mobile,
    CASE WHEN event_type = 'click' THEN ['chrome-desktop','chrome-mobile','safari-desktop','safari-mobile','firefox-desktop'][k % 5 + 1] END AS uan,
    CASE WHEN event_type IN ('signup','error') AND k % 4 = 0 THEN ['en-US','ru-RU','ja-JP','de-DE'][k % 3 + 1] END AS locale,
    CASE WHEN event_type = 'signup' THEN ['light','dark','no-preference'][k % 3 + 1] END AS scheme
  FROM base WHERE NOT (event_type = 'view' AND k % 3 = 0 AND k % 6 <> 0)),
ch AS (
  SELECT r.profile, r.seq, r.k, r.e, (r.device IS NOT NULL OR r.scale IS NOT NULL OR r.mobile IS NOT NULL) AS restart,
    CASE WHEN d.name IS NOT NULL THEN d.w || 'x' || d.h WHEN r.e = 'view' AND r.k % 6 = 0 THEN (600 + r.k) || 'x' || (400 + r.k)
         WHEN v.name IS NOT NULL THEN v.w || 'x' || v.h END AS viewport,
    coalesce(CAST(d.scale AS DOUBLE), r.scale) AS scale, coalesce(d.mobile, r.mobile) AS mobile, coalesce(d.touch, r.mobile) AS touch,
    CASE WHEN d.name IS NOT NULL THEN d.agent WHEN r.e = 'click' AND r.k % 3 = 0 THEN 'agent/' || r.k ELSE u.agent END AS agent,
    r.locale, r.scheme
  FROM raw r LEFT JOIN dev d ON d.name = r.device LEFT JOIN vp v ON v.name = r.vpn LEFT JOIN ua u ON u.name = r.uan),
rs AS (SELECT profile, max(seq) FILTER (WHERE restart) AS restart_seq, count(*) FILTER (WHERE restart) AS restarts FROM ch GROUP BY 1),
sel AS (SELECT c.*, coalesce(r.restart_seq, -1) AS rseq FROM ch c JOIN rs r ON r.profile = c.profile
        WHERE c.restart OR c.seq > coalesce(r.restart_seq, -1))"""


@query("effective_settings", f"""WITH {SETTINGS}
SELECT s.profile, coalesce(arg_max(viewport, seq) FILTER (WHERE viewport IS NOT NULL), '1280x900') AS viewport,
  arg_max(scale, seq) FILTER (WHERE scale IS NOT NULL) AS scale,
  arg_max(mobile, seq) FILTER (WHERE mobile IS NOT NULL) AS mobile, arg_max(touch, seq) FILTER (WHERE touch IS NOT NULL) AS touch,
  arg_max(agent, seq) FILTER (WHERE agent IS NOT NULL) AS user_agent,
  arg_max(locale, seq) FILTER (WHERE locale IS NOT NULL) AS locale,
  arg_max(scheme, seq) FILTER (WHERE scheme IS NOT NULL) AS color_scheme,
  any_value(r.restarts) AS restarts, any_value(r.restart_seq) AS restart_seq
FROM sel s JOIN rs r ON r.profile = s.profile GROUP BY 1""")
def effective_settings(spark, sf):
    return settings.effective_settings(feeds.settings_log(spark, sf)).drop("headers")


@query("effective_headers", f"""WITH {SETTINGS},
h AS (
  SELECT c.profile, c.seq, 1 AS r, 'User-Agent' AS name, agent AS value FROM ch c JOIN rs ON rs.profile = c.profile
    WHERE agent IS NOT NULL AND NOT restart AND c.seq > coalesce(restart_seq, -1)
  UNION ALL SELECT c.profile, c.seq, 2, 'Accept-Language', locale FROM ch c JOIN rs ON rs.profile = c.profile
    WHERE locale IS NOT NULL AND NOT restart AND c.seq > coalesce(restart_seq, -1)
  UNION ALL SELECT c.profile, max(restart_seq), 0, 'Accept-Language', arg_max(locale, seq) FROM ch c JOIN rs ON rs.profile = c.profile
    WHERE restart AND locale IS NOT NULL GROUP BY 1
  UNION ALL SELECT c.profile, c.seq, 3, 'X-H' || CAST(k % 4 AS VARCHAR), CAST(k AS VARCHAR) FROM ch c JOIN rs ON rs.profile = c.profile
    WHERE e IN ('purchase', 'error') AND c.seq >= coalesce(restart_seq, -1))
SELECT profile, name, arg_max(value, seq * 10 + r) AS value FROM h GROUP BY 1, 2""")
def effective_headers(spark, sf):
    return settings.effective_settings(feeds.settings_log(spark, sf)).select(
        "profile", F.explode("headers").alias("name", "value"))
