"""SQL twins of the feeds: named CTE texts over the given tables."""

BASE = """base AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value, props,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         'p' || CAST(user_id % 10 AS VARCHAR) AS profile, 't' || CAST(user_id AS VARCHAR) AS tab_id
  FROM events),
based AS (
  SELECT *, 'https://' || CASE k % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'cdn' ELSE 'www' END
            || '.example.com/' || event_type || '/' || CAST(k AS VARCHAR) AS url FROM base)"""

NET = BASE + """,
net AS (
  SELECT seq, ts_ms, profile, tab_id, k, props,
    CASE WHEN event_type IN ('signup','purchase') THEN 'POST' WHEN event_type = 'error' THEN 'PUT' ELSE 'GET' END AS method,
    url,
    CASE k % 4 WHEN 0 THEN 'xhr' WHEN 1 THEN 'fetch' WHEN 2 THEN 'document' ELSE 'script' END AS resource_type,
    CASE WHEN event_type = 'error' AND k % 2 = 1 THEN NULL WHEN event_type = 'error' THEN 500 + k % 5
         WHEN event_type = 'view' AND k % 10 = 0 THEN 404 ELSE 200 END AS status,
    CAST(floor(value) AS BIGINT) AS duration_ms,
    CASE WHEN k % 7 = 0 AND NOT (event_type = 'error' AND k % 2 = 1) THEN TRUE END AS from_cache,
    CASE WHEN event_type = 'error' AND k % 2 = 1
         THEN CASE WHEN k % 4 = 1 THEN 'net::ERR_FAILED' ELSE 'failed' END END AS failed
  FROM based)"""

CONSOLE = BASE + """,
console AS (
  SELECT seq, ts_ms, profile, tab_id,
    CASE event_type WHEN 'click' THEN 'log' WHEN 'view' THEN 'info' WHEN 'signup' THEN 'debug'
      WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'log' ELSE 'warn' END
      ELSE CASE WHEN k % 2 = 1 THEN 'pageerror' ELSE 'error' END END AS level,
    event_type || ' failed ' || CAST(k AS VARCHAR) AS text,
    CASE WHEN k % 5 <> 0 AND NOT (event_type = 'error' AND k % 2 = 1) THEN
      url || ':' || CAST(CASE WHEN k % 3 <> 0 THEN k ELSE 0 END AS VARCHAR)
          || ':' || CAST(CASE WHEN k % 2 = 0 THEN k + 1 ELSE 0 END AS VARCHAR) END AS location
  FROM based)"""

BODIES = NET + """,
resp AS (
  SELECT seq, ts_ms, profile, tab_id, method, status,
    CASE WHEN k % 11 = 0 THEN 'file:' || substr(url, 7) ELSE url END AS url,
    CASE k % 4 WHEN 0 THEN 'application/JSON' WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN 'image/png' END AS content_type,
    CASE WHEN k % 10 = 3 THEN repeat(props, 30000) ELSE repeat(props, k + 1) END AS body
  FROM net WHERE failed IS NULL),
bodies AS (
  SELECT * FROM resp
  WHERE (starts_with(url, 'http://') OR starts_with(url, 'https://'))
    AND regexp_matches(lower(coalesce(content_type, '')), 'json|text|xml|javascript|urlencoded')
    AND octet_length(encode(body)) <= 262144)"""

TABS = BASE + """,
tabs AS (
  SELECT profile, profile || '/s' || CAST(k % 2 AS VARCHAR) AS session, tab_id, ts_ms, seq,
    CASE event_type WHEN 'view' THEN 'navigate' WHEN 'click' THEN 'switch' WHEN 'signup' THEN 'open' ELSE 'close' END AS action,
    CASE WHEN event_type IN ('view','signup') THEN url END AS url,
    CASE WHEN event_type IN ('view','signup') THEN 'Page ' || CAST(k AS VARCHAR) END AS title
  FROM based WHERE event_type <> 'error'),
calls AS (
  SELECT profile, profile || '/s' || CAST(k % 2 AS VARCHAR) AS session, ts_ms, seq FROM based WHERE event_type = 'error')"""

HELD = BASE + """,
held AS (
  SELECT profile, seq AS session_id, ts_ms AS start_ms, ts_ms + k * 120000 AS end_ms, ts_ms + k * 120000 AS last_ms
  FROM base WHERE event_type = 'view')"""

LOADS = BASE + """,
ev AS (SELECT *, tab_id || '-' || CAST(ts_ms // 432000000 AS VARCHAR) AS load_id FROM base),
steps AS (
  SELECT load_id, k * 25 AS ts_ms, 1 AS delta, seq * 2 AS seq FROM ev WHERE event_type <> 'click'
  UNION ALL
  SELECT load_id, k * 25 + CAST(floor(value) AS BIGINT) * 4, -1, seq * 2 + 1 FROM ev WHERE event_type <> 'error')"""
