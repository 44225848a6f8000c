"""Registered queries for rules, call logs and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import check_manifest, resolve_target, sandbox_paths
from ..functions.urls import origin_verdict, url_verdict
from ..operators import calls, rules
from ..operators.tool_catalog import tool_rows, tools_table
from . import feeds
from .feeds_sql import BASE
from .registry import query

URLS = BASE + """,
u AS (SELECT seq, k, event_type AS e,
  CASE event_type WHEN 'view' THEN 'HTTPS://Www.Example' || k || '.COM:' || (8000 + k) || '/p?q=1'
    WHEN 'click' THEN 'http://user@' || (k + 100) || '.' || (k * 2) || '.1.2/x'
    WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'file:///tmp/' || k WHEN 1 THEN 'javascript:void(' || k || ')'
         WHEN 2 THEN 'about:blank' ELSE 'plain text ' || k END
    WHEN 'purchase' THEN 'http://[' || CASE k % 3 WHEN 0 THEN 'FD00' WHEN 1 THEN 'fe80' ELSE '2001' END || '::' || k || ']/'
    ELSE 'http://' || (CAST(k AS BIGINT) * 33554432 + 257) || '/' END AS url FROM base),
h AS (SELECT *,
  CASE e WHEN 'view' THEN 'www.example' || k || '.com' WHEN 'click' THEN (k + 100) || '.' || (k * 2) || '.1.2'
    WHEN 'purchase' THEN '[' || CASE k % 3 WHEN 0 THEN 'fd00' WHEN 1 THEN 'fe80' ELSE '2001' END
       || CASE WHEN k = 0 THEN '::' ELSE '::' || k END || ']'
    WHEN 'error' THEN (k * 2) || '.0.1.1' END AS host,
  CASE e WHEN 'click' THEN (k + 100) IN (127) OR (k + 100 = 172 AND k * 2 BETWEEN 16 AND 31)
       OR (k + 100 = 192 AND k * 2 = 168) OR (k + 100 = 169 AND k * 2 = 254)
    WHEN 'purchase' THEN k % 3 IN (0, 1) WHEN 'error' THEN k * 2 IN (0, 10, 127) ELSE FALSE END AS private FROM u),
v AS (SELECT *, CASE WHEN e = 'signup' THEN CASE k % 4 WHEN 0 THEN 'file:// URLs are blocked by default.'
      WHEN 1 THEN 'URL scheme ''javascript:'' is not allowed. Only http:, https:, about:blank are supported by default.'
      WHEN 3 THEN 'invalid URL: ' || url END
    WHEN private THEN 'host ''' || host || ''' is a private/loopback/link-local address.' END AS reason FROM h)"""


@query("url_verdicts", f"WITH {URLS} SELECT seq, url, host, reason, reason IS NULL AS safe FROM v")
def url_verdicts(spark, sf):
    return url_verdict(feeds.checked_urls(spark, sf)).drop("k")


@query("origin_verdicts", f"""WITH {URLS}
SELECT seq, url, CASE WHEN e <> 'signup' THEN CASE WHEN e = 'view' THEN 'https://' || host || ':' || (8000 + k) ELSE 'http://' || host END END AS origin,
  coalesce(reason, CASE WHEN url = 'about:blank' THEN 'permissions origin must be http(s), got about:' END) AS reason,
  reason IS NULL AND url <> 'about:blank' AS safe FROM v""")
def origin_verdicts(spark, sf):
    return origin_verdict(feeds.checked_urls(spark, sf)).drop("k")


@query("page_url_verdicts", """SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host,
  NULL AS reason, TRUE AS safe FROM pages""")
def page_url_verdicts(spark, sf):
    return url_verdict(feeds.pages(spark, sf)).select("page_id", "host", "reason", "safe")


@query("sandbox_paths", f"""WITH {BASE},
r AS (SELECT seq, k, event_type AS e, profile AS own, CASE WHEN k % 5 = 0 THEN '' ELSE profile END AS profile FROM base),
p AS (SELECT *, CASE WHEN profile = '' THEN 'default' ELSE profile END AS box,
  CASE e WHEN 'view' THEN 'reports/./' || k || '//page.html' WHEN 'click' THEN '/srv/pages/downloads/' || own || '/f' || k
    WHEN 'signup' THEN 'a/../../' || own || '/g' || k WHEN 'purchase' THEN repeat('../', k % 6) || 'etc/' || k ELSE '..n' || k END AS path FROM r),
o AS (SELECT *, CASE e WHEN 'view' THEN '/srv/pages/downloads/' || box || '/reports/' || k || '/page.html'
    WHEN 'click' THEN CASE WHEN own = box THEN path END WHEN 'signup' THEN CASE WHEN own = box THEN '/srv/pages/downloads/' || own || '/g' || k END
    WHEN 'purchase' THEN CASE WHEN k % 6 = 0 THEN '/srv/pages/downloads/' || box || '/etc/' || k END END AS resolved FROM p)
SELECT seq, profile, path, resolved, resolved IS NOT NULL AS ok,
  CASE WHEN resolved IS NULL THEN 'path ''' || path || ''' escapes the download sandbox (/srv/pages/downloads/' || box || ').' END AS reason
FROM o""")
def sandbox_check(spark, sf):
    return sandbox_paths(feeds.sandbox_requests(spark, sf))


@query("upload_manifest", f"""WITH {BASE},
m AS (SELECT seq, profile, k, 'docs/' || k || '.txt' AS path FROM base WHERE event_type = 'view'
      UNION ALL SELECT seq, profile, k, '../' || profile || 'x/' || k FROM base WHERE event_type = 'click'),
l AS (SELECT DISTINCT profile, k, k % 3 <> 0 AS is_file FROM base WHERE event_type = 'signup')
SELECT m.seq, m.profile, m.path, CASE WHEN m.path LIKE 'docs%' THEN '/srv/pages/uploads/' || m.profile || '/' || m.path END AS resolved,
  m.path LIKE 'docs%' AND coalesce(l.is_file, FALSE) AS ok,
  CASE WHEN m.path NOT LIKE 'docs%' THEN 'upload path ''' || m.path || ''' escapes the upload sandbox (/srv/pages/uploads/' || m.profile || ').'
    WHEN l.k IS NULL THEN 'file not found: /srv/pages/uploads/' || m.profile || '/' || m.path
    WHEN NOT l.is_file THEN 'not a regular file: /srv/pages/uploads/' || m.profile || '/' || m.path END AS reason
FROM m LEFT JOIN l ON l.profile = m.profile AND l.k = m.k""")
def upload_manifest(spark, sf):
    ev = feeds.base(spark, sf)
    k = F.col("k").cast("string")
    manifest = ev.filter(F.col("event_type").isin("view", "click")).select(
        "seq", "profile",
        F.when(F.col("event_type") == "view", F.concat(F.lit("docs/"), k, F.lit(".txt")))
        .otherwise(F.concat(F.lit("../"), F.col("profile"), F.lit("x/"), k)).alias("path"))
    listing = ev.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("/srv/pages/uploads/"), F.col("profile"), F.lit("/docs/"), k, F.lit(".txt")).alias("path"),
        (F.col("k") % 3 != 0).alias("is_file")).distinct()
    return check_manifest(manifest, listing)


@query("download_targets", f"""WITH {BASE}
SELECT seq, CASE event_type WHEN 'view' THEN 'in/' || CASE WHEN k % 4 = 0 OR k % 4 = 1 THEN 'download' ELSE 'f' || k END
  WHEN 'click' THEN 'in\\' || CASE WHEN k % 4 = 0 OR k % 4 = 1 THEN 'download' ELSE 'f' || k END ELSE 'out/' || k END AS target FROM base""")
def download_targets(spark, sf):
    e, k = F.col("event_type"), F.col("k")
    save_to = F.when(e == "view", "in/").when(e == "click", "in\\").otherwise(F.concat(F.lit("out/"), k.cast("string")))
    suggested = F.when(k % 4 == 0, "").when(k % 4 != 1, F.concat(F.lit("f"), k.cast("string")))
    return feeds.base(spark, sf).select("seq", resolve_target(save_to, suggested).alias("target"))


@query("cors_verdicts", f"""WITH {BASE},
o AS (SELECT seq, CASE k % 5 WHEN 0 THEN 'https://a.example' WHEN 1 THEN 'null' WHEN 2 THEN 'https://A.example' WHEN 3 THEN 'https://b.example' END AS origin FROM base)
SELECT *, origin IS NULL OR origin IN ('https://a.example', 'null') AS origin_ok,
  CASE WHEN origin NOT IN ('https://a.example', 'null') THEN 'origin ''' || origin || ''' not allowed' END AS origin_reason FROM o""")
def cors_verdicts(spark, sf):
    k = F.col("k")
    log = feeds.base(spark, sf).select("seq", F.when(k % 5 == 0, "https://a.example").when(k % 5 == 1, "null").when(
        k % 5 == 2, "https://A.example").when(k % 5 == 3, "https://b.example").alias("origin"))
    return rules.cors_verdict(log, " https://a.example , null,")


@query("gate_status", f"""WITH {BASE},
r AS (SELECT *, event_type AS e, k % 12 = 1 AS evil, k % 16 = 3 AS untyped, k % 19 = 0 AS anon,
   CASE WHEN k % 23 = 0 THEN 413 WHEN k % 29 = 0 THEN 408 WHEN k % 10 = 0 THEN 500 END AS body_fail FROM base)
SELECT seq, CASE
  WHEN e = 'view' THEN CASE
     WHEN k % 5 = 0 AND k % 3 <> 0 THEN 200
     WHEN k % 5 IN (0, 1) THEN 404 WHEN evil THEN 403 WHEN k % 3 = 0 AND untyped THEN 415 WHEN anon THEN 401
     WHEN k % 5 = 4 THEN 404 WHEN k % 3 = 0 THEN 405 ELSE 200 END
  WHEN evil THEN 403
  WHEN e = 'purchase' THEN CASE WHEN anon THEN 401 WHEN k % 4 = 0 THEN 405 WHEN k % 8 = 0 THEN 400 ELSE 200 END
  WHEN untyped THEN 415 WHEN anon THEN 401
  WHEN e = 'click' THEN CASE WHEN k % 6 = 0 THEN 400 WHEN body_fail IS NOT NULL THEN body_fail
     WHEN k % 2 = 1 AND k >= 50 THEN 503 WHEN k % 31 = 0 THEN 400 ELSE 200 END
  WHEN e = 'signup' AND k % 7 = 0 THEN 400
  WHEN body_fail IS NOT NULL THEN body_fail WHEN k % 3 = 0 THEN 200 WHEN k % 10 > 5 THEN 400 WHEN k >= 50 THEN 503 ELSE 200 END AS gate_status
FROM r""")
def gate_status(spark, sf):
    return rules.gate_status(feeds.request_log(spark, sf), rules.GateConfig(cors="https://ok.example")).select(
        "seq", "gate_status")


@query("api_routes", f"""WITH {BASE}
SELECT seq, CASE event_type WHEN 'view' THEN CASE k % 5 WHEN 2 THEN CASE WHEN k % 3 = 0 THEN 'method_not_allowed' ELSE 'tools' END
     WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'method_not_allowed' ELSE 'openapi' END END
  WHEN 'click' THEN 'tool' WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'method_not_allowed' ELSE 'release' END END AS kind,
  CASE event_type WHEN 'click' THEN 'browser_read' WHEN 'purchase' THEN CASE WHEN k % 4 <> 0 THEN profile END END AS name
FROM base""")
def api_routes(spark, sf):
    route = rules.parse_route(F.col("method"), F.regexp_extract("url", "^([^?#]*)", 1))
    return feeds.request_log(spark, sf).select("seq", route["kind"].alias("kind"), route["name"].alias("name"))


@query("profile_names", f"""WITH {BASE},
n AS (SELECT seq, CASE k % 6 WHEN 0 THEN profile WHEN 1 THEN profile || '.x' WHEN 2 THEN '' WHEN 3 THEN repeat('a', 60 + k % 10)
    WHEN 4 THEN 'ok_-' || k ELSE profile || chr(10) END AS name FROM base)
SELECT seq, name, regexp_full_match(name, '[a-zA-Z0-9_-]{{1,64}}') AS valid,
  CASE WHEN name = '' THEN 'default' WHEN regexp_full_match(name, '[a-zA-Z0-9_-]{{1,64}}') THEN name END AS path_profile FROM n""")
def profile_names(spark, sf):
    k = F.col("k")
    name = (F.when(k % 6 == 0, F.col("profile")).when(k % 6 == 1, F.concat("profile", F.lit(".x"))).when(k % 6 == 2, "")
            .when(k % 6 == 3, F.repeat(F.lit("a"), 60 + k % 10)).when(k % 6 == 4, F.concat(F.lit("ok_-"), k.cast("string")))
            .otherwise(F.concat("profile", F.lit("\n"))))
    return feeds.base(spark, sf).select("seq", name.alias("name")).select(
        "seq", "name", rules.valid_profile(F.col("name")).alias("valid"),
        rules.profile_from_path(F.concat(F.lit("/mcp/"), F.col("name")))["profile"].alias("path_profile"))


@query("deployment_audit", f"""WITH {BASE}
SELECT seq, CASE WHEN k % 4 >= 2 AND k % 3 <> 1 AND k % 5 <> 0 THEN 'host is bound to ''' ||
  CASE WHEN k % 4 = 2 THEN '0.0.0.0' ELSE 'box.example.com' END || ''' (not loopback) and no API key is set.' END AS problem FROM base""")
def deployment_audit(spark, sf):
    return rules.config_audit(feeds.deployments(spark, sf)).select("seq", "problem")


@query("config_layers", f"""WITH {BASE}
SELECT seq, CASE event_type
  WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'cli' || k WHEN k % 2 = 0 THEN 'env' ELSE 'default' END
  WHEN 'click' THEN CASE WHEN k % 6 = 0 THEN CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN '1.5' ELSE '7' END
  WHEN 'signup' THEN CASE WHEN k % 6 = 0 THEN 'true' WHEN k % 3 = 0 THEN 'false' WHEN k % 4 = 0 THEN 'false' ELSE 'true' END
  WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN '["--a=1,2","--b' || k || '"]' WHEN k % 2 = 0 THEN '["--env"]' ELSE '[]' END
  ELSE CASE WHEN k % 3 = 0 THEN k || 'x' || k WHEN k % 2 = 0 THEN '10x20' WHEN k % 5 = 0 THEN NULL ELSE '1280x900' END END AS resolved
FROM base""")
def config_layers(spark, sf):
    return rules.resolve_config(feeds.config_layers(spark, sf)).select("seq", "resolved")


@query("scroll_percent", f"""WITH {BASE}
SELECT seq, CASE WHEN k * 40 <= 900 THEN 0 ELSE CAST(floor(CAST(value AS DOUBLE) / (k * 40 - 900) * 100 + 0.5) AS BIGINT) END AS pct FROM base""")
def scroll_percent(spark, sf):
    return feeds.base(spark, sf).select(
        "seq", rules.scroll_pct(F.col("value"), F.col("k") * 40, F.lit(900)).alias("pct"))


CALLS = BASE + """,
c AS (SELECT seq, ts_ms, k, event_type AS e, k % 9 = 0 AS bad, value,
  CASE WHEN k % 17 = 0 THEN 'browser_unknown' ELSE CASE event_type WHEN 'view' THEN 'browser_open' WHEN 'click' THEN 'browser_type'
    WHEN 'signup' THEN 'browser_fill_form' WHEN 'purchase' THEN 'browser_cookies' ELSE 'browser_evaluate' END END AS name,
  CASE event_type WHEN 'view' THEN '{"url":"' || CASE WHEN k % 9 = 0 THEN 'nowhere' ELSE url END || '","tab_id":"t' || k || '"}'
    WHEN 'click' THEN '{"target":"Password","target_type":"' || CASE WHEN k % 9 = 0 THEN 'guess' ELSE 'label' END
      || '","text":"secret-' || k || '","submit":true}'
    WHEN 'signup' THEN '{"fields":[{"target":"Email","value":"secret-' || k || '@x.org"},{"target":"Agree"'
      || CASE WHEN k % 9 = 0 THEN '' ELSE ',"checked":true' END || '}]}'
    WHEN 'purchase' THEN '{"action":"set","cookies":[{"name":"sid","value":"secret-' || k || '","domain":".x.org"'
      || CASE WHEN k % 9 = 0 THEN '' ELSE ',"path":"/"' END || '}]}'
    ELSE '{"expression":' || CASE WHEN k % 9 = 0 THEN CAST(k AS VARCHAR) ELSE '"secret(' || k || ')"' END || '}' END AS args
  FROM based),
red AS (SELECT *, CASE WHEN name = 'browser_unknown' OR e = 'view' THEN args
    WHEN e = 'error' THEN '{"expression":"«redacted ' || CASE WHEN bad THEN length(CAST(k AS VARCHAR)) ELSE length('secret(' || k || ')') END || 'ch»"}'
    ELSE regexp_replace(args, 'secret-[0-9]+(@x.org)?', '«redacted»') END AS redacted FROM c),
st AS (SELECT *, CASE WHEN name = 'browser_unknown' THEN 404 WHEN bad THEN 400 ELSE 200 END AS status, k % 11 = 0 AS broke FROM red)"""


@query("redacted_calls", f"WITH {CALLS} SELECT seq, name, redacted FROM red")
def redacted_calls(spark, sf):
    return calls.redact_args(feeds.tool_calls(spark, sf)).select("seq", "name", "redacted")


# White space that may stand around JSON, by call.
_SPACED = r"""CASE seq % 4 WHEN 0 THEN {n} WHEN 1 THEN {t} WHEN 2 THEN {r} || {n} ELSE '  ' || {n} || ' ' END || args || {n}"""
_SPACED_DUCK = _SPACED.format(n="chr(10)", t="chr(9)", r="chr(13)")
_SPACED_SPARK = _SPACED.format(n="char(10)", t="char(9)", r="char(13)")


def _spaced(spark, sf):
    return feeds.tool_calls(spark, sf).withColumn("args", F.expr(_SPACED_SPARK))


@query("redacted_spaced_calls", f"""WITH {CALLS}
SELECT seq, name, CASE WHEN name = 'browser_unknown' OR e = 'view' THEN {_SPACED_DUCK} ELSE redacted END AS redacted FROM red""")
def redacted_spaced_calls(spark, sf):
    return calls.redact_args(_spaced(spark, sf)).select("seq", "name", "redacted")


@query("classified_spaced_calls", f"WITH {CALLS} SELECT seq, name, status FROM st")
def classified_spaced_calls(spark, sf):
    return calls.classify_calls(_spaced(spark, sf)).select("seq", "name", "status")


# All tools whose arguments carry secrets, with objects, lists and broken text; the same expression in both dialects.
_TOOLS = """CASE seq % 10 WHEN 0 THEN 'browser_type' WHEN 1 THEN 'browser_save' WHEN 2 THEN 'browser_download_wait' WHEN 3 THEN 'browser_storage'
  WHEN 4 THEN 'browser_handle_dialog' WHEN 5 THEN 'browser_cookies' WHEN 6 THEN 'browser_fill_form' WHEN 7 THEN 'browser_evaluate'
  WHEN 8 THEN 'browser_upload' ELSE 'browser_configure' END"""
_SECRET = "'s3cret ' || CAST(k AS {text})"
_ARGS = """CASE WHEN k % 13 = 5 THEN '{{"text":"' || {secret} WHEN k % 11 = 3 THEN '[1,"x"]' ELSE
  CASE seq % 10 WHEN 0 THEN '{{"target":"a","text":"' || {secret} || '","submit":true}}' WHEN 1 THEN '{{"path":"' || {secret} || '","format":"pdf"}}'
  WHEN 2 THEN '{{"action":"click","save_to":"' || {secret} || '"}}' WHEN 3 THEN '{{"action":"set","key":"k","value":"' || {secret} || '"}}'
  WHEN 4 THEN '{{"prompt_text":"' || {secret} || '"}}' WHEN 5 THEN '{{"cookies":[{{"name":"n","value":"' || {secret} || '"}},{{"name":"m"}}]}}'
  WHEN 6 THEN '{{"fields":[{{"target":"t","value":"' || {secret} || '"}},{{"target":"u","checked":true}}]}}' WHEN 7 THEN '{{"expression":"' || {secret} || '"}}'
  WHEN 8 THEN '{{"files":["' || {secret} || '","b"]}}' ELSE '{{"locale":"de","extra_headers":{{"A":"' || {secret} || '","B":"x"}}}}' END END"""


@query("redacted_tool_calls", f"""WITH {BASE}, a AS (SELECT seq, k, {_TOOLS} AS name, {_ARGS.format(secret=_SECRET.format(text="VARCHAR"))} AS args FROM base)
SELECT seq, name, CASE WHEN k % 13 = 5 THEN '"«redacted»"' WHEN k % 11 = 3 THEN args
  WHEN name = 'browser_cookies' THEN '{{"cookies":[{{"name":"n","value":"«redacted»"}},{{"name":"m","value":"«redacted»"}}]}}'
  WHEN name = 'browser_evaluate' THEN '{{"expression":"«redacted ' || (7 + length(CAST(k AS VARCHAR))) || 'ch»"}}' WHEN name = 'browser_upload' THEN '{{"files":"«2 files»"}}'
  WHEN name = 'browser_configure' THEN '{{"locale":"de","extra_headers":{{"A":"«redacted»","B":"«redacted»"}}}}'
  ELSE regexp_replace(args, 's3cret [0-9]+', '«redacted»') END AS redacted FROM a""")
def redacted_tool_calls(spark, sf):
    made = feeds.base(spark, sf).select("seq", "k", F.expr(_TOOLS).alias("name"), F.expr(_ARGS.format(secret=_SECRET.format(text="STRING"))).alias("args"))
    return calls.redact_args(made).select("seq", "name", "redacted")


_HANDLED = """CASE seq % 4 WHEN 0 THEN 'browser_wait' WHEN 1 THEN 'browser_configure' WHEN 2 THEN 'browser_storage' ELSE 'browser_download_wait' END"""
_HANDLED_ARGS = """CASE seq % 4 WHEN 0 THEN CASE k % 3 WHEN 0 THEN '{"selector":"a"}' WHEN 1 THEN '{"selector":"a","condition":"b"}' ELSE '{}' END
  WHEN 1 THEN CASE k % 3 WHEN 0 THEN '{"viewport_width":800,"viewport_height":600}' WHEN 1 THEN '{"viewport_width":800}' ELSE '{"locale":"de"}' END
  WHEN 2 THEN CASE k % 3 WHEN 0 THEN '{"action":"set","key":"a","value":"b"}' WHEN 1 THEN '{"action":"set","key":"a"}' ELSE '{"action":"remove"}' END
  ELSE CASE k % 3 WHEN 0 THEN '{"action":"click","target":"a","save_to":"f"}' WHEN 1 THEN '{"action":"navigate","save_to":"f"}' ELSE '{"action":"click","save_to":"f"}' END END"""


@query("handler_outcomes", f"""WITH {BASE}, a AS (SELECT seq, k, {_HANDLED} AS name FROM base),
p AS (SELECT *, CASE WHEN name = 'browser_wait' AND k % 3 > 0 THEN 'provide exactly one of `selector` or `condition`'
  WHEN name = 'browser_configure' AND k % 3 = 1 THEN 'viewport_width and viewport_height must be set together.'
  WHEN name = 'browser_storage' AND k % 3 = 1 THEN '`key` and `value` are required for action=''set'''
  WHEN name = 'browser_storage' AND k % 3 = 2 THEN '`key` is required for action=''remove'''
  WHEN name = 'browser_download_wait' AND k % 3 = 1 THEN 'url required for action=''navigate'''
  WHEN name = 'browser_download_wait' AND k % 3 = 2 THEN 'target required for action=''click''' END AS problem FROM a)
SELECT seq, name, 200 AS status, problem IS NULL AS ok, 'Error in ' || name || ': ' || problem AS error_message FROM p""")
def handler_outcomes(spark, sf):
    made = feeds.base(spark, sf).select(
        "seq", F.expr(_HANDLED).alias("name"), F.expr(_HANDLED_ARGS).alias("args"), F.lit(False).alias("is_error"), F.lit("[]").alias("content"))
    return calls.classify_calls(made).select("seq", "name", "status", "ok", "error_message")


@query("call_log_lines", f"""WITH {CALLS}
SELECT seq, ts_ms, name, redacted, CAST(floor(value) AS BIGINT) AS elapsed_ms, NOT broke AS ok,
  '→ ' || name || ' ' || CASE WHEN length(redacted) > 200 THEN substr(redacted, 1, 200) || '…' ELSE redacted END AS start_line,
  CASE WHEN broke THEN 'ERROR ' || name || ' (' || CAST(floor(value) AS BIGINT) || 'ms): timeout after ' || k
       ELSE '✓ ' || name || ' (' || CAST(floor(value) AS BIGINT) || 'ms)' END AS end_line FROM st""")
def call_log_lines(spark, sf):
    return calls.call_log(feeds.tool_calls(spark, sf))


@query("call_outcomes", f"""WITH {CALLS}
SELECT seq, broke AS is_error, CASE WHEN broke THEN 'Error in ' || name || ': timeout after ' || k
  ELSE '[{{"type":"image","data":"AA"}},{{"type":"text","text":"done ' || k || '"}}]' END AS outcome_text FROM st""")
def call_outcomes(spark, sf):
    log = feeds.tool_calls(spark, sf).drop("is_error")
    return calls.with_outcome(log, text="content").select("seq", "is_error", "outcome_text")


_ISSUE = """CASE WHEN status <> 400 THEN NULL ELSE CASE e WHEN 'view' THEN 'url:invalid_format' WHEN 'click' THEN 'target_type:invalid_value'
  WHEN 'signup' THEN 'fields:custom' WHEN 'purchase' THEN 'cookies:custom' ELSE 'expression:invalid_type' END END"""


@query("classified_calls", f"""WITH {CALLS}
SELECT seq, status, status = 200 AND NOT broke AS ok, {_ISSUE} AS issues,
  CASE WHEN status = 404 THEN 'unknown tool: browser_unknown' WHEN status = 400 THEN 'invalid arguments'
       WHEN broke THEN 'done ' || k END AS error_message FROM st""")
def classified_calls(spark, sf):
    got = calls.classify_calls(feeds.tool_calls(spark, sf))
    text = F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",")
    return got.select("seq", "status", "ok", F.when(F.col("status") == 400, text).alias("issues"), "error_message")


@query("call_defaults", f"""WITH {CALLS}
SELECT seq, CASE WHEN status = 200 THEN CASE e WHEN 'click' THEN left(args, length(args) - 1) || ',"exact":false}}'
  ELSE args END END AS filled FROM st""")
def call_defaults(spark, sf):
    return calls.validate_args(feeds.tool_calls(spark, sf)).select("seq", "filled")


@query("call_envelopes", f"""WITH {CALLS}, x AS (SELECT *, {_ISSUE} AS issue,
    CASE WHEN k % 2 = 0 THEN ',"data":{{"k":' || k || '}}' ELSE '' END
    || ',"content":[{{"type":"image","data":"AA"}},{{"type":"text","text":"done ' || k || '"}}]}}' AS rest FROM st)
SELECT seq, CASE WHEN status = 404 THEN '{{"ok":false,"error":{{"message":"unknown tool: browser_unknown"}}}}'
  WHEN status = 400 THEN '{{"ok":false,"error":{{"message":"invalid arguments","issues":[{{"path":"' || split_part(issue, ':', 1)
     || '","code":"' || split_part(issue, ':', 2) || '"}}]}}}}'
  WHEN broke THEN '{{"ok":false,"error":{{"message":"done ' || k || '"}}' || rest ELSE '{{"ok":true' || rest END AS envelope FROM x""")
def call_envelopes(spark, sf):
    return calls.envelope(calls.classify_calls(feeds.tool_calls(spark, sf))).select("seq", "envelope")


@query("tool_usage", f"""WITH {CALLS}, n AS (SELECT name, count(*) AS calls FROM c GROUP BY 1),
t(name) AS (VALUES {", ".join(f"('{n}')" for n, _ in tool_rows())})
SELECT t.name, coalesce(n.calls, 0) AS calls FROM t LEFT JOIN n ON n.name = t.name""")
def tool_usage(spark, sf):
    used = feeds.tool_calls(spark, sf).groupBy("name").agg(F.count("*").alias("calls"))
    return tools_table(spark).join(used, "name", "left").select("name", F.coalesce("calls", F.lit(0)).alias("calls"))


@query("known_roles", f"""WITH {BASE},
r AS (SELECT seq, CASE k % 4 WHEN 0 THEN 'button' WHEN 1 THEN 'treegrid' WHEN 2 THEN 'Button' END AS role FROM base)
SELECT seq, coalesce(role IN ('button', 'treegrid'), FALSE) AS known FROM r""")
def known_roles(spark, sf):
    k = F.col("k")
    role = F.when(k % 4 == 0, "button").when(k % 4 == 1, "treegrid").when(k % 4 == 2, "Button")
    return feeds.base(spark, sf).select("seq", rules.valid_role(role).alias("known"))
