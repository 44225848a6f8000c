"""Telemetry feeds derived from the given ``events`` and ``pages`` tables.

The event table plays every raw log; each feed is a projection of it (plus a filter on the
event type where only some types belong to the log), so the work of every query grows with
the table. The SQL twins of these rules are in ``feeds_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import epoch_ms
from ..sources.pages import read_pages_table, spread


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages_table(spark, f"{sf}/pages.parquet")


CALLS_PER_TASK = 100_000  # judging as many takes a core some six seconds


def base(spark: SparkSession, sf: str, rows_per_task: int | None = None) -> DataFrame:
    """Events with typed helper columns; event ids rise with time, so they are the arrival order."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    if not events.isStreaming:
        events = spread(events, rows_per_task)
    return events.select(
        F.col("event_id").alias("seq"),
        epoch_ms(F.col("ts")).alias("ts_ms"),
        "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("profile"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tab_id"),
        "props",
    )


def _url() -> F.Column:
    host = F.when(F.col("k") % 3 == 0, "api").when(F.col("k") % 3 == 1, "cdn").otherwise("www")
    return F.concat(F.lit("https://"), host, F.lit(".example.com/"), F.col("event_type"), F.lit("/"),
                    F.col("k").cast("string"))


def raw_requests(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    broke = (e == "error") & (k % 2 == 1)
    return base(spark, sf).select(
        "seq", "ts_ms", "profile", "tab_id",
        F.when(broke, "failed").otherwise("finished").alias("outcome"),
        F.when(e.isin("signup", "purchase"), "POST").when(e == "error", "PUT").otherwise("GET").alias("method"),
        _url().alias("url"),
        F.when(k % 4 == 0, "xhr").when(k % 4 == 1, "fetch").when(k % 4 == 2, "document").otherwise("script")
        .alias("resource_type"),
        F.when(e == "error", 500 + k % 5).when((e == "view") & (k % 10 == 0), 404).otherwise(200).alias("status"),
        F.when(k % 4 == 1, "net::ERR_FAILED").alias("error_text"),
        F.floor("value").alias("duration_ms"),
        (k % 7 == 0).alias("from_service_worker"),
        k, "props",
    )


def raw_console(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    return base(spark, sf).select(
        "seq", "ts_ms", "profile", "tab_id",
        F.when((e == "error") & (k % 2 == 1), "pageerror").otherwise("console").alias("kind"),
        F.when(e == "click", "log").when(e == "view", "info").when(e == "signup", "debug")
        .when(e == "purchase", F.when(k % 3 == 0, "table").otherwise("warning")).otherwise("error").alias("level"),
        F.concat(e, F.lit(" failed "), k.cast("string")).alias("text"),
        F.when(k % 5 != 0, _url()).alias("loc_url"),
        F.when(k % 3 != 0, k).alias("loc_line"),
        F.when(k % 2 == 0, k + 1).alias("loc_col"),
    )


def raw_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with a body; every tenth ``k`` body exceeds the size cap."""
    k = F.col("k")
    body = F.when(k % 10 == 3, F.repeat("props", 30_000)).otherwise(F.repeat("props", k + 1))
    return raw_requests(spark, sf).filter(F.col("outcome") == "finished").select(
        "seq", "ts_ms", "profile", "tab_id", "method", "status",
        F.when(k % 11 == 0, F.regexp_replace("url", "^https:", "file:")).otherwise(F.col("url")).alias("url"),
        F.when(k % 4 == 0, "application/JSON").when(k % 4 == 1, "text/html; charset=utf-8")
        .when(k % 4 == 2, "image/png").alias("content_type"),
        body.alias("body"),
    )


def request_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose start was seen (very short ones were not)."""
    return base(spark, sf).filter(F.col("value") >= 5).select(F.col("seq").alias("req_id"), "ts_ms", "tab_id")


def request_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that ended (very long ones never did)."""
    return base(spark, sf).filter(F.col("value") < 200).select(
        F.col("seq").alias("req_id"),
        (F.col("ts_ms") + F.floor("value")).alias("ts_ms"),
        F.when(F.col("k") % 5 == 0, F.lit(-1.0)).otherwise(F.col("value")).alias("timing_ms"),
        "profile", "tab_id",
    )


def load_events(spark: SparkSession, sf: str) -> DataFrame:
    """Request timelines of page loads: each user's five-day spell is one load starting at 0.

    ``k`` sets the offset of a request, ``value`` its duration; clicks have an end only.
    """
    ev = base(spark, sf).withColumn(
        "load_id", F.concat_ws("-", "tab_id", F.floor(F.col("ts_ms") / (5 * 86_400_000)).cast("string"))
    )
    begin = F.col("k") * 25
    end = begin + F.floor("value") * 4
    starts = ev.filter(F.col("event_type") != "click").select(
        "load_id", F.lit(0).cast("long").alias("t0_ms"), begin.cast("long").alias("ts_ms"),
        F.lit(1).alias("delta"), (F.col("seq") * 2).alias("seq"))
    ends = ev.filter(F.col("event_type") != "error").select(
        "load_id", F.lit(0).cast("long").alias("t0_ms"), end.cast("long").alias("ts_ms"),
        F.lit(-1).alias("delta"), (F.col("seq") * 2 + 1).alias("seq"))
    # One row per load keeps loads whose events all fall after the cap.
    loads = ev.groupBy("load_id").agg(F.lit(0).cast("long").alias("t0_ms")).select(
        "load_id", "t0_ms", F.lit(None).cast("long").alias("ts_ms"),
        F.lit(None).cast("int").alias("delta"), F.lit(-1).cast("long").alias("seq"))
    return starts.unionByName(ends).unionByName(loads)


def tab_events(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    nav = e.isin("view", "signup")
    return base(spark, sf).filter(e != "error").select(
        "profile", F.concat_ws("/", "profile", F.concat(F.lit("s"), (k % 2).cast("string"))).alias("session"),
        "tab_id", "ts_ms", "seq",
        F.when(e == "view", "navigate").when(e == "click", "switch").when(e == "signup", "open")
        .otherwise("close").alias("action"),
        F.when(nav, _url()).alias("url"),
        F.when(nav, F.concat(F.lit("Page "), k.cast("string"))).alias("title"),
    )


def tab_calls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return base(spark, sf).filter(F.col("event_type") == "error").select(
        "profile", F.concat_ws("/", "profile", F.concat(F.lit("s"), (k % 2).cast("string"))).alias("session"),
        "ts_ms", "seq",
    )


def held_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions opened by views; ``value`` and ``k`` set how long they stay in use."""
    return base(spark, sf).filter(F.col("event_type") == "view").select(
        "profile", F.col("seq").alias("session_id"), F.col("ts_ms").alias("start_ms"),
        (F.col("ts_ms") + F.col("k") * 120_000).alias("end_ms"),
        (F.col("ts_ms") + F.col("k") * 120_000).alias("last_ms"),
    )


def kv_log(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    return base(spark, sf).select(
        "profile", F.concat(F.lit("o"), (F.col("user_id") % 5).cast("string")).alias("origin"),
        F.when(k % 2 == 0, "local").otherwise("session").alias("area"),
        F.when(e == "view", "get").when(e == "purchase", "remove")
        .when((e == "error") & (k % 20 == 0), "clear").otherwise("set").alias("action"),
        F.concat(F.lit("key"), (k % 5).cast("string")).alias("key"),
        F.when(k % 13 != 0, k.cast("string")).alias("value"),
        "ts_ms", "seq",
    )


def cookie_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Set calls with two cookies (one by domain, one by url), clears, and refused calls without a path."""
    e, k = F.col("event_type"), F.col("k")
    by_domain = F.struct(
        F.concat(F.lit("c"), (k % 7).cast("string")).alias("name"),
        F.concat(F.lit("v"), k.cast("string")).alias("value"),
        F.when(k % 3 == 0, ".example.com").when(k % 3 == 1, "api.example.com").otherwise("www.example.com").alias("domain"),
        F.when(e != "purchase", F.when(k % 4 == 0, "/view").otherwise("/")).alias("path"),
        F.lit(None).cast("string").alias("url"),
        F.when(k % 5 == 0, F.lit(-1)).when(k % 5 == 1, F.lit(None)).otherwise(1_704_067_200 + k * 86_400).cast("double").alias("expires"),
        (k % 2 == 0).alias("httpOnly"), (k % 3 == 0).alias("secure"),
        F.when(k % 4 == 1, "Lax").when(k % 4 == 2, "Strict").alias("sameSite"),
    )
    by_url = F.struct(
        F.concat(F.lit("u"), (k % 3).cast("string")).alias("name"), F.col("value").cast("string").alias("value"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("path"), _url().alias("url"),
        F.lit(None).cast("double").alias("expires"), F.lit(False).alias("httpOnly"), F.lit(False).alias("secure"),
        F.lit(None).cast("string").alias("sameSite"),
    )
    return base(spark, sf).filter(e != "view").select(
        "profile", "seq",
        F.when((e == "error") & (k % 25 == 0), "clear").otherwise("set").alias("action"),
        F.array(by_domain, by_url).alias("cookies"),
    )


def dialog_policies(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    return base(spark, sf).filter(e.isin("signup", "purchase")).select(
        "profile", "ts_ms", "seq", F.when(k % 3 == 0, "dismiss").otherwise("accept").alias("action"),
        F.when(k % 4 != 0, F.concat(F.lit("answer "), k.cast("string"))).alias("prompt_text"),
        (k % 2 == 1).alias("persist"),
    )


def dialogs(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).filter(F.col("event_type") == "click").select("profile", "ts_ms", "seq")


def permission_log(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    return base(spark, sf).filter(e != "view").select(
        "profile", "seq",
        F.when((e == "error") & (k % 30 == 0), "none").when(k % 3 == 0, "all").otherwise("list").alias("grant"),
        F.when(k % 2 == 0, F.array(F.lit("camera"), F.lit("midi"))).otherwise(F.array(F.lit("geolocation"))).alias("permissions"),
        F.when(k % 4 == 1, F.concat(F.lit("https://o"), (k % 9).cast("string"), F.lit(".example.com")))
        .when(k % 4 == 2, "ftp://files.example.com").alias("origin"),
        F.when(k % 8 == 0, "about:blank").when(k % 5 != 0, _url()).alias("current_url"),
    )


def geo_log(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return base(spark, sf).select(
        "profile", "seq",
        F.when(k == 0, 95.0).otherwise((k - 50).cast("double")).alias("latitude"),
        (k * 2 - 100).cast("double").alias("longitude"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 7 == 1, -1.0).otherwise(k.cast("double")).cast("double").alias("accuracy"),
    )


def settings_log(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")

    def pick(names: str, n: int):
        return F.element_at(F.array(*[F.lit(x) for x in names.split()]), k % n + 1)

    none = F.lit(None)
    return base(spark, sf).select(
        "profile", "seq",
        F.when((e == "purchase") & (k % 9 == 0),
               pick("iphone-15 iphone-se ipad ipad-pro pixel-8 galaxy-s24 desktop-retina", 7)).alias("device_preset"),
        F.when(e == "view", pick("mobile tablet desktop desktop-hd desktop-2k", 5)).alias("viewport_preset"),
        F.when((e == "view") & (k % 3 == 0), 600 + k).alias("viewport_width"),
        F.when((e == "view") & (k % 6 == 0), 400 + k).alias("viewport_height"),
        F.when((e == "error") & (k % 10 == 0), k / 10.0 + 1).cast("double").alias("device_scale_factor"),
        F.when((e == "error") & (k % 14 == 0), k % 4 == 0).alias("is_mobile"),
        F.when((e == "click") & (k % 3 == 0), F.concat(F.lit("agent/"), k.cast("string"))).alias("user_agent"),
        F.when(e == "click", pick("chrome-desktop chrome-mobile safari-desktop safari-mobile firefox-desktop", 5)).alias("ua_preset"),
        F.when(e.isin("signup", "error") & (k % 4 == 0), pick("en-US ru-RU ja-JP de-DE", 3)).alias("locale"),
        F.when(e == "signup", pick("light dark no-preference", 3)).alias("color_scheme"),
        F.when(e.isin("purchase", "error"), F.create_map(
            F.concat(F.lit("X-H"), (k % 4).cast("string")), k.cast("string"))).otherwise(none.cast("map<string,string>")).alias("extra_headers"),
    )


def checked_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URLs of many kinds spelled from ``k`` and the event type."""
    e, k = F.col("event_type"), F.col("k")
    s = k.cast("string")
    return base(spark, sf).select(
        "seq", k,
        F.when(e == "view", F.concat(F.lit("HTTPS://Www.Example"), s, F.lit(".COM:"), (8000 + k).cast("string"), F.lit("/p?q=1")))
        .when(e == "click", F.concat(F.lit("http://user@"), (k + 100).cast("string"), F.lit("."), (k * 2).cast("string"), F.lit(".1.2/x")))
        .when(e == "signup", F.when(k % 4 == 0, F.concat(F.lit("file:///tmp/"), s)).when(k % 4 == 1, F.concat(F.lit("javascript:void("), s, F.lit(")")))
              .when(k % 4 == 2, "about:blank").otherwise(F.concat(F.lit("plain text "), s)))
        .when(e == "purchase", F.concat(F.lit("http://["), F.when(k % 3 == 0, "FD00").when(k % 3 == 1, "fe80").otherwise("2001"),
                                        F.lit("::"), s, F.lit("]/")))
        .otherwise(F.concat(F.lit("http://"), (k.cast("long") * 2 * 16_777_216 + 257).cast("string"), F.lit("/"))).alias("url"),
    )


def sandbox_requests(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    s = k.cast("string")
    return base(spark, sf).select(
        "seq", F.when(k % 5 == 0, "").otherwise(F.col("profile")).alias("profile"),
        F.when(e == "view", F.concat(F.lit("reports/./"), s, F.lit("//page.html")))
        .when(e == "click", F.concat(F.lit("/srv/pages/downloads/"), F.col("profile"), F.lit("/f"), s))
        .when(e == "signup", F.concat(F.lit("a/../../"), F.col("profile"), F.lit("/g"), s))
        .when(e == "purchase", F.concat(F.repeat(F.lit("../"), k % 6), F.lit("etc/"), s))
        .otherwise(F.concat(F.lit("..n"), s)).alias("path"),
    )


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls with secrets spelled from ``k``; some tools are unknown, some arguments invalid."""
    e, k = F.col("event_type"), F.col("k")
    s = k.cast("string")
    name = (
        F.when(k % 17 == 0, "browser_unknown").when(e == "view", "browser_open").when(e == "click", "browser_type")
        .when(e == "signup", "browser_fill_form").when(e == "purchase", "browser_cookies").otherwise("browser_evaluate")
    )
    bad = k % 9 == 0
    args = (
        F.when(e == "view", F.concat(F.lit('{"url":"'), F.when(bad, "nowhere").otherwise(_url()), F.lit('","tab_id":"t'), s, F.lit('"}')))
        .when(e == "click", F.concat(F.lit('{"target":"Password","target_type":"'), F.when(bad, "guess").otherwise("label"),
                                     F.lit('","text":"secret-'), s, F.lit('","submit":true}')))
        .when(e == "signup", F.concat(F.lit('{"fields":[{"target":"Email","value":"secret-'), s, F.lit('@x.org"},{"target":"Agree"'),
                                      F.when(bad, "").otherwise(',"checked":true'), F.lit("}]}")))
        .when(e == "purchase", F.concat(F.lit('{"action":"set","cookies":[{"name":"sid","value":"secret-'), s, F.lit('","domain":".x.org"'),
                                        F.when(bad, "").otherwise(',"path":"/"'), F.lit("}]}")))
        .otherwise(F.concat(F.lit('{"expression":'), F.when(bad, s).otherwise(F.concat(F.lit('"secret('), s, F.lit(')"'))), F.lit("}")))
    )
    return base(spark, sf, CALLS_PER_TASK).select(
        "seq", "ts_ms", name.alias("name"), args.alias("args"), F.floor("value").alias("elapsed_ms"),
        F.when(k % 11 == 0, F.concat(F.lit("timeout after "), s)).alias("error"),
        (k % 11 == 0).alias("is_error"),
        F.concat(F.lit('[{"type":"image","data":"AA"},{"type":"text","text":"done '), s, F.lit('"}]')).alias("content"),
        F.when(k % 2 == 0, F.concat(F.lit('{"k":'), s, F.lit("}"))).alias("data"),
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    s = k.cast("string")
    url = (
        F.when(e == "view", F.when(k % 5 == 0, "/health").when(k % 5 == 1, F.concat(F.lit("/other/"), s))
               .when(k % 5 == 2, "/api/v1/tools").when(k % 5 == 3, "/api/v1/openapi.json").otherwise("/api/v2/x"))
        .when(e == "click", F.concat(F.lit("/api/v1/tools/browser_read?profile="), F.when(k % 6 == 0, "bad%20name").otherwise(F.col("profile"))))
        .when(e == "signup", F.concat(F.lit("/mcp/"), F.when(k % 7 == 0, "no.good").otherwise(F.col("profile"))))
        .when(e == "purchase", F.concat(F.lit("/api/v1/profiles/"), F.when(k % 8 == 0, "a%2Fb").otherwise(F.col("profile"))))
        .otherwise("/mcpfoo")
    )
    body = F.when(k % 10 == 0, "{broken").when(k % 10 < 5, '{"method":"initialize"}').when(k % 10 == 5, '[{"method":"ping"},{"method":"initialize"}]').otherwise('{"method":"ping"}')
    return base(spark, sf).select(
        "seq",
        F.when(e == "view", F.when(k % 3 == 0, "POST").otherwise("GET"))
        .when(e == "purchase", F.when(k % 4 == 0, "GET").otherwise("DELETE")).otherwise("POST").alias("method"),
        url.alias("url"),
        F.when(k % 12 == 1, "https://evil.example").when(k % 12 == 2, "https://ok.example").alias("origin"),
        F.when(k % 16 != 3, "application/json; charset=utf-8").alias("content_type"),
        (k % 19 != 0).alias("auth_ok"), body.alias("body"),
        F.when(k % 23 == 0, 2_000_000).otherwise(F.length(body)).alias("body_bytes"),
        (k % 29 == 0).alias("body_late"),
        k.alias("live_sessions"), (k % 3 == 0).alias("known_session"), (k % 2 == 0).alias("holder_exists"),
        F.when(k % 31 == 0, 400).otherwise(200).alias("call_status"),
    )


def deployments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return base(spark, sf).select(
        "seq",
        F.when(k % 4 == 0, "127.0.0.1").when(k % 4 == 1, "::1").when(k % 4 == 2, "0.0.0.0").otherwise("box.example.com").alias("host"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "key").alias("api_key"),
        (k % 5 == 0).alias("allow_insecure"),
    )


def config_layers(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("k")
    s = k.cast("string")
    kind = (F.when(e == "view", "string").when(e == "click", "number").when(e == "signup", "bool")
            .when(e == "purchase", "list").otherwise("viewport"))
    cli = F.when(k % 3 == 0, F.when(kind == "number", F.when(k % 2 == 0, s).otherwise("abc"))
                 .when(kind == "bool", F.when(k % 2 == 0, "true").otherwise("false"))
                 .when(kind == "list", F.concat(F.lit("  --a=1,2   --b"), s, F.lit(" ")))
                 .when(kind == "viewport", F.concat(s, F.lit("x"), s)).otherwise(F.concat(F.lit("cli"), s)))
    env = F.when(k % 2 == 0, F.when(kind == "number", "1.5").when(kind == "bool", F.when(k % 4 == 0, "0").otherwise("no"))
                 .when(kind == "list", "--env").when(kind == "viewport", "10X20").otherwise("env"))
    fallback = (F.when(kind == "number", "7").when(kind == "bool", "true").when(kind == "list", F.lit(None))
                .when(kind == "viewport", F.when(k % 5 == 0, "wide").otherwise("1280x900")).otherwise("default"))
    return base(spark, sf).select("seq", kind.alias("kind"), cli.alias("cli"), env.alias("env"), fallback.alias("fallback"))
