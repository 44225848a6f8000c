"""URLs, paths, call arguments, redaction and settings on fixed rows."""

import json

import pytest
from pyspark.sql import functions as F

from pagespark.functions.paths import sandbox_paths
from pagespark.functions.text import log_value, pad_end
from pagespark.functions.urls import origin_verdict, url_verdict
from pagespark.operators import calls, rules, settings

SAFE = ["https://example.org/a", "HTTP://EX.com:81", "about:blank", "http://172.15.0.1", "http://172.32.0.1", "http://11.0.0.1",
        "http://[2001:db8::1]/", "http://[fe90::1]/", "http://[::ffff:127.0.0.1]/", "https://localhost.example"]
UNSAFE = ["http://127.0.0.1", "http://10.1.2.3", "http://172.16.0.1", "http://172.31.255.255", "http://192.168.0.9",
          "http://169.254.169.254/meta", "http://0.0.0.0", "http://localhost:3000", "http://LOCALHOST", "http://[::1]/", "http://[::]",
          "http://[fd12::1]", "http://[fe80::1]", "http://2130706433", "http://0x7f000001", "http://0177.0.0.1", "http://127.1",
          "file:///etc/passwd", "javascript:alert(1)", "data:text/html,x", "ftp://host/", "about:config", "no url", "http://",
          "http://1.2.3.256", "http://[1:2"]


def test_url_rules(spark):
    df = spark.createDataFrame([(u,) for u in SAFE + UNSAFE], "url string")
    got = {r["url"]: r["safe"] for r in url_verdict(df).collect()}
    assert [u for u in SAFE if not got[u]] == [] and [u for u in UNSAFE if got[u]] == []
    free = {r["url"]: r["safe"] for r in url_verdict(df, allow_file=True, allow_private=True).collect()}
    assert free["file:///etc/passwd"] and free["http://10.1.2.3"] and not free["ftp://host/"]
    origins = {r["url"]: r for r in origin_verdict(df).collect()}
    assert origins["HTTP://EX.com:81"]["origin"] == "http://ex.com:81"
    assert origins["about:blank"]["reason"] == "permissions origin must be http(s), got about:"


def test_paths(spark):
    box = "/srv/pages/downloads/p1"
    cases = {"r.pdf": f"{box}/r.pdf", f"{box}/s/f": f"{box}/s/f", "a/../b": f"{box}/b", ".": box, "/etc/passwd": None,
             "../../x": None, "/srv/pages/downloads/p2/x": None, "..foo": None, "a/..foo": f"{box}/a/..foo", f"{box}x/y": None}
    df = spark.createDataFrame([(p, "p1") for p in cases], "path string, profile string")
    assert {r["path"]: r["resolved"] for r in sandbox_paths(df).collect()} == cases
    assert all(r["ok"] for r in sandbox_paths(df, allow_any=True).collect())


REDACT = [
    ("browser_type", {"target": "P", "text": "s3cret", "n": 1.5}, {"target": "P", "text": "«redacted»", "n": 1.5}),
    ("browser_cookies", {"action": "get"}, {"action": "get"}),
    ("browser_cookies", {"cookies": [{"name": "a", "value": "v", "path": "/"}, {"name": "b"}]},
     {"cookies": [{"name": "a", "value": "«redacted»", "path": "/"}, {"name": "b", "value": "«redacted»"}]}),
    ("browser_evaluate", {"expression": "1+1 // é"}, {"expression": "«redacted 8ch»"}),
    ("browser_upload", {"files": ["/a", "/b", "/c"], "target": "#u"}, {"files": "«3 files»", "target": "#u"}),
    ("browser_fill_form", {"fields": [{"target": "E", "value": "x"}, {"target": "A", "checked": True}], "submit": True},
     {"fields": [{"target": "E", "value": "«redacted»"}, {"target": "A", "checked": True}], "submit": True}),
    ("browser_configure", {"locale": "de", "extra_headers": {"Z": "1", "A": "2"}},
     {"locale": "de", "extra_headers": {"Z": "«redacted»", "A": "«redacted»"}}),
    ("browser_handle_dialog", {"action": "accept", "prompt_text": "pw"}, {"action": "accept", "prompt_text": "«redacted»"}),
    ("browser_save", {"format": "pdf", "path": "/home/x"}, {"format": "pdf", "path": "«redacted»"}),
    ("browser_open", {"url": "https://x", "text": "stays"}, {"url": "https://x", "text": "stays"}),
]


def test_redaction_keeps_shape_and_order(spark):
    df = spark.createDataFrame([(i, n, json.dumps(a, ensure_ascii=False)) for i, (n, a, _) in enumerate(REDACT)], "i int, name string, args string")
    got = {r["i"]: r["redacted"] for r in calls.redact_args(df).collect()}
    for i, (_, _, want) in enumerate(REDACT):
        assert json.loads(got[i]) == want
        assert list(json.loads(got[i])) == list(want)
    odd = spark.createDataFrame([("browser_type", "42"), ("browser_type", None), ("browser_type", "[1]")], "name string, args string")
    assert [r["redacted"] for r in calls.redact_args(odd).collect()] == ["42", None, "[1]"]


def test_redaction_never_leaks(spark):
    rows = [("browser_configure", '{"extra_headers":["Authorization: Bearer abc"]}', '{"extra_headers":{"0":"«redacted»"}}'),
            ("browser_configure", '{"extra_headers":[]}', '{"extra_headers":{}}'),
            ("browser_type", '{"text":"secret", bad', '"«redacted»"'), ("browser_cookies", "", '"«redacted»"'),
            ("browser_open", "{bad", "{bad")]
    got = calls.redact_args(spark.createDataFrame(rows, "name string, args string, want string")).collect()
    assert [r["redacted"] for r in got] == [r["want"] for r in got]


def test_long_hex_host(spark):
    urls = [f"http://0x{'0' * pad}{end}/" for end in ("08080808", "7f000001") for pad in (0, 40, 400)]
    got = url_verdict(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [(r["host"], r["safe"]) for r in got] == [("8.8.8.8", True)] * 3 + [("127.0.0.1", False)] * 3


ARGS = [
    ("browser_find", {"query": "x"}, []), ("browser_find", {}, ["query:invalid_type"]), ("browser_find", {"query": "x", "limit": 51}, ["limit:too_big"]),
    ("browser_find", {"query": "x", "limit": 0}, ["limit:too_small"]), ("browser_network_log", {"limit": 1.5}, ["limit:invalid_type"]),
    ("browser_expect", {"assertion": "count", "target": "li", "expected": 2}, []), ("browser_expect", {"assertion": "seen"}, ["assertion:invalid_value"]),
    ("browser_click", {"target": "x" * 2049}, ["target:too_big"]), ("browser_permissions", {"grant": "all"}, []),
    ("browser_permissions", {"grant": ["camera", "fly"]}, ["grant:invalid_union"]), ("browser_open", {"url": "nowhere"}, ["url:invalid_format"]),
    ("browser_cookies", {"action": "set", "cookies": [{"name": "a", "value": "b", "domain": "x"}]}, ["cookies:custom"]),
    ("browser_fill_form", {"fields": [{"target": "a", "value": "1", "checked": True}]}, ["fields:custom"]),
    ("browser_fill_form", {"fields": [{"target": "a", "value": "1"}], "submit": {"target": "b"}}, []),
    ("browser_set_geolocation", {"latitude": 90, "longitude": -180.5}, ["longitude:too_small"]),
    ("browser_configure", {"device_scale_factor": 0}, ["device_scale_factor:too_small"]), ("browser_upload", {"target": "#u", "files": []}, ["files:too_small"]),
]


def test_argument_rules(spark):
    df = spark.createDataFrame([(i, n, json.dumps(a)) for i, (n, a, _) in enumerate(ARGS)], "i int, name string, args string")
    got = {r["i"]: [f"{x['path']}:{x['code']}" for x in r["issues"]] for r in calls.validate_args(df).collect()}
    assert [got[i] for i in range(len(ARGS))] == [want for _, _, want in ARGS]
    plain = calls.validate_args(spark.createDataFrame([("browser_scroll", None)], "name string, args string")).first()
    assert json.loads(plain["filled"]) == {"direction": "down", "amount": 800}
    wait = calls.validate_args(spark.createDataFrame([("browser_wait", '{"selector":"a","condition":"b"}')], "name string, args string")).first()
    assert wait["problem"].startswith("provide exactly one")


def test_settings_rules(spark):
    schema = ("profile string, seq long, device_preset string, viewport_preset string, viewport_width int, viewport_height int, "
              "device_scale_factor double, is_mobile boolean, user_agent string, ua_preset string, locale string, "
              "color_scheme string, extra_headers map<string,string>")

    def change(seq, **kw):
        names = [c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")][2:]
        return ("p", seq, *[kw.get(n) for n in names])

    log = [
        change(1, viewport_preset="mobile", user_agent="me/1", ua_preset="chrome-desktop", extra_headers={"X": "1"}),
        change(2, is_mobile=True, locale="de-DE", extra_headers={"Y": "2"}),
        change(3, viewport_width=640),
        change(4, viewport_preset="tablet", viewport_width=500, viewport_height=400, locale="en-US"),
    ]
    got = settings.effective_settings(spark.createDataFrame(log, schema)).first()
    assert (got["viewport"], got["user_agent"], got["locale"], got["mobile"], got["restarts"]) == ("500x400", None, "en-US", True, 1)
    assert got["headers"] == {"Accept-Language": "en-US", "Y": "2"}
    device = settings.effective_settings(spark.createDataFrame(
        [*log, change(5, device_preset="pixel-8", viewport_width=1, viewport_height=1, user_agent="no")], schema)).first()
    assert (device["viewport"], device["scale"], device["touch"]) == ("412x915", 2.625, True)
    assert device["user_agent"].startswith("Mozilla/5.0 (Linux; Android 14; Pixel 8)")
    assert device["headers"] == {"Accept-Language": "de-DE"}


@pytest.mark.parametrize("cli, env, fallback, want", [
    ("5", "6", 7.0, 5.0), ("abc", "6", 7.0, 6.0), (None, "x", 7.0, 7.0), (None, "", 7.0, 0.0), (" 1e2 ", None, 7.0, 100.0), (None, "0x10", 7.0, 16.0)])
def test_layered_numbers(spark, cli, env, fallback, want):
    row = spark.range(1).select(rules.layered_number(*[F.lit(v).cast("string") for v in (cli, env)], F.lit(fallback)).alias("n")).first()
    assert row["n"] == want


def test_small_texts(spark):
    row = spark.range(1).select(
        pad_end(F.lit("abc"), 2).alias("a"), pad_end(F.lit("abc"), 5).alias("b"),
        log_value(F.lit("x" * 201)).alias("c"), log_value(F.lit(None).cast("string")).alias("d")).first()
    assert (row["a"], row["b"], len(row["c"]), row["c"][-1], row["d"]) == ("abc", "abc  ", 201, "…", "")


BLANKS = ["", " ", "\n", "\t", "\r\n", " \n\t \r"]


def test_white_space_around_json_hides_nothing(spark):
    rows = [(f"{i}-{j}-{len(after)}", tool, before + json.dumps(args) + after, want)
            for i, before in enumerate(BLANKS) for after in ("", "\n ") for j, (tool, args, want) in enumerate(REDACT)]
    df = spark.createDataFrame([r[:3] for r in rows], "i string, name string, args string")
    wanted = {i: want for i, _, _, want in rows}
    for r in calls.redact_args(df).collect():
        assert json.loads(r["redacted"]) == wanted[r["i"]], r


def test_white_space_around_arguments_is_valid(spark):
    rows = [(b + '{"url":"https://a.b"}' + b, 200) for b in BLANKS] + [(b + "null" + b, 400) for b in BLANKS] + [(b, 400) for b in BLANKS] + [
        (b + '[{"url":"https://a.b"}]', 400) for b in BLANKS] + [('{"url"', 400)]
    df = spark.createDataFrame([(i, "browser_open", a, False, "[]") for i, (a, _) in enumerate(rows)], "i int, name string, args string, is_error boolean, content string")
    got = {r["i"]: r["status"] for r in calls.classify_calls(df).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]
