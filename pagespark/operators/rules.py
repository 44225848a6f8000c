"""Request-level rules: CORS, routes, the request gate, profile names, deployments, settings layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up

MAX_REQUEST_BYTES = 1_048_576
PROFILE_RULE = "^[a-zA-Z0-9_-]{1,64}\\z"

# The role names a locator accepts.
ROLES = """
alert alertdialog application article banner blockquote button caption cell checkbox code columnheader
combobox complementary contentinfo definition deletion dialog directory document emphasis feed figure form
generic grid gridcell group heading img insertion link list listbox listitem log main marquee math meter menu
menubar menuitem menuitemcheckbox menuitemradio navigation none note option paragraph presentation progressbar
radio radiogroup region row rowgroup rowheader scrollbar search searchbox separator slider spinbutton status
strong subscript superscript switch tab table tablist tabpanel term textbox time timer toolbar tooltip tree
treegrid treeitem
""".split()


def valid_role(c: Column) -> Column:
    return F.coalesce(c.isin(*ROLES), F.lit(False))


def valid_profile(c: Column) -> Column:
    return F.coalesce(c.rlike(PROFILE_RULE), F.lit(False))


def profile_from_path(path: Column) -> Column:
    """Struct (profile, valid) from ``/mcp`` or ``/mcp/<name>``; a bare path means ``default``."""
    is_mcp = path.startswith("/mcp")
    raw = F.regexp_extract(path, "^/mcp/([^/?#]*)", 1)
    valid = is_mcp & ((raw == "") | valid_profile(raw))
    return F.struct(
        F.when(valid, F.when(raw == "", "default").otherwise(raw)).alias("profile"), valid.alias("valid")
    )


def scroll_pct(y: Column, height: Column, viewport: Column) -> Column:
    return F.when(height <= viewport, F.lit(0).cast("long")).otherwise(
        round_half_up(y / (height - viewport) * 100).cast("long")
    )


def cors_ok(origin: Column, allow: str) -> Column:
    """No Origin passes, ``*`` passes everything, otherwise an exact entry of the comma list."""
    if allow == "*":
        return F.lit(True)
    listed = [a.strip() for a in allow.split(",") if a.strip()]
    return origin.isNull() | (origin.isin(*listed) if listed else F.lit(False))


def cors_verdict(log: DataFrame, allow: str, origin: str = "origin") -> DataFrame:
    ok = F.coalesce(cors_ok(F.col(origin), allow), F.lit(False))
    why = F.concat(F.lit("origin '"), F.col(origin), F.lit("' not allowed"))
    return log.select("*", ok.alias("origin_ok"), F.when(~ok, why).alias("origin_reason"))


def _decoded(part: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(part, "\\+", "%2B"))


def parse_route(method: Column, path: Column) -> Column:
    """Struct (kind, name) of an API path without its query; kind is null for unknown paths."""
    tool = F.regexp_extract(path, "^/api/v1/tools/([^/]+)$", 1)
    profile = F.regexp_extract(path, "^/api/v1/profiles/([^/]+)$", 1)
    no = F.lit("method_not_allowed")
    kind = (
        F.when(path == "/api/v1/openapi.json", F.when(method == "GET", "openapi").otherwise(no))
        .when(path == "/api/v1/tools", F.when(method == "GET", "tools").otherwise(no))
        .when(tool != "", F.when(method == "POST", "tool").otherwise(no))
        .when(profile != "", F.when(method == "DELETE", "release").otherwise(no))
    )
    name = F.when((tool != "") & (method == "POST"), _decoded(tool)).when(
        (profile != "") & (method == "DELETE"), _decoded(profile)
    )
    return F.struct(kind.alias("kind"), name.alias("name"))


@dataclass(frozen=True)
class GateConfig:
    cors: str = ""
    max_sessions: int = 50
    max_bytes: int = MAX_REQUEST_BYTES


def _is_initialize(body: Column) -> Column:
    batch = F.from_json(body, "array<struct<method:string>>")
    one = F.get_json_object(body, "$.method") == "initialize"
    any_of = F.exists(batch, lambda m: F.coalesce(m["method"] == "initialize", F.lit(False)))
    return F.when(F.ltrim(body).startswith("["), F.coalesce(any_of, F.lit(False))).otherwise(
        F.coalesce(one, F.lit(False))
    )


def gate_status(log: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Status of each request; the first failing rule wins.

    ``log``: method, url, origin, content_type, auth_ok, body, body_bytes, body_late,
    live_sessions, known_session (the id names a live MCP session), holder_exists (the
    profile has a REST holder), call_status (outcome of the tool call, if it gets there).
    """
    method, url = F.col("method"), F.col("url")
    path = F.regexp_extract(url, "^([^?#]*)", 1)
    is_api, is_mcp = url.startswith("/api/"), url.startswith("/mcp")
    post = method == "POST"
    route = parse_route(method, path)
    kind, name = route["kind"], route["name"]
    wanted = F.coalesce(_decoded(F.regexp_extract(url, "[?&]profile=([^&#]*)", 1)), F.lit(""))
    bad_body = (
        F.when(F.coalesce(F.col("body_bytes"), F.lit(0)) > cfg.max_bytes, 413)
        .when(F.coalesce(F.col("body_late"), F.lit(False)), 408)
        .when((F.length("body") > 0) & F.try_parse_json("body").isNull(), 500)
    )
    full = F.col("live_sessions") >= cfg.max_sessions
    json_type = F.lower(F.coalesce(F.col("content_type"), F.lit(""))).startswith("application/json")
    api = (
        F.when(kind.isNull(), 404)
        .when(kind == "method_not_allowed", 405)
        .when(kind.isin("openapi", "tools"), 200)
        .when(name.isNull(), 500)
        .when(kind == "release", F.when(valid_profile(name), 200).otherwise(400))
        .when((wanted != "") & ~valid_profile(wanted), 400)
        .when(bad_body.isNotNull(), bad_body)
        .when(~F.col("holder_exists") & full, 503)
        .otherwise(F.coalesce(F.col("call_status"), F.lit(200)))
    )
    mcp = (
        F.when(~profile_from_path(url)["valid"], 400)
        .when(post & bad_body.isNotNull(), bad_body)
        .when(F.col("known_session"), 200)
        .when(~post | ~F.coalesce(_is_initialize(F.col("body")), F.lit(False)), 400)
        .when(full, 503)
        .otherwise(200)
    )
    status = (
        F.when((url == "/health") & method.isin("GET", "HEAD"), 200)
        .when(~is_api & ~is_mcp, 404)
        .when(~F.coalesce(cors_ok(F.col("origin"), cfg.cors), F.lit(False)), 403)
        .when(post & ~json_type, 415)
        .when(~F.col("auth_ok"), 401)
        .when(is_api, api)
        .otherwise(mcp)
    )
    return log.select("*", status.alias("gate_status"))


def config_audit(df: DataFrame) -> DataFrame:
    """Deployments (host, api_key, allow_insecure) that expose the service without a key."""
    loopback = F.col("host").isin("127.0.0.1", "::1", "localhost")
    has_key = F.length(F.coalesce(F.col("api_key"), F.lit(""))) > 0
    risky = ~loopback & ~has_key & ~F.coalesce(F.col("allow_insecure"), F.lit(False))
    text = F.concat(F.lit("host is bound to '"), F.col("host"), F.lit("' (not loopback) and no API key is set."))
    return df.select("*", F.when(risky, text).alias("problem"))


# --- layered settings: command line, then environment, then default ---

def layered_string(cli: Column, env: Column, fallback: Column) -> Column:
    return F.coalesce(cli, env, fallback)


def _number(text: Column) -> Column:
    trimmed = F.trim(text)
    hexa = F.conv(F.regexp_extract(trimmed, "^0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("double")
    plain = F.when(trimmed.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), trimmed.try_cast("double"))
    return (
        F.when(text.isNull(), F.lit(None).cast("double"))
        .when(trimmed == "", F.lit(0.0))
        .when(trimmed.rlike("^0[xX][0-9a-fA-F]+$"), hexa)
        .otherwise(plain)
    )


def layered_number(cli: Column, env: Column, fallback: Column) -> Column:
    """The first layer that is a number; anything else falls through."""
    return F.coalesce(_number(cli), _number(env), fallback.cast("double"))


def layered_bool(cli: Column, env: Column, fallback: Column) -> Column:
    """An environment value of "0" is false, any other text is true."""
    return F.coalesce(cli, env != "0", fallback)


def layered_list(cli: Column, env: Column) -> Column:
    text = F.coalesce(cli, env, F.lit(""))
    return F.filter(F.split(text, "\\s+"), lambda s: s != "")


def parse_viewport(raw: Column) -> Column:
    ok = raw.rlike("^[0-9]+[xX][0-9]+\\z")
    return F.when(ok, F.struct(
        F.regexp_extract(raw, "^([0-9]+)", 1).cast("int").alias("width"),
        F.regexp_extract(raw, "[xX]([0-9]+)", 1).cast("int").alias("height"),
    ))


def resolve_config(layers: DataFrame) -> DataFrame:
    """``layers``: name, kind ('string'|'number'|'bool'|'list'|'viewport'), cli, env, fallback (all text)."""
    cli, env, fb = F.col("cli"), F.col("env"), F.col("fallback")
    kind = F.col("kind")
    number = layered_number(cli, env, fb.try_cast("double"))
    number_text = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    flag = layered_bool(cli.try_cast("boolean"), env, fb.try_cast("boolean")).cast("string")
    views = F.coalesce(parse_viewport(cli), parse_viewport(env), parse_viewport(fb))
    view = F.concat_ws("x", views["width"].cast("string"), views["height"].cast("string"))
    value = (
        F.when(kind == "string", layered_string(cli, env, fb))
        .when(kind == "number", number_text)
        .when(kind == "bool", flag)
        .when(kind == "list", F.to_json(layered_list(cli, env)))
        .when(kind == "viewport", F.nullif(view, F.lit("")))
    )
    return layers.select("*", value.alias("resolved"))
