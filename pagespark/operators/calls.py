"""Tool-call logs: redaction, validation, classification, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_string, log_value
from .tool_catalog import rules_table

GONE = "«redacted»"

# Tool and argument whose value is blanked.
SECRET_ARGS = {
    "browser_type": "text",
    "browser_save": "path",
    "browser_download_wait": "save_to",
    "browser_storage": "value",
    "browser_handle_dialog": "prompt_text",
}
# Tool and list argument whose objects carry a secret ``value``.
SECRET_LISTS = {"browser_cookies": "cookies", "browser_fill_form": "fields"}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(args: Column) -> Column:
    """Whether a text is a JSON object, whatever white space stands around it; false for other JSON, broken text and null."""
    return F.coalesce(_kind(F.try_parse_json(args)).startswith("OBJECT"), F.lit(False))


def _json_at(text: Column, path: Column) -> Column:
    return F.call_function("get_json_object", text, path)


def _raw(args: Column, key: Column, v: Column) -> Column:
    """JSON text of one argument; nested values keep their own key order where the path allows."""
    nested = _kind(v).rlike("^(OBJECT|ARRAY)") & key.rlike("^[A-Za-z0-9_]+$")
    own = _json_at(args, F.concat(F.lit("$."), key))
    return F.when(nested, F.coalesce(own, F.to_json(v))).otherwise(F.to_json(v))


def _object_text(entries: Column) -> Column:
    """``{...}`` from an array of (key, json) structs."""
    parts = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _map_text(m: Column) -> Column:
    return _object_text(F.transform(
        F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json"))
    ))


def _blank_values(list_json: Column, add_missing: bool) -> Column:
    """A JSON list whose objects get a blanked ``value``; other items stay."""
    blank = F.parse_json(F.lit(f'"{GONE}"'))

    def one(item: Column) -> Column:
        fields = F.from_json(item, "map<string,variant>")
        has = F.map_contains_key(fields, "value")
        hidden = F.transform_values(fields, lambda k, v: F.when(k == "value", blank).otherwise(v))
        if add_missing:
            hidden = F.when(has, hidden).otherwise(
                F.map_concat(fields, F.create_map(F.lit("value"), blank)))
        return F.when(fields.isNotNull(), _map_text(hidden)).otherwise(F.lit(f'"{GONE}"'))

    # Items as raw JSON text, in order: one get_json_object per index keeps each item's own key order.
    n = F.json_array_length(list_json)
    items = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: _json_at(
            F.concat(F.lit('{"a":'), list_json, F.lit("}")), F.concat(F.lit("$.a["), i.cast("string"), F.lit("]"))),
    )
    kinds = F.from_json(list_json, "array<variant>")
    texts = F.zip_with(items, kinds, lambda raw, v: F.when(_kind(v).startswith("OBJECT"), one(raw)).otherwise(F.to_json(v)))
    return F.when(n > 0, F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))).otherwise("[]")


def redact(tool: Column, args: Column) -> Column:
    """Arguments with secrets blanked and everything else kept, key order included.

    Only calls of tools that carry secrets are parsed at all; of those, text that is no JSON becomes
    the marker. JSON that is not an object passes unchanged, as do calls of other tools.
    """
    fields = F.from_json(args, "map<string,variant>")
    gone = F.lit(f'"{GONE}"')

    def rewrite(e: Column) -> Column:
        key, v = e["key"], e["value"]
        new = F.when(F.lit(False), gone)
        for name, arg in SECRET_ARGS.items():
            new = new.when((tool == name) & (key == arg), gone)
        raw = _raw(args, key, v)
        for name, arg in SECRET_LISTS.items():
            new = new.when(
                (tool == name) & (key == arg) & _kind(v).startswith("ARRAY"),
                _blank_values(raw, add_missing=name == "browser_cookies"),
            )
        said = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        new = new.when(
            (tool == "browser_evaluate") & (key == "expression"),
            F.concat(F.lit('"«redacted '), F.length(said).cast("string"), F.lit('ch»"')),
        )
        new = new.when(
            (tool == "browser_upload") & (key == "files") & _kind(v).startswith("ARRAY"),
            F.concat(F.lit('"«'), F.json_array_length(raw).cast("string"), F.lit(' files»"')),
        )
        heads = F.from_json(raw, "map<string,variant>")
        new = new.when(
            (tool == "browser_configure") & (key == "extra_headers") & _kind(v).startswith("OBJECT"),
            _object_text(F.transform(
                F.map_entries(heads), lambda h: F.struct(h["key"].alias("key"), gone.alias("json"))
            )),
        )
        new = new.when(  # a list counts as an object whose keys are its positions
            (tool == "browser_configure") & (key == "extra_headers") & _kind(v).startswith("ARRAY"),
            _object_text(F.transform(
                F.filter(F.sequence(F.lit(0), F.json_array_length(raw)), lambda i: i < F.json_array_length(raw)),
                lambda i: F.struct(i.cast("string").alias("key"), gone.alias("json"))
            )),
        )
        return F.struct(key.alias("key"), new.otherwise(raw).alias("json"))

    careful = tool.isin(
        *SECRET_ARGS, *SECRET_LISTS, "browser_evaluate", "browser_upload", "browser_configure"
    )
    return F.when(careful & args.isNotNull() & F.try_parse_json(args).isNull(), gone).when(
        careful & is_object(args), F.coalesce(_object_text(F.transform(F.map_entries(fields), rewrite)), gone),
    ).otherwise(args)


def redact_args(call_log: DataFrame, tool: str = "name", args: str = "args") -> DataFrame:
    return call_log.withColumn("redacted", redact(F.col(tool), F.col(args)))


def call_log(raw: DataFrame) -> DataFrame:
    """Raw calls (seq, ts_ms, name, args, elapsed_ms, error) as log rows with the two log lines."""
    hidden = redact(F.col("name"), F.col("args"))
    broke = F.col("error").isNotNull()
    took = F.concat(F.lit(" ("), F.col("elapsed_ms").cast("string"), F.lit("ms)"))
    start = F.when(F.col("args").isNull(), F.concat(F.lit("→ "), F.col("name"))).otherwise(
        F.concat(F.lit("→ "), F.col("name"), F.lit(" "), log_value(F.col("redacted"))))
    end = F.when(broke, F.concat(F.lit("ERROR "), F.col("name"), took, F.lit(": "), F.col("error"))).otherwise(
        F.concat(F.lit("✓ "), F.col("name"), took))
    return raw.withColumn("redacted", hidden).select(
        "seq", "ts_ms", "name", "redacted", "elapsed_ms", (~broke).alias("ok"),
        start.alias("start_line"), end.alias("end_line"),
    )


def with_outcome(df: DataFrame, tool: str = "name", text: str = "text", error: str = "error") -> DataFrame:
    """Success or ``Error in <tool>: <message>`` as data."""
    broke = F.col(error).isNotNull()
    said = F.when(broke, F.concat(F.lit("Error in "), F.col(tool), F.lit(": "), F.col(error))).otherwise(F.col(text))
    return df.select("*", broke.alias("is_error"), said.alias("outcome_text"))


# --- argument validation ---

def valid_cookie(c: Column) -> Column:
    """A cookie needs a url, or a domain and a path (empty texts do not count)."""

    def set_(name: str) -> Column:
        return F.length(F.coalesce(c[name], F.lit(""))) > 0

    return set_("url") | (set_("domain") & set_("path"))


def valid_field(c: Column) -> Column:
    """A form field sets exactly one of value, checked, options."""
    given = [c[name].isNotNull().cast("int") for name in ("value", "checked", "options")]
    return given[0] + given[1] + given[2] == 1


def _is_url(text: Column) -> Column:
    return text.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & (
        ~F.lower(text).rlike("^(https?|ftp|wss?):") | F.lower(text).rlike("^[a-z]+:[/\\\\]*[^/\\\\?#\\s]+")
    )


NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)$"
TYPE_PATTERN = {
    "string": "^STRING$", "url": "^STRING$", "bool": "^BOOLEAN$", "number": NUMERIC, "int": NUMERIC,
    "strings": "^ARRAY", "urls": "^ARRAY", "objects": "^ARRAY", "object": "^OBJECT",
    "text_or_number": f"^STRING$|{NUMERIC}", "bool_or_object": "^BOOLEAN$|^OBJECT", "grant": "^STRING$|^ARRAY",
}

# Permissions that can be granted.
PERMISSIONS = """
geolocation midi midi-sysex notifications camera microphone background-sync ambient-light-sensor accelerometer
gyroscope magnetometer clipboard-read clipboard-write payment-handler storage-access
""".split()


def _check(r: Column, v: Column) -> Column:
    """Issue code of one argument value under one rule, or null."""
    kind, t = _kind(v), r["type"]
    typed = F.when(F.lit(False), F.lit(True))
    for name, pattern in TYPE_PATTERN.items():
        typed = typed.when(t == name, kind.rlike(pattern))
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    size = (
        F.when(kind == "STRING", F.length(text))
        .when(kind.startswith("ARRAY"), F.json_array_length(F.to_json(v)))
    )
    measured = F.when(t.isin("int", "number"), number).when(t != "object", size.cast("double"))
    items = F.from_json(F.to_json(v), "array<variant>")
    item_text = F.transform(items, lambda i: F.try_variant_get(i, "$", "string"))
    listed = t.isin("strings", "urls") | ((t == "grant") & kind.startswith("ARRAY"))
    return (
        F.when(v.isNull(), F.when(r["required"], "invalid_type"))
        .when(~typed, F.when(t.isin("text_or_number", "grant", "bool_or_object"), "invalid_union").otherwise("invalid_type"))
        .when((t == "int") & (number != F.floor(number)), "invalid_type")
        .when(r["words"].isNotNull() & ~F.array_contains(r["words"], F.coalesce(text, F.lit(""))), "invalid_value")
        .when((t == "url") & ~_is_url(text), "invalid_format")
        .when(measured < r["lo"], "too_small")
        .when(number <= r["above"], "too_small")
        .when(measured > r["hi"], "too_big")
        .when(listed & F.exists(items, lambda i: _kind(i) != "STRING"),
              F.when(t == "grant", "invalid_union").otherwise("invalid_type"))
        .when(listed & F.exists(item_text, lambda s: F.length(s) > r["item"]), "too_big")
        .when((t == "urls") & F.exists(item_text, lambda s: ~_is_url(s)), "invalid_format")
        .when((t == "grant") & F.when(kind == "STRING", ~text.isin("all", "none")).otherwise(
            F.exists(item_text, lambda s: ~s.isin(*PERMISSIONS))), "invalid_union")
        .when((t == "objects") & F.exists(items, lambda i: ~_kind(i).startswith("OBJECT")), "invalid_type")
    )


_COOKIE = "array<struct<name:string,value:string,domain:string,path:string,url:string>>"
_FIELD = "array<struct<target:string,value:string,checked:boolean,options:array<string>>>"


def _whole_call_issues(fields: Column, tool: Column) -> Column:
    """Rules across fields of the objects in a list argument."""

    def listed(arg: str, schema: str) -> Column:
        return F.from_json(F.to_json(F.try_element_at(fields, F.lit(arg))), schema)

    return F.array_compact(F.array(
        F.when(
            (tool == "browser_cookies") & F.exists(listed("cookies", _COOKIE), lambda c: ~valid_cookie(c)),
            F.struct(F.lit("cookies").alias("path"), F.lit("custom").alias("code"))),
        F.when(
            (tool == "browser_fill_form") & F.exists(listed("fields", _FIELD), lambda c: ~valid_field(c)),
            F.struct(F.lit("fields").alias("path"), F.lit("custom").alias("code"))),
    ))


def handler_problem(tool: Column, fields: Column) -> Column:
    """Errors a valid call still meets in its handler: pairs and exactly-one-of rules."""

    def text(arg: str) -> Column:
        return F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit(arg)), "$", "string"), F.lit(""))

    def given(arg: str) -> Column:
        return F.map_contains_key(fields, arg)

    both_or_none = (text("selector") != "") == (text("condition") != "")
    half = given("viewport_width") != given("viewport_height")
    action = text("action")
    n_cookies = F.json_array_length(F.to_json(F.try_element_at(fields, F.lit("cookies"))))
    return (
        F.when((tool == "browser_wait") & both_or_none, "provide exactly one of `selector` or `condition`")
        .when((tool == "browser_configure") & half, "viewport_width and viewport_height must be set together.")
        .when((tool == "browser_storage") & (action == "set") & ~(given("key") & given("value")),
              "`key` and `value` are required for action='set'")
        .when((tool == "browser_storage") & (action == "remove") & ~given("key"),
              "`key` is required for action='remove'")
        .when((tool == "browser_cookies") & (action == "set") & (F.coalesce(n_cookies, F.lit(0)) == 0),
              "`cookies` array required for action='set'")
        .when((tool == "browser_download_wait") & (action == "navigate") & (text("url") == ""),
              "url required for action='navigate'")
        .when((tool == "browser_download_wait") & action.isin("", "click") & (text("target") == ""),
              "target required for action='click'")
    )


def validate_args(call_log: DataFrame) -> DataFrame:
    """Add ``known``, ``issues`` (path, code), ``filled`` (arguments with defaults) and ``problem``.

    The rule lists ride along on a broadcast of the fixed tool table and are evaluated inside
    the row with array functions, so no call is ever exploded, shuffled or regrouped.
    """
    ruled = call_log.join(F.broadcast(rules_table(call_log.sparkSession)), "name", "left")
    fields = F.when(
        F.regexp_replace(F.coalesce(F.col("args"), F.lit("")), "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "").isin("", "null"), F.from_json(F.lit("{}"), "map<string,variant>")
    ).when(is_object(F.col("args")), F.from_json("args", "map<string,variant>"))
    parsed = ruled.withColumn("_fields", fields)
    m = F.col("_fields")
    found = F.filter(
        F.transform("rules", lambda r: F.struct(
            r["arg"].alias("path"), _check(r, F.try_element_at(m, r["arg"])).alias("code"))),
        lambda i: i["code"].isNotNull(),
    )
    not_object = F.array(F.struct(F.lit("").alias("path"), F.lit("invalid_type").alias("code")))
    issues = F.when(m.isNull(), not_object).otherwise(F.concat(found, _whole_call_issues(m, F.col("name"))))
    known = F.col("rules").isNotNull()
    given = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), _raw(F.col("args"), e["key"], e["value"]).alias("json")))
    taken = F.filter(given, lambda g: F.exists("rules", lambda r: r["arg"] == g["key"]))
    added = F.transform(
        F.filter("rules", lambda r: r["fill"].isNotNull() & ~F.map_contains_key(m, r["arg"])),
        lambda r: F.struct(r["arg"].alias("key"), r["fill"].alias("json")),
    )
    out = parsed.withColumn("issues", F.when(known, issues)).withColumn("known", known)
    good = F.col("known") & (F.size("issues") == 0)
    return out.withColumn("filled", F.when(good, _object_text(F.concat(taken, added)))).withColumn(
        "problem", F.when(good, handler_problem(F.col("name"), m))
    ).drop("_fields", "rules")


def classify_calls(call_log: DataFrame) -> DataFrame:
    """HTTP status and outcome of each call.

    ``call_log``: name, args, is_error, content (JSON list of result blocks). Unknown tool
    404, bad arguments 400 with issues, otherwise 200 and the tool's own outcome, or the error that its handler gives for
    arguments that do not go together (``problem``).
    """
    checked = validate_args(call_log)
    blocks = F.from_json("content", "array<struct<type:string,text:string>>")
    first = F.get(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(0))["text"]
    status = F.when(~F.col("known"), 404).when(F.size("issues") > 0, 400).otherwise(200)
    refused = (status == 200) & F.col("problem").isNotNull()
    ok = (status == 200) & ~refused & ~F.coalesce(F.col("is_error"), F.lit(False))
    message = (
        F.when(status == 404, F.concat(F.lit("unknown tool: "), F.col("name")))
        .when(status == 400, "invalid arguments")
        .when(refused, F.concat(F.lit("Error in "), F.col("name"), F.lit(": "), F.col("problem")))
        .when(~ok, F.coalesce(first, F.lit("tool error")))
    )
    return checked.select("*", status.alias("status"), ok.alias("ok"), message.alias("error_message"))


def envelope(df: DataFrame) -> DataFrame:
    """JSON result envelope of classified calls; ``data`` and ``content`` are JSON text or null."""

    def part(name: str, value: Column) -> Column:
        return F.concat(F.lit(f',"{name}":'), value)

    issues = F.when(F.size("issues") > 0, part("issues", F.to_json("issues")))
    error = F.concat(
        F.lit('{"ok":false,"error":{"message":'), json_string(F.col("error_message")),
        F.coalesce(issues, F.lit("")), F.lit("}"),
    )
    ran = F.col("status") == 200
    rest = F.concat(
        F.coalesce(F.when(ran, part("data", F.col("data"))), F.lit("")),
        F.coalesce(F.when(ran, part("content", F.col("content"))), F.lit("")), F.lit("}"),
    )
    text = F.concat(F.when(F.col("ok"), F.lit('{"ok":true')).otherwise(error), rest)
    return df.withColumn("envelope", text)
