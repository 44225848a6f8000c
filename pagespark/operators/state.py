"""State replay: the latest state a change log leads to, or the state as of each event.

Final states are plain aggregates (``max_by`` with map-side combine), never a window over a
whole profile, so one profile holding most of a log does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import iso_text
from ..functions.skew import HOUR_MS, Run, running
from ..functions.urls import origin as url_origin
from .calls import PERMISSIONS, valid_cookie

DAY = 24 * HOUR_MS
STORE = ["profile", "origin", "area"]


# --- key-value storage ---

def kv_state(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Live entries per (profile, origin, area, key); ``as_of`` is a seq, inclusive.

    An entry is live when the latest change of its key is a ``set`` that came after the
    store's latest ``clear``. A set without a value stores an empty text.
    """
    seen = log if as_of is None else log.filter(F.col("seq") <= as_of)
    cleared = seen.filter(F.col("action") == "clear").groupBy(*STORE).agg(F.max("seq").alias("cleared_seq"))
    latest = (
        seen.filter(F.col("action").isin("set", "remove"))
        .groupBy(*STORE, "key")
        .agg(F.max_by(F.struct("action", "value"), "seq").alias("last"), F.max("seq").alias("seq"))
        .filter(F.col("last.action") == "set")
    )
    return (
        latest.join(cleared, STORE, "left")
        .filter(F.col("cleared_seq").isNull() | (F.col("seq") > F.col("cleared_seq")))
        .select(*STORE, "key", F.coalesce("last.value", F.lit("")).alias("value"), "seq")
    )


def kv_get(state: DataFrame, key: str | None = None) -> DataFrame:
    """One key's value per store (null when absent), or all entries of each store as a map.

    A store's entries are bounded by the browser's storage quota.
    """
    if key is not None:
        return state.groupBy(*STORE).agg(F.max(F.when(F.col("key") == key, F.col("value"))).alias("value"))
    return state.groupBy(*STORE).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("entries")
    )


def kv_reads(log: DataFrame, chunk_ms: int = DAY) -> DataFrame:
    """What each keyed ``get`` saw: the value in force at that moment, or null."""
    wrote = F.col("action").isin("set", "remove")
    per_key = running(
        log.filter(wrote | (F.col("action") == "get")), [*STORE, "key"], ["ts_ms", "seq"],
        [Run("last", "last", F.when(wrote, F.struct("action", F.coalesce("value", F.lit("")).alias("v"), "seq")))],
        "ts_ms", chunk_ms,
    ).filter(F.col("action") == "get")
    clears = log.filter(F.col("action") == "clear")
    empty = F.lit(None).cast(per_key.schema["last"].dataType)
    both = per_key.select(*STORE, "key", "ts_ms", "seq", "last", F.lit(False).alias("is_clear")).unionByName(
        clears.select(*STORE, "key", "ts_ms", "seq", empty.alias("last"), F.lit(True).alias("is_clear")))
    seen = running(
        both, STORE, ["ts_ms", "seq"],
        [Run("cleared_seq", "last", F.when(F.col("is_clear"), F.col("seq")))], "ts_ms", chunk_ms,
    ).filter(~F.col("is_clear"))
    alive = (F.col("last.action") == "set") & (
        F.col("cleared_seq").isNull() | (F.col("last.seq") > F.col("cleared_seq")))
    return seen.select(*STORE, "key", "seq", F.when(alive, F.col("last.v")).alias("value"))


# --- cookies ---

MAX_COOKIES_PER_CALL = 64


COOKIE = ["name", "domain", "path"]
COOKIE_REST = ["value", "expires", "httpOnly", "secure", "sameSite"]


def cookie_changes(calls: DataFrame) -> DataFrame:
    """One row per accepted cookie of a set call, and one per clear call (``clears``); no shuffle, so streams can use it.

    ``calls``: profile, seq, action, cookies (array of structs). Calls with more than 64 cookies or an incomplete cookie are
    rejected as a whole. A cookie given by url takes the url's host and folder.
    """
    clears = F.col("action") == "clear"
    accepted = (F.col("action") == "set") & F.size("cookies").between(1, MAX_COOKIES_PER_CALL) & F.forall("cookies", valid_cookie)
    none = F.array(F.lit(None).cast(calls.schema["cookies"].dataType.elementType))
    rows = calls.filter(clears | accepted).select("profile", "seq", clears.alias("clears"), F.posexplode(F.when(clears, none).otherwise(F.col("cookies"))).alias("pos", "c"))
    host = F.lower(F.regexp_extract("c.url", "^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    folder = F.regexp_extract("c.url", "^[a-zA-Z]+://[^/?#]*(/(?:[^?#]*/)?)", 1)
    return rows.select(
        "profile", "seq", "pos", "clears", (~F.col("clears")).alias("live"), F.col("c.name").alias("name"),
        F.coalesce("c.domain", host).alias("domain"),
        F.coalesce("c.path", F.when(folder == "", "/").otherwise(folder)).alias("path"),
        *[F.col(f"c.{c}").alias(c) for c in COOKIE_REST])


def cookie_state(calls: DataFrame, now_s: int | None = None) -> DataFrame:
    """Cookies in the jar after set / clear calls (see ``cookie_changes``). ``now_s`` also drops cookies that have expired by then."""
    changes = cookie_changes(calls)
    cleared = changes.filter("clears").groupBy("profile").agg(F.max("seq").alias("cleared_seq"))
    latest = changes.filter("live").groupBy("profile", *COOKIE).agg(
        F.max_by(F.struct(*COOKIE_REST), F.struct("seq", "pos")).alias("rest"), F.max("seq").alias("seq"))
    live = latest.join(cleared, "profile", "left").filter(
        F.col("cleared_seq").isNull() | (F.col("seq") > F.col("cleared_seq")))
    out = live.select("profile", *COOKIE, "rest.*", "seq")
    return out if now_s is None else out.filter(unexpired(now_s))


def unexpired(now_s: int) -> Column:
    return F.col("expires").isNull() | (F.col("expires") <= 0) | (F.col("expires") > now_s)


def cookies_for(cookies: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """Cookies that apply to at least one of the urls.

    The host equals the cookie's domain or lies below it, the path starts with the cookie's
    path, and secure cookies need https (or localhost). Each url is expanded to the few
    suffixes of its host and to the beginnings of its path that are as long as a cookie path
    of that domain, so the match is an equi-join on domain and path rather than a test of
    all pairs, also inside one busy domain.
    """
    host = F.lower(F.regexp_extract(F.col(url), "^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(F.col(url), "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    labels = F.split(F.col("_host"), "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    domain = F.regexp_replace(F.lower("domain"), "^\\.", "")
    lengths = cookies.groupBy(domain.alias("_domain")).agg(F.collect_set(F.length("path")).alias("_lengths"))
    wanted = urls.select(
        host.alias("_host"), F.when(path == "", "/").otherwise(path).alias("_path"),
        (F.lower(F.col(url)).startswith("https:")).alias("_https"),
    ).withColumn("_safe", F.col("_https") | (F.col("_host") == "localhost")).select(
        "_path", "_safe", F.explode(suffixes).alias("_domain")).distinct()
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    begun = wanted.join(lengths, "_domain").select(
        "_domain", "_safe", F.explode(F.transform(fitting, lambda n: F.substr("_path", F.lit(1), n))).alias("_begin"),
    ).groupBy("_domain", "_begin").agg(F.max("_safe").alias("_safe"))
    return cookies.join(
        begun,
        (domain == F.col("_domain")) & (F.col("path") == F.col("_begin"))
        & (~F.coalesce("secure", F.lit(False)) | F.col("_safe")),
        "left_semi",
    )


def format_cookie() -> Column:
    """``name (domainpath) = value  [flags] expires=...``"""
    flags = F.concat_ws(
        " ", F.when(F.col("secure"), "Secure"), F.when(F.col("httpOnly"), "HttpOnly"),
        F.when(F.length("sameSite") > 0, F.concat(F.lit("SameSite="), F.col("sameSite"))),
    )
    until = F.when(F.col("expires") > 0, iso_text((F.col("expires") * 1000).cast("long"))).otherwise("session")
    return F.concat(
        F.col("name"), F.lit(" ("), F.col("domain"), F.col("path"), F.lit(") = "), F.col("value"),
        F.lit("  ["), flags, F.lit("] expires="), until,
    )


# --- dialogs ---

def dialog_outcomes(policies: DataFrame, dialogs: DataFrame, chunk_ms: int = DAY) -> DataFrame:
    """How each dialog was answered.

    ``policies``: profile, ts_ms, seq, action, prompt_text, persist. ``dialogs``: profile,
    ts_ms, seq. The latest policy decides; a one-shot policy only serves the dialog that
    comes right after it. Without a policy dialogs are dismissed.
    """
    p = policies.select(
        "profile", "ts_ms", "seq", F.struct("action", "prompt_text", "persist").alias("policy"))
    d = dialogs.select("profile", "ts_ms", "seq", F.lit(None).cast(p.schema["policy"].dataType).alias("policy"))
    walked = running(
        p.unionByName(d), ["profile"], ["ts_ms", "seq"],
        [
            Run("rule", "last", F.col("policy")),
            Run("after_policy", "last", F.col("policy").isNotNull(), inclusive=False),
        ],
        "ts_ms", chunk_ms,
    ).filter(F.col("policy").isNull())
    applies = F.col("rule").isNotNull() & (F.col("rule.persist") | F.col("after_policy"))
    accepted = applies & (F.col("rule.action") == "accept")
    return walked.select(
        "profile", "seq", "ts_ms",
        F.when(accepted, "accept").otherwise("dismiss").alias("outcome"),
        F.when(accepted, F.col("rule.prompt_text")).alias("prompt_text"),
    )


# --- permissions and position ---

def permission_state(log: DataFrame) -> DataFrame:
    """Granted permissions per (profile, origin); origin ``*`` is any origin.

    ``log``: profile, seq, grant ('all', 'none' or 'list'), permissions (array), origin,
    current_url. ``none`` clears the profile. A grant replaces what its origin had; without
    an origin the current tab's http(s) origin is used. Grants with a refused origin do not count.
    """
    judged = log.withColumn("_ok", F.col("origin").isNull() | url_origin(F.col("origin"))["reason"].isNull())
    here = url_origin(F.col("current_url"), allow_private=True)["origin"]
    target = F.coalesce("origin", here, F.lit("*"))
    names = F.when(F.col("grant") == "all", F.array(*[F.lit(p) for p in PERMISSIONS])).otherwise(F.col("permissions"))
    cleared = log.filter(F.col("grant") == "none").groupBy("profile").agg(F.max("seq").alias("cleared_seq"))
    latest = (
        judged.filter((F.col("grant") != "none") & F.col("_ok"))
        .select("profile", "seq", target.alias("origin"), names.alias("permissions"))
        .groupBy("profile", "origin")
        .agg(F.max_by("permissions", "seq").alias("permissions"), F.max("seq").alias("seq"))
    )
    return (
        latest.join(cleared, "profile", "left")
        .filter(F.col("cleared_seq").isNull() | (F.col("seq") > F.col("cleared_seq")))
        .select("profile", "origin", F.explode("permissions").alias("permission"))
    )


def geo_as_of(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The last valid position per profile."""
    ok = (
        F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
        & (F.coalesce("accuracy", F.lit(0.0)) >= 0)
    )
    seen = log if as_of is None else log.filter(F.col("seq") <= as_of)
    return seen.filter(ok).groupBy("profile").agg(
        F.max_by(F.struct("latitude", "longitude", "accuracy"), "seq").alias("g"), F.max("seq").alias("seq")
    ).select("profile", "seq", "g.*")
