"""URL safety verdicts as column expressions.

Hosts are normalised the way a browser's URL parser does before they are judged: lower
case, percent-decoded, user info and port removed, numeric IPv4 spellings (decimal, hex,
octal, short) folded to dotted form, IPv6 compressed.

Every step is bound to a name with ``let``, so the expression stays linear in size however
the optimizer moves it around; the IPv4 and IPv6 branches only run for such hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lets import let

_NUMBER = "(?:0[xX][0-9a-fA-F]*|[0-9]+)"


def _ipv4_number(label: Column) -> Column:
    """A label as an IPv4 number (hex, octal or decimal), null when it is not one."""
    digits = (
        F.when(label.rlike("^0[xX][0-9a-fA-F]*$"), F.conv(F.regexp_replace(label, "^0[xX]0*", "0"), 16, 10))
        .when(label.rlike("^0[0-7]+$"), F.conv(label, 8, 10))
        .when(label.rlike("^(0|[1-9][0-9]*)$"), label)
    )
    return digits.try_cast("decimal(38,0)")


def _dotted(nums: Column) -> Column:
    """Dotted text of one to four IPv4 numbers (the last one fills the remaining bytes), or null."""
    n = F.size(nums)
    last = F.element_at(nums, -1)
    fits = (
        (n <= 4) & ~F.exists(nums, lambda v: v.isNull())
        & F.forall(F.slice(nums, 1, F.greatest(n - 1, F.lit(0))), lambda v: v <= 255)
        & (last < F.pow(F.lit(256.0), (5 - n)).cast("decimal(38,0)"))
    )
    value = last.cast("long")
    for i in range(3):
        value = value + F.when(n > i + 1, F.get(nums, F.lit(i)).cast("long") * (256 ** (3 - i))).otherwise(0)
    return let(F.when(F.coalesce(fits, F.lit(False)), value), lambda v: F.when(v.isNotNull(), F.concat_ws(
        ".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])))


def _ipv4(name: Column) -> Column:
    labels = F.split(F.regexp_replace(name, "\\.$", ""), "\\.")
    return let(F.transform(labels, _ipv4_number), _dotted)


def _compressed(full: Column) -> Column:
    """Eight groups joined by colons, with the first longest run of zeros as ``::``."""
    short = F.when(full.isNull(), F.lit(None).cast("string"))
    for run in range(8, 1, -1):
        zeros = f"^(|.*?[^:]:)0(?::0){{{run - 1}}}(|:.*)$"
        packed = F.concat(
            F.regexp_replace(F.regexp_extract(full, zeros, 1), ":$", ""), F.lit("::"),
            F.regexp_replace(F.regexp_extract(full, zeros, 2), "^:", ""),
        )
        short = short.when(full.rlike(zeros), packed)
    return short.otherwise(full)


def _groups(halves: Column) -> Column:
    def side(i: int) -> Column:
        text = F.coalesce(F.get(halves, F.lit(i)), F.lit(""))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))

    def fill(s: Column) -> Column:
        have = F.size(s["l"]) + F.size(s["r"])
        gap = F.size(halves) - 1
        return F.when(
            (gap == 1) & (have <= 7), F.concat(s["l"], F.array_repeat(F.lit("0"), 8 - have), s["r"])
        ).when(gap == 0, s["l"])

    return let(F.struct(side(0).alias("l"), side(1).alias("r")), fill)


def _ipv6(inner: Column) -> Column:
    """Compressed IPv6 of the text between brackets, or null."""

    def with_tail(octets: Column) -> Column:
        def pair(i: int) -> Column:
            return F.lower(F.hex(F.get(octets, F.lit(i)) * 256 + F.get(octets, F.lit(i + 1))))

        return F.when(F.size(octets) != 4, inner).when(
            F.forall(octets, lambda o: o <= 255),
            F.concat(F.regexp_replace(inner, "[0-9.]+$", ""), pair(0), F.lit(":"), pair(2)),
        )

    tail = F.split(F.regexp_extract(inner, "(?:^|:)((?:[0-9]{1,3}\\.){3}[0-9]{1,3})$", 1), "\\.")
    plain = let(F.transform(tail, lambda p: p.try_cast("int")), with_tail)

    def joined(groups: Column) -> Column:
        ok = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(ok, F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"))

    return let(let(let(F.split(plain, "::", -1), _groups), joined), _compressed)


def _private(host: Column) -> Column:
    """Loopback, private, link-local and unique-local hosts.

    IPv4-mapped IPv6 and fe90: to febf: are not in the rule.
    """

    def bad4(o: Column) -> Column:
        a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
        return (
            a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        )

    octets = F.transform(F.split(host, "\\."), lambda p: p.try_cast("int"))
    inner = F.regexp_replace(host, "^\\[|\\]$", "")
    return (
        F.when(host.rlike("^[0-9]+(\\.[0-9]+){3}$"), let(octets, bad4))
        .when(host.startswith("["), inner.isin("::1", "::") | inner.rlike("^(fc|fd|fe80:)"))
        .otherwise(host == "localhost")
    )


def _host(host_port: Column) -> Column:
    """Normalised host of ``host[:port]``; null when it is not a valid host."""
    boxed = host_port.startswith("[")
    inner = F.lower(F.regexp_extract(host_port, "^\\[([^\\]]*)\\](?::[0-9]*)?$", 1))
    decoded = F.lower(F.try_url_decode(F.regexp_replace(F.regexp_replace(host_port, ":[0-9]*$", ""), "\\+", "%2B")))

    def named(name: Column) -> Column:
        numeric = F.regexp_extract(name, "([^.]+)\\.?$", 1).rlike(f"^{_NUMBER}$")
        bad = (name == "") | name.rlike("[\\x00-\\x20#/<>?@\\\\^|%\\[\\]:]")
        return F.when(numeric, _ipv4(name)).when(~bad, name)

    return F.when(
        boxed, let(_ipv6(inner), lambda v: F.concat(F.lit("["), v, F.lit("]")))
    ).otherwise(let(decoded, named))


def _parts(url: Column) -> Column:
    """Struct (clean, scheme, host, port, ok) of an absolute URL."""
    clean = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\n\\r]", "")

    def split_up(c: Column) -> Column:
        scheme = F.lower(F.regexp_extract(c, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
        host_port = F.regexp_extract(c, "^[^:]*:[/\\\\]*(?:[^/\\\\?#]*@)?([^/\\\\?#@]*)", 1)
        return F.struct(c.alias("clean"), scheme.alias("scheme"), host_port.alias("hp"))

    def judge(s: Column) -> Column:
        web = s["scheme"].isin("http", "https", "ftp", "ws", "wss")
        port = F.regexp_extract(s["hp"], ":([0-9]+)$", 1).try_cast("int")
        default_port = F.when(s["scheme"] == "http", 80).when(s["scheme"] == "https", 443)
        return let(
            F.when(web, _host(s["hp"])),
            lambda host: F.struct(
                s["clean"].alias("clean"), s["scheme"].alias("scheme"), host.alias("host"),
                F.when(F.coalesce(port != default_port, F.lit(True)), port).alias("port"),
                ((s["scheme"] != "") & (~web | (host.isNotNull() & (F.coalesce(port, F.lit(0)) <= 65535)))).alias("ok"),
            ),
        )

    return let(let(clean, split_up), judge)


def _reason(url: Column, u: Column, allow_file: bool, allow_private: bool) -> Column:
    about = F.regexp_extract(u["clean"], "^[^:]*:([^?#]*)", 1)
    private = F.lit(False) if allow_private else F.coalesce(_private(u["host"]), F.lit(False))
    return (
        F.when(~u["ok"], F.concat(F.lit("invalid URL: "), url))
        .when(
            u["scheme"] == "about",
            F.when(about != "blank", F.concat(
                F.lit("about: scheme other than about:blank is blocked: "),
                F.regexp_replace(u["clean"], "^[^:]*:", "about:"))),
        )
        .when(
            u["scheme"] == "file",
            F.lit(None).cast("string") if allow_file else F.lit("file:// URLs are blocked by default."),
        )
        .when(
            ~u["scheme"].isin("http", "https"),
            F.concat(F.lit("URL scheme '"), u["scheme"], F.lit(
                ":' is not allowed. Only http:, https:, about:blank are supported by default.")),
        )
        .when(
            private,
            F.concat(F.lit("host '"), u["host"], F.lit("' is a private/loopback/link-local address.")),
        )
    )


# Plain http(s) URLs with an ASCII host name whose last label starts with a letter: nothing to fold.
PLAIN_URL = "(?i)^https?://(?:[a-z0-9-]+\\.)*[a-z][a-z0-9-]*(?::[0-9]{1,4})?(?:[/?#].*)?$"


def _plain_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[^:]*://([^:/?#]+)", 1))


def _local_reason(host: Column, allow_private: bool) -> Column:
    blocked = F.lit("host 'localhost' is a private/loopback/link-local address.")
    return F.when((host == "localhost") & F.lit(not allow_private), blocked)


def verdict(url: Column, allow_file: bool = False, allow_private: bool = False) -> Column:
    """Struct (host, reason); the reason is null for a URL that may be opened.

    Plain URLs, nearly all of a real table, are judged by one generated-code pattern; only
    the others go through the full parser.
    """
    host = _plain_host(url)
    plain = F.struct(host.alias("host"), _local_reason(host, allow_private).alias("reason"))
    full = let(_parts(url), lambda u: F.struct(
        u["host"].alias("host"), _reason(url, u, allow_file, allow_private).alias("reason")))
    return F.when(url.rlike(PLAIN_URL), plain).otherwise(full)


def origin(url: Column, allow_private: bool = False) -> Column:
    """Struct (origin, reason): as ``verdict`` but http(s) only; origin is scheme, host and non-default port."""

    def judge(u: Column) -> Column:
        web = u["scheme"].isin("http", "https")
        text = F.concat(
            u["scheme"], F.lit("://"), u["host"],
            F.coalesce(F.concat(F.lit(":"), u["port"].cast("string")), F.lit("")),
        )
        not_web = F.concat(F.lit("permissions origin must be http(s), got "), u["scheme"], F.lit(":"))
        reason = F.coalesce(_reason(url, u, False, allow_private), F.when(~web, not_web))
        return F.struct(F.when(u["ok"] & web, text).alias("origin"), reason.alias("reason"))

    host = _plain_host(url)
    scheme = F.lower(F.regexp_extract(url, "^([^:]*):", 1))
    port = F.regexp_extract(url, "^[^:]*://[^:/?#]+:([0-9]+)", 1).try_cast("int")
    usual = port.isNull() | (port == F.when(scheme == "http", 80).otherwise(443))
    tail = F.when(usual, "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    plain = F.struct(
        F.concat(scheme, F.lit("://"), host, tail).alias("origin"), _local_reason(host, allow_private).alias("reason"))
    return F.when(url.rlike(PLAIN_URL), plain).otherwise(let(_parts(url), judge))


def url_verdict(
    df: DataFrame, url: str = "url", allow_file: bool = False, allow_private: bool = False
) -> DataFrame:
    """Add ``host``, ``reason`` (null when safe) and ``safe``.

    Allowed are http, https and about:blank; file URLs and private hosts by opt-in only.
    """
    judged = df.withColumn("_v", verdict(F.col(url), allow_file, allow_private))
    return judged.select(*df.columns, "_v.host", "_v.reason", F.col("_v.reason").isNull().alias("safe"))


def origin_verdict(df: DataFrame, url: str = "url", allow_private: bool = False) -> DataFrame:
    """Add ``origin``, ``reason`` and ``safe``."""
    judged = df.withColumn("_v", origin(F.col(url), allow_private))
    return judged.select(*df.columns, "_v.origin", "_v.reason", F.col("_v.reason").isNull().alias("safe"))
