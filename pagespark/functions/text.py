"""Text columns shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 50_000
MAX_HTML_CHARS = 10_000_000
HTML_CUT_WARNING = "\n\n[warning: HTML was truncated before parsing — page exceeded 10 MB]"

# White space as the ECMAScript trim sees it (Java's \s is ASCII only).
SPACE_CLASS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def squash(c: Column) -> Column:
    """Runs of white space as one space, edges trimmed (accessible names, locators)."""
    return trim_all(F.regexp_replace(c, f"{SPACE_CLASS}+", " "))


def truncate_col(c: Column, max_chars: int = MAX_CHARS) -> Column:
    """Cut at ``max_chars`` and say how much is gone."""
    n = F.length(c)
    cut = F.concat(
        F.substring(c, 1, max_chars),
        F.lit("\n\n[...truncated, "), (n - max_chars).cast("string"), F.lit(" more chars]"),
    )
    return F.when(n > max_chars, cut).otherwise(c)


def pad_end(c: Column, width: int) -> Column:
    """Pad with spaces on the right; longer text is never cut."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c))))


def log_value(c: Column, limit: int = 200) -> Column:
    """JSON text for a log line: cut at ``limit`` plus an ellipsis; absent is empty."""
    short = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)
    return F.coalesce(short, F.lit(""))


def json_string(c: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_replace(
        F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', ""
    )


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)
