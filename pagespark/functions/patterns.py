"""User-supplied regular expressions are checked once, on the driver, before a job starts."""

from __future__ import annotations

from pyspark.sql import SparkSession


class BadPattern(ValueError):
    """A filter that cannot be compiled; the reference answers these with an error result."""


def pattern_error(spark: SparkSession, pattern: str | None) -> str | None:
    """Why the JVM refuses ``pattern``, or None."""
    if pattern is None:
        return None
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return None
    except Exception as exc:  # Py4J wraps PatternSyntaxException
        cause = getattr(exc, "java_exception", None)
        text = cause.getMessage() if cause is not None else str(exc)
        return str(text).splitlines()[0].split(" near index ")[0]


def require_pattern(spark: SparkSession, pattern: str | None) -> None:
    problem = pattern_error(spark, pattern)
    if problem is not None:
        raise BadPattern(f"invalid filter: {problem}")
