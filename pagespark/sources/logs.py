"""Typed telemetry logs from raw browser events.

Every log keeps ``seq``, the arrival order: retention follows completion order, which is
not the order of the (start) timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BODY_MAX_BYTES = 262_144
TEXTY_CONTENT = "(?i)json|text|xml|javascript|urlencoded"


def net_log(raw: DataFrame) -> DataFrame:
    """Finished and failed requests as one typed log.

    Raw: seq, ts_ms, profile, tab_id, outcome ('finished'|'failed'), method, url,
    resource_type, status, error_text, duration_ms, from_service_worker.
    """
    broke = F.col("outcome") == "failed"
    return raw.select(
        F.col("seq").cast("long").alias("seq"),
        F.col("ts_ms").cast("long").alias("ts_ms"),
        "profile", "tab_id", "method", "url", "resource_type",
        F.when(~broke, F.col("status").cast("int")).alias("status"),
        F.col("duration_ms").cast("long").alias("duration_ms"),
        F.when(~broke & F.col("from_service_worker"), F.lit(True)).alias("from_cache"),
        F.when(broke, F.coalesce("error_text", F.lit("failed"))).alias("failed"),
    )


def console_level(raw_level: Column) -> Column:
    """Known levels stay, ``warning`` becomes ``warn``, anything else is ``log``."""
    return (
        F.when(raw_level == "warning", "warn")
        .when(raw_level.isin("error", "info", "debug", "log", "pageerror"), raw_level)
        .otherwise("log")
    )


def console_location(url: Column, line: Column, column: Column) -> Column:
    spot = F.concat_ws(
        ":", url,
        F.coalesce(line, F.lit(0)).cast("string"),
        F.coalesce(column, F.lit(0)).cast("string"),
    )
    return F.when(F.length(url) > 0, spot)


def console_log(raw: DataFrame) -> DataFrame:
    """Raw: seq, ts_ms, profile, tab_id, kind ('console'|'pageerror'), level, text, loc_url, loc_line, loc_col."""
    uncaught = F.col("kind") == "pageerror"
    level = F.when(uncaught, "pageerror").otherwise(
        F.when(F.col("level") == "pageerror", "log").otherwise(console_level(F.col("level")))
    )
    where = console_location(F.col("loc_url"), F.col("loc_line"), F.col("loc_col"))
    return raw.select(
        "seq", "ts_ms", "profile", "tab_id", level.alias("level"), "text",
        F.when(~uncaught, where).alias("location"),
    )


def capture_bodies(
    responses: DataFrame, max_bytes: int = BODY_MAX_BYTES, enabled: bool = True
) -> DataFrame:
    """Keep small textual http(s) response bodies."""
    if not enabled:
        return responses.filter(F.lit(False))
    return responses.filter(
        F.col("url").rlike("^https?://")
        & F.coalesce(F.col("content_type"), F.lit("")).rlike(TEXTY_CONTENT)
        & (F.octet_length("body") <= max_bytes)
    )


def read_log_table(spark, path: str, schema, streaming: bool = False) -> DataFrame:
    """A parquet log as batch or file stream, always with a declared schema."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)
