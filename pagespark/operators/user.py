"""User-supplied expressions over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_CHARS, truncate_col


def evaluate(pages: DataFrame, expression: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """A Spark SQL expression per page as JSON text, cut at ``max_chars``; null is ``undefined``."""
    wrapped = F.to_json(F.struct(F.expr(expression).alias("v")))
    bare = F.regexp_replace(wrapped, '^\\{("v":)?|\\}$', "")
    text = F.when(bare == "", "undefined").otherwise(bare)
    return pages.select("page_id", truncate_col(text, max_chars).alias("result"))
