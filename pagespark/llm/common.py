"""Small helpers of the training-data operators: shared tables, keys of rows, carried columns."""

from __future__ import annotations

import gc
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespark.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


KEPT: dict = {}  # what a Python worker keeps between tasks


def forget() -> None:
    """Called by work that needs nothing of what is kept: a worker's memory is lent from stage to stage, and goes back to the machine."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the cluster's shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffles behind a written table are of no more use
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Documents go to Python about ``size`` bytes at a time, whatever their lengths, not 10,000 together: tasks and workers each hold a batch.

    Spark reads the setting when a job starts, so it stays set for the session; a session that has less keeps it.
    """
    held = spark.conf.get(BATCH, None)
    if held is None or not re.fullmatch(r"\d+b?", held) or int(held.rstrip("b")) > size:
        spark.conf.set(BATCH, f"{size}b")


def col(name: str) -> Column:
    """A column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def row_key(*cols: Column) -> Column:
    """64-bit key of a row's content; equal rows share it and get equal results."""
    return F.xxhash64(*cols)


def packed(df: DataFrame, keep: Sequence[str] | None = None, **inputs: Column) -> DataFrame:
    """One struct ``row`` of all columns (or those to ``keep``), whatever their names, and the operator's inputs beside it."""
    return df.select(F.struct(*[col(c) for c in (df.columns if keep is None else keep)]).alias("row"), *[c.alias(n) for n, c in inputs.items()])


def unpacked(df: DataFrame, columns: Sequence[str], results: Sequence[str]) -> DataFrame:
    """Undo ``packed``; a result replaces an input column of its name."""
    taken = {r.lower() for r in results}
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken],
                     *[F.col(r) for r in results])


def word_count(text: Column) -> Column:
    """Number of words (maximal runs without ASCII white space) as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
