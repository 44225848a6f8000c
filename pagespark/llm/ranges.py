"""Places of rows in a global order, found without putting a key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

POSITION_BITS = 33  # of a row inside its partition, in monotonically_increasing_id


def placed(df: DataFrame, order: Sequence[Column], purpose: str) -> DataFrame:
    """``df`` sorted by ``order`` over range partitions and written down with a long ``at`` that ascends in that order.

    The high bits of ``at`` are the partition, the low ones the row's position in it, so neighbours in the order are neighbours
    in ``at`` and a key of any size is spread over as many partitions as it needs. Rows that tie are told apart by their place in the
    input, so no number of equal rows makes a partition large.
    """
    told = df.withColumn("told", F.monotonically_increasing_id())
    order = [*order, F.col("told")]
    return settle(told.repartitionByRange(*order).sortWithinPartitions(*order).drop("told").withColumn("at", F.monotonically_increasing_id()), purpose)


def ranked(df: DataFrame, key: str, order: Sequence[Column], purpose: str) -> DataFrame:
    """``df`` with ``rank`` (from 0, in ``order`` inside the non-null ``key``) and ``of`` (rows of that key).

    Ranks come from row positions and the counts of each (partition, key); that table has a row or few a partition and key, and
    no row of ``df`` meets more than one of them.
    """
    rows = placed(df, [F.col(key), *order], purpose).withColumn("part", F.shiftright("at", POSITION_BITS))
    runs = rows.groupBy("part", key).agg(F.min("at").alias("run_at"), F.count("*").alias("run_of"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "part", key, "run_at", F.coalesce(F.sum("run_of").over(before), F.lit(0)).alias("run_start"),
        F.sum("run_of").over(Window.partitionBy(key)).alias("of"))
    return rows.join(starts, ["part", key]).withColumn("rank", F.col("run_start") + F.col("at") - F.col("run_at")).drop(
        "part", "at", "run_at", "run_start")
