"""Keyed top-k and keyed running values that do not put a hot key into one task.

A plain window partitioned by a key sorts all rows of that key in one task. When one key
may hold a third of the table, that task decides the job's run time. The two helpers here
split every key first:

* ``topk_per_key`` ranks inside (key, salt) and then ranks the survivors, so the last step
  sees at most ``k * salts`` rows per key.
* ``running`` cuts every key into time chunks, aggregates each chunk (with map-side partial
  aggregation), carries the chunk totals along, and only sorts inside (key, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 64
HOUR_MS = 3_600_000


def topk_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_on: Sequence[str],
    salts: int = DEFAULT_SALTS,
    rank_col: str | None = None,
) -> DataFrame:
    """First ``k`` rows per key in ``order`` (which must be total within a key)."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    in_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
    in_key = Window.partitionBy(*keys).orderBy(*order)
    first = salted.withColumn("_rank", F.row_number().over(in_salt)).filter(F.col("_rank") <= k)
    best = (
        first.drop("_rank", "_salt")
        .withColumn("_rank", F.row_number().over(in_key))
        .filter(F.col("_rank") <= k)
    )
    return best.withColumnRenamed("_rank", rank_col) if rank_col else best.drop("_rank")


@dataclass(frozen=True)
class Run:
    """One running value. ``how``: sum, max, min, last (previous non-null), next (following non-null).

    ``inclusive`` says whether the current row takes part.
    """

    name: str
    how: str
    value: Column
    inclusive: bool = True


def _summary(run: Run, order: Sequence[str], i: int) -> Column:
    col = f"_s{i}"
    at = F.struct(*[F.col(c) for c in order])
    if run.how == "sum":
        return F.sum(run.value).alias(col)
    if run.how == "max":
        return F.max(run.value).alias(col)
    if run.how == "min":
        return F.min(run.value).alias(col)
    present = F.when(run.value.isNotNull(), at)
    pick = F.max_by if run.how == "last" else F.min_by
    return pick(run.value, present).alias(col)


def _over(run: Run, value: Column, window, start: int, end: int) -> Column:
    framed = window.rowsBetween(start, end)
    if run.how == "sum":
        return F.sum(value).over(framed)
    if run.how == "max":
        return F.max(value).over(framed)
    if run.how == "min":
        return F.min(value).over(framed)
    if run.how == "last":
        return F.last(value, ignorenulls=True).over(framed)
    return F.first(value, ignorenulls=True).over(framed)


def _merge(run: Run, inside: Column, carry: Column) -> Column:
    if run.how == "sum":
        return F.coalesce(inside, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if run.how == "max":
        return F.greatest(inside, carry)
    if run.how == "min":
        return F.least(inside, carry)
    return F.coalesce(inside, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    runs: Sequence[Run],
    time_col: str,
    chunk_ms: int = HOUR_MS,
) -> DataFrame:
    """Add running values along ``order`` per key.

    ``order`` starts with ``time_col`` (a long, in ms), so equal chunks keep the order;
    its remaining columns break ties. Pick ``chunk_ms`` so that one chunk of the busiest
    key fits a task (see ``chunk_for``).
    """
    if order[0] != time_col:
        raise ValueError("the order must start with the time column")
    chunked = df.withColumn("_chunk", F.floor(F.col(time_col) / F.lit(chunk_ms)))
    totals = chunked.groupBy(*keys, "_chunk").agg(
        *[_summary(r, order, i) for i, r in enumerate(runs)]
    )
    along = Window.partitionBy(*keys).orderBy("_chunk")
    carried = []
    for i, r in enumerate(runs):
        lo, hi = (1, Window.unboundedFollowing) if r.how == "next" else (Window.unboundedPreceding, -1)
        carried.append(_over(r, F.col(f"_s{i}"), along, lo, hi).alias(f"_c{i}"))
    carry = totals.select(*keys, "_chunk", *carried)

    joined = chunked.join(carry, [*keys, "_chunk"], "left")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c) for c in order])
    out = []
    for i, r in enumerate(runs):
        if r.how == "next":
            lo, hi = (0 if r.inclusive else 1), Window.unboundedFollowing
        else:
            lo, hi = Window.unboundedPreceding, (0 if r.inclusive else -1)
        out.append(_merge(r, _over(r, r.value, inside, lo, hi), F.col(f"_c{i}")).alias(r.name))
    return joined.select(*df.columns, *out)


def merged_runs(df: DataFrame, keys: Sequence[str], start: str, end: str, gap_ms: int, chunk_ms: int = HOUR_MS * 24) -> DataFrame:
    """Maximal runs of intervals (start, end) per key: keys, run_start, run_end, run_rows.

    An interval goes on with a run while it starts no more than ``gap_ms`` after the run's end so far. Each (key, chunk of starts) is first
    summarised on its own: runs inside a chunk that neither the reach of earlier chunks touches nor a later chunk may go on with are finished there, the
    rest, two rows a chunk, is merged along the key. So a busy key's rows are sorted chunk by chunk, and one exchange carries them.
    """
    key = F.struct(*[F.col(k) for k in keys])  # a struct is never null, and equals one with the same nulls
    rows = df.select(key.alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.floor(F.col(start) / F.lit(chunk_ms)).alias("_c"), F.lit(1).cast("long").alias("_n"))

    def numbered(part: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_s", "_e")
        reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.col("_reach").isNull() | (F.col("_s") - F.col("_reach") > gap_ms)
        return part.withColumn("_reach", reach).withColumn("_run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def summary(part: DataFrame, *by: str) -> DataFrame:
        return part.groupBy(*by).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))

    inside = summary(numbered(rows, "_k", "_c"), "_k", "_c", "_run").withColumn("_last", F.max("_run").over(Window.partitionBy("_k", "_c")) == F.col("_run"))
    earlier = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    come = rows.groupBy("_k", "_c").agg(F.max("_e").alias("_far")).select("_k", "_c", F.max("_far").over(earlier).alias("_come"))
    met = inside.join(come, ["_k", "_c"]).withColumn("_touched", F.coalesce(F.col("_s") - F.col("_come") <= gap_ms, F.lit(False)))
    # Finished runs stay in their chunk's part; the others share the null part of the key. What the reach touches is one run.
    met = met.withColumn("_part", F.when(~F.col("_touched") & ~F.col("_last"), F.col("_c"))).withColumn("_one", F.when(~F.col("_touched"), F.col("_run")))
    whole = summary(numbered(summary(met, "_k", "_c", "_part", "_one"), "_k", "_part"), "_k", "_part", "_run")
    return whole.select("_k.*", F.col("_s").alias("run_start"), F.col("_e").alias("run_end"), F.col("_n").alias("run_rows"))


def chunk_for(df: DataFrame, keys: Sequence[str], time_col: str, rows_per_task: int = 5_000_000) -> int:
    """A chunk length for ``running``, from the row count and time span of the busiest key.

    One partially aggregated pass; a single row reaches the driver.
    """
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max(time_col) - F.min(time_col)).alias("span")
    )
    row = per_key.agg(F.max_by("span", "n").alias("span"), F.max("n").alias("n")).first()
    if row is None or not row["n"]:
        return HOUR_MS
    return max(1, int((row["span"] + 1) * min(1.0, rows_per_task / row["n"])))
