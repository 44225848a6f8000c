"""Comparing semantic trees: path signatures, full outer diff, reports, named snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import topk_per_key
from .ax import state_summary
from .tree_fold import path_rows

MAX_LINES = 100


def path_signature(ax: DataFrame) -> DataFrame:
    """One row per distinct path (snapshot_id, signature): role, name and state of the last node with it.

    The value is not part of the signature, so an edited field shows up as changed.
    """
    part = F.concat(F.col("role"), F.lit("|"), F.coalesce("name", F.lit("")))
    return path_rows(ax.withColumn("part", part).withColumn("state", state_summary()))


def friendly(role: Column, name: Column) -> Column:
    shown = F.when(F.length(name) > 0, F.concat(F.lit(' "'), name, F.lit('"'))).otherwise("")
    return F.concat(role, shown)


def diff_snapshots(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """Added, removed and changed paths between two signature tables.

    Output: keys, kind, signature (display form of the after node, or of the removed one), was, now, pos, path.
    """
    cols = [*keys, "signature", "role", "name", "state", "pos"]
    both = before.select(*cols, F.lit(False).alias("_after")).unionByName(after.select(*cols, F.lit(True).alias("_after")))
    return diff_versions(both, F.col("_after"), keys)


def diff_versions(signatures: DataFrame, is_after: Column, keys: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """The same for both versions in one signature table; ``is_after`` marks the newer one.

    A path occurs at most once per version, so the full outer match on (keys, path) is one
    aggregate: the table is read once and combined before the shuffle.
    """
    keys = list(keys)
    node = F.struct("role", "name", "state", "pos")
    both = signatures.withColumn("_is_after", is_after).groupBy(*keys, F.col("signature").alias("path")).agg(
        F.max(F.when(~F.col("_is_after"), node)).alias("b"), F.max(F.when(F.col("_is_after"), node)).alias("a"))
    kind = (
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed")
        .when(F.col("a.state") != F.col("b.state"), "changed")
    )
    shown = both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("_n", F.coalesce("a", "b"))
    return shown.select(
        *keys, "kind", friendly(F.col("_n.role"), F.col("_n.name")).alias("signature"),
        F.when(F.col("kind") == "changed", F.col("b.state")).alias("was"),
        F.when(F.col("kind") == "changed", F.col("a.state")).alias("now"),
        F.col("_n.pos").alias("pos"), "path",
    )


def diff_report(diff: DataFrame, base: DataFrame, name: str, keys: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """One text per key: counted sections with at most 100 lines each, or "No changes since".

    ``base`` lists the keys that were compared. Lines are limited with a salted top-k, so
    the text of a huge diff stays small while its counts stay exact.
    """
    keys = list(keys)
    counts = diff.groupBy(*keys, "kind").agg(F.count("*").alias("n"))
    top = topk_per_key(diff, [*keys, "kind"], [F.col("pos"), F.col("path")], MAX_LINES, salt_on=["path"])
    was, now = (F.when(F.length(c) > 0, F.col(c)).otherwise("-") for c in ("was", "now"))
    line = (
        F.when(F.col("kind") == "added", F.concat(F.lit("  + "), F.col("signature")))
        .when(F.col("kind") == "removed", F.concat(F.lit("  - "), F.col("signature")))
        .otherwise(F.concat(F.lit("  ~ "), F.col("signature"), F.lit("  ["), was, F.lit("] → ["), now, F.lit("]")))
    )
    listed = top.groupBy(*keys, "kind").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "path", line.alias("line")))), lambda r: r["line"]).alias("lines"))
    more = F.when(F.col("n") > MAX_LINES, F.concat(
        F.lit("\n  …("), (F.col("n") - MAX_LINES).cast("string"), F.lit(" more)"))).otherwise("")
    section = F.concat(
        F.lit("\n"), F.initcap("kind"), F.lit(" ("), F.col("n").cast("string"), F.lit("):\n"),
        F.array_join("lines", "\n"), more)
    rank = F.when(F.col("kind") == "added", 1).when(F.col("kind") == "removed", 2).otherwise(3)
    texts = listed.join(counts, [*keys, "kind"]).groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), section.alias("text")))), lambda r: r["text"]), "\n").alias("body"))
    text = F.when(F.col("body").isNull(), F.lit(f'No changes since "{name}"')).otherwise(
        F.concat(F.lit(f'── diff vs "{name}" ──\n'), F.col("body")))
    return base.select(*keys).distinct().join(texts, keys, "left").select(*keys, text.alias("text"))


def snapshot_store(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Latest version per (session, name). ``log``: session, name, seq, version."""
    seen = log if as_of is None else log.filter(F.col("seq") <= as_of)
    return seen.groupBy("session", "name").agg(F.max_by("version", "seq").alias("version"), F.max("seq").alias("seq"))


def snapshot_lookup(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored version per wanted (session, name), or the error for a name nobody stored."""
    missing = F.concat(
        F.lit('No stored snapshot named "'), F.col("name"), F.lit('". Use store_as= on an earlier call first.'))
    return wanted.join(store.select("session", "name", "version"), ["session", "name"], "left").select(
        *wanted.columns, "version", F.when(F.col("version").isNull(), missing).alias("error"))


def rolling_diff(signatures: DataFrame, keys: Sequence[str] = ("session", "name")) -> DataFrame:
    """Each version against the one before it in its series.

    ``signatures``: keys, seq (of the version), signature, role, name_text as ``name``... one
    row per path and version. Versions are paired by ``lag`` over the short list of versions.
    """
    keys = list(keys)
    versions = signatures.select(*keys, "seq").distinct()
    order = Window.partitionBy(*keys).orderBy("seq")
    pairs = versions.withColumn("prev_seq", F.lag("seq").over(order)).filter(F.col("prev_seq").isNotNull())
    now = signatures.join(pairs.select(*keys, "seq"), [*keys, "seq"], "left_semi")
    was = signatures.withColumnRenamed("seq", "prev_seq").join(pairs, [*keys, "prev_seq"]).drop("prev_seq")
    return diff_snapshots(was, now, [*keys, "seq"])
