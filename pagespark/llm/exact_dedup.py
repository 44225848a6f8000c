"""Exact duplicates through an extendible-hash index in shared files.

Every text gets a 64-bit hash. The index is a directory of 2**depth slots over the hash's
leading bits; each slot points to a bucket, and a bucket that holds more than
``bucket_entries`` distinct hashes is split by one more bit, which doubles the directory when
the bucket already used all of its bits. Hot texts count as one entry, so they never split.

Owner tasks get ranges of (bucket, hash). Copies are first combined where they are read, then
texts of one hash are compared byte by byte: different texts under one hash become a chain of
entries. The finished index (one small row per distinct text) is written to the shared folder and
probed by the documents' (hash, digest) rows; texts are shuffled once and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, lower_ascii, settle

MAX_DEPTH = 16  # bits of the directory: at most 65,536 slots, whatever the input


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def directory(slots: dict[int, int], bucket_entries: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) for all slots, from the entries counted per slot of the deepest directory.

    Starts with one bit and doubles; ``bucket`` is the first deepest slot of its range, so
    that buckets are ordered ranges of the hash.
    """
    level = [(0, 1), (1 << (max_depth - 1), 1)]
    done: list[tuple[int, int]] = []
    while level:
        deeper = []
        for first, depth in level:
            width = 1 << (max_depth - depth)
            if depth == max_depth or sum(slots.get(s, 0) for s in range(first, first + width)) <= bucket_entries:
                done.append((first, depth))
            else:
                deeper += [(first, depth + 1), (first + width // 2, depth + 1)]
        level = deeper
    return [(s, first, depth) for first, depth in sorted(done) for s in range(first, first + (1 << (max_depth - depth)))]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 100_000,
                hash_bits: int = 64, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``bucket``, ``chain``.

    Texts are equal when identical after lower-casing A-Z. The largest id of a group stays. A null
    text is the empty text, and all empty texts are one group. Null ids lose to any other id;
    rows that repeat one id and text are counted, and stay or go together. ``hash_bits`` below 64
    shortens the hash (tests use it to force chains). An empty table gives no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = normalised(col(text_col))
    full = F.xxhash64(F.col("norm"))
    cut = 64 - hash_bits
    key = F.shiftleft(F.shiftrightunsigned(full, cut), cut) if cut else full
    rows = docs.select(col(id_col).alias("id"), text.alias("norm")).withColumn("h", key).withColumn(
        "slot", F.shiftrightunsigned("h", 64 - max_depth))
    light = settle(rows.select("id", "h", F.sha2("norm", 256).alias("sha")), "exact-rows")

    counted = light.select("h").distinct().groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("slot")).count()
    slots = {r["slot"]: r["count"] for r in counted.collect()}  # at most 2**max_depth rows
    dir_rows = spark.createDataFrame(directory(slots, bucket_entries, max_depth), "slot long, bucket long, depth int")

    entries = (
        rows.join(F.broadcast(dir_rows.select("slot", "bucket")), "slot")  # 2**max_depth rows at most
        .groupBy("bucket", "h", "norm")
        .agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
        .select("bucket", "h", F.sha2("norm", 256).alias("sha"), "group_size", "keep_id")
    )
    chain = Window.partitionBy("bucket", "h").orderBy("sha")
    index = settle(entries.repartitionByRange("bucket", "h").withColumn("chain", F.row_number().over(chain)), "exact-index")

    return light.join(index, ["h", "sha"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"), "bucket", "chain")
