"""URL rules: a blocked Bloom filter lets possible hits through, an exact hash join settles them.

A rule is a canonical host and a path prefix. A URL's candidates are its host's suffixes (as many labels
as any rule has) with its path's prefixes (of the lengths that rules have). The filter has a fixed
number of 512-bit blocks, built by ``bit_or`` over the rules; a candidate looks at one block only.
Its size does not depend on the rules: with many rules more false hits pass, and the exact join
removes all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, lower_ascii

BLOCKS = 4096  # x 512 bits = 256 KB, the size of the broadcast
WORDS = 8

#: Fixed rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _bits(key: Column) -> list[Column]:
    """Eight masks with one bit each, from six bits of a second hash per word."""
    second = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``block``, ``w0``..``w7`` for the non-empty blocks of a one-column table ``key``; at most ``blocks`` rows."""
    masks = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_bits(F.col("key")))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", blocks: int = BLOCKS) -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (which replace columns so named).

    A rule fits its host and subdomains when the path starts with the rule's; the rule of most
    characters wins, then the longer host, then block. A URL that no rule fits is not
    listed and gets ``default``. A null URL or one without ``://`` has an empty host and path and no rule. Empty
    tables give no rows; without rules all URLs get ``default``. Repeated rows are kept.
    """
    listed = rules.select(
        lower_ascii(F.coalesce(col("host"), F.lit(""))).alias("r_host"), F.coalesce(col("path"), F.lit("")).alias("r_path"),
        col("verdict").alias("r_verdict")).filter("r_host <> ''")
    shape = listed.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
                       F.collect_set(F.length("r_path")).alias("lengths")).first()  # one row; lengths up to the longest path
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"] or [])

    carried = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    out = pages.select(F.struct(*[col(c) for c in carried]).alias("row"), host_of(col(url_col)).alias("u_host"), path_of(col(url_col)).alias("u_path"))

    suffixes = F.array_distinct(F.array(*[F.substring_index("u_host", ".", -k) for k in range(1, labels + 1)])) if labels else F.array().cast("array<string>")
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("u_path"))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.struct(
        s.alias("c_host"), F.substr(F.col("u_path"), F.lit(1), n).alias("c_path")))))
    tried = (
        out.filter("u_host <> ''").select("u_host", "u_path").distinct()
        .select("u_host", "u_path", F.inline(pairs))
        .withColumn("key", F.concat("c_host", "c_path"))
        .withColumn("block", _block(F.col("key"), blocks))
    )
    sieve = bloom(listed.select(F.concat("r_host", "r_path").alias("key")), blocks)
    hit = F.lit(True)
    for i, mask in enumerate(_bits(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    possible = tried.join(F.broadcast(sieve), "block").filter(hit).select("u_host", "u_path", "c_host", "c_path")
    exact = possible.join(listed, (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path")))
    weight = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"), F.col("r_verdict"))
    best = exact.groupBy(F.col("u_host").alias("b_host"), F.col("u_path").alias("b_path")).agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), weight).alias("best"))
    joined = out.join(best, (F.col("u_host") == F.col("b_host")) & (F.col("u_path") == F.col("b_path")), "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in carried], F.col("u_host").alias("host"), F.col("u_path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
