"""Merkle manifest of a table: leaf digests, a tree per key, a tree over the keys' roots, and a proof for every row.

Nodes carry the interval of leaf ranks they cover: a node of level l and rank i covers [i * 3^l, (i + 1) * 3^l), cut at the number
of leaves. Levels come in buckets of ``LEVELS``; inside a bucket everything below one node of its top level is a block of at
most 3^LEVELS entries. Going up, a block's inner nodes are computed from its entries, and its top enters the next
bucket. Going down, an entry meets the inner nodes of its block whose interval contains it (a containment join on the block); those
are its ancestors in the bucket, and the children of each ancestor whose interval does not contain the entry are its
siblings: the ancestor's interval less the entry's side of it. The proof of the block's top is attached behind, one row a block.

Blocks have the same size however many rows a key has, so a key with a third of all rows is as evenly dealt as the others; only digests
move, texts do not. The number of buckets grows with the logarithm of the largest key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, packed, settle, unpacked
from .ranges import ranked

ARITY = 3
LEVELS = 4  # in a bucket: blocks of at most 81 entries
BLOCK = ARITY ** LEVELS


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def field(value: Column) -> Column:
    """A null as ``-``, else the number of its UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _parents(children: Column) -> Column:
    """Nodes over every ARITY consecutive ones of ``children`` (array of struct lo, hi, digest), which travel with them."""
    def parent(i):
        part = F.slice(children, i + 1, ARITY)
        return F.struct(
            part[0]["lo"].alias("lo"), F.element_at(part, -1)["hi"].alias("hi"),
            digest(F.array_join(F.transform(part, lambda c: c["digest"]), "")).alias("digest"),
            F.transform(part, lambda c: F.struct(c["lo"], c["hi"], c["digest"])).alias("children"))
    return F.transform(F.sequence(F.lit(0), F.size(children) - 1, F.lit(ARITY)), parent)


def _blocks(entries: DataFrame, height: int) -> DataFrame:
    """key, of, block, n_up (levels of the tree left, at most LEVELS), entries and l1..lLEVELS (inner nodes, empty above the root)."""
    depth = F.lit(0)
    size = F.lit(1).cast("decimal(38,0)")
    for _ in range(height + LEVELS):  # levels of a tree of ``of`` leaves; the loop is as long as the tallest tree
        depth = depth + F.when(size < F.col("of"), 1).otherwise(0)
        size = size * ARITY
    out = entries.groupBy("key", "of", F.expr(f"rank div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("entries"))
    out = out.withColumn("n_up", F.least(F.lit(LEVELS), F.greatest(F.lit(0), depth - height)))
    below = "entries"
    for level in range(1, LEVELS + 1):
        none = F.expr("cast(array() as array<struct<lo:bigint,hi:bigint,digest:string,children:array<struct<lo:bigint,hi:bigint,digest:string>>>>)")
        out = out.withColumn(f"l{level}", F.when(F.col("n_up") >= level, _parents(F.col(below))).otherwise(none))
        below = f"l{level}"
    return out


def _tops(blocks: DataFrame) -> DataFrame:
    """The top node of each block, an entry of the next bucket (rank is its block)."""
    top = F.element_at(F.col("entries"), 1)
    for level in range(1, LEVELS + 1):
        here = F.col(f"l{level}")[0]
        top = F.when(F.col("n_up") >= level, F.struct(here["lo"].alias("lo"), here["hi"].alias("hi"), here["digest"].alias("digest"))).otherwise(top)
    return blocks.withColumn("top", top).select("key", "of", F.col("block").alias("rank"), "top.lo", "top.hi", "top.digest")


def _steps(blocks: DataFrame) -> DataFrame:
    """key, rank, digest, block, steps: for every entry its ancestors inside the bucket, bottom up, as the text left and right of its side."""
    entries = blocks.select("key", "block", F.posexplode("entries").alias("i", "e")).select(
        "key", "block", (F.col("block") * BLOCK + F.col("i")).alias("rank"), "e.lo", "e.digest")
    labelled = [F.expr(f"transform(l{level}, n -> struct({level} as level, n.lo as p_lo, n.hi as p_hi, n.children as children))") for level in range(1, LEVELS + 1)]
    inner = blocks.select("key", "block", F.explode(F.concat(*labelled)).alias("n")).select(F.col("key").alias("p_key"), F.col("block").alias("p_block"), "n.*")
    contained = (F.col("key") == F.col("p_key")) & (F.col("block") == F.col("p_block")) & (F.col("lo") >= F.col("p_lo")) & (F.col("lo") < F.col("p_hi"))
    side = lambda test: F.array_join(F.transform(F.filter(F.col("children"), test), lambda c: c["digest"]), "")
    step = F.struct(
        F.col("level"), side(lambda c: c["hi"] <= F.col("lo")).alias("left"), side(lambda c: c["lo"] > F.col("lo")).alias("right"))
    found = entries.join(inner, contained, "left").groupBy("key", "block", "rank", "digest").agg(
        F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), step))).alias("found"))
    return found.select("key", "block", "rank", "digest", F.transform("found", lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right"))).alias("steps"))


def proofs(leaves: DataFrame, above: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, roots) of one tree per ``key``.

    ``leaves``: key, rank, of, digest. ``roots``: key, digest. ``paths``: key, rank, steps (bottom up to the root). With ``above``
    as a function of the roots, its steps follow and its columns subroot and root come along.
    """
    entries = leaves.select("key", "of", "rank", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    most = leaves.agg(F.max("of")).first()[0] or 0
    buckets, height = [], 0
    while True:
        blocks = settle(_blocks(entries, height), "merkle-blocks")
        buckets.append(blocks)
        entries = _tops(blocks)
        height += LEVELS
        if ARITY ** height >= most:
            break
    roots = entries.select("key", "digest")
    upper = above(roots) if above else roots.select("key", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("steps"), F.col("digest").alias("root"))
    upper = upper.withColumn("rank", F.lit(0).cast("long"))
    carried = [c for c in upper.columns if c not in ("key", "rank", "steps")]
    for blocks in reversed(buckets):
        upper = upper.select(F.col("key").alias("u_key"), F.col("rank").alias("u_rank"), F.col("steps").alias("u_steps"), *carried)
        upper = _steps(blocks).join(upper, (F.col("key") == F.col("u_key")) & (F.col("block") == F.col("u_rank"))).select(
            "key", "rank", F.concat("steps", "u_steps").alias("steps"), *carried)
    return upper, roots


def fold(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and its proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def proof_digest(steps: Column) -> Column:
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "source",
             order: str = "doc_id", keep: Sequence[str] | None = None, **extra: Column) -> DataFrame:
    """``docs`` (or its columns to ``keep``) with leaf, steps (array of left, right), subroot, root, and the ``extra`` columns.

    A leaf is the digest of ``fields``; leaves ascend by ``order`` (nulls first, then the leaf) inside ``key``, keys ascend bytewise with
    null first. Nulls are hashed as ``-``, which no value gives; an empty text is ``0:``. Rows that are equal in all fields have equal leaves in neighbouring
    places; which of them gets which place makes no difference to any root. Empty tables give empty results. Result
    columns replace input columns of their names; other columns take no part.
    """
    names = list(docs.columns if keep is None else keep)
    rows = packed(
        docs, names, key=F.coalesce(F.concat(F.lit("="), col(key).cast("string")), F.lit("")), place=col(order),
        leaf=leaf_digest([col(f) for f in fields]), **extra)
    rows = settle(rows, "merkle-leaves")  # texts are read and hashed once
    leaves = settle(ranked(rows, "key", [F.col("place").asc_nulls_first(), F.col("leaf")], "merkle-order"), "merkle-ranks")

    def over_keys(roots: DataFrame) -> DataFrame:
        roots = settle(roots, "merkle-subroots")
        keys = ranked(roots.select(F.lit("").alias("all"), F.col("key").alias("k"), "digest"), "all", [F.col("k")], "merkle-keys")
        keys = settle(keys, "merkle-key-ranks")
        paths, _ = proofs(keys.select(F.col("all").alias("key"), "rank", "of", "digest"))
        return keys.select("k", "digest", F.col("rank").alias("k_rank")).join(paths.select("rank", "steps", "root"), F.col("k_rank") == F.col("rank")).select(
            F.col("k").alias("key"), "steps", F.col("digest").alias("subroot"), "root")

    paths, _ = proofs(leaves.select("key", "rank", "of", F.col("leaf").alias("digest")), over_keys)
    paths = paths.select(F.col("key").alias("t_key"), F.col("rank").alias("t_rank"), "steps", "subroot", "root")
    out = leaves.join(paths, (F.col("key") == F.col("t_key")) & (F.col("rank") == F.col("t_rank")))
    return unpacked(out, names, ["leaf", "steps", "subroot", "root", *extra])


def tampered(row_id: Column, text: Column) -> Column:
    """The text after tampering: where 2 divides the unsigned crc32 of the decimal id, its newlines are gone. Null ids and texts stay."""
    hit = F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
