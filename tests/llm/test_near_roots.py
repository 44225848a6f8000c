"""Dense roots of every tree are compared."""

from pyspark.sql import functions as F

from pagespark.llm import near_dedup


def test_dense_roots_of_late_trees(spark):
    """A group of near copies that meets in the root of one tree only, whichever it is."""
    n = near_dedup.NODE_ROWS + 30
    for tree in (0, near_dedup.TREES - 1):
        roots = F.array(*[F.lit(7) if k == tree else F.col("id") * 100 + 1000 + k for k in range(near_dedup.TREES)])
        classes = spark.range(n).select(
            F.col("id").alias("cid"), F.lit(50).alias("n"), F.transform(roots, lambda x: x.cast("long")).alias("roots"),
            F.lit("a" * near_dedup.LETTERS).alias("letters"))
        small, big = near_dedup.nodes(classes)
        assert small.count() == 0
        assert {(r["node"], r["cid"]) for r in big.collect()} == {(7, i) for i in range(n)}


def _apart(spark, n, trees):
    """Classes that are all apart and share the dense root of each tree."""
    seen = spark.range(n).select(F.lit(7).cast("long").alias("node"), F.col("id").alias("cid"), F.lit(n).cast("long").alias("size"), F.lit(0).alias("tree"), F.lit(-1).cast("long").alias("held"))
    large = seen
    for k in range(1, trees):
        large = large.unionByName(seen.withColumns({"node": F.lit(7 + k).cast("long"), "tree": F.lit(k), "held": F.lit(7).cast("long")}))
    return large, spark.range(n).select(F.col("id").alias("cid"), F.col("id").alias("place"))


def test_crossing_rows_do_not_grow_with_the_square(spark):
    rows = {n: near_dedup.crossing(*_apart(spark, n, 3)).count() for n in (1536, 6144)}
    assert rows[6144] <= 9 * rows[1536]  # 16 times before
    assert rows[6144] <= 6144 * 2 * 8


def test_crossing_lets_every_pair_meet(spark):
    """Once in the first root; a class that only a later root holds meets the others there."""
    n = 300
    large, placed = _apart(spark, n, 2)
    late = large.filter("tree = 1").limit(1).selectExpr("node", f"{n}L as cid", "size", "tree", "-1L as held")
    placed = placed.unionByName(spark.createDataFrame([(n, n)], "cid long, place long"))
    met = {}
    for r in near_dedup.crossing(large.unionByName(late), placed).collect():
        met.setdefault(r["unit"], []).append((r["cid"], r["side"]))
    pairs = set()
    for rows in met.values():
        for a, s in rows:
            for b, t in rows:
                if s == 1 and (t == 2 or t == 3 and a < b):
                    assert (min(a, b), max(a, b)) not in pairs
                    pairs.add((min(a, b), max(a, b)))
    assert pairs == {(a, b) for b in range(n + 1) for a in range(b)}
