"""Preorder places of very large trees by list ranking on the Euler tour.

Walking around a tree passes every node twice: down into it and up out of it. Each pass knows its successor from the node's children,
siblings and parent alone. Pointer doubling then sums, for every pass, what lies between it and the end of the walk: in round r a pass looks 2^r
passes ahead, so a tree of n nodes needs about log2(2 n) joins and no task ever holds a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

END = "."  # no pass has this name
DOWN, UP = "+", "-"


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_places(links: DataFrame, parents: DataFrame, roots: DataFrame) -> DataFrame:
    """(snapshot_id, nodeId, ord, parent_ord, depth, last) of all nodes that a root reaches.

    ``links``: snapshot_id, nodeId. ``parents``: snapshot_id, nodeId, parent, place (order among siblings). ``roots``: snapshot_id, root. Nodes on
    cycles and below other parentless nodes never reach the end and are left out.
    """
    name = lambda c, way: F.concat(F.col(c), F.lit(way))
    siblings = Window.partitionBy("snapshot_id", "parent").orderBy("place")
    kin = parents.withColumn("next", F.lead("nodeId").over(siblings)).withColumn("first", F.row_number().over(siblings) == 1)
    first_child = kin.filter("first").select("snapshot_id", F.col("parent").alias("nodeId"), F.col("nodeId").alias("child"))
    nodes = links.select("snapshot_id", "nodeId").join(kin.select("snapshot_id", "nodeId", "parent", "next"), ["snapshot_id", "nodeId"], "left").join(
        first_child, ["snapshot_id", "nodeId"], "left").join(roots, "snapshot_id")
    on = F.when(F.col("nodeId") == F.col("root"), END).when(F.col("next").isNotNull(), name("next", DOWN)).otherwise(name("parent", UP))
    passes = nodes.select("snapshot_id", F.explode(F.array(
        F.struct(name("nodeId", DOWN).alias("at"), F.coalesce(name("child", DOWN), name("nodeId", UP)).alias("on"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d")),
        F.struct(name("nodeId", UP).alias("at"), on.alias("on"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d")))).alias("p")).select("snapshot_id", "p.*")
    passes = _written(passes, "tree-passes")
    longest = passes.groupBy("snapshot_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < longest:
        ahead = passes.select("snapshot_id", F.col("at").alias("on"), F.col("on").alias("a_on"), F.col("n").alias("a_n"), F.col("d").alias("a_d"))
        passes = _written(passes.join(ahead, ["snapshot_id", "on"], "left").select(
            "snapshot_id", "at", F.when(F.col("a_n").isNull(), F.col("on")).otherwise(F.col("a_on")).alias("on"),
            (F.col("n") + F.coalesce("a_n", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("a_d", F.lit(0))).alias("d")), "tree-passes")
        reach *= 2
    down = F.substring("at", -1, 1) == DOWN
    ranked = passes.filter(F.col("on") == END).groupBy("snapshot_id", F.expr("substring(at, 1, length(at) - 1)").alias("nodeId")).agg(
        F.max(F.when(down, F.col("n"))).alias("left"), F.max(F.when(~down, F.col("n"))).alias("after"), F.max(F.when(down, -F.col("d"))).alias("depth"))
    whole = ranked.filter("depth = 0").select("snapshot_id", F.col("left").alias("whole"))
    placed = ranked.join(whole, "snapshot_id").select(
        "snapshot_id", "nodeId", (F.col("whole") - F.col("left")).cast("int").alias("ord"), F.col("depth").cast("int").alias("depth"),
        (F.col("whole") - F.col("after") - 1).cast("int").alias("last"))
    placed = _written(placed, "tree-places")
    above = placed.select("snapshot_id", F.col("nodeId").alias("parent"), F.col("ord").alias("parent_ord"))
    up = parents.select("snapshot_id", "nodeId", "parent").join(above, ["snapshot_id", "parent"]).select("snapshot_id", "nodeId", "parent_ord")
    return placed.join(up, ["snapshot_id", "nodeId"], "left").withColumn("parent_ord", F.when(F.col("depth") > 0, F.col("parent_ord"))).select(
        "snapshot_id", "nodeId", "ord", "parent_ord", "depth", "last")
