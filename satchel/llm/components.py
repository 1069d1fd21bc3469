"""Connected components of an edge table, without lists of neighbours and without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node id reachable; nodes without edges have no row.

    Each round every node takes the neighbour (or itself) that is first in a hashed order, and the edges are
    contracted to those leaders; hashing keeps the number of rounds logarithmic on paths too.  Neighbours are reduced
    by ``min`` (combined before the shuffle), so a hub with millions of edges is no hot group.  An empty edge table
    gives an empty result; self loops, repeats and null ends are ignored.
    """
    def ranked(c: str):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b").distinct()
    left = written(edges, "edges")
    to = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().withColumn("leader", F.col("node"))
    to = written(to, "leaders")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select("a", F.least("m", ranked("a"))["v"].alias("p"))
        step = written(step, "step")
        one = step.select(F.col("a").alias("x"), F.col("p").alias("px"))
        two = step.select(F.col("a").alias("y"), F.col("p").alias("py"))
        to = written(to.join(one, to.leader == one.x, "left").select("node", F.coalesce("px", "leader").alias("leader")), "leaders")
        left = left.join(one, left.a == one.x).join(two, left.b == two.y).select(F.col("px").alias("a"), F.col("py").alias("b"))
        left = written(left.where("a != b").distinct(), "edges")
    least = to.groupBy("leader").agg(F.min("node").alias("component"))
    return to.join(least, "leader").select("node", "component")
