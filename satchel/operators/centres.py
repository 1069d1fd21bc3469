"""Centroids, medoids and spreads of clusters.  Assignments are (bag_idx, cluster); negative clusters are unassigned."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .joins import pair_table


def assigned(instances: DataFrame, clusters: DataFrame) -> DataFrame:
    return instances.join(clusters.where("cluster >= 0").select("bag_idx", "cluster"), "bag_idx")


def mean_centroids(instances: DataFrame, clusters: DataFrame, compat_first_twice: bool = False) -> DataFrame:
    """cluster and c: the mean of all instances.  compat_first_twice counts the instances of the first bag twice."""
    rows = assigned(instances, clusters)
    weight = F.lit(1)
    if compat_first_twice:
        first = clusters.where("cluster >= 0").groupBy("cluster").agg(F.min("bag_idx").alias("_first"))
        rows = rows.join(F.broadcast(first), "cluster")
        weight = F.when(F.col("bag_idx") == F.col("_first"), 2).otherwise(1)
    flat = rows.select("cluster", weight.alias("w"), F.posexplode("x").alias("dim", "v")).groupBy("cluster", "dim").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return flat.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("c"))


def held(centroids: DataFrame) -> dict[int, np.ndarray]:
    """k centroids (or medoid bags) on the driver."""
    return {r[0]: np.asarray(r[1], float) for r in centroids.collect()}


def spreads(instances: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, dim, mean, var, std (sample) and n."""
    flat = assigned(instances, clusters).select("cluster", F.posexplode("x").alias("dim", "v"))
    return flat.groupBy("cluster", "dim").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("var"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"))


def unions(bags: DataFrame, clusters: DataFrame) -> DataFrame:
    """bag_idx (the cluster) and bag: all instances of a cluster, in the order of the bags."""
    rows = bags.join(clusters.where("cluster >= 0").select("bag_idx", "cluster"), "bag_idx")
    grouped = rows.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("bag_idx", "bag"))).alias("b"))
    return grouped.select(F.col("cluster").cast("long").alias("bag_idx"), F.flatten(F.col("b.bag")).alias("bag"))


def medoids(bags: DataFrame, clusters: DataFrame, distance: str = "maxmin", block: int = 256) -> DataFrame:
    """cluster, bag_idx, bag, d: the bag of least distance to all instances of its cluster, the lowest index on ties.

    For the three distances to nearest instances a candidate's own instances are at 0, so no bag is nearer than one of finite
    values (of ``minmin``: with any such instance): the first of these is the medoid, and only clusters without one are compared.
    For those, and for ``mean``, members of a cluster are cut into blocks, and each is compared with each block of its own cluster as a task: what
    leaves it is the least distance of every instance of the candidate to the block (for ``mean`` the sum and the
    number), which are combined by candidate.  Only distances that need all of a cluster at once (not of the Hausdorff
    family) still take its union as one row."""
    rows = bags.join(clusters.where("cluster >= 0").select("bag_idx", "cluster"), "bag_idx").select("cluster", "bag_idx", "bag")
    if distance in ("maxmin", "minmin", "meanmin"):
        plain = rows.where(_at_zero(distance)).groupBy("cluster").agg(F.min("bag_idx").alias("bag_idx"))
        first = rows.join(F.broadcast(plain), ["cluster", "bag_idx"]).select("cluster", "bag_idx", "bag", F.lit(0.0).alias("d"))  # a row per cluster
        rest = rows.join(F.broadcast(plain.select("cluster")), "cluster", "left_anti")
        return first if rest.isEmpty() else first.unionByName(_least(rest, _to_own_cluster(rest, distance, block)))
    if distance in kernels.HAUSDORFF:
        d = _to_own_cluster(rows, distance, block)
    else:
        d = pair_table(bags, unions(bags, clusters), distance).select(F.col("i").alias("bag_idx"), F.col("j").cast("int").alias("cluster"), "d")
    return _least(rows, d)


def _at_zero(distance: str) -> Column:
    """Whether a bag is at no distance from any union that holds it."""
    def finite(x: Column) -> Column:
        return F.forall(x, lambda v: F.abs(v) < float("inf"))

    return F.exists("bag", finite) if distance == "minmin" else F.forall("bag", finite)


def _least(rows: DataFrame, d: DataFrame) -> DataFrame:
    best = rows.join(d, ["bag_idx", "cluster"]).groupBy("cluster").agg(F.min_by(F.struct("bag_idx", "bag", "d"), F.struct("d", "bag_idx")).alias("m"))
    return best.select("cluster", "m.bag_idx", "m.bag", "m.d")


def _to_own_cluster(rows: DataFrame, distance: str, block: int) -> DataFrame:
    """cluster, bag_idx, d to all instances of the cluster, from partial extremes (or sums) by block."""
    n = F.ceil(F.col("n") / block).cast("int")
    sized = rows.join(F.broadcast(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))), "cluster")  # a row per cluster
    sized = sized.select("cluster", "bag_idx", "bag", F.pmod(F.xxhash64("bag_idx"), n).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    members = sized.select(F.col("cluster").alias("c"), F.col("bag_idx").alias("j"), F.col("bag").alias("y"), F.col("other").alias("r"), F.col("own").alias("s"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"cluster": np.zeros(0, int), "bag_idx": np.zeros(0, int), "inst": np.zeros(0, int), "v": np.zeros(0), "m": np.zeros(0, int)})]
        if len(x) and len(y):
            y = y.sort_values("j")
            stack = np.concatenate([np.stack(b).astype(float) for b in y.y])
            for c, i, bag in zip(x.cluster, x.bag_idx, x.bag, strict=True):
                far = kernels.euclidean(np.stack(bag).astype(float), stack)
                v = far.sum(1) if distance == "mean" else far.min(1)
                out.append(pd.DataFrame({"cluster": c, "bag_idx": i, "inst": np.arange(len(v)), "v": v, "m": len(stack)}))
        return pd.concat(out)

    parts = sized.groupBy("cluster", "own", "other").cogroup(members.groupBy("c", "r", "s")).applyInPandas(compare, "cluster int, bag_idx long, inst int, v double, m long")
    keys = ["cluster", "bag_idx"]
    if distance == "mean":
        return parts.groupBy(*keys).agg((F.sum("v") / F.sum("m")).alias("d"))
    least = parts.groupBy(*keys, "inst").agg(F.min("v").alias("v"))
    return least.groupBy(*keys).agg({"maxmin": F.max, "minmin": F.min, "meanmin": F.avg}[distance]("v").alias("d"))


def counts(clusters: DataFrame, k: int) -> DataFrame:
    """cluster and n for 0 to k - 1, empty ones too; unassigned bags as cluster -1."""
    spark = clusters.sparkSession
    n = clusters.groupBy(F.greatest("cluster", F.lit(-1)).alias("cluster")).count()
    every = spark.range(-1, k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(n, "cluster", "left").select("cluster", F.coalesce("count", F.lit(0)).alias("n"))


def survey(instances: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, bags, instances, dim, mean, std (sample) of each cluster and, as cluster -1, of all data; clusters without
    instances have no rows."""
    inside = clusters.where("cluster >= 0").select("bag_idx", "cluster")
    kinds = F.array(F.lit(-1), F.col("cluster"))
    rows = instances.join(inside, "bag_idx", "left").select("bag_idx", "x", F.explode(F.when(F.col("cluster").isNull(), F.array(F.lit(-1))).otherwise(kinds)).alias("cluster"))
    bags = rows.groupBy("cluster").agg(F.count_distinct("bag_idx").alias("bags"), F.count(F.lit(1)).alias("instances"))
    flat = rows.select("cluster", F.posexplode("x").alias("dim", "v")).groupBy("cluster", "dim").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return flat.join(F.broadcast(bags), "cluster").select("cluster", "bags", "instances", "dim", "mean", "std")  # a row per cluster
