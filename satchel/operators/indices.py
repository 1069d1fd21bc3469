"""Internal validity indices of an assignment (bag_idx, cluster) of bags (bag_idx, bag, label).

``by`` names further key columns: one row per key, so that all assignments of a population are rated by one plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import bag_mean, total
from ..sources.views import long
from .centres import held, mean_centroids, spreads, unions
from .joins import pair_table
from .lineage import light


def to_own_centroid(bags: DataFrame, clusters: DataFrame, distance: str = "maxmin") -> DataFrame:
    """bag_idx, cluster, d: distance to the mean centroid of the bag's own cluster (k centroids go with the task)."""
    centres = held(mean_centroids(long(bags), clusters))
    mine = bags.select("bag_idx", "bag").join(clusters.where("cluster >= 0").select("bag_idx", "cluster"), "bag_idx")

    def measure(batches):
        for pdf in batches:
            d = [kernels.distance(distance, np.stack(b), centres[c][None]) for b, c in zip(pdf.bag, pdf.cluster, strict=True)]
            yield pd.DataFrame({"bag_idx": pdf.bag_idx, "cluster": pdf.cluster, "d": np.array(d, float)})

    return mine.mapInPandas(measure, "bag_idx long, cluster int, d double")


def centroid_distances(bags: DataFrame, clusters: DataFrame, distance: str = "maxmin") -> DataFrame:
    """(i, j, d) for clusters i != j."""
    c = mean_centroids(long(bags), clusters).select(F.col("cluster").cast("long").alias("bag_idx"), F.array("c").alias("bag"))
    return pair_table(c, None, distance)


def twcv(own: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of squared distances to own centroids; ``own`` is to_own_centroid."""
    return own.groupBy(*by).agg(F.sum(F.col("d") * F.col("d")).alias("twcv"))


def rmsstd(own: DataFrame, dimensions: int, by: tuple[str, ...] = ()) -> DataFrame:
    per = own.groupBy(*by, "cluster").agg(F.sum(F.col("d") * F.col("d")).alias("s"), F.count("d").alias("n"))
    return per.groupBy(*by).agg(F.sqrt(F.try_divide(F.sum("s"), dimensions * F.sum(F.col("n") - 1))).alias("rmsstd"))


def xie_beni(own: DataFrame, between: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    per = own.groupBy(*by, "cluster").agg((F.sum(F.col("d") * F.col("d")) / F.count("d")).alias("s"), F.count("d").alias("n")).groupBy(*by).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    least = between.where("i < j").groupBy(*by).agg(F.min(F.col("d") * F.col("d")).alias("m"))
    both = per.join(least, list(by), "left") if by else per.join(least)  # without keys one row each
    return both.select(*by, F.try_divide("s", F.col("n") * F.col("m")).alias("xie_beni"))


def davies_bouldin(own: DataFrame, between: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over i of max_j (S_i + S_j) / min_j d(i, j), maximum and minimum taken apart."""
    s = own.groupBy(*by, "cluster").agg(F.avg("d").alias("s"))
    rows = between.join(s.toDF(*by, "i", "si"), [*by, "i"]).join(s.toDF(*by, "j", "sj"), [*by, "j"])
    return rows.groupBy(*by, "i").agg(F.try_divide(F.max(F.col("si") + F.col("sj")), F.min("d")).alias("r")).groupBy(*by).agg(F.avg("r").alias("davies_bouldin"))


def silhouette_values(pairs: DataFrame, clusters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """bag_idx, cluster, a, b, s: own cluster divided by n - 1, others by n; s is 0 for a cluster of one."""
    c = light(clusters.where("cluster >= 0").select(*by, "bag_idx", "cluster"))
    rows = pairs.join(c.toDF(*by, "i", "ci"), "i").join(c.toDF(*by, "j", "cj"), [*by, "j"]).groupBy(*by, "i", "ci", "cj").agg(F.avg("d").alias("d"))
    rows = rows.groupBy(*by, F.col("i").alias("bag_idx"), F.col("ci").alias("cluster")).agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("b"))
    s = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return rows.withColumn("s", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(s, F.lit(0.0))))


def silhouette(pairs: DataFrame, clusters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return silhouette_values(pairs, clusters, by).groupBy(*by).agg(F.coalesce(F.avg("s"), F.lit(-1.0)).alias("silhouette"))


def s_dbw(bags: DataFrame, clusters: DataFrame, distance: str = "maxmin") -> DataFrame:
    """scat, dens and their sum: spread of clusters against all data, and how many bags lie near the union of two; infinite
    without clusters.  The distances come from the pair table, whatever the number of clusters."""
    from .evoclusters import Space

    one = clusters.select(F.lit(0).cast("long").alias("ind_id"), "bag_idx", "cluster")
    found = Space(bags, distance=distance, once=True).s_dbw(one).select("scat", "dens", "s_dbw")
    return found.agg(*(F.coalesce(F.max(c), F.lit(float("inf"))).alias(c) for c in ("scat", "dens", "s_dbw")))


def ftwcv(bags: DataFrame, clusters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of squared norms of bag means, less per cluster that sum divided by its size."""
    q = bags.join(clusters.where("cluster >= 0").select(*by, "bag_idx", "cluster"), "bag_idx").select(*by, "cluster", total(F.transform(bag_mean(F.col("bag")), lambda v: v * v)).alias("q"))
    per = q.groupBy(*by, "cluster").agg(F.sum("q").alias("s"), F.count("q").alias("n"))
    return per.groupBy(*by).agg((F.sum("s") - F.sum(F.col("s") / F.col("n"))).alias("ftwcv"))


def ftwcv_fitness(scores: DataFrame) -> DataFrame:
    """Of (ind_id, f, complete): selection values against the extremes of the generation."""
    e = scores.agg(F.max("f").alias("_max"), F.min("f").alias("_min"))
    return scores.join(F.broadcast(e)).select("ind_id", F.when(F.col("complete"), 1.5 * F.col("_max") - F.col("f")).otherwise(F.col("_min")).alias("fitness"))


def longest_links(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys and longest: the longest edge of the least spanning tree of each graph of edges (keys, i, j, r) with i < j.

    All graphs at once: in each round every part of a tree takes its least edge to another part (ties by i and j), parts
    that meet become one by pointer jumping, and of the edges between two parts the least stays.  So parts at least halve, and
    neither a graph nor a part is ever in one task.  A graph that isn't connected has the trees of its components."""
    from .lineage import saved

    ends = [F.struct(*keys, F.col(c).alias("v")) for c in ("i", "j")]
    left, longest = saved(edges.select(ends[0].alias("a"), ends[1].alias("b"), F.struct("r", "i", "j").alias("e"))), None
    while not left.isEmpty():
        picked = left.union(left.select("b", "a", "e")).groupBy("a").agg(F.min(F.struct("e", "b")).alias("m"))
        picked = saved(picked.select("a", F.col("m.b").alias("up"), F.col("m.e.r").alias("r")))
        most = picked.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.max("r").alias("longest"))
        longest = most if longest is None else longest.unionByName(most)
        # of two parts that pick each other the first is the root
        other = picked.select(F.col("a").alias("up"), F.col("up").alias("back"))
        to = saved(picked.join(other, "up").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("up")), F.col("a")).otherwise(F.col("up")).alias("up")))
        while True:
            further = to.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = saved(to.join(further, "up").select("a", "up", "top"))
            to = jumped.select("a", F.col("top").alias("up"))
            if jumped.where("up != top").isEmpty():
                break
        both = left.join(to, "a").drop("a").withColumnRenamed("up", "p").join(to.withColumnRenamed("a", "b"), "b").select("p", F.col("up").alias("q"), "e").where("p != q")
        left = saved(both.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("e").alias("e")))
    if longest is None:
        return edges.select(*keys, F.col("r").alias("longest")).limit(0)
    return longest.groupBy(*keys).agg(F.max("longest").alias("longest"))


def dbcv(bags: DataFrame, clusters: DataFrame, pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Density-based validity: each cluster's spanning tree of mutual reachability against the gap to other clusters.

    Noise (negative clusters) counts in the weights only.  The trees of all clusters, and of all keys, grow together.
    """
    d = bags.select(F.size(F.col("bag")[0])).first()[0]
    every = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("_every"))
    c = light(clusters.where("cluster >= 0").select(*by, "bag_idx", "cluster"))
    inside = pairs.join(c.toDF(*by, "i", "ci"), "i").join(c.toDF(*by, "j", "cj"), [*by, "j"])
    own = inside.where("ci = cj")
    core = own.groupBy(*by, "i").agg(F.pow(F.sum(F.pow(1 / F.greatest("d", F.lit(1e-12)), F.lit(float(d)))) / F.count("d"), F.lit(-1.0 / d)).alias("core"))
    core = light(core)
    reach = inside.join(core.toDF(*by, "i", "ki"), [*by, "i"]).join(core.toDF(*by, "j", "kj"), [*by, "j"]).withColumn("r", F.greatest("d", "ki", "kj"))

    sparse = longest_links(reach.where("ci = cj and i < j").select(*by, F.col("ci").alias("cluster"), "i", "j", "r"), [*by, "cluster"]).withColumnRenamed("longest", "sparse")
    gap = reach.where("ci != cj").groupBy(*by, F.col("ci").alias("cluster")).agg(F.min("r").alias("gap"))
    n = c.groupBy(*by, "cluster").agg(F.count("bag_idx").alias("n"))
    v = n.join(sparse, [*by, "cluster"], "left").join(gap, [*by, "cluster"], "left")
    v = v.join(every, list(by)) if by else v.join(F.broadcast(every))  # without keys one row
    value = F.coalesce(F.try_divide(F.col("gap") - F.col("sparse"), F.greatest("gap", "sparse")), F.lit(0.0))
    return v.groupBy(*by).agg((F.sum(value * F.col("n") / F.col("_every"))).alias("dbcv"))


def evaluation(bags: DataFrame, clusters: DataFrame, distance: str = "maxmin") -> DataFrame:
    """full_evaluation as one row; no row where no bag is assigned."""
    found = full_evaluation(bags, clusters, distance)
    names = ", ".join(f"{k} double" for k in found) or "rmsstd double"
    return bags.sparkSession.createDataFrame([tuple(None if v is None else float(v) for v in found.values())] if found else [], names)


def full_evaluation(bags: DataFrame, clusters: DataFrame, distance: str = "maxmin") -> dict[str, float]:
    """All internal indices; no table of pairs is kept.  Where no bag is assigned none is defined, so none is given."""
    from . import density, silhouettes
    from .lineage import saved

    if clusters.where("cluster >= 0").isEmpty():
        return {}
    own, between = saved(to_own_centroid(bags, clusters, distance)), saved(centroid_distances(bags, clusters, distance))
    d = bags.select(F.size(F.col("bag")[0])).first()[0]
    labels = saved(clusters.select(F.lit(0).cast("long").alias("ind_id"), "bag_idx", "cluster"))
    wide = silhouettes.silhouettes(bags, labels, distance).agg(F.coalesce(F.max("silhouette"), F.lit(-1.0)).alias("silhouette"))
    dense = density.dbcv(bags, labels, distance).select("dbcv")
    frames = [rmsstd(own, d), wide, xie_beni(own, between), davies_bouldin(own, between), s_dbw(bags, clusters, distance), dense, twcv(own), ftwcv(bags, clusters)]
    return {k: v for f in frames for k, v in f.first().asDict().items()}
