"""Dataset transforms and set operations on bags and instances.

Instances are (bag_idx, ord, x, label); bags are (bag_idx, bag, label).  Statistics are taken per attribute over all
instances of all bags in one aggregation that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def attributes(instances: DataFrame) -> DataFrame:
    """Per attribute: dim, n, low, high, mean, std (sample)."""
    flat = instances.select(F.posexplode("x").alias("dim", "v"))
    return flat.groupBy("dim").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def _arrays(stats: DataFrame, *names: str) -> DataFrame:
    """One row with an array per statistic, in the order of the attributes."""
    return stats.agg(*(F.sort_array(F.collect_list(F.struct("dim", n)))[n].alias(f"_{n}") for n in names))


def _with(instances: DataFrame, *names: str) -> DataFrame:
    return instances.join(F.broadcast(_arrays(attributes(instances), *names)))  # one row


def standardised(instances: DataFrame, kind: str = "z1") -> DataFrame:
    """z1: (x - mean) / sample deviation; z5: (x - least) / range; a constant attribute becomes 0."""
    if kind == "z1":
        known, a, b = _with(instances, "mean", "std"), F.col("_mean"), F.col("_std")
    else:
        known, a, b = _with(instances, "low", "high"), F.col("_low"), F.transform(F.arrays_zip("_low", "_high"), lambda s: s["_high"] - s["_low"])
    x = F.transform("x", lambda v, i: F.when(F.coalesce(b[i], F.lit(0.0)) == 0, 0.0).otherwise((v - a[i]) / b[i]))
    return known.withColumn("x", x).select(*instances.columns)


def imputed(instances: DataFrame) -> DataFrame:
    """Missing numbers become the mean of their attribute."""
    return _with(instances, "mean").withColumn("x", F.transform("x", lambda v, i: F.coalesce(v, F.col("_mean")[i]))).select(*instances.columns)


def cut_points(instances: DataFrame, bins: int = 10) -> DataFrame:
    """dim and cuts of equal width; no cuts where the attribute is constant."""
    s = attributes(instances)
    cuts = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / bins)
    return s.select("dim", F.when(F.col("high") > F.col("low"), cuts).otherwise(F.array().cast("array<double>")).alias("cuts"))


def best_cut_points(instances: DataFrame, most: int = 10) -> DataFrame:
    """Equal width with the number of bins (1 to most) of least leave-one-out entropy, from one histogram per number."""
    s = attributes(instances)
    flat = instances.select(F.posexplode("x").alias("dim", "v")).join(F.broadcast(s), "dim").where("high > low")
    tried = flat.select("dim", "n", "low", "high", "v", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    width = (F.col("high") - F.col("low")) / F.col("k")
    slot = F.least(F.greatest(F.ceil((F.col("v") - F.col("low")) / width), F.lit(1)), F.col("k"))
    counts = tried.groupBy("dim", "k", "n", "low", "high", slot.alias("slot")).count()
    loss = F.sum(F.when(F.col("count") < 2, F.lit(float("inf"))).otherwise(-F.col("count") * F.log((F.col("count") - 1) / width)))
    best = counts.groupBy("dim", "k", "low", "high").agg(loss.alias("loss")).groupBy("dim").agg(F.min_by(F.struct("k", "low", "high"), F.struct("loss", "k")).alias("b"))
    cuts = F.when(F.col("b.k") < 2, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.col("b.k") - 1, F.lit(1))), lambda j: F.col("b.low") + (F.col("b.high") - F.col("b.low")) * j / F.col("b.k")))
    return s.select("dim").join(best.select("dim", cuts.alias("cuts")), "dim", "left").select("dim", F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"))


def discretised(instances: DataFrame, cuts: DataFrame) -> DataFrame:
    """x becomes an array of labels: B1 to Bn by the intervals (-inf, c1], (c1, c2], ...; All where there are no cuts."""
    row = cuts.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "cuts"))), lambda s: s["cuts"]).alias("_cuts"))
    known = instances.join(F.broadcast(row))  # one row

    def label(v: Column, i: Column) -> Column:
        c = F.col("_cuts")[i]
        return F.when(F.size(c) == 0, "All").otherwise(F.concat(F.lit("B"), (F.size(F.filter(c, lambda p: v > p)) + 1).cast("string")))

    return known.withColumn("x", F.transform("x", label)).select(*instances.columns)


def binary_splits(instances: DataFrame, cuts: DataFrame) -> DataFrame:
    """x becomes one flag per attribute and cut point: whether the value is at most the cut."""
    row = cuts.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "cuts"))), lambda s: s["cuts"]).alias("_cuts"))
    flags = F.flatten(F.transform("x", lambda v, i: F.transform(F.col("_cuts")[i], lambda p: v <= p)))
    return instances.join(F.broadcast(row)).withColumn("x", flags).select(*instances.columns)


def relabelled_by_size(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters are numbered from 0 by falling size, ties by old label; negative labels stay."""
    sizes = assigned.where(F.col(cluster) >= 0).groupBy(cluster).count()
    order = sizes.select(cluster, (F.row_number().over(Window.orderBy(F.desc("count"), cluster)) - 1).alias("_new"))  # one row per cluster
    return assigned.join(F.broadcast(order), cluster, "left").withColumn(cluster, F.coalesce(F.col("_new"), F.col(cluster)).cast("int")).select(*assigned.columns)


def union_of_datasets(sets: list[DataFrame], positive: int = 1) -> DataFrame:
    """The positive bags of all sets with new ids from 0, labelled by the number of their set; widths must agree."""
    widths = {r[0] for s in sets for r in s.select(F.size(F.col("bag")[0])).limit(1).collect()}
    if len(widths) > 1:
        raise ValueError("the bags of these sets have instances of different widths")
    out = None
    for i, s in enumerate(sets):
        part = s.where(F.col("label") == positive).select(F.lit(i).alias("label"), "bag_idx", "bag")
        out = part if out is None else out.unionByName(part)
    return ranks.numbered(out, ["label", "bag_idx"], "_id").select(F.col("_id").alias("bag_idx"), "bag", "label")


