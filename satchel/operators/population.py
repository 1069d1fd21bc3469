"""Populations (ind_id, genotype, fitness) as DataFrames: creators, statistics, selectors, set operations.

Stochastic operators take their uniform draws as columns (keyed by seed, generation, slot and locus), so that they are
pure functions of their input, whatever its partitions.  Positions are the order of ind_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import draw
from . import niches, ranks

# Creators: n individuals of a given length


def integers(spark: SparkSession, n: int, length: int, low: int, high: int, seed: int = 1) -> DataFrame:
    """Genes uniform in [low, high)."""
    gene = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (low + F.floor(draw(seed, F.col("id"), i) * (high - low))).cast("int"))
    return spark.range(n).select(F.col("id").alias("ind_id"), gene.alias("genotype"), F.lit(None).cast("double").alias("fitness"))


def bits(spark: SparkSession, n: int, length: int, seed: int = 1) -> DataFrame:
    return integers(spark, n, length, 0, 2, seed)


def reals(spark: SparkSession, n: int, length: int, low: float, high: float, seed: int = 1) -> DataFrame:
    gene = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: low + draw(seed, F.col("id"), i) * (high - low))
    return spark.range(n).select(F.col("id").alias("ind_id"), gene.alias("genotype"), F.lit(None).cast("double").alias("fitness"))


def labelled(spark: SparkSession, n: int, length: int, kmin: int, kmax: int, seed: int = 1) -> DataFrame:
    """Labels in [0, k) and the number of clusters k of [kmin, kmax] in the last gene."""
    k = (kmin + F.floor(draw(seed, F.col("id"), -1) * (kmax - kmin + 1))).cast("int")
    gene = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.floor(draw(seed, F.col("id"), i) * k).cast("int"))
    return spark.range(n).select(F.col("id").alias("ind_id"), F.concat(gene, F.array(k)).alias("genotype"), F.lit(None).cast("double").alias("fitness"))


# Statistics


def best(pop: DataFrame, maximise: bool = True) -> DataFrame:
    """The best individual, the first one on ties."""
    sign = F.col("fitness") if maximise else -F.col("fitness")
    return pop.agg(F.max_by(F.struct("ind_id", "fitness"), F.struct(sign, -F.col("ind_id"))).alias("b")).select("b.*")


def worst(pop: DataFrame, maximise: bool = True) -> DataFrame:
    return best(pop, not maximise)


def median(pop: DataFrame) -> DataFrame:
    """The individual at place n / 2 in the order of fitness."""
    placed = ranks.numbered(pop.select("ind_id", "fitness"), ["fitness", "ind_id"])
    return placed.where(F.col("place") == placed.count() // 2).select("ind_id", "fitness")


def moments(pop: DataFrame) -> DataFrame:
    return pop.agg(F.avg("fitness").alias("mean"), F.var_pop("fitness").alias("variance"))


# Set operations


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both, one individual per genotype (the lowest id)."""
    rows = a.unionByName(b)
    return rows.groupBy("genotype").agg(F.min_by(F.struct("ind_id", "fitness"), "ind_id").alias("i")).select("i.ind_id", "genotype", "i.fitness")


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("ind_id"), "ind_id", "left_anti")


def genotype_distances(pop: DataFrame, kind: str = "hamming") -> DataFrame:
    """(i, j, d) for i < j."""
    return niches.pairs_of(pop, kind)


# Selection: weights by individual, then slots


def with_whole(pop: DataFrame, **values: Column) -> DataFrame:
    """pop with aggregates of all of it, which are one row."""
    return pop.crossJoin(F.broadcast(pop.agg(*(v.alias(k) for k, v in values.items()))))


def weights(pop: DataFrame, kind: str = "roulette", temperature: float = 1.0) -> DataFrame:
    """ind_id and w by selector: roulette, boltzmann, disruptive, linear_rank, nonlinear_rank, sigma.

    Ranks count from the smallest fitness, equal fitness in the order of ids."""
    f = F.col("fitness")
    if kind == "roulette":
        pop, w = with_whole(pop, _sum=F.sum("fitness")), F.when(F.col("_sum") == 0, 1.0).otherwise(f)
    elif kind == "boltzmann":
        w = F.exp(f / temperature)
    elif kind == "disruptive":
        pop, w = with_whole(pop, _mean=F.avg("fitness")), F.abs(f - F.col("_mean"))
    elif kind == "linear_rank":
        pop = ranks.numbered(pop.select("ind_id", "fitness"), ["fitness", "ind_id"], "_rank")
        pop, w = with_whole(pop, _n=F.count(F.lit(1))), 0.9 + 0.2 * F.col("_rank") / F.greatest(F.col("_n") - 1, F.lit(1))
    elif kind == "nonlinear_rank":
        pop, w = ranks.numbered(pop.select("ind_id", "fitness"), ["fitness", "ind_id"], "_rank"), 0.3 * F.pow(F.lit(0.7), F.col("_rank"))
    elif kind == "sigma":
        pop, s = with_whole(pop, _s=F.stddev_pop("fitness"), _mean=F.avg("fitness")), F.col("_s")
        w = F.when(s == 0, 1.0).otherwise(F.greatest(1 + (f - F.col("_mean")) / (2 * F.when(s == 0, 1.0).otherwise(s)), F.lit(0.0)))
    else:
        raise ValueError(f"no selector named {kind}")
    return pop.select("ind_id", w.alias("w"))


def wheel(w: DataFrame) -> DataFrame:
    """ind_id, low and high: each individual's part of [0, 1) in the order of ids."""
    placed, total = ranks.running(w.select("ind_id", F.col("w").cast("double").alias("w")), ["ind_id"], "w")
    return placed.select("ind_id", (F.col("before") / total).alias("low"), ((F.col("before") + F.col("w")) / total).alias("high"))


def spun(w: DataFrame, slots: DataFrame) -> DataFrame:
    """slot and ind_id: the individual whose part holds the slot's draw u; individuals of weight 0 have no part.

    Parts and draws are sorted together, and each draw takes the last part that begins at or before it."""
    parts = wheel(w).where("high > low").select(F.col("low").alias("at"), "ind_id")
    return ranks.last_before(parts, "at", "ind_id", slots.select("slot", "u"), "u").select("slot", "ind_id")


def slots(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("slot"), draw(seed, F.col("id")).alias("u"))


def universal(w: DataFrame, n: int, start: float) -> DataFrame:
    """Stochastic universal sampling: n pointers at equal distances from start / n."""
    pointers = w.sparkSession.range(n).select(F.col("id").alias("slot"), ((F.col("id") + F.lit(start)) / n).alias("u"))
    return spun(w, pointers)


def remainder(w: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Stochastic remainder: the whole part of the expected copies is certain, the fraction is drawn."""
    expected = with_whole(w, _sum=F.sum("w")).select("ind_id", (F.col("w") / F.col("_sum") * n).alias("e"))
    copies = F.floor("e") + (draw(seed, F.col("ind_id")) < F.col("e") - F.floor("e")).cast("int")
    return expected.select("ind_id", copies.cast("int").alias("copies"))


def _picked(pop: DataFrame, drawn: DataFrame) -> DataFrame:
    """slot and the individual at the place that u picks in the order of ids."""
    placed = ranks.numbered(pop.select("ind_id", "fitness"), ["ind_id"], "p")
    picks = _one(drawn, placed).select("slot", F.floor(F.col("u") * F.col("m")).cast("long").alias("p"))
    return picks.join(placed, "p").select("slot", "ind_id", "fitness")


def _one(drawn: DataFrame, placed: DataFrame) -> DataFrame:
    return drawn.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("m"))))  # one row


def tournament(pop: DataFrame, drawn: DataFrame, maximise: bool = True) -> DataFrame:
    """slot and ind_id: of drawn (slot, u), t rows per slot, the best; u picks a position, ties go to the lower id."""
    sign = F.col("fitness") if maximise else -F.col("fitness")
    return _picked(pop, drawn).groupBy("slot").agg(F.max_by("ind_id", F.struct(sign, -F.col("ind_id"))).alias("ind_id"))


def uniform(pop: DataFrame, drawn: DataFrame) -> DataFrame:
    """Random selection with replacement."""
    return _picked(pop, drawn).select("slot", "ind_id")


def ordered(pop: DataFrame, n: int, maximise: bool = True) -> DataFrame:
    """The n best (or, with maximise turned round, worst) individuals; from the first again when they are used up."""
    placed = ranks.numbered(pop.select("ind_id", "fitness"), [F.desc("fitness") if maximise else F.asc("fitness"), "ind_id"], "p")
    slot = _one(pop.sparkSession.range(n).withColumnRenamed("id", "slot"), placed).where("m > 0").select("slot", (F.col("slot") % F.col("m")).alias("p"))
    return slot.join(placed, "p").select("slot", "ind_id")


def chosen(pop: DataFrame, picks: DataFrame) -> DataFrame:
    """slot, and the individual's columns."""
    return picks.join(pop, "ind_id").select("slot", "ind_id", "genotype", "fitness")


def boltzmann_temperature(first: float, decrease: float, generation: int) -> float:
    return first * decrease**generation


def pairs(parents: DataFrame) -> DataFrame:
    """(pair, a, b): slots 2k and 2k + 1; an odd last one stays single and is left out."""
    side = parents.select(F.floor(F.col("slot") / 2).alias("pair"), (F.col("slot") % 2).alias("side"), "genotype")
    grouped = side.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("genotype"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("genotype"))).alias("b"))
    return grouped.where("a is not null and b is not null")


def better(a: Column, b: Column, maximise: bool = True) -> Column:
    return a > b if maximise else a < b
