"""Evolutionary algorithms as loops over population DataFrames.

A problem gives random individuals, a fitness plan, a crossover and a mutation of genotype columns; an algorithm is a
plan per generation.  Fitness is computed for individuals that have none.  All draws are keyed by seed, generation,
individual and locus, so results don't depend on partitions.  Lineage is cut once per generation in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import draw, draw_array, hamming
from . import multiobjective as mo
from . import niches, ranks
from . import population as P
from . import variation as V
from .lineage import saved


@dataclass
class Problem:
    create: Callable[[SparkSession, int, int], DataFrame]  # spark, n, seed
    evaluate: Callable[[DataFrame], DataFrame]  # adds fitness to (ind_id, genotype)
    cross: Callable[[Column, Column, int, Column], tuple[Column, ...]]  # a, b, seed, pair key
    mutate: Callable[[Column, int, Column], Column]  # genotype, seed, individual key
    maximise: bool = True
    p_cross: float = 1.0
    p_mutate: float = 0.1
    sons: int = 2  # of a crossover, at most


def integer_problem(length: int, low: int, high: int, evaluate, maximise: bool = True, p_locus: float = 0.05, p_mutate: float = 0.5) -> Problem:
    n = F.lit(length)
    return Problem(
        lambda spark, k, seed: P.integers(spark, k, length, low, high, seed),
        evaluate,
        lambda a, b, seed, key: V.uniform(a, b, draw_array(seed, n, key)),
        lambda g, seed, key: V.uniform_mutation(g, draw_array(seed, n, key), draw_array(seed + 1, n, key), p_locus, low, high),
        maximise,
        p_mutate=p_mutate,
    )


def summary(pop: DataFrame, maximise: bool = True) -> DataFrame:
    """One row of a population: best_id, best, worst_id, worst, median_id, median (at place n / 2), mean and variance."""
    sign = F.col("fitness") if maximise else -F.col("fitness")
    one = F.struct("ind_id", "fitness")
    ends = pop.agg(F.max_by(one, F.struct(sign, -F.col("ind_id"))).alias("b"), F.max_by(one, F.struct(-sign, -F.col("ind_id"))).alias("w"), F.avg("fitness").alias("mean"), F.var_pop("fitness").alias("variance"))
    middle = P.median(pop).select(F.col("ind_id").alias("median_id"), F.col("fitness").alias("median"))
    return ends.crossJoin(F.broadcast(middle)).select(F.col("b.ind_id").alias("best_id"), F.col("b.fitness").alias("best"), F.col("w.ind_id").alias("worst_id"), F.col("w.fitness").alias("worst"), "median_id", "median", "mean", "variance")


@dataclass
class Report:
    """A listener: the summary of every ``every``-th generation, kept as rows, and below ``folder`` (if given) appended as CSV;
    with ``whole`` the population itself is written there too, a folder for each reported generation."""

    every: int = 1
    folder: str | None = None
    whole: bool = False
    generations: list[dict] = field(default_factory=list)

    def __call__(self, generation: int, pop: DataFrame, maximise: bool) -> None:
        if generation % self.every:
            return
        rows = saved(summary(pop, maximise).select(F.lit(generation).alias("generation"), "*"))
        self.generations += [r.asDict() for r in rows.collect()]
        if self.folder:
            rows.write.mode("append").option("header", True).csv(f"{self.folder}/generations")
            if self.whole:
                _sorted(pop, maximise).write.mode("overwrite").parquet(f"{self.folder}/population-{generation:06d}")


def evaluated(problem: Problem, pop: DataFrame) -> DataFrame:
    known, new = pop.where("fitness is not null"), pop.where("fitness is null").select("ind_id", "genotype")
    return known.unionByName(problem.evaluate(new).select("ind_id", "genotype", F.col("fitness").cast("double")))


def offspring(problem: Problem, parents: DataFrame, seed: int, first_id: int) -> DataFrame:
    """Children (ind_id, genotype, fitness null) of parents (slot, genotype): crossover by pairs, then mutation."""
    pairs = P.pairs(parents)
    sons = problem.cross(F.col("a"), F.col("b"), seed, F.col("pair"))[: problem.sons]
    crossed = F.when(draw(seed + 2, F.col("pair")) < problem.p_cross, F.array(*sons)).otherwise(F.array("a", "b") if len(sons) > 1 else F.array("a"))
    rows = pairs.select("pair", F.posexplode(crossed).alias("side", "g")).select((F.lit(first_id) + F.col("pair") * max(2, problem.sons) + F.col("side")).cast("long").alias("ind_id"), "g")
    g = F.when(draw(seed + 3, F.col("ind_id")) < problem.p_mutate, problem.mutate(F.col("g"), seed + 4, F.col("ind_id"))).otherwise(F.col("g"))
    return rows.select("ind_id", g.alias("genotype"), F.lit(None).cast("double").alias("fitness"))


def _sorted(pop: DataFrame, maximise: bool):
    return pop.orderBy(F.desc("fitness") if maximise else F.asc("fitness"), "ind_id")


def _parents(problem: Problem, pop: DataFrame, n: int, seed: int) -> DataFrame:
    drawn = P.slots(pop.sparkSession, n, seed).unionByName(P.slots(pop.sparkSession, n, seed + 1))
    return P.chosen(pop, P.tournament(pop, drawn, problem.maximise))


def generational(problem: Problem, pop: DataFrame, n: int, seed: int, first_id: int) -> DataFrame:
    """SG: the children replace all."""
    return evaluated(problem, offspring(problem, _parents(problem, pop, n, seed), seed, first_id))


def elitist(problem: Problem, pop: DataFrame, n: int, seed: int, first_id: int) -> DataFrame:
    """SGE: the best parent takes the place of the worst child, if it is better."""
    children = saved(generational(problem, pop, n, seed, first_id))
    best = _sorted(pop, problem.maximise).limit(1)
    return _sorted(children.unionByName(best), problem.maximise).limit(n)


def steady(problem: Problem, pop: DataFrame, n: int, seed: int, first_id: int, parents: int = 2) -> DataFrame:
    """SS: the chosen parents give way to the best of them and their children."""
    chosen = saved(P.chosen(pop, P.uniform(pop, P.slots(pop.sparkSession, parents, seed))))
    mine = chosen.select("ind_id", "genotype", "fitness").dropDuplicates(["ind_id"])
    children = evaluated(problem, offspring(problem, chosen, seed, first_id))
    rest = pop.join(mine.select("ind_id"), "ind_id", "left_anti")
    return rest.unionByName(_sorted(mine.unionByName(children), problem.maximise).limit(mine.count()))


def gap_g3(problem: Problem, pop: DataFrame, n: int, seed: int, first_id: int, mu: int = 3, replaced: int = 2) -> DataFrame:
    """G3: children of the best and random parents compete with ``replaced`` random individuals."""
    best = _sorted(pop, problem.maximise).limit(1)
    others = P.chosen(pop, P.uniform(pop, P.slots(pop.sparkSession, mu, seed)))
    parents = best.select(F.lit(0).cast("long").alias("slot"), "ind_id", "genotype", "fitness").unionByName(others.withColumn("slot", F.col("slot") + 1))
    children = evaluated(problem, offspring(problem, saved(parents), seed, first_id))
    out = saved(P.chosen(pop, P.uniform(pop, P.slots(pop.sparkSession, replaced, seed + 9))).select("ind_id", "genotype", "fitness").dropDuplicates(["ind_id"]))
    stay = _sorted(out.unionByName(children), problem.maximise).limit(out.count())
    return pop.join(out.select("ind_id"), "ind_id", "left_anti").unionByName(stay)


def gap_mgg(problem: Problem, pop: DataFrame, n: int, seed: int, first_id: int, lam: int = 6) -> DataFrame:
    """MGG: of a family of two parents and their children, the best and one drawn by roulette replace the parents."""
    two = saved(P.chosen(pop, P.uniform(pop, P.slots(pop.sparkSession, 2, seed))))
    parents = two.select("ind_id", "genotype", "fitness").dropDuplicates(["ind_id"])
    repeated = two.select(F.explode(F.sequence(F.lit(0), F.lit(lam // 2 - 1))).alias("k"), "*").withColumn("slot", F.col("k") * 2 + F.col("slot")).drop("k")
    family = saved(parents.unionByName(evaluated(problem, offspring(problem, repeated, seed, first_id))))
    best = saved(_sorted(family, problem.maximise).limit(1))
    rest = family.join(best.select("ind_id"), "ind_id", "left_anti")
    ends = P.with_whole(rest, _low=F.min("fitness"), _high=F.max("fitness"))
    weights = ends.select("ind_id", (F.col("fitness") - F.col("_low") + 1e-9 if problem.maximise else F.col("_high") - F.col("fitness") + 1e-9).alias("w"))
    drawn = P.chosen(rest, P.spun(weights, P.slots(pop.sparkSession, 1, seed + 5))).select("ind_id", "genotype", "fitness")
    stay = best.unionByName(drawn).limit(parents.count())
    return pop.join(parents.select("ind_id"), "ind_id", "left_anti").unionByName(stay)


def niching(kind: str = "sharing", radius: float = 1.0, distance: str = "hamming", **options) -> Callable[..., DataFrame]:
    """A step whose parents are chosen by their fitness within niches (sharing or clearing, of a maximised fitness), while
    children are rated by themselves.  A best parent that beats all children takes the place of the worst child; if there
    are fewer children than individuals, the best parents fill up."""
    rated = {"sharing": niches.shared, "clearing": niches.cleared}[kind]

    def step(problem: Problem, pop: DataFrame, n: int, seed: int, first_id: int) -> DataFrame:
        niched = saved(rated(pop.select("ind_id", "genotype", "fitness"), radius, kind=distance, **options).select("ind_id", "fitness"))
        parents = _parents(problem, pop.drop("fitness").join(niched, "ind_id"), n, seed)
        children = saved(evaluated(problem, offspring(problem, parents, seed, first_id)))
        short = n - children.count()
        if short > 0:
            return children.unionByName(_sorted(pop, problem.maximise).limit(short))
        best, ahead = _sorted(pop, problem.maximise).limit(1), _sorted(children, problem.maximise).first().fitness
        top = best.first().fitness
        if top > ahead if problem.maximise else top < ahead:
            return _sorted(children, problem.maximise).limit(children.count() - 1).unionByName(best)
        return children

    return step


STEPS = {"SG": generational, "SGE": elitist, "SS": steady, "G3": gap_g3, "MGG": gap_mgg}


def run(spark: SparkSession, problem: Problem, algorithm: str | Callable[..., DataFrame] = "SGE", n: int = 40, generations: int = 10, seed: int = 1, acceptable: float | None = None, report: Report | None = None) -> DataFrame:
    """The last population (ind_id, genotype, fitness); algorithm: a name of STEPS, or a step such as ``niching`` gives."""
    step = STEPS[algorithm] if isinstance(algorithm, str) else algorithm
    pop = saved(evaluated(problem, problem.create(spark, n, seed)))
    for g in range(1, generations + 1):
        pop = saved(step(problem, pop, n, seed * 1_000_003 + 17 * g, g * 10 * n))
        if report is not None:
            report(g, pop, problem.maximise)
        if acceptable is not None:
            top = _sorted(pop, problem.maximise).first().fitness
            if top >= acceptable if problem.maximise else top <= acceptable:
                break
    return pop


def chc(spark: SparkSession, problem: Problem, length: int, n: int = 40, generations: int = 20, seed: int = 1, survivors: int = 1, improve: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """CHC: pairs mate if they differ in more than 2d loci (HUX); the best of parents and children stay; without a change
    d falls, and below 0 the population restarts around its survivors.  improve: change children before they are rated."""
    pop, d = saved(evaluated(problem, problem.create(spark, n, seed))), length // 4
    for g in range(1, generations + 1):
        s = seed * 1_000_003 + 17 * g
        pairs = P.pairs(ranks.numbered(pop, [draw(s, F.col("ind_id")), "ind_id"], "slot")).where(hamming(F.col("a"), F.col("b")) / 2 > d)
        sons = V.half_uniform(F.col("a"), F.col("b"), draw_array(s, F.lit(length), F.col("pair")))
        rows = pairs.select("pair", F.posexplode(F.array(*sons)).alias("side", "genotype"))
        sired = rows.select((F.lit(g * 10 * n) + F.col("pair") * 2 + F.col("side")).cast("long").alias("ind_id"), "genotype", F.lit(None).cast("double").alias("fitness"))
        children = evaluated(problem, sired if improve is None else improve(saved(sired), s))
        after = saved(_sorted(pop.unionByName(children), problem.maximise).limit(n))
        if after.join(pop.select("ind_id"), "ind_id", "left_anti").isEmpty():
            d -= 1
        pop = after
        if d < 0:
            kept = _sorted(pop, problem.maximise).limit(survivors)
            fresh = problem.create(spark, n - survivors, s).withColumn("ind_id", F.col("ind_id") + g * 10 * n)
            pop, d = saved(evaluated(problem, kept.unionByName(fresh))), length // 4
    return pop


def nsga2(spark: SparkSession, problem: Problem, n: int = 40, generations: int = 10, seed: int = 1) -> DataFrame:
    """The last population (ind_id, genotype, objectives, front, crowding); evaluate gives objectives, all maximised."""
    def rated(pop: DataFrame) -> DataFrame:
        pop = saved(pop)
        f = saved(mo.fronts(pop).join(pop, "ind_id"))
        return f.join(mo.crowding(f), ["ind_id", "front"])

    pop = saved(rated(problem.evaluate(problem.create(spark, n, seed).drop("fitness"))).select("ind_id", "genotype", "objectives", "front", "crowding"))
    for g in range(1, generations + 1):
        s = seed * 1_000_003 + 17 * g
        ranked = ranks.numbered(pop, [F.desc("front"), F.asc("crowding"), F.desc("ind_id")], "fitness").withColumn("fitness", F.col("fitness").cast("double"))
        drawn = P.slots(spark, n, s).unionByName(P.slots(spark, n, s + 1))
        children = offspring(problem, P.chosen(ranked, P.tournament(ranked, drawn)), s, g * 10 * n).drop("fitness")
        both = rated(pop.select("ind_id", "genotype", "objectives").unionByName(problem.evaluate(children).select("ind_id", "genotype", "objectives")))
        pop = saved(both.orderBy("front", F.desc("crowding"), "ind_id").limit(n).select("ind_id", "genotype", "objectives", "front", "crowding"))
    return pop


def spea2(spark: SparkSession, problem: Problem, n: int = 40, archive: int = 20, generations: int = 10, seed: int = 1) -> DataFrame:
    """The last archive (ind_id, genotype, objectives, fitness)."""
    pop, kept = saved(problem.evaluate(problem.create(spark, n, seed).drop("fitness")).select("ind_id", "genotype", "objectives")), None
    for g in range(generations + 1):
        s = seed * 1_000_003 + 17 * g
        every = saved(pop if kept is None else pop.unionByName(kept.select("ind_id", "genotype", "objectives")))
        k = max(1, int((n + archive) ** 0.5))
        scored = mo.archive(saved(mo.spea2(every, k)), archive, every, k)
        kept = saved(every.join(scored.select("ind_id", "fitness"), "ind_id").select("ind_id", "genotype", "objectives", "fitness"))
        if g < generations:
            drawn = P.slots(spark, n, s).unionByName(P.slots(spark, n, s + 1))
            children = offspring(problem, P.chosen(kept, P.tournament(kept, drawn, maximise=False)), s, (g + 1) * 10 * n).drop("fitness")
            pop = saved(problem.evaluate(children).select("ind_id", "genotype", "objectives"))
    return kept
