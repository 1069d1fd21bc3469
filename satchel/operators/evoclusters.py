"""Evolutionary clusterers of bags: evaluators, mutations and ready-made runs.

A genotype is a label per bag in the order of bag_idx (or bag indices used as medoids).  It is one array, so a population
suits as many bags as fit a row; the work on bags is spread all the same: genotypes are flattened to (ind_id, bag_idx,
cluster) and every step rates or moves all individuals in one plan, keyed by ind_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bag_mean, draw, draw_array, hausdorff, l2
from ..sources.views import long
from . import evolution as E
from . import density, indices
from . import population as P
from . import ranks, silhouettes
from . import variation as V
from .joins import pair_table
from .lineage import light, saved

KEY = ("ind_id",)
MAXIMISE = {"silhouette", "dbcv", "ftwcv"}
METRICS = ("rmssd", "silhouette", "db", "xb", "sdbw", "dbcv", "twcv", "ftwcv")


@dataclass
class Space:
    """Bags prepared for populations; ``distance`` is one of the four Hausdorff kinds."""

    source: DataFrame
    k: int = 2
    distance: str = "maxmin"
    once: bool = False  # the pair table is read once: it isn't written

    @cached_property
    def bags(self) -> DataFrame:
        """bag_idx, bag, locus, m (mean instance) and size."""
        order = ranks.numbered(self.source.select("bag_idx"), ["bag_idx"], "locus").withColumn("locus", F.col("locus").cast("int"))  # a genotype needs one order of all bags
        return saved(self.source.select("bag_idx", "bag").join(order, "bag_idx").select("bag_idx", "locus", "bag", bag_mean(F.col("bag")).alias("m"), F.size("bag").alias("size")))

    @cached_property
    def n(self) -> int:
        return self.bags.count()

    @cached_property
    def dimensions(self) -> int:
        return self.bags.select(F.size("m")).first()[0]

    @cached_property
    def pairs(self) -> DataFrame:
        """(i, j, d), once per run; only ``sdbw`` needs it."""
        found = pair_table(self.source, None, self.distance)
        return found if self.once else saved(found)

    def labels(self, pop: DataFrame) -> DataFrame:
        """(ind_id, bag_idx, cluster)"""
        flat = pop.select("ind_id", F.posexplode("genotype").alias("locus", "cluster"))
        return flat.join(self.bags.select("locus", "bag_idx"), "locus").select("ind_id", "bag_idx", "cluster")

    def centroids(self, labels: DataFrame) -> DataFrame:
        """ind_id and cs: (cluster, c) of the mean of all instances of each cluster, in the order of clusters."""
        rows = labels.where("cluster >= 0").join(self.bags.select("bag_idx", "m", "size"), "bag_idx")
        flat = rows.select("ind_id", "cluster", "size", F.posexplode("m").alias("dim", "v"))
        dims = flat.groupBy("ind_id", "cluster", "dim").agg((F.sum(F.col("v") * F.col("size")) / F.sum("size")).alias("v"))
        c = dims.groupBy("ind_id", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("c"))
        return c.groupBy("ind_id").agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("cs"))

    def to_centroids(self, labels: DataFrame) -> DataFrame:
        """ind_id, bag_idx, cluster and ds: (d, cluster) of the bag to every centroid of its individual."""
        rows = labels.join(F.broadcast(self.centroids(labels)), "ind_id").join(self.bags.select("bag_idx", "bag"), "bag_idx")  # a row per individual
        ds = F.transform("cs", lambda s: F.struct(hausdorff(self.distance, F.col("bag"), F.array(s["c"])).alias("d"), s["cluster"].alias("cluster")))
        return rows.select("ind_id", "bag_idx", "cluster", ds.alias("ds"))

    def own(self, labels: DataFrame) -> DataFrame:
        """(ind_id, bag_idx, cluster, d) to the own centroid."""
        mine = F.filter("ds", lambda s: s["cluster"] == F.col("cluster"))[0]["d"]
        return self.to_centroids(labels.where("cluster >= 0")).select("ind_id", "bag_idx", "cluster", mine.alias("d"))

    def between(self, labels: DataFrame) -> DataFrame:
        """(ind_id, i, j, d) of the centroids of clusters i != j."""
        one = self.centroids(labels).select("ind_id", "cs", F.explode("cs").alias("a"))
        two = one.select("ind_id", "a", F.explode("cs").alias("b")).where("a.cluster != b.cluster")
        return two.select("ind_id", F.col("a.cluster").alias("i"), F.col("b.cluster").alias("j"), l2(F.col("a.c"), F.col("b.c")).alias("d"))

    def s_dbw(self, labels: DataFrame) -> DataFrame:
        """(ind_id, scat, dens, s_dbw).  A union's distance to a bag is put together from those of its members, so that all pairs of
        clusters of all individuals come from the pair table."""
        c = light(labels.where("cluster >= 0").select("ind_id", "bag_idx", "cluster"))
        flat = c.join(long(self.source).select("bag_idx", "x"), "bag_idx").select("ind_id", "cluster", F.posexplode("x").alias("dim", "v"))
        var = flat.groupBy("ind_id", "cluster", "dim").agg(F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("v"))  # a single instance has no spread
        norm = F.sqrt(F.sum(F.col("v") * F.col("v")))
        norms = var.groupBy("ind_id", "cluster").agg(norm.alias("v")).groupBy("ind_id").agg(F.sum("v").alias("s"), F.count("v").alias("k"))
        whole = long(self.source).select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.var_samp("v").alias("v")).agg(norm.alias("whole"))
        self_d = self.bags.select(F.col("bag_idx").alias("i"), F.col("bag_idx").alias("j"), hausdorff(self.distance, F.col("bag"), F.col("bag")).alias("d"))
        every = self.pairs.unionByName(self_d).join(light(self.bags.select(F.col("bag_idx").alias("i"), "size")), "i")
        joined = every.join(c.toDF("ind_id", "i", "ci"), "i")
        weight = F.col("size").cast("double")
        part = joined.groupBy("ind_id", "ci", "j").agg(F.max("d").alias("high"), F.min("d").alias("low"), F.sum(F.col("d") * weight).alias("s"), F.sum(weight).alias("w"))
        placed = part.join(c.toDF("ind_id", "j", "cj"), ["ind_id", "j"])
        home = placed.where("ci = cj").select("ind_id", "j", "cj", F.struct("high", "low", "s", "w").alias("h"))
        away = placed.where("ci != cj").join(home, ["ind_id", "j", "cj"])
        d = {"maxmin": F.greatest("high", "h.high"), "minmin": F.least("low", "h.low")}.get(self.distance, (F.col("s") + F.col("h.s")) / (F.col("w") + F.col("h.w")))
        near = away.select("ind_id", F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b"), d.alias("d")).join(norms, "ind_id")
        n = c.groupBy("ind_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
        inside = near.groupBy("ind_id", "a", "b").agg(F.sum((F.col("d") <= F.sqrt("s") / F.col("k")).cast("long")).alias("hits"))
        sized = inside.join(n.toDF("ind_id", "a", "na"), ["ind_id", "a"]).join(n.toDF("ind_id", "b", "nb"), ["ind_id", "b"])
        dens = sized.groupBy("ind_id").agg(F.sum(2 * F.col("hits") / F.greatest("na", "nb")).alias("dens"))
        rows = norms.join(dens, "ind_id", "left").join(F.broadcast(whole))  # one row
        scat = F.try_divide(F.col("s"), F.col("whole") * F.col("k"))
        density = F.coalesce(F.try_divide(F.col("dens"), F.col("k") * (F.col("k") - 1)), F.lit(0.0))
        none = F.col("k") == 0
        worst = F.lit(float("inf"))
        return rows.select("ind_id", F.when(none, worst).otherwise(scat).alias("scat"), F.when(none, worst).otherwise(density).alias("dens"), F.when(none, worst).otherwise(scat + density).alias("s_dbw"))

    def rated(self, labels: DataFrame, metric: str) -> DataFrame:
        """(ind_id, fitness) by one of METRICS; the worst value where the metric isn't defined."""
        if metric not in METRICS:
            raise ValueError(f"no metric named {metric}")
        if metric == "ftwcv":
            whole = labels.groupBy("ind_id").agg((F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))) >= self.k).alias("complete"))
            return indices.ftwcv_fitness(indices.ftwcv(self.bags, labels, KEY).withColumnRenamed("ftwcv", "f").join(whole, "ind_id"))
        if metric in ("rmssd", "xb", "db", "twcv"):
            labels = saved(labels)
            own = saved(self.own(labels))
            found = {
                "rmssd": lambda: indices.rmsstd(own, self.dimensions, KEY),
                "xb": lambda: indices.xie_beni(own, self.between(labels), KEY),
                "db": lambda: indices.davies_bouldin(own, self.between(labels), KEY),
                "twcv": lambda: indices.twcv(own, KEY),
            }[metric]()
        elif metric == "sdbw":
            found = self.s_dbw(saved(labels)).select("ind_id", "s_dbw")
        elif metric == "dbcv":
            found = density.dbcv(self.source, labels, self.distance)
        else:
            found = silhouettes.silhouettes(self.source, labels, self.distance)
        worst = float("-inf") if metric in MAXIMISE else float("inf")
        every = labels.select("ind_id").distinct()
        return every.join(found.toDF("ind_id", "fitness"), "ind_id", "left").select("ind_id", F.coalesce("fitness", F.lit(worst)).alias("fitness"))

    def evaluate(self, metric: str) -> Callable[[DataFrame], DataFrame]:
        return lambda pop: pop.select("ind_id", "genotype").join(self.rated(self.labels(pop), metric), "ind_id")

    def regrouped(self, rows: DataFrame) -> DataFrame:
        """A population of (ind_id, bag_idx, cluster); fitness is unknown."""
        placed = rows.join(self.bags.select("bag_idx", "locus"), "bag_idx")
        g = F.transform(F.sort_array(F.collect_list(F.struct("locus", "cluster"))), lambda s: s["cluster"].cast("int"))
        return placed.groupBy("ind_id").agg(g.alias("genotype")).withColumn("fitness", F.lit(None).cast("double"))

    # Mutations of whole populations

    def kmeans_step(self, pop: DataFrame, repair: bool = True) -> DataFrame:
        """Every bag to the nearest mean centroid of its individual, the lowest cluster on ties.  repair: each label that
        no bag has then takes the bag farthest from its own centroid (one bag per label, ties by index)."""
        moved = self.to_centroids(self.labels(pop)).select("ind_id", "bag_idx", F.array_min("ds").alias("b"))
        rows = moved.select("ind_id", "bag_idx", F.col("b.cluster").alias("cluster"), F.col("b.d").alias("d"))
        if not repair:
            return self.regrouped(rows)
        rows = saved(rows)
        labels = F.array(*[F.lit(c) for c in range(self.k)])
        empty = rows.groupBy("ind_id").agg(F.array_except(labels, F.collect_set("cluster")).alias("e"))
        missing = empty.select("ind_id", F.posexplode("e").alias("r", "taken"))
        far = F.row_number().over(Window.partitionBy("ind_id").orderBy(F.desc("d"), "bag_idx")) - 1
        first = F.row_number().over(Window.partitionBy("ind_id", "cluster").orderBy("d", "bag_idx"))
        free = rows.withColumn("_first", first).where("_first > 1").withColumn("r", far)  # a cluster keeps one bag
        taken = free.join(missing, ["ind_id", "r"]).select("ind_id", "bag_idx", "taken")
        return self.regrouped(rows.join(taken, ["ind_id", "bag_idx"], "left").select("ind_id", "bag_idx", F.coalesce("taken", "cluster").alias("cluster")))

    def _spun(self, candidates: DataFrame, seed: int, pop: DataFrame) -> DataFrame:
        """candidates (ind_id, locus, label, w): one label per (ind_id, locus) by roulette, put into the genotypes."""
        low = Window.partitionBy("ind_id", "locus")
        upto = low.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
        u = draw(seed, F.col("ind_id"), F.col("locus"))
        cum = candidates.select("ind_id", "locus", "label", F.sum("w").over(upto).alias("c"), (F.sum("w").over(low) * u).alias("at"))
        drawn = cum.groupBy("ind_id", "locus").agg(F.coalesce(F.min(F.when(F.col("c") > F.col("at"), F.col("label"))), F.max("label")).alias("label"))
        loci = pop.select("ind_id", F.posexplode("genotype").alias("locus", "x")).join(drawn, ["ind_id", "locus"], "left")
        g = F.sort_array(F.collect_list(F.struct("locus", F.coalesce("label", "x").cast("int").alias("x"))))
        return loci.groupBy("ind_id").agg(F.transform(g, lambda s: s["x"]).alias("genotype")).withColumn("fitness", F.lit(None).cast("double"))

    def _loci(self, pop: DataFrame, seed: int, p: float) -> DataFrame:
        """(ind_id, locus) that mutate."""
        hit = pop.select("ind_id", F.explode(F.sequence(F.lit(0), F.size("genotype") - 1)).alias("locus"))
        return hit.where(draw(seed, F.col("ind_id"), F.col("locus")) < p)

    def fast_mutation(self, pop: DataFrame, seed: int, p: float = 0.05) -> DataFrame:
        """Loci that mutate draw a label with weight 1.5 * largest distance - distance + 0.5 to the label's centroid; a
        label without bags has distance 0."""
        near = self.to_centroids(self.labels(pop)).join(self.bags.select("bag_idx", "locus"), "bag_idx")
        hit = near.join(self._loci(pop, seed, p), ["ind_id", "locus"])
        labels = F.array(*[F.lit(c) for c in range(self.k)])
        d = F.transform(labels, lambda c: F.struct(c.alias("label"), F.coalesce(F.get(F.filter("ds", lambda s: s["cluster"] == c), F.lit(0))["d"], F.lit(0.0)).alias("d")))
        rows = hit.select("ind_id", "locus", F.array_max(F.transform("ds", lambda s: s["d"])).alias("top"), F.explode(d).alias("o"))
        return self._spun(rows.select("ind_id", "locus", "o.label", (1.5 * F.col("top") - F.col("o.d") + 0.5).alias("w")), seed + 1, pop)

    def guided_mutation(self, pop: DataFrame, metric: str, seed: int, p: float = 0.05) -> DataFrame:
        """Loci that mutate draw a label by the fitness that the individual would have with it (other loci as in the parent).
        Weights are the distances from the locus's worst value, and half the mean of those more for each label.

        Silhouettes come from the parent's sums of distances; for other metrics every changed genotype is a row."""
        if metric == "silhouette":
            at = self.bags.select("bag_idx", "locus")
            loci = self._loci(pop, seed, p).join(at, "locus").select("ind_id", "bag_idx")
            values = silhouettes.changed(self.source, self.labels(pop), loci, self.k, self.distance).join(at, "bag_idx")
            return self._weighed(values.select("ind_id", "locus", "label", F.col("silhouette").alias("f")), metric, seed, pop)
        hit = self._loci(pop, seed, p).join(pop.select("ind_id", "genotype"), "ind_id")
        options = hit.select("ind_id", "locus", "genotype", F.explode(F.sequence(F.lit(0), F.lit(self.k - 1))).alias("label"))
        changed = F.transform("genotype", lambda x, i: F.when(i == F.col("locus"), F.col("label")).otherwise(x))
        key = ((F.col("ind_id") * self.n + F.col("locus")) * self.k + F.col("label")).alias("key")
        rows = saved(options.select("ind_id", "locus", "label", key, changed.alias("genotype")))
        values = self.rated(self.labels(rows.select(F.col("key").alias("ind_id"), "genotype")), metric).toDF("key", "f")
        return self._weighed(rows.join(values, "key"), metric, seed, pop)

    def _weighed(self, rated: DataFrame, metric: str, seed: int, pop: DataFrame) -> DataFrame:
        """The draw of labels by rated (ind_id, locus, label, f)."""
        each = Window.partitionBy("ind_id", "locus")
        finite = F.when(F.abs("f") < float("inf"), F.col("f"))
        gain = finite - F.min(finite).over(each) if metric in MAXIMISE else F.max(finite).over(each) - finite
        weighed = rated.select("ind_id", "locus", "label", F.coalesce(gain, F.lit(0.0)).alias("gain"))
        w = F.col("gain") + F.avg("gain").over(each) / 2
        return self._spun(weighed.select("ind_id", "locus", "label", F.when(F.sum("gain").over(each) > 0, w).otherwise(1.0).alias("w")), seed + 1, pop)

    # Medoid genotypes

    def medoid_labels(self, pop: DataFrame) -> DataFrame:
        """(ind_id, bag_idx, cluster): each bag to the nearest bag named by a gene, the first gene on ties."""
        genes = pop.select("ind_id", F.posexplode("genotype").alias("gene", "locus"))
        meds = genes.join(self.bags.select("locus", F.col("bag").alias("c")), "locus").groupBy("ind_id").agg(F.sort_array(F.collect_list(F.struct("gene", "c"))).alias("ms"))
        # the genes of all individuals meet every bag: that is the assignment itself, rows of population x bags
        every = self.bags.select("bag_idx", F.explode(F.lit(self._ids(pop))).alias("ind_id"), "bag")
        rows = every.join(F.broadcast(meds), "ind_id")  # a row per individual
        best = F.array_min(F.transform("ms", lambda s: F.struct(hausdorff(self.distance, F.col("bag"), s["c"]).alias("d"), s["gene"].alias("gene"))))
        return rows.select("ind_id", "bag_idx", best["gene"].cast("int").alias("cluster"))

    @staticmethod
    def _ids(pop: DataFrame) -> list[int]:
        """Ids of a population, which is of a chosen size."""
        return [r[0] for r in pop.select("ind_id").collect()]

    def evaluate_medoids(self, metric: str) -> Callable[[DataFrame], DataFrame]:
        def rate(pop: DataFrame) -> DataFrame:
            pop = saved(pop)
            if pop.isEmpty():
                return pop.select("ind_id", "genotype", F.lit(None).cast("double").alias("fitness"))
            return pop.select("ind_id", "genotype").join(self.rated(saved(self.medoid_labels(pop)), metric), "ind_id")

        return rate


def _problem(space: Space, metric: str) -> E.Problem:
    return E.integer_problem(space.n, 0, space.k, space.evaluate(metric), maximise=metric in MAXIMISE)


def _renewed(space: Space, problem: E.Problem, pop: DataFrame, n: int, s: int, first_id: int, change) -> DataFrame:
    """Elitist generation whose children are changed copies of tournament winners."""
    picks = P.tournament(pop, P.slots(pop.sparkSession, n, s).unionByName(P.slots(pop.sparkSession, n, s + 1)), problem.maximise)
    copies = P.chosen(pop, picks).select((F.lit(first_id) + F.col("slot")).cast("long").alias("ind_id"), "genotype", F.lit(None).cast("double").alias("fitness"))
    children = E.evaluated(problem, saved(change(saved(copies), s)))
    return E._sorted(children.unionByName(E._sorted(pop, problem.maximise).limit(1)), problem.maximise).limit(n)


def _evolved(space: Space, problem: E.Problem, n: int, generations: int, seed: int, change) -> DataFrame:
    pop = saved(E.evaluated(problem, problem.create(space.source.sparkSession, n, seed)))
    for g in range(1, generations + 1):
        pop = saved(_renewed(space, problem, pop, n, seed * 1_000_003 + 17 * g, g * 10 * n, change))
    return pop


def migka(bags: DataFrame, k: int = 2, metric: str = "silhouette", distance: str = "maxmin", n: int = 20, generations: int = 5, seed: int = 1, p: float = 0.05) -> DataFrame:
    """Genetic k-means: guided mutation of labels, then a k-means step; no crossover."""
    space = Space(bags, k, distance)
    return _evolved(space, _problem(space, metric), n, generations, seed, lambda pop, s: space.kmeans_step(saved(space.guided_mutation(pop, metric, s + 4, p))))


def mifgka(bags: DataFrame, k: int = 2, distance: str = "maxmin", n: int = 20, generations: int = 5, seed: int = 1, p: float = 0.05) -> DataFrame:
    """The fast form: labels drawn by the distances to centroids, a step without repair, rated by ftwcv.  Those values are
    relative to the extremes of a generation, so all of it is rated together each time."""
    space = Space(bags, k, distance)
    problem = _problem(space, "ftwcv")
    pop = saved(E.evaluated(problem, problem.create(bags.sparkSession, n, seed)))
    for g in range(1, generations + 1):
        s = seed * 1_000_003 + 17 * g
        stay = E._sorted(pop, True).limit(1)
        after = _renewed(space, problem, pop, n, s, g * 10 * n, lambda q, s: space.kmeans_step(saved(space.fast_mutation(q, s + 4, p)), repair=False))
        every = saved(after.unionByName(stay).dropDuplicates(["ind_id"]).withColumn("fitness", F.lit(None).cast("double")))
        pop = saved(E._sorted(E.evaluated(problem, every), True).limit(n))
    return pop


def migcuk(bags: DataFrame, kmin: int = 2, kmax: int = 2, metric: str = "silhouette", distance: str = "maxmin", n: int = 20, generations: int = 5, seed: int = 1, p: float = 0.05) -> DataFrame:
    """Genes are loci of bags used as medoids, kmax - kmin + 2 of them; one-point crossover, flips that keep the first two
    apart."""
    space, length = Space(bags, kmax, distance), kmax - kmin + 2
    problem = E.integer_problem(length, 0, space.n, space.evaluate_medoids(metric), maximise=metric in MAXIMISE, p_mutate=1.0)
    problem.cross = lambda a, b, s, key: V.one_point(a, b, draw(s, key))
    problem.mutate = lambda g, s, key: V.medoid_pair(g, draw_array(s, F.lit(length), key), draw_array(s + 1, F.lit(length), key), 0, space.n, p)
    return E.run(bags.sparkSession, problem, "SGE", n, generations, seed)


def chc_clusters(bags: DataFrame, k: int = 2, metric: str = "silhouette", distance: str = "maxmin", n: int = 20, generations: int = 5, seed: int = 1, p: float = 0.05, p_mutate: float = 0.1, p_step: float = 1.0) -> DataFrame:
    """CHC over labels whose children go through the guided mutation and a k-means step, each with its probability."""
    space = Space(bags, k, distance)
    problem = _problem(space, metric)

    def some(pop: DataFrame, s: int, share: float, change) -> DataFrame:
        marked = saved(pop.withColumn("_go", draw(s, F.col("ind_id")) < share))
        go = marked.where("_go").drop("_go")
        return marked.where("not _go").drop("_go") if go.isEmpty() else marked.where("not _go").drop("_go").unionByName(saved(change(go)))

    def improve(children: DataFrame, s: int) -> DataFrame:
        mutants = some(children, s + 5, p_mutate, lambda q: space.guided_mutation(q, metric, s + 6, p))
        return some(mutants, s + 8, p_step, space.kmeans_step)

    return E.chc(bags.sparkSession, problem, space.n, n, generations, seed, improve=improve)


def evolved_clusters(bags: DataFrame, kmin: int = 2, kmax: int = 4, metric: str = "db", distance: str = "maxmin", n: int = 20, generations: int = 5, seed: int = 1, p_cluster: float = 0.5, p_locus: float = 0.5) -> DataFrame:
    """Variable numbers of clusters: implanting crossover, then one of merge, split, reclassify, drawn per individual."""
    space = Space(bags, kmax, distance)
    spark, loci = bags.sparkSession, F.lit(space.n)
    by_label = F.lit(kmax + 1)

    def create(spark, n, seed):
        drawn = P.labelled(spark, n, space.n, kmin, kmax, seed)
        return drawn.withColumn("genotype", V.ordered_labels(F.slice("genotype", F.lit(1), loci)))

    def cross(a: Column, b: Column, s: int, key: Column):
        def son(x, y, t):
            return V.implanted(x, y, draw_array(t, by_label, key), draw_array(t + 1, loci, key), draw_array(t + 2, loci, key), p_cluster, p_locus)

        return son(a, b, s + 20), son(b, a, s + 30)

    def mutate(g: Column, s: int, key: Column) -> Column:
        us, vs, kind = draw_array(s, by_label, key), draw_array(s + 1, loci, key), draw(s + 2, key)
        return F.when(kind < 1 / 3, V.merged(g, us, p_cluster, kmin)).when(kind < 2 / 3, V.split(g, us, vs, p_cluster, kmax)).otherwise(V.reclassified(g, us, vs, p_cluster, kmin))

    problem = E.Problem(create, space.evaluate(metric), cross, mutate, metric in MAXIMISE, p_mutate=0.5)
    return E.run(spark, problem, "SGE", n, generations, seed)


def grouping_clusters(bags: DataFrame, kmin: int = 2, kmax: int = 4, metric: str = "silhouette", distance: str = "maxmin", n: int = 20, generations: int = 5, seed: int = 1, p: float = 0.05) -> DataFrame:
    """Labels and, in the last gene, the number of clusters: uniform crossover of labels; each child takes the number of
    one parent and folds its labels into it."""
    space = Space(bags, kmax, distance)
    length = F.lit(space.n + 1)

    def folded(g: Column) -> Column:
        return V.once(g, lambda y: V.once(F.element_at(y, -1), lambda k: F.transform(y, lambda x, i: F.when(i == space.n, x).otherwise(F.pmod(x, k)).cast("int"))))

    def cross(a: Column, b: Column, s: int, key: Column):
        return tuple(folded(g) for g in V.uniform(a, b, draw_array(s, length, key)))

    def mutate(g: Column, s: int, key: Column) -> Column:
        held = F.struct(g.alias("g"), F.element_at(g, -1).alias("k"), draw_array(s, length, key).alias("us"), draw_array(s + 1, length, key).alias("vs"))
        return V.once(held, lambda h: F.transform(h["g"], lambda x, i: F.when((i < space.n) & (F.get(h["us"], i) < p), F.floor(F.get(h["vs"], i) * h["k"])).otherwise(x).cast("int")))

    def evaluate(pop: DataFrame) -> DataFrame:
        labels = pop.select("ind_id", F.slice("genotype", F.lit(1), F.lit(space.n)).alias("genotype"))
        return pop.select("ind_id", "genotype").join(space.rated(space.labels(labels), metric), "ind_id")

    problem = E.Problem(lambda spark, n, seed: P.labelled(spark, n, space.n, kmin, kmax, seed), evaluate, cross, mutate, metric in MAXIMISE, p_mutate=0.5)
    return E.run(bags.sparkSession, problem, "SGE", n, generations, seed)


ALGORITHMS = {"MIGKA": migka, "MIFGKA": mifgka, "MIGCUK": migcuk, "CHCMIC": chc_clusters, "MIEvoCluster": evolved_clusters, "MIGGA": grouping_clusters}
