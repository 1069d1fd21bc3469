"""Registered queries of the library over its whole tables, and the SQL that each must equal.

Doubles are rounded to 6 places on both sides.  Assignments that a query only needs as an input follow a rule
(``bag_idx % 3``), so that the SQL is closed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import generators
from ..operators import centres, clusterers, density, evoclusters, evolution, external, indices, joins, multiobjective, niches, population, rules, transforms, trees, variation
from ..operators.lineage import saved
from ..sources import views

R = 6
MEDOIDS = [0, 10]


def rounded(df, *cols):
    """Doubles (and arrays of doubles) to 6 places, -0.0 as 0.0."""
    for name, kind in df.dtypes:
        if kind == "double":
            df = df.withColumn(name, F.round(name, R) + F.lit(0.0))
        elif kind == "array<double>":
            df = df.withColumn(name, F.transform(name, lambda v: F.round(v, R) + F.lit(0.0)))
    return df.select(*cols) if cols else df


def vec(spark, d):
    return views.vector_bags(spark, d)


def _real(spark, d):
    return genotypes(spark, d).select("ind_id", F.col("r").alias("genotype"), "fitness")


def _rules(spark, d):
    """A rule for every fifth vector: its first three values bound the same dimensions, from below, above and below."""
    e = views.table(spark, d, "embeddings").where("vec_id % 5 = 0")
    conditions = F.array(*(F.struct(F.lit(k).alias("dim"), F.lit(sign).alias("sign"), F.col("embedding")[k].cast("double").alias("bound")) for k, sign in enumerate((1, -1, 1))))
    return e.select(F.col("vec_id").alias("rule_id"), conditions.alias("conditions"), F.col("label").cast("int").alias("cls"))


def _instances(spark, d):
    return views.vector_instances(spark, d).select(F.col("ord").alias("id"), F.col("label").cast("int").alias("label"), "x")


def _label_sets(spark, d):
    """Bags with all labels of their instances."""
    labels = views.vector_instances(spark, d).groupBy("bag_idx").agg(F.collect_set(F.col("label").cast("int")).alias("label"))
    return vec(spark, d).select("bag_idx", "bag").join(labels, "bag_idx").select(F.col("bag_idx").alias("id"), "label", F.col("bag").alias("instances"))


def _trees():
    return trees.arithmetic(3, (0.5,), 11)


def _programs(spark, d):
    """One of four programs for each vector, with the vector as its inputs (whose first two values differ in each)."""
    t = _trees()
    texts = ("+ x0 * x1 x2", "if < x0 x1 - x0 x2 neg + x1 0.5", "* + x0 x1 - x1 neg x2", "x2")
    codes = F.array(*(F.lit([t.code(n) for n in text.split()]) for text in texts))
    e = views.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("ind_id"), F.get(codes, (F.col("vec_id") % 4).cast("int")).alias("p"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("x"))


def _mated(spark, d):
    """Each program with the next one's, and two draws."""
    p = _programs(spark, d).select("ind_id", "p")
    q = p.select((F.col("ind_id") - 1).alias("ind_id"), F.col("p").alias("q"))
    return p.join(q, "ind_id").withColumn("u", (F.col("ind_id") * 7 % 101) / 101).withColumn("v", (F.col("ind_id") * 11 % 103) / 103)


def _rule_list(spark, d):
    rows, model = rules.bags_of(vec(spark, d)), rules.RuleList(7)
    model.fit(rows, _rules(spark, d))
    return model.predict(rows)


def by_rule(bags, k=3):
    return bags.select("bag_idx", (F.col("bag_idx") % k).cast("int").alias("cluster"))


def medoid_assignment(spark, d):
    bags = vec(spark, d)
    held = {i: np.asarray(r.bag, float) for i, r in enumerate(bags.where(F.col("bag_idx").isin(MEDOIDS)).orderBy("bag_idx").collect())}
    return bags, joins.assign_nearest(bags, held, "maxmin")


RULES = (2, 3, 4)  # individuals of the population queries: bag_idx % rule
RATED = {"population_rmsstd": "rmssd", "population_silhouette": "silhouette", "population_davies_bouldin": "db", "population_xie_beni": "xb", "population_twcv": "twcv", "population_s_dbw": "sdbw"}


def population_rated(metric, name):
    """One metric of several assignments by one plan."""

    def query(spark, d):
        bags = vec(spark, d)
        labels = bags.select("bag_idx", F.explode(F.array(*[F.lit(t) for t in RULES])).alias("ind_id"))
        labels = labels.select(F.col("ind_id").cast("long"), "bag_idx", (F.col("bag_idx") % F.col("ind_id")).cast("int").alias("cluster"))
        return rounded(evoclusters.Space(bags, max(RULES), once=True).rated(labels, metric).withColumnRenamed("fitness", name))

    return query


def evolved(run, **options):
    return lambda s, d: rounded(run(vec(s, d), **options))


# SQL pieces

VEC = "inst as (select vec_id // 5 as bag, vec_id as ord, list_transform(embedding, lambda v: v::double) as x from embeddings), lab as (select vec_id // 5 as bag, arg_min(label, vec_id) as label from embeddings group by 1)"
USER = "inst as (select user_id as bag, event_id as ord, [value + 0.0, hour(ts)::double] as x from events)"
ORDER = "inst as (select l_orderkey as bag, [l_quantity + 0.0, l_extendedprice + 0.0, l_discount + 0.0, l_tax + 0.0] as x from lineitem)"
FLAT = "flat as (select bag, unnest(x) as v, generate_subscripts(x, 1) - 1 as dim from inst)"
ENDS = "d as (select a.bag as i, b.bag as j, a.ord as oa, b.ord as ob, list_distance(a.x, b.x) as d from inst a, inst b)"
PAIR = {
    "maxmin": "p as (select i, j, max(m) as d from (select i, j, oa, min(d) as m from d group by all) group by all)",
    "minmin": "p as (select i, j, min(d) as d from d group by all)",
    "meanmin": "p as (select i, j, avg(m) as d from (select i, j, oa, min(d) as m from d group by all) group by all)",
    "mean": "p as (select i, j, avg(d) as d from d group by all)",
}
#: mean centroids of the rule's clusters, and each bag's distance to its own (maxmin)
CENTRES = "cen as (select cluster, list(v order by dim) as c from (select bag % 3 as cluster, dim, avg(v) as v from flat group by all) group by cluster)"
OWN = "own as (select i.bag as bag, c.cluster, max(list_distance(i.x, c.c)) as d from inst i join cen c on i.bag % 3 = c.cluster group by all)"
BETWEEN = "bet as (select a.cluster as i, b.cluster as j, list_distance(a.c, b.c) as d from cen a, cen b where a.cluster != b.cluster)"
NEAR2 = f"med as (select bag, ord, x, case bag when {MEDOIDS[0]} then 0 else 1 end as cluster from inst where bag in ({MEDOIDS[0]}, {MEDOIDS[1]})), ad as (select bag, cluster, max(m) as d from (select i.bag, i.ord, m.cluster, min(list_distance(i.x, m.x)) as m from inst i, med m group by all) group by all), asg as (select bag, cluster, d from (select *, row_number() over (partition by bag order by d, cluster) as r from ad) where r = 1)"


RULES_ = "rule as (select vec_id as rule_id, embedding[1]::double as b0, embedding[2]::double as b1, embedding[3]::double as b2, label as cls from embeddings where vec_id % 5 = 0)"
FIRE = "fire as (select rule_id, cls, bag, bool_or(x[1] >= b0 and x[2] <= b1 and x[3] >= b2) as fired from inst, rule group by all)"
CONFUSED = "cf as (select rule_id, cls, count(*) filter (label = cls and fired) as tp, count(*) filter (label != cls and fired) as fp, count(*) filter (label = cls and not fired) as fn, count(*) filter (label != cls and not fired) as tn from fire join lab using (bag) group by all), rt as (select *, case when tp + fn > 0 then tp / (tp + fn) else 0 end as sens, case when tn + fp > 0 then tn / (tn + fp) else 0 end as spec from cf) "


def with_(*parts):
    return "with recursive " + ", ".join(parts) + " "


def flagship(spark, d):
    bags, found = medoid_assignment(spark, d)
    found = saved(found)
    own = indices.to_own_centroid(bags, found)
    per = own.groupBy("cluster").agg(F.count("d").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s"))
    cells = external.confusion(found.join(bags.select("bag_idx", "label"), "bag_idx"))
    best = cells.groupBy("cluster").agg(F.max("n").alias("most"))
    return rounded(per.join(best, "cluster").select("cluster", "n", F.col("s").alias("squares"), (F.col("most") / F.col("n")).alias("purity")))


def _draws(n):
    """Per locus ((ind * 7919 + locus * 104729 + n) % 1000) / 1000."""
    return F.transform(F.col("g"), lambda _, i: ((F.col("ind_id") * 7919 + i * 104729 + n) % 1000) / F.lit(1000.0))


def _one(n):
    return ((F.col("ind_id") * 7919 + n) % 1000) / F.lit(1000.0)


def genotypes(spark, d):
    """One individual per embedding: ind_id, integer genes g in [0, 5), real genes r in [0, 1], fitness."""
    e = views.table(spark, d, "embeddings")
    g = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 5).cast("int"))
    return e.select(F.col("vec_id").alias("ind_id"), g.alias("g")).withColumn("r", F.transform("g", lambda v: v / F.lit(4.0))).withColumn("fitness", F.aggregate("g", F.lit(0.0), lambda s, v: s + v))


GENES = "g0 as (select vec_id as ind_id, list_transform(embedding, lambda v: (floor(abs(v::double) * 1000)::bigint % 5)::int) as g from embeddings), pop as (select ind_id, g, list_transform(g, lambda v: v / 4.0::double) as r, list_sum(g)::double as fitness from g0)"
PAIRS = "par as (select a.ind_id, a.g, b.g as h, a.r, b.r as s from pop a join pop b on b.ind_id = a.ind_id + 1)"


def parents(spark, d):
    p = genotypes(spark, d)
    q = p.select((F.col("ind_id") - 1).alias("ind_id"), F.col("g").alias("h"), F.col("r").alias("s"))
    return p.join(q, "ind_id")


def u_sql(n):
    return f"((ind_id * 7919 + (k - 1) * 104729 + {n}) % 1000) / 1000.0::double"


def one_sql(n):
    return f"(((ind_id * 7919 + {n}) % 1000) / 1000.0::double)"


def mapped_sql(expr, source="pop", of="g"):
    """expr of v (gene), k (1-based locus), in a list comprehension over the genes."""
    return with_(GENES, PAIRS) + f"select ind_id, list_transform(range(1, len({of}) + 1), lambda k: {expr}) as son from {source}"


def _q_pairs(kind):
    def run(spark, d):
        return rounded(joins.pair_table(vec(spark, d), None, kind))

    return run


def _rates(spark, d):
    """label: toxic, predicted: 1 - quality, over all labels."""
    t = views.table(spark, d, "labels")
    return t.select(F.col("toxic").alias("label"), F.when(F.col("doc_id") % 10 == 0, -1).otherwise(1 - F.col("quality")).alias("predicted"))


PRED = "pr as (select toxic as label, case when doc_id % 10 = 0 then -1 else 1 - quality end as predicted from labels)"


def _multi(spark, d):
    e = views.table(spark, d, "embeddings")
    flag = lambda c, s: F.transform(c, lambda v: (v.cast("double") + s > 0).cast("int"))
    return e.select(flag("embedding", 0.0).alias("truth"), flag("embedding", 0.02).alias("guess"))


MULTI = "ml as (select vec_id as id, k as label, (embedding[k]::double > 0)::int as t, (embedding[k]::double + 0.02 > 0)::int as g from embeddings, (select unnest(range(1, 65)) as k))"


def _weighted(kind):
    def run(spark, d):
        return rounded(population.weights(genotypes(spark, d), kind, 100.0).select("ind_id", F.col("w")))

    return run


def _objectives(spark, d):
    """One point per supplier: balances of sums over its items."""
    i = views.table(spark, d, "lineitem")
    return i.groupBy(F.col("l_suppkey").alias("ind_id")).agg(F.array(F.round(F.sum("l_quantity"), 2), F.round(-F.avg("l_discount"), 6), F.round(F.avg("l_tax"), 6)).alias("objectives"))


POINTS = "pt as (select l_suppkey as ind_id, round(sum(l_quantity), 2) as a, round(-avg(l_discount), 6) as b, round(avg(l_tax), 6) as c from lineitem group by 1), dom as (select p.ind_id as i, q.ind_id as j from pt p, pt q where p.a >= q.a and p.b >= q.b and p.c >= q.c and (p.a > q.a or p.b > q.b or p.c > q.c))"


def queries():
    q = {"flagship": flagship}
    for kind in PAIR:
        q[f"hausdorff_{kind}"] = _q_pairs(kind)
    q |= {
        "earth_movers": lambda s, d: rounded(joins.pair_table(vec(s, d), None, "earth_movers")),
        "cauchy_schwarz": lambda s, d: rounded(joins.pair_table(views.user_bags(s, d), None, "cauchy_schwarz")),
        "mahalanobis_2d": lambda s, d: joins.pair_table(views.user_bags(s, d), None, "mahalanobis").select("i", "j", (F.round(F.col("d"), 5) + 0.0).alias("d")),
        "l2_matrix": lambda s, d: rounded(vec(s, d).select("bag_idx", F.posexplode("bag").alias("a", "x"), "bag").select("bag_idx", "a", "x", F.posexplode("bag").alias("b", "y")).select("bag_idx", "a", "b", C.l2(F.col("x"), F.col("y")).alias("d"))),
        "hausdorff_expression": lambda s, d: rounded(vec(s, d).select("bag_idx", F.col("bag").alias("p")).join(vec(s, d).select((F.col("bag_idx") - 1).alias("bag_idx"), F.col("bag").alias("q")), "bag_idx").select("bag_idx", *(C.hausdorff(k, F.col("p"), F.col("q")).alias(k) for k in PAIR))),
        "pair_table_mirrored": lambda s, d: rounded(joins.pair_table(vec(s, d), None, "maxmin", compat_mirror=True)),
        "bag_mean": lambda s, d: rounded(vec(s, d).select("bag_idx", C.bag_mean(F.col("bag")).alias("c"))),
        "assign_nearest": lambda s, d: rounded(medoid_assignment(s, d)[1]),
        "eps_neighbors": lambda s, d: rounded(joins.range_join(vec(s, d), vec(s, d), EPS)),
        "knn_neighbors": lambda s, d: rounded(joins.nearest_join(vec(s, d), vec(s, d), 3)),
        "core_points": lambda s, d: joins.range_counts(vec(s, d), vec(s, d), EPS).where("n >= 4"),
        "dbscan": lambda s, d: clusterers.DBSCAN(EPS, 4).fit(vec(s, d)),
        "optics_core_distance": lambda s, d: rounded(clusterers.OPTICS(EPS, 4).core_distances(vec(s, d))),
        "optics": lambda s, d: rounded(clusterers.OPTICS(EPS, 4).fit(vec(s, d))),
        "like_class": lambda s, d: clusterers.LikeClass().fit(vec(s, d)),
        "one_step_kmeans": lambda s, d: rounded(clusterers.one_step(vec(s, d), by_rule(vec(s, d)), repair=False)),
        "mikmeans": lambda s, d: rounded(clusterers.KMeans(2, start=MEDOIDS).fit(vec(s, d))),
        "mikmeans_one_iteration": lambda s, d: rounded(clusterers.KMeans(2, start=MEDOIDS, most_iterations=1).fit(vec(s, d))),
        "mikmeans_until_stable": lambda s, d: rounded(clusterers.KMeans(3).fit(vec(s, d))),
        "bamic": lambda s, d: rounded(clusterers.KMedoids(2, start=MEDOIDS).fit(vec(s, d))),
        "cluster_centroid": lambda s, d: rounded(centres.mean_centroids(views.order_instances(s, d), by_rule(views.order_instances(s, d).select("bag_idx").distinct()))),
        "cluster_centroid_first_twice": lambda s, d: rounded(centres.mean_centroids(views.user_instances(s, d), by_rule(views.user_bags(s, d)), compat_first_twice=True)),
        "cluster_medoid": lambda s, d: rounded(centres.medoids(vec(s, d), by_rule(vec(s, d))).select("cluster", "bag_idx", "d")),
        "cluster_spread": lambda s, d: rounded(centres.spreads(views.order_instances(s, d), by_rule(views.order_instances(s, d).select("bag_idx").distinct())).drop("var")),
        "bags_per_cluster": lambda s, d: centres.counts(medoid_assignment(s, d)[1], 4),
        "attribute_stats": lambda s, d: rounded(transforms.attributes(views.order_instances(s, d))),
        "zscore": lambda s, d: rounded(transforms.standardised(views.user_instances(s, d), "z1").select("bag_idx", "ord", "x")),
        "minmax": lambda s, d: rounded(transforms.standardised(views.user_instances(s, d), "z5").select("bag_idx", "ord", "x")),
        "cut_points": lambda s, d: rounded(transforms.cut_points(views.order_instances(s, d))),
        "best_cut_points": lambda s, d: rounded(transforms.best_cut_points(views.user_instances(s, d))),
        "discretize_equal_width": lambda s, d: transforms.discretised(views.user_instances(s, d), transforms.cut_points(views.user_instances(s, d), 4)).select("bag_idx", "ord", "x"),
        "binary_splits": lambda s, d: transforms.binary_splits(views.user_instances(s, d), transforms.cut_points(views.user_instances(s, d), 3)).select("bag_idx", "ord", "x"),
        "relabel_by_size": lambda s, d: transforms.relabelled_by_size(views.table(s, d, "orders").select(F.col("o_orderkey").alias("bag_idx"), (F.col("o_custkey") % 7).cast("int").alias("cluster"))),
        "dataset_union": lambda s, d: rounded(transforms.union_of_datasets([views.user_bags(s, d), views.user_bags(s, d).withColumn("label", 1 - F.col("label"))]).select("bag_idx", "label", F.size("bag").alias("n"))),
        "range_scale": lambda s, d: rounded(views.table(s, d, "orders").select("o_orderkey", C.nearest_of(F.col("o_totalprice"), 1000.0, 200000.0).alias("clipped"), C.scaled(F.col("o_totalprice"), 1000.0, 200000.0).alias("scaled"), C.contains(F.col("o_totalprice"), 1000.0, 200000.0, "open-closed").alias("inside"))),
        "rmsstd": lambda s, d: rounded(indices.rmsstd(indices.to_own_centroid(vec(s, d), by_rule(vec(s, d))), 64)),
        "twcv": lambda s, d: rounded(indices.twcv(indices.to_own_centroid(vec(s, d), by_rule(vec(s, d))))),
        "ftwcv": lambda s, d: rounded(indices.ftwcv(vec(s, d), by_rule(vec(s, d)))),
        "xie_beni": lambda s, d: rounded(indices.xie_beni(indices.to_own_centroid(vec(s, d), by_rule(vec(s, d))), indices.centroid_distances(vec(s, d), by_rule(vec(s, d))))),
        "davies_bouldin": lambda s, d: rounded(indices.davies_bouldin(indices.to_own_centroid(vec(s, d), by_rule(vec(s, d))), indices.centroid_distances(vec(s, d), by_rule(vec(s, d))))),
        "silhouette": lambda s, d: rounded(indices.silhouette(joins.pair_table(vec(s, d)), by_rule(vec(s, d)))),
        "s_dbw": lambda s, d: rounded(indices.s_dbw(vec(s, d), by_rule(vec(s, d)))),
        "dbcv": lambda s, d: rounded(density.dbcv(vec(s, d), by_rule(vec(s, d)).withColumn("ind_id", F.lit(0).cast("long")), "mean").select("dbcv")),
        "confusion_matrix": lambda s, d: external.confusion(vec(s, d).select((F.col("bag_idx") % 3).cast("int").alias("cluster"), "label")),
        "entropy": lambda s, d: rounded(external.entropy(_cells(s, d))),
        "purity": lambda s, d: rounded(external.purity(_cells(s, d))),
        "rand_index": lambda s, d: rounded(external.rand_index(_cells(s, d))),
        "class_metrics": lambda s, d: rounded(external.per_class(_cells(s, d))),
        "prediction_rates": lambda s, d: rounded(external.rates(_rates(s, d))),
        "kappa": lambda s, d: rounded(external.kappa(_rates(s, d))),
        "geometric_mean": lambda s, d: rounded(external.geometric_mean(_rates(s, d))),
        "auc": lambda s, d: rounded(external.auc(_rates(s, d))),
        "multilabel_metrics": lambda s, d: rounded(external.multilabel(_multi(s, d))),
        "label_accuracy": lambda s, d: rounded(external.label_accuracy(_multi(s, d))),
        "hamming_pairs": lambda s, d: population.genotype_distances(genotypes(s, d).select("ind_id", F.col("g").alias("genotype"))),
        "fitness_moments": lambda s, d: rounded(population.moments(genotypes(s, d))),
        "best_individual": lambda s, d: rounded(population.best(genotypes(s, d))),
        "worst_individual": lambda s, d: rounded(population.worst(genotypes(s, d))),
        "median_individual": lambda s, d: rounded(population.median(genotypes(s, d))),
        "roulette": lambda s, d: population.spun(population.weights(genotypes(s, d)), _slots(s, d)),
        "universal_sampling": lambda s, d: population.universal(population.weights(genotypes(s, d), "linear_rank"), 300, 0.37),
        "tournament": lambda s, d: population.tournament(genotypes(s, d), _slots(s, d).withColumn("slot", F.floor(F.col("slot") / 3))),
        "truncation": lambda s, d: population.ordered(genotypes(s, d), 100),
        "pareto_front": lambda s, d: multiobjective.fronts(_objectives(s, d)),
        "crowding": lambda s, d: rounded(multiobjective.crowding(_objectives(s, d).withColumn("front", (F.col("ind_id") % 4).cast("int")))),
        "spea2_strength": lambda s, d: multiobjective.spea2(_objectives(s, d), 3).select("ind_id", "strength", "raw"),
        "one_point_xover": lambda s, d: parents(s, d).select("ind_id", variation.one_point(F.col("g"), F.col("h"), _one(3))[0].alias("son")),
        "two_point_xover": lambda s, d: parents(s, d).select("ind_id", variation.two_point(F.col("g"), F.col("h"), _one(3), _one(8))[0].alias("son")),
        "uniform_xover": lambda s, d: parents(s, d).select("ind_id", variation.uniform(F.col("g"), F.col("h"), _draws(5))[0].alias("son")),
        "arithmetic_xover": lambda s, d: rounded(parents(s, d).select("ind_id", variation.arithmetic(F.col("r"), F.col("s"))[0].alias("son"))),
        "blx_alpha": lambda s, d: rounded(parents(s, d).select("ind_id", variation.blend(F.col("r"), F.col("s"), _draws(1), 0.0, 1.0).alias("son"))),
        "flat_xover": lambda s, d: rounded(parents(s, d).select("ind_id", variation.flat(F.col("r"), F.col("s"), _draws(1)).alias("son"))),
        "linear_xover": lambda s, d: rounded(parents(s, d).select("ind_id", variation.linear(F.col("r"), F.col("s"), 0.0, 1.0)[1].alias("son"))),
        "wright_xover": lambda s, d: rounded(parents(s, d).select("ind_id", variation.wright(F.col("r"), F.col("s"), _draws(1), 0.0, 1.0).alias("son"))),
        "uniform_mutation": lambda s, d: genotypes(s, d).select("ind_id", variation.uniform_mutation(F.col("g"), _draws(1), _draws(77), 0.3, 0, 5).alias("son")),
        "one_locus_mutation": lambda s, d: genotypes(s, d).select("ind_id", variation.one_locus(F.col("g"), _one(4), _one(9), 0, 5).alias("son")),
        "random_reset_mutation": lambda s, d: rounded(genotypes(s, d).select("ind_id", variation.random_reset(F.col("r"), _draws(1), _draws(77), 0.0, 1.0, 0.2).alias("son"))),
        "random_range_mutation": lambda s, d: rounded(genotypes(s, d).select("ind_id", variation.random_range(F.col("r"), _draws(1), _draws(77), 0.0, 1.0, 0.5).alias("son"))),
        "fuzzy_connectives": lambda s, d: rounded(_connected(s, d)),
        "relabel_genotype": lambda s, d: genotypes(s, d).select("ind_id", variation.ordered_labels(F.col("g")).alias("son")),
    }
    q |= {
        "one_step_repaired": lambda s, d: rounded(clusterers.one_step(vec(s, d), by_rule(vec(s, d)))),
        "imputed": lambda s, d: rounded(transforms.imputed(_with_gaps(s, d)).select("bag_idx", "ord", "x")),
        "mapped_accuracy": lambda s, d: rounded(external.accuracy(_cells(s, d))),
        "real_clusters": lambda s, d: external.real_clusters(_partly(s, d)),
        "class_sizes": lambda s, d: external.class_sizes(_partly(s, d)),
        "best_and_worst_together": lambda s, d: population.united(population.chosen(_coded(s, d), population.ordered(_coded(s, d), 50)).drop("slot"), population.chosen(_coded(s, d), population.ordered(_coded(s, d), 70, False)).drop("slot")).select("ind_id", "fitness"),
        "population_difference": lambda s, d: population.without(genotypes(s, d), genotypes(s, d).where("ind_id % 3 = 0")).select("ind_id", "fitness"),
        "worst_first": lambda s, d: population.ordered(genotypes(s, d), 100, False),
        "random_selection": lambda s, d: population.uniform(genotypes(s, d), _slots(s, d)),
        "euclidean_pairs": lambda s, d: rounded(population.genotype_distances(genotypes(s, d).select("ind_id", F.col("r").alias("genotype")), "euclidean")),
        "shared_fitness": lambda s, d: rounded(niches.shared(_coded(s, d), 40.0)),
        "shared_fitness_of_reals": lambda s, d: rounded(niches.shared(_real(s, d), 2.0, 2.0, "euclidean")),
        "near_genotypes": lambda s, d: niches.hamming_near(_coded(s, d), 42),
        "cleared_fitness": lambda s, d: rounded(niches.cleared(_coded(s, d), 44.0)),
        "ranecu_draws": lambda s, d: rounded(views.table(s, d, "embeddings").select("vec_id", generators.ranecu(F.col("vec_id") + 1, 12345, 67890).alias("u"))),
        "ranecu_far_draws": lambda s, d: rounded(views.table(s, d, "embeddings").select("vec_id", generators.ranecu(F.col("vec_id") * 1_000_003_000_007, F.col("vec_id") + 1, 2 * F.col("vec_id") + 1).alias("u"))),
        "rule_confusions": lambda s, d: rules.confusions(rules.bags_of(vec(s, d)), _rules(s, d)),
        "rule_confusions_of_instances": lambda s, d: rules.confusions(rules.single(_instances(s, d)), _rules(s, d)),
        "rule_confusions_of_label_sets": lambda s, d: rules.multilabel_confusions(_label_sets(s, d), _rules(s, d)),
        "rule_fitness": lambda s, d: rounded(rules.rated(rules.confusions(rules.bags_of(vec(s, d)), _rules(s, d)))),
        "rule_list_predictions": _rule_list,
        "cluster_survey": lambda s, d: rounded(centres.survey(views.user_instances(s, d), views.user_instances(s, d).select("bag_idx").distinct().select("bag_idx", ((F.col("bag_idx") % 4) - 1).cast("int").alias("cluster")))),
        "population_report": lambda s, d: rounded(evolution.summary(genotypes(s, d))),
        "full_evaluation": lambda s, d: rounded(indices.evaluation(vec(s, d), by_rule(vec(s, d)))),
        "class_macros": lambda s, d: rounded(external.macros(_cells(s, d))),
        "tree_ends": lambda s, d: _programs(s, d).select("ind_id", F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: trees.end_of(_trees(), F.col("p"), i)).alias("ends")),
        "tree_values": lambda s, d: rounded(_programs(s, d).select("ind_id", trees.value(_trees(), F.col("p"), F.col("x")).alias("v"))),
        "tree_crossover": lambda s, d: _mated(s, d).select("ind_id", trees.crossed(_trees(), F.col("p"), F.col("q"), F.col("u"), F.col("v")).alias("c")).select("ind_id", F.col("c")[0].alias("a"), F.col("c")[1].alias("b")),
        "spea2_fitness": lambda s, d: rounded(multiobjective.spea2(_objectives(s, d), 3)),
        "spea2_archive": lambda s, d: _archived(s, d, 60),
        "spea2_truncated": lambda s, d: _archived(s, d, 5),
        "half_uniform_xover": lambda s, d: parents(s, d).select("ind_id", variation.half_uniform(F.col("g"), F.col("h"), _draws(5))[1].alias("son")),
        "discrete_xover": lambda s, d: rounded(parents(s, d).select("ind_id", variation.uniform(F.col("r"), F.col("s"), _draws(5), 0.3)[1].alias("son"))),
        "linear_xover_all": lambda s, d: rounded(parents(s, d).select("ind_id", *(x.alias(f"son{i}") for i, x in enumerate(variation.linear(F.col("r"), F.col("s"), 0.0, 1.0))))),
        "several_loci_mutation": lambda s, d: genotypes(s, d).select("ind_id", variation.several_loci(F.col("g"), _draws(1), _draws(77), 7, 0, 5).alias("son")),
        "muhlenbein_mutation": lambda s, d: rounded(genotypes(s, d).select("ind_id", variation.muhlenbein(F.col("r"), _draws(1), _draws(77), 0.0, 1.0, 0.1, 0.4).alias("son"))),
        "modal_discrete_mutation": lambda s, d: rounded(genotypes(s, d).select("ind_id", variation.geometric(F.col("r"), _draws(1), _draws(77), 0.0, 1.0, p=0.4).alias("son"))),
        "modal_continuous_mutation": lambda s, d: rounded(genotypes(s, d).select("ind_id", variation.modal_continuous(F.col("r"), _draws(1), _draws(77), 0.0, 1.0).alias("son"))),
        "non_uniform_mutation": lambda s, d: rounded(genotypes(s, d).select("ind_id", variation.non_uniform(F.col("r"), _draws(1), _draws(77), 0.0, 1.0, 3, 10, p=0.4).alias("son"))),
        "mixed_non_uniform_mutation": lambda s, d: rounded(genotypes(s, d).select("ind_id", variation.mixed_non_uniform(F.col("r"), _draws(1), _draws(77), 3, 10, p=0.4).alias("son"))),
        "medoid_pair_mutation": lambda s, d: genotypes(s, d).select("ind_id", variation.medoid_pair(F.col("g"), _draws(1), _draws(77), 0, 5, 0.3).alias("son")),
        "merge_mutation": lambda s, d: genotypes(s, d).select("ind_id", variation.merged(F.col("g"), _draws(1), 0.5).alias("son")),
        "split_mutation": lambda s, d: genotypes(s, d).select("ind_id", variation.split(F.col("g"), _draws(1), _draws(77), 0.5, 7).alias("son")),
        "reclassify_mutation": lambda s, d: genotypes(s, d).select("ind_id", variation.reclassified(F.col("g"), _draws(1), _draws(77), 0.5).alias("son")),
        "implant_xover": lambda s, d: parents(s, d).select("ind_id", variation.implanted(F.col("g"), F.col("h"), _draws(1), _draws(5), _draws(77), 0.5, 0.5).alias("son")),
        "population_ftwcv": population_rated("ftwcv", "ftwcv"),
        "population_dbcv": population_rated("dbcv", "dbcv"),
        "interval_closures": lambda s, d: views.table(s, d, "lineitem").groupBy("l_orderkey").agg(*(F.sum(C.contains(F.col("l_quantity"), 10.0, 20.0, k).cast("long")).alias(k.replace("-", "_")) for k in CLOSURES)),
    }
    for kind in ("boltzmann", "disruptive", "linear_rank", "nonlinear_rank", "sigma"):
        q[f"weights_{kind}"] = _weighted(kind)
    q |= {name: population_rated(metric, name.removeprefix("population_")) for name, metric in RATED.items()}
    q |= {f"evolve_{name.lower()}": evolved(run, **({} if name == "MIGKA" else {"n": 4, "generations": 2})) for name, run in evoclusters.ALGORITHMS.items()}
    return q


EPS = 1.14


def _cells(spark, d):
    return external.confusion(vec(spark, d).select((F.col("bag_idx") % 3).cast("int").alias("cluster"), (F.col("label") % 3).alias("label")))


CLOSURES = ("closed-closed", "closed-open", "open-closed", "open-open")


def _with_gaps(spark, d):
    """Instances of users without the attribute at place ord % 5."""
    return views.user_instances(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when(F.col("ord") % 5 != i, v)))


def _partly(spark, d):
    """Bags by rule, every tenth without a cluster."""
    b = vec(spark, d)
    return b.select(F.when(F.col("bag_idx") % 10 == 0, -1).otherwise(F.col("bag_idx") % 3).cast("int").alias("cluster"), "label")


def _coded(spark, d):
    return genotypes(spark, d).select("ind_id", F.col("g").alias("genotype"), "fitness")


def _archived(spark, d, size):
    points = saved(_objectives(spark, d))
    return rounded(multiobjective.archive(saved(multiobjective.spea2(points, 3)), size, points, 3).select("ind_id", "fitness"))


def _slots(spark, d):
    e = views.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("slot"), ((F.col("vec_id") * 7919 + 13) % 1000 / F.lit(1000.0)).alias("u"))


def _connected(spark, d):
    i = views.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"))
    cols = [e.alias(f"{k}_{n}") for k in ("algebraic", "einstein", "hamacher", "logical") for n, e in C.connectives(k, F.col("x"), F.col("y")).items()]
    return i.select("l_orderkey", *cols).groupBy("l_orderkey").agg(*(F.sum(c).alias(c) for c in [f"{k}_{n}" for k in ("algebraic", "einstein", "hamacher", "logical") for n in "msfl"]))


def dbcv_sql(kind):
    """The longest edge of a cluster's spanning tree is the least threshold that connects it."""
    r = lambda e: f"round({e}, 6) + 0.0"
    return with_(VEC, ENDS, PAIR[kind], "s as (select i, j, i % 3 as ci, j % 3 as cj, d from p where i != j)", "k as (select i, pow(sum(pow(1 / greatest(d, 1e-12), 64)) / count(*), -1.0 / 64) as k from s where ci = cj group by i)", "m as (select s.i, s.j, ci, cj, greatest(d, a.k, b.k) as r from s join k a on a.i = s.i join k b on b.i = s.j)", "o as (select ci, i, j, r from m where ci = cj and i < j union all select ci, j, i, r from m where ci = cj and i < j)", "t as (select distinct ci, r as t from o)", "reach as (select t.ci, t, min(i) as i from t join k on i % 3 = ci group by all union select w.ci, w.t, m.j from reach w join o m on m.ci = w.ci and m.i = w.i and m.r <= w.t)", "n as (select i % 3 as ci, count(*) as n from k group by 1)", "sp as (select ci, min(t) as sparse from (select ci, t, count(*) as c from reach group by all) join n using (ci) where c = n group by ci)", "gp as (select ci, min(r) as gap from m where ci != cj group by ci)") + f"select {r('sum(n * (gap - sparse) / greatest(gap, sparse)) / sum(n)')} as dbcv from n join sp using (ci) join gp using (ci)"


def oracle_sql():
    r = lambda e: f"round({e}, 6) + 0.0"
    rl = lambda e: f"list_transform({e}, lambda w: round(w, 6) + 0.0)"
    out = {}
    for kind, p in PAIR.items():
        out[f"hausdorff_{kind}"] = with_(VEC, ENDS, p) + f"select i, j, {r('d')} as d from p where i != j"
    judged = with_(VEC, RULES_, FIRE)
    # codes: x0 x1 x2 0.5 true + - * neg < and not if; and how many nodes are asked for less those that are there
    programs = with_("prog as (select vec_id as ind_id, case vec_id % 4 when 0 then [5, 0, 7, 1, 2] when 1 then [12, 9, 0, 1, 6, 0, 2, 8, 5, 1, 3] when 2 then [7, 5, 0, 1, 6, 1, 8, 2] else [2] end as p from embeddings)", "code as (select ind_id, unnest(p) as g, generate_subscripts(p, 1) - 1 as i from prog)", "size as (select ind_id, len(p) as n from prog)", "ar as (select ind_id, i, [0, 0, 0, 0, 0, 2, 2, 2, 1, 2, 2, 1, 3][g + 1] - 1 as d from code)", "open_ as (select ind_id, i, i as j, coalesce(sum(d) over (partition by ind_id order by i rows between unbounded preceding and 1 preceding), 0) as s from ar union all select ind_id, null, count(*), sum(d) from ar group by ind_id)")
    minmin = with_(VEC, ENDS, PAIR["minmin"], f"near as (select i, j, d from p where d <= {EPS} or i = j)")
    rule = with_(VEC, FLAT, CENTRES, OWN, BETWEEN)
    cells = with_(VEC, "cell as (select (bag % 3)::int as cluster, label % 3 as class, count(*) as n from lab group by all)")
    after = "flat as (select bag, unnest(x) as v, generate_subscripts(x, 1) - 1 as dim from inst)"
    k2 = f"{after}, cen as (select cluster, list(v order by dim) as c from (select a.cluster, dim, avg(v) as v from flat f join asg a using (bag) group by all) group by cluster)"
    moved = "fin as (select bag, cluster, d from (select *, row_number() over (partition by bag order by d, cluster) as r from (select i.bag, c.cluster, max(list_distance(i.x, c.c)) as d from inst i, cen c group by all)) where r = 1)"
    stats = "st as (select dim, count(v) as n, min(v) as low, max(v) as high, avg(v) as mean, stddev_samp(v) as std from flat group by dim)"
    flat2 = "flat as (select bag, ord, unnest(x) as v, generate_subscripts(x, 1) - 1 as dim from inst)"
    weighted = lambda e: with_(GENES, "rk as (select *, row_number() over (order by fitness, ind_id) - 1 as k, count(*) over () as n, avg(fitness) over () as m, stddev_pop(fitness) over () as s from pop)") + f"select ind_id, {r(e)} as w from rk"
    slot = "sl as (select vec_id as slot, ((vec_id * 7919 + 13) % 1000) / 1000.0::double as u from embeddings)"
    conn = []
    for kind, (m, s, f) in {
        "algebraic": ("sqrt({p}) * sqrt({q})", "x + y - x * y", "x * y"),
        "einstein": ("case when {p} = 0 or {q} = 0 then 0 else 2 / (1 + sqrt((2 - {p}) / {p}) * sqrt((2 - {q}) / {q})) end", "(x + y) / (1 + x * y)", "(x * y) / (1 + (1 - x) * (1 - y))"),
        "hamacher": ("case when {p} = 0 or {q} = 0 then 0 else {p} * {q} / (0.5 * {p} + 0.5 * {q}) end", "case when x = 1 and y = 1 then 1 else (x + y - 2 * x * y) / (1 - x * y) end", "case when x = 0 and y = 0 then 0 else (x * y) / (x + y - x * y) end"),
        "logical": ("0.5 * {p} + 0.5 * {q}", "greatest(x, y)", "least(x, y)"),
    }.items():
        both = f"sqrt({f}) * sqrt({s})" if kind == "logical" else m.format(p=f"({f})", q=f"({s})")
        for name, e in (("m", m.format(p="x", q="y")), ("s", s), ("f", f), ("l", both)):
            conn.append(f"{r(f'sum({e})')} as {kind}_{name}")
    out |= {
        "flagship": with_(VEC, NEAR2, k2, "own as (select a.bag, a.cluster, max(list_distance(i.x, c.c)) as d from asg a join inst i using (bag) join cen c using (cluster) group by all)") + f"select cluster::int as cluster, n, {r('s')} as squares, {r('most / n')} as purity from (select cluster, count(*) as n, sum(d * d) as s from own group by 1) join (select cluster, max(n) as most from (select cluster, label, count(*) as n from asg join lab using (bag) group by all) group by 1) using (cluster)",
        "pair_table_mirrored": with_(VEC, ENDS, PAIR["maxmin"]) + f"select i, j, {r('d')} as d from p where i < j union all select j, i, {r('d')} from p where i < j",
        "mahalanobis_2d": with_("inst as (select user_id as bag, value as a, hour(ts)::double as b from events), st as (select bag, avg(a) as ma, avg(b) as mb, var_samp(a) as saa, var_samp(b) as sbb, covar_samp(a, b) as sab from inst group by 1)", "pr as (select p.bag as i, q.bag as j, p.ma - q.ma as da, p.mb - q.mb as db, (p.saa + q.saa) / 2 as aa, (p.sbb + q.sbb) / 2 as bb, (p.sab + q.sab) / 2 as ab from st p, st q where p.bag != q.bag)") + "select i, j, round((da * da * bb - 2 * da * db * ab + db * db * aa) / (aa * bb - ab * ab), 5) + 0.0 as d from pr",
        "l2_matrix": with_(VEC) + f"select a.bag as bag_idx, (a.ord % 5)::int as a, (b.ord % 5)::int as b, {r('list_distance(a.x, b.x)')} as d from inst a join inst b using (bag)",
        "hausdorff_expression": with_(VEC, "e as (select a.bag, a.ord as oa, list_distance(a.x, b.x) as d, min(list_distance(a.x, b.x)) over (partition by a.bag, a.ord) as m from inst a join inst b on b.bag = a.bag + 1)") + f"select bag as bag_idx, {r('max(m)')} as maxmin, {r('min(m)')} as minmin, {r('avg(m)')} as meanmin, {r('avg(d)')} as mean from e group by bag",
        "bag_mean": with_(VEC, FLAT) + f"select bag as bag_idx, list({r('v')} order by dim) as c from (select bag, dim, avg(v) as v from flat group by all) group by bag",
        "assign_nearest": with_(VEC, NEAR2) + f"select bag as bag_idx, cluster::int as cluster, {r('d')} as d from asg",
        "eps_neighbors": minmin + f"select i, j, {r('d')} as d from near",
        "knn_neighbors": with_(VEC, ENDS, PAIR["minmin"]) + f"select i, j, {r('d')} as d, rank::int as rank from (select *, row_number() over (partition by i order by d, j) as rank from p where i != j) where rank <= 3",
        "core_points": minmin + "select i, count(*) as n from near group by i having count(*) >= 4",
        "dbscan": minmin + ", core as (select i from near group by i having count(*) >= 4), ce as (select n.i, n.j from near n join core a on n.i = a.i join core b on n.j = b.i), reach as (select i as a, i as b from core union select r.a, e.j from reach r join ce e on r.b = e.i), part as (select a as core, min(b) as part from reach group by 1), seed as (select part, arg_min(core, core::varchar) as seed, row_number() over (order by min(core::varchar)) - 1 as cluster from part group by part), cc as (select p.core, s.cluster, s.seed from part p join seed s using (part)), bor as (select n.i, coalesce(max(case when c.core = c.seed then c.cluster end), min(c.cluster)) as cluster from near n join cc c on n.j = c.core where n.i not in (select i from core) group by 1) select l.bag as bag_idx, coalesce(c.cluster, b.cluster, -2)::int as cluster from lab l left join cc c on c.core = l.bag left join bor b on b.i = l.bag",
        "optics_core_distance": minmin + f"select i as bag_idx, case when count(*) >= 4 then {r('list(d order by d)[4]')} end as core from near group by i",
        "like_class": with_(VEC) + "select bag as bag_idx, label as cluster from lab",
        "one_step_kmeans": with_(VEC, FLAT, CENTRES, moved) + f"select bag as bag_idx, cluster::int as cluster, {r('d')} as d from fin",
        "cluster_centroid": with_(ORDER, FLAT) + f"select cluster::int as cluster, list({r('v')} order by dim) as c from (select bag % 3 as cluster, dim, avg(v) as v from flat group by all) group by cluster",
        "cluster_centroid_first_twice": with_(USER, FLAT, "fb as (select bag % 3 as cluster, min(bag) as f from inst group by 1)") + f"select cluster::int as cluster, list({r('v')} order by dim) as c from (select bag % 3 as cluster, dim, sum(v * w) / sum(w) as v from (select flat.*, case when bag = f then 2 else 1 end as w from flat join fb on bag % 3 = cluster) group by all) group by cluster",
        "cluster_medoid": with_(VEC, "m as (select a.bag, a.ord, min(list_distance(a.x, b.x)) as m from inst a join inst b on a.bag % 3 = b.bag % 3 group by all), h as (select bag, max(m) as d from m group by 1)") + f"select (bag % 3)::int as cluster, arg_min(bag, struct_pack(d := d, bag := bag)) as bag_idx, {r('min(d)')} as d from h group by 1",
        "cluster_spread": with_(ORDER, FLAT) + f"select (bag % 3)::int as cluster, dim::int as dim, {r('avg(v)')} as mean, {r('stddev_samp(v)')} as std, count(v) as n from flat group by 1, 2",
        "bags_per_cluster": with_(VEC, NEAR2) + "select k::int as cluster, count(bag) as n from (select unnest(range(-1, 4)) as k) left join asg on cluster = k group by k",
        "attribute_stats": with_(ORDER, FLAT, stats) + f"select dim::int as dim, n, {r('low')} as low, {r('high')} as high, {r('mean')} as mean, {r('std')} as std from st",
        "zscore": with_(USER, flat2, stats) + f"select bag as bag_idx, ord, list(round(case when std = 0 then 0 else (v - mean) / std end, 6) + 0.0 order by dim) as x from flat join st using (dim) group by bag, ord",
        "minmax": with_(USER, flat2, stats) + f"select bag as bag_idx, ord, list(round(case when high = low then 0 else (v - low) / (high - low) end, 6) + 0.0 order by dim) as x from flat join st using (dim) group by bag, ord",
        "cut_points": with_(ORDER, FLAT, stats) + f"select dim::int as dim, list_transform(range(1, 10), lambda k: round(low + (high - low) * k / 10, 6) + 0.0) as cuts from st",
        "discretize_equal_width": with_(USER, flat2, stats) + "select bag as bag_idx, ord, list('B' || (1 + (v > low + (high - low) * 1 / 4)::int + (v > low + (high - low) * 2 / 4)::int + (v > low + (high - low) * 3 / 4)::int) order by dim) as x from flat join st using (dim) group by bag, ord",
        "binary_splits": with_(USER, flat2, stats) + "select bag as bag_idx, ord, flatten(list([v <= low + (high - low) * 1 / 3, v <= low + (high - low) * 2 / 3] order by dim)) as x from flat join st using (dim) group by bag, ord",
        "relabel_by_size": "with c as (select o_custkey % 7 as k, row_number() over (order by count(*) desc, o_custkey % 7) - 1 as n from orders group by o_custkey % 7) select o_orderkey as bag_idx, n::int as cluster from orders join c on o_custkey % 7 = k",
        "dataset_union": "with b as (select user_id, count(*) as n from events group by 1), u as (select 0 as label, * from b where user_id % 2 = 1 union all select 1, * from b where user_id % 2 = 0) select row_number() over (order by label, user_id) - 1 as bag_idx, label::int as label, n::int as n from u",
        "range_scale": f"select o_orderkey, {r('least(greatest(o_totalprice, 1000.0), 200000.0)')} as clipped, {r('(o_totalprice - 1000.0) / 199000.0')} as scaled, o_totalprice > 1000 and o_totalprice <= 200000 as inside from orders",
        "rmsstd": rule + f"select {r('sqrt(sum(s) / (64 * sum(n - 1)))')} as rmsstd from (select sum(d * d) as s, count(*) as n from own group by cluster)",
        "twcv": rule + f"select {r('sum(d * d)')} as twcv from own",
        "ftwcv": with_(VEC, FLAT, "q as (select bag % 3 as cluster, bag, sum(v * v) as q from (select bag, dim, avg(v) as v from flat group by all) group by all)") + f"select {r('sum(s) - sum(s / n)')} as ftwcv from (select sum(q) as s, count(*) as n from q group by cluster)",
        "xie_beni": rule + f"select {r('sum(s) / (sum(n) * (select min(d * d) from bet))')} as xie_beni from (select sum(d * d) / count(*) as s, count(*) as n from own group by cluster)",
        "davies_bouldin": rule + f", s as (select cluster, avg(d) as s from own group by 1) select {r('avg(x)')} as davies_bouldin from (select max(a.s + b.s) / min(bet.d) as x from bet join s a on a.cluster = bet.i join s b on b.cluster = bet.j group by bet.i)",
        "silhouette": with_(VEC, ENDS, PAIR["maxmin"], "g as (select i, i % 3 as ci, j % 3 as cj, avg(d) as d from p where i != j group by all), ab as (select i, max(case when ci = cj then d end) as a, min(case when ci != cj then d end) as b from g group by 1)") + f"select {r('avg((b - a) / greatest(a, b))')} as silhouette from ab",
        "s_dbw": with_(VEC, FLAT, "v as (select cluster, sqrt(sum(v * v)) as v from (select bag % 3 as cluster, dim, var_samp(v) as v from flat group by all) group by 1), w as (select sqrt(sum(v * v)) as v from (select dim, var_samp(v) as v from flat group by 1)), near as (select sqrt(sum(v)) / 3 as t from v), n as (select bag % 3 as c, count(distinct bag) as n from inst group by 1)", "cp as (select a.c as i, b.c as j, greatest(a.n, b.n) as m from n a, n b where a.c != b.c), du as (select i, j, m, bag, max(e) as d from (select cp.i, cp.j, cp.m, t.bag, u.ord, min(list_distance(u.x, t.x)) as e from cp, inst t, inst u where t.bag % 3 in (cp.i, cp.j) and u.bag % 3 in (cp.i, cp.j) group by all) group by all)", "sc as (select sum(v.v) / max(w.v) / 3 as s from v, w), de as (select coalesce(sum(x), 0) / 6 as d from (select sum((d <= t)::int) / m as x from du, near group by i, j, m))") + f"select {r('s')} as scat, {r('d')} as dens, {r('s + d')} as s_dbw from sc, de",
        "confusion_matrix": with_(VEC) + "select (bag % 3)::int as cluster, label as class, count(*) as n from lab group by all",
        "entropy": cells + f"select {r('-sum(n * log2(n / t)) / sum(n)')} as entropy from (select *, sum(n) over (partition by cluster) as t from cell)",
        "purity": cells + f"select {r('sum(m) / sum(t)')} as purity from (select max(n) as m, sum(n) as t from cell group by cluster)",
        "rand_index": cells + f", s as (select sum(n) as t, sum(n * (n - 1) / 2) as b from cell), a as (select sum(n * (n - 1) / 2) as x from (select sum(n) as n from cell group by cluster)), c as (select sum(n * (n - 1) / 2) as y from (select sum(n) as n from cell group by class)) select {r('(t * (t - 1) / 2 + 2 * b - x - y) / (t * (t - 1) / 2)')} as rand_index from s, a, c",
        "prediction_rates": with_(PRED) + f"select {r('avg((predicted = label)::int)')} as success, {r('avg((predicted != label and predicted >= 0)::int)')} as fail, {r('avg((predicted < 0)::int)')} as unclassified from pr",
        "kappa": with_(PRED) + f", t as (select count(*)::double as t, sum((predicted = label)::int) as a from pr), e as (select sum(x * y)::double as e from (select label as k, count(*) as x from pr group by 1) join (select predicted as k, count(*) as y from pr group by 1) using (k)) select {r('(t * a - e) / (t * t - e)')} as kappa from t, e",
        "geometric_mean": with_(PRED) + f"select {r('case when min(r) = 0 then 0 else exp(avg(ln(r))) end')} as geometric_mean from (select avg((predicted = label)::int) as r from pr group by label)",
        "auc": with_(PRED, "k as (select distinct label as k from pr), c as (select i.k as i, j.k as j, sum((label = i.k and predicted = i.k)::int) as tp, sum((label = i.k and predicted = j.k)::int) as fn, sum((label = j.k and predicted = i.k)::int) as fp, sum((label = j.k and predicted = j.k)::int) as tn from k i, k j, pr where i.k != j.k group by all)") + f"select {r('avg((1 + coalesce(tp / nullif(tp + fn, 0), 1) - coalesce(fp / nullif(fp + tn, 0), 0)) / 2)')} as auc from c",
        "label_accuracy": with_(MULTI) + f"select (label - 1)::int as label, {r('avg((t = g)::int)')} as accuracy from ml group by 1",
        "multilabel_metrics": with_(MULTI, *(f"{n} as (select sum((t = 1 and g = 1)::int) as tp, sum((t = 0 and g = 1)::int) as fp, sum((t = 1 and g = 0)::int) as fn, sum((t = 0 and g = 0)::int) as tn from ml {by})" for n, by in (("a", "group by id"), ("b", "group by label"), ("c", "")))) + "select " + ", ".join(f"(select {r(e)} from {t}) as {n}" for t, e, n in (
            ("a", "avg(tp / nullif(tp + fp + fn, 0))", "accuracy"), ("a", "avg(tp / nullif(tp + fp, 0))", "precision"), ("a", "avg(tp / nullif(tp + fn, 0))", "recall"), ("a", "avg((fp + fn) / (tp + fp + fn + tn))", "hamming_loss"), ("a", "avg((fp + fn = 0)::int)", "subset_accuracy"),
            ("b", "avg(2 * tp / nullif(2 * tp + fp + fn, 0))", "macro_f"), ("b", "avg(tp / nullif(tp + fp, 0))", "macro_precision"), ("b", "avg(tp / nullif(tp + fn, 0))", "macro_recall"), ("b", "avg((1 + tp / nullif(tp + fn, 0) - coalesce(fp / nullif(fp + tn, 0), 0)) / 2)", "macro_auc"),
            ("c", "tp / nullif(tp + fp, 0)", "micro_precision"), ("c", "tp / nullif(tp + fn, 0)", "micro_recall"), ("c", "2 * tp / nullif(2 * tp + fp + fn, 0)", "micro_f"), ("c", "(1 + tp / nullif(tp + fn, 0) - coalesce(fp / nullif(fp + tn, 0), 0)) / 2", "micro_auc"))),
        "hamming_pairs": with_(GENES) + "select a.ind_id as i, b.ind_id as j, list_sum(list_transform(list_zip(a.g, b.g), lambda z: (z[1] != z[2])::int))::int as d from pop a join pop b on a.ind_id < b.ind_id",
        "fitness_moments": with_(GENES) + f"select {r('avg(fitness)')} as mean, {r('var_pop(fitness)')} as variance from pop",
        "best_individual": with_(GENES) + "select ind_id, fitness from pop order by fitness desc, ind_id limit 1",
        "worst_individual": with_(GENES) + "select ind_id, fitness from pop order by fitness, ind_id limit 1",
        "median_individual": with_(GENES) + "select ind_id, fitness from (select *, row_number() over (order by fitness, ind_id) as p, count(*) over () as n from pop) where p = n // 2 + 1",
        # a part of the wheel for each, and pointers at equal distances
        "universal_sampling": with_(GENES, "rk as (select ind_id, 0.9 + 0.2 * (row_number() over (order by fitness, ind_id) - 1) / greatest(count(*) over () - 1, 1) as w from pop)", "wh as (select ind_id, coalesce(sum(w) over (order by ind_id rows between unbounded preceding and 1 preceding), 0) / sum(w) over () as low from rk)", "pt as (select unnest(range(0, 300)) as slot)") + "select slot, ind_id from (select slot, (slot + 0.37) / 300 as u from pt) asof join wh on u >= low",
        "dbcv": dbcv_sql("mean"),
        "shared_fitness_of_reals": with_(GENES, "hd as (select a.ind_id as i, b.ind_id as j, list_distance(a.r, b.r) as d from pop a join pop b on a.ind_id != b.ind_id)", "sh as (select i, sum(1 - pow(d / 2, 2)) as s from hd where d < 2 group by i)") + f"select ind_id, {r('fitness / (1 + coalesce(s, 0))')} as fitness from pop left join sh on i = ind_id",
        "near_genotypes": with_(GENES) + "select i, j, d::int as d from (select a.ind_id as i, b.ind_id as j, list_sum(list_transform(list_zip(a.g, b.g), lambda z: (z[1] != z[2])::int)) as d from pop a join pop b on a.ind_id < b.ind_id) where d <= 42",
        # one after the other in the order of fitness, with the list of those that stay
        "cleared_fitness": with_(GENES, "o as (select *, row_number() over (order by fitness desc, ind_id) as p from pop)", "hd as materialized (select a.p, b.p as q, list_sum(list_transform(list_zip(a.g, b.g), lambda z: (z[1] != z[2])::int)) as d from o a join o b on a.p < b.p)", "nb as materialized (select q as p, list(p) as before from hd where d < 44 group by q)", "st as (select 0::bigint as p, []::bigint[] as kept union all select o.p, case when list_has_any(kept, coalesce(before, [])) then kept else list_append(kept, o.p) end from st join o on o.p = st.p + 1 left join nb on nb.p = o.p)") + f"select ind_id, {r('case when list_contains((select kept from st order by p desc limit 1), p) then fitness else 0 end')} as fitness from o",
        "ranecu_draws": with_("g as (select 0::bigint as n, 12345::bigint as a, 67890::bigint as b union all select n + 1, a * 40014 % 2147483563, b * 40692 % 2147483399 from g where n <= (select max(vec_id) from embeddings))") + f"select vec_id, {r('case when a - b < 1 then a - b + 2147483562 else a - b end * 4.656613e-10')} as u from embeddings join g on n = vec_id + 1",
        "ranecu_far_draws": with_("s as (select vec_id, vec_id * 1000003000007 as n, 40014::hugeint as fa, 40692::hugeint as fb, (vec_id + 1)::hugeint as a, (2 * vec_id + 1)::hugeint as b from embeddings union all select vec_id, n // 2, fa * fa % 2147483563, fb * fb % 2147483399, case when n % 2 = 1 then a * fa % 2147483563 else a end, case when n % 2 = 1 then b * fb % 2147483399 else b end from s where n > 0)") + f"select vec_id, {r('case when a - b < 1 then a - b + 2147483562 else a - b end::double * 4.656613e-10')} as u from s where n = 0",
        "rule_confusions": judged + "select rule_id, count(*) filter (label = cls and fired) as tp, count(*) filter (label != cls and fired) as fp, count(*) filter (label = cls and not fired) as fn, count(*) filter (label != cls and not fired) as tn from fire join lab using (bag) group by rule_id",
        "rule_confusions_of_instances": with_(VEC, RULES_) + "select rule_id, count(*) filter (label = cls and fired) as tp, count(*) filter (label != cls and fired) as fp, count(*) filter (label = cls and not fired) as fn, count(*) filter (label != cls and not fired) as tn from (select rule_id, cls, label, embedding[1]::double >= b0 and embedding[2]::double <= b1 and embedding[3]::double >= b2 as fired from embeddings, rule) group by rule_id",
        "rule_confusions_of_label_sets": judged + "select rule_id, count(*) filter (list_contains(ls, cls) and fired) as tp, count(*) filter (not list_contains(ls, cls) and fired) as fp, count(*) filter (list_contains(ls, cls) and not fired) as fn, count(*) filter (not list_contains(ls, cls) and not fired) as tn from fire join (select vec_id // 5 as bag, list(label) as ls from embeddings group by 1) using (bag) group by rule_id",
        "rule_fitness": judged + ", " + CONFUSED + f"select rule_id, {r('sens')} as sensitivity, {r('spec')} as specificity, {r('case when tp + fp > 0 then tp / (tp + fp) else 0 end')} as precision, {r('case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end')} as f1, {r('(tp + tn) / (tp + fp + fn + tn)')} as accuracy, {r('sens * spec')} as fitness from rt",
        "rule_list_predictions": judged + ", " + CONFUSED.rstrip() + ", best as (select *, row_number() over (order by sens * spec desc, rule_id) as p from rt qualify p <= 7), first as (select bag, min_by(cls, p) as cls from fire join best using (rule_id, cls) where fired group by bag) select lab.bag as id, label::int as label, coalesce(cls, (select label from lab group by label order by count(*) desc, label limit 1))::int as predicted from lab left join first using (bag)",
        "tree_ends": programs + ", ends as (select ind_id, i, min(z) as e from open_ a join (select ind_id as k, j as z, s as t from open_) on k = ind_id and z > i and t = s - 1 group by all) select ind_id, list(e order by i)::int[] as ends from ends group by ind_id",
        "tree_values": programs + f"select vec_id as ind_id, {r('case vec_id % 4 when 0 then x0 + x1 * x2 when 1 then case when x0 < x1 then x0 - x2 else -(x1 + 0.5) end when 2 then (x0 + x1) * (x1 + x2) else x2 end')} as v from (select vec_id, embedding[1]::double as x0, embedding[2]::double as x1, embedding[3]::double as x2 from embeddings)",
        "tree_crossover": programs + ", e as (select ind_id, i, min(z) as e from open_ a join (select ind_id as k, j as z, s as t from open_) on k = ind_id and z > i and t = s - 1 group by all), g as (select e.*, g, n, (g in (4, 9, 10, 11))::int as ty from e join code using (ind_id, i) join size using (ind_id)), one as (select ind_id, i, e, ty, n from g where n > 1 and i = 1 + floor((ind_id * 7 % 101) / 101 * (n - 1))), two as (select one.ind_id, one.i, one.e, g.i as j, g.e as f, row_number() over (partition by one.ind_id order by g.i) - 1 as k, count(*) over (partition by one.ind_id) as c from one join g on g.ind_id = one.ind_id + 1 and g.i > 0 and g.ty = one.ty and one.n - (one.e - one.i) + g.e - g.i <= 11 and g.n - (g.e - g.i) + one.e - one.i <= 11), pick as (select * from two where k = floor((ind_id * 11 % 103) / 103 * c)) select a.ind_id, case when i is null then a.p else a.p[:i] || b.p[j + 1:f] || a.p[e + 1:] end as a, case when i is null then b.p else b.p[:j] || a.p[i + 1:e] || b.p[f + 1:] end as b from prog a join prog b on b.ind_id = a.ind_id + 1 left join pick on pick.ind_id = a.ind_id",
        "cluster_survey": with_(USER, "c as (select *, unnest(case when bag % 4 = 0 then [-1] else [-1, bag % 4 - 1] end) as cluster from inst)", "f as (select cluster, unnest(x) as v, generate_subscripts(x, 1) - 1 as dim from c)", "n as (select cluster, count(distinct bag) as bags, count(*) as instances from c group by 1)") + f"select cluster::int as cluster, bags, instances, dim::int as dim, {r('avg(v)')} as mean, {r('stddev_samp(v)')} as std from f join n using (cluster) group by all",
        "population_report": with_(GENES, "o as (select *, row_number() over (order by fitness, ind_id) as p, count(*) over () as n from pop)") + f"select arg_max(ind_id, fitness * 1000000 - ind_id) as best_id, max(fitness) as best, arg_min(ind_id, fitness * 1000000 + ind_id) as worst_id, min(fitness) as worst, max(case when p = n // 2 + 1 then ind_id end) as median_id, max(case when p = n // 2 + 1 then fitness end) as median, {r('avg(fitness)')} as mean, {r('var_pop(fitness)')} as variance from o",
        "roulette": with_(GENES, slot, "wh as (select ind_id, sum(fitness) over (order by ind_id) / sum(fitness) over () as high, fitness / sum(fitness) over () as p, max(ind_id) over () as top from pop)") + "select slot, min(ind_id) as ind_id from sl join wh on u >= high - p and (u < high or ind_id = top) group by slot",
        "tournament": with_(GENES, slot, "pl as (select *, row_number() over (order by ind_id) - 1 as p from pop), n as (select count(*) as n from pop)") + "select slot // 3 as slot, arg_max(ind_id, struct_pack(f := fitness, i := -ind_id)) as ind_id from sl, n join pl on p = floor(u * n)::bigint group by 1",
        "truncation": with_(GENES) + "select r - 1 as slot, ind_id from (select ind_id, row_number() over (order by fitness desc, ind_id) as r from pop) where r <= 100",
        "spea2_strength": with_(POINTS) + ", s as (select p.ind_id, count(d.j) as strength from pt p left join dom d on d.i = p.ind_id group by 1) select s.ind_id, s.strength, coalesce(r.raw, 0)::bigint as raw from s left join (select d.j, sum(t.strength) as raw from dom d join s t on t.ind_id = d.i group by 1) r on r.j = s.ind_id",
        "crowding": with_(POINTS, "fl as (select ind_id, (ind_id % 4)::int as front, unnest([a, b, c]) as v, unnest([0, 1, 2]) as k from pt), nb as (select *, lead(v) over w - lag(v) over w as gap, lag(v) over w is null or lead(v) over w is null as ends, max(v) over (partition by front, k) - min(v) over (partition by front, k) as span from fl window w as (partition by front, k order by v, ind_id))") + "select ind_id, front, round(sum(case when ends then 'inf'::double when span = 0 then 0 else gap / span end), 6) + 0.0 as crowding from nb group by all",
        "one_point_xover": with_(GENES, PAIRS) + f"select ind_id, list_concat(g[1:cut], h[cut + 1:]) as son from (select *, (1 + floor({one_sql(3)} * (len(g) - 2)))::int as cut from par)",
        "two_point_xover": with_(GENES, PAIRS) + f"select ind_id, list_concat(list_concat(g[1:a], h[a + 1:b]), g[b + 1:]) as son from (select *, a + floor({one_sql(8)} * (len(g) - 1 - a))::int as b from (select *, (1 + floor({one_sql(3)} * (len(g) - 3)))::int as a from par))",
        "uniform_xover": mapped_sql(f"case when {u_sql(5)} < 0.5 then h[k] else g[k] end", "par"),
        "arithmetic_xover": mapped_sql(r("r[k] * 0.8 + s[k] * 0.2"), "par"),
        "blx_alpha": mapped_sql(r(f"least(greatest(least(r[k], s[k]) - abs(r[k] - s[k]) * 0.5 + {u_sql(1)} * 2 * abs(r[k] - s[k]), 0), 1)"), "par"),
        "flat_xover": mapped_sql(r(f"least(r[k], s[k]) + {u_sql(1)} * abs(r[k] - s[k])"), "par"),
        "linear_xover": mapped_sql(r("least(greatest(r[k] * 1.5 - s[k] * 0.5, 0), 1)"), "par"),
        "wright_xover": mapped_sql(r(f"least(greatest(r[k] + {u_sql(1)} * (r[k] - s[k]), 0), 1)"), "par"),
        "uniform_mutation": mapped_sql(f"case when {u_sql(1)} < 0.3 then (floor({u_sql(77)} * 4) + (floor({u_sql(77)} * 4) >= g[k])::int)::int else g[k] end"),
        "one_locus_mutation": mapped_sql(f"case when k - 1 = floor({one_sql(4)} * len(g)) then (floor({one_sql(9)} * 4) + (floor({one_sql(9)} * 4) >= g[k])::int)::int else g[k] end"),
        "random_reset_mutation": mapped_sql(r(f"case when {u_sql(1)} < 0.2 then {u_sql(77)} else r[k] end")),
        "random_range_mutation": mapped_sql(r(f"case when {u_sql(1)} < 0.6 then least(greatest(r[k] + (2 * {u_sql(77)} - 1) * 0.5, 0), 1) else r[k] end")),
        "fuzzy_connectives": f"with i as (select l_orderkey, l_discount * 10 as x, l_tax * 10 as y from lineitem) select l_orderkey, {', '.join(conn)} from i group by 1",
        "weights_boltzmann": weighted("exp(fitness / 100)"),
        "weights_disruptive": weighted("abs(fitness - m)"),
        "weights_linear_rank": weighted("0.9 + 0.2 * k / greatest(n - 1, 1)"),
        "weights_nonlinear_rank": weighted("0.3 * pow(0.7::double, k)"),
        "weights_sigma": weighted("case when s = 0 then 1 else greatest(1 + (fitness - m) / (2 * s), 0) end"),
    }
    digit = lambda k, v=u_sql(77): f"({v} * 1048576.0::double * {2 * k + 3} * 0.6180339887498949::double - floor({v} * 1048576.0::double * {2 * k + 3} * 0.6180339887498949::double))"
    side = f"(case when {digit(99)} < 0.5 then 1.0 else -1.0 end)::double"
    gamma = lambda n: " + ".join(f"case when {digit(k)} < 0.0625 then {2.0**-k!r}::double else 0 end" for k in range(n + 1))
    stepped = lambda n, p: mapped_sql(r(f"case when {u_sql(1)} < {p} then least(greatest(r[k] + {side} * 0.1::double * ({gamma(n)}), 0), 1) else r[k] end"))
    triangles = []
    for n in range(17):
        middle, below, above = 2.0**-n, (2.0**-n - 2.0 ** -(n + 1)) / 2, (2.0 ** (1 - n) - 2.0**-n) / 2
        t = digit(200 + n)
        low_step = f"{middle - below!r}::double + sqrt({t} * {below * (below + above)!r}::double)"
        high_step = f"{middle + above!r}::double - sqrt((1 - {t}) * {above * (below + above)!r}::double)"
        triangles.append(f"case when {digit(n)} < 0.0625 then case when {t} < {below / (below + above)!r}::double then {low_step} else {high_step} end else 0 end")
    part = f"(1 - pow(greatest({digit(1)}, 1e-300), {0.7**5!r}::double))"
    other = f"(floor({u_sql(77)} * 4) + (floor({u_sql(77)} * 4) >= g[k])::int)::int"
    ordered = lambda label, source="pop", of="g": with_(GENES, PAIRS, f"lb as (select ind_id, k, {label} as x from {source}, (select unnest(range(1, 65)) as k))", "cn as (select ind_id, x, row_number() over (partition by ind_id order by count(*) desc, x) - 1 as y from lb group by ind_id, x)") + "select ind_id, list(y::int order by k) as son from lb join cn using (ind_id, x) group by ind_id"
    top = "(list_max(g) + 1)"
    by_label = lambda n, c: f"((ind_id * 7919 + ({c}) * 104729 + {n}) % 1000) / 1000.0::double"
    perms = "pm as (select a, b, c from (select unnest([0, 1, 2]) as a), (select unnest([0, 1, 2]) as b), (select unnest([0, 1, 2]) as c) where a != b and b != c and a != c), sc as (select a, b, c, sum(n) as hits from pm, cell where class = case cluster when 0 then a when 1 then b else c end group by all), mp as (select * from sc order by hits desc, a, b, c limit 1), hit as (select cluster, class, n, case cluster when 0 then a when 1 then b else c end as said from cell, mp)"
    partly = with_(VEC, "pt as (select case when bag % 10 = 0 then -1 else bag % 3 end as cluster, label from lab)")
    out |= {
        "mikmeans_one_iteration": with_(VEC, FLAT, f"first as (select case bag when {MEDOIDS[0]} then 0 else 1 end as cluster, list(v order by dim) as c from (select bag, dim, avg(v) as v from flat where bag in ({MEDOIDS[0]}, {MEDOIDS[1]}) group by all) group by 1)", "asg as (select bag, cluster from (select *, row_number() over (partition by bag order by d, cluster) as r from (select i.bag, f.cluster, max(list_distance(i.x, f.c)) as d from inst i, first f group by all)) where r = 1)", "cen as (select cluster, list(v order by dim) as c from (select a.cluster, dim, avg(v) as v from flat f join asg a using (bag) group by all) group by cluster)", moved) + f"select bag as bag_idx, cluster::int as cluster, {r('d')} as d from fin",
        "one_step_repaired": out["one_step_kmeans"],
        "imputed": with_(USER, flat2) + f"select bag as bag_idx, ord, list({r('case when ord % 5 = dim then m else v end')} order by dim) as x from (select *, avg(case when ord % 5 != dim then v end) over (partition by dim) as m from flat) group by bag, ord",
        "mapped_accuracy": cells + f", {perms} select {r('sum((class = said)::int * n) / sum(n)')} as accuracy, {r('100 * (1 - sum((class = said)::int * n) / sum(n))')} as error_rate from hit",
        "class_metrics": cells + f", {perms}, k as (select unnest([0, 1, 2]) as class), q as (select k.class, sum((said = k.class and hit.class = k.class)::int * n) as tp, sum((said = k.class and hit.class != k.class)::int * n) as fp, sum((said != k.class and hit.class = k.class)::int * n) as fn, sum((said != k.class and hit.class != k.class)::int * n) as tn from k, hit group by 1) select class::int as class, {r('coalesce(tp / nullif(tp + fp, 0), 0)')} as precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)')} as recall, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} as f1, {r('coalesce(tn / nullif(tn + fp, 0), 0)')} as specificity from q",
        "real_clusters": partly + "select count(distinct cluster) filter (where cluster >= 0) as clusters, count(distinct label) as classes, count(*) filter (where cluster < 0) as unassigned from pt",
        "class_sizes": partly + "select label as class, count(*) as n, count(*) filter (where cluster >= 0) as assigned from pt group by 1",
        "best_and_worst_together": with_(GENES, "pk as (select g, ind_id, fitness from (select *, row_number() over (order by fitness desc, ind_id) as a, row_number() over (order by fitness, ind_id) as b from pop) where a <= 50 or b <= 70)") + "select min(ind_id) as ind_id, arg_min(fitness, ind_id) as fitness from pk group by g",
        "population_difference": with_(GENES) + "select ind_id, fitness from pop where ind_id % 3 != 0",
        "worst_first": with_(GENES) + "select r - 1 as slot, ind_id from (select ind_id, row_number() over (order by fitness, ind_id) as r from pop) where r <= 100",
        "random_selection": with_(GENES, slot, "pl as (select ind_id, row_number() over (order by ind_id) - 1 as p, count(*) over () as n from pop)") + "select slot, ind_id from sl join pl on p = floor(u * n)::bigint",
        "euclidean_pairs": with_(GENES) + f"select a.ind_id as i, b.ind_id as j, {r('list_distance(a.r, b.r)')} as d from pop a join pop b on a.ind_id < b.ind_id",
        "shared_fitness": with_(GENES, "hd as (select a.ind_id as i, b.ind_id as j, list_sum(list_transform(list_zip(a.g, b.g), lambda z: (z[1] != z[2])::int)) as d from pop a join pop b on a.ind_id != b.ind_id)", "sh as (select i, sum(1 - d / 40.0::double) as s from hd where d < 40 group by i)") + f"select ind_id, {r('fitness / (1 + coalesce(s, 0))')} as fitness from pop left join sh on i = ind_id",
        "spea2_fitness": with_(POINTS) + ", s as (select p.ind_id, count(d.j) as strength from pt p left join dom d on d.i = p.ind_id group by 1), rw as (select d.j, sum(t.strength) as raw from dom d join s t on t.ind_id = d.i group by 1), nr as (select p.ind_id, list_distance([p.a, p.b, p.c], [q.a, q.b, q.c]) as d, row_number() over (partition by p.ind_id order by list_distance([p.a, p.b, p.c], [q.a, q.b, q.c]), q.ind_id) as r from pt p join pt q on p.ind_id != q.ind_id), f as (select s.ind_id, s.strength, coalesce(rw.raw, 0)::bigint as raw, coalesce(1 / (nr.d + 2), 0.5) as density from s left join rw on rw.j = s.ind_id left join nr on nr.ind_id = s.ind_id and nr.r = 3) " + f"select ind_id, strength, raw, {r('density')} as density, {r('raw + density')} as fitness from f",
        "spea2_archive": with_(POINTS) + ", s as (select p.ind_id, count(d.j) as strength from pt p left join dom d on d.i = p.ind_id group by 1), rw as (select d.j, sum(t.strength) as raw from dom d join s t on t.ind_id = d.i group by 1), nr as (select p.ind_id, list_distance([p.a, p.b, p.c], [q.a, q.b, q.c]) as d, row_number() over (partition by p.ind_id order by list_distance([p.a, p.b, p.c], [q.a, q.b, q.c]), q.ind_id) as r from pt p join pt q on p.ind_id != q.ind_id), f as (select s.ind_id, s.strength, coalesce(rw.raw, 0)::bigint as raw, coalesce(1 / (nr.d + 2), 0.5) as density from s left join rw on rw.j = s.ind_id left join nr on nr.ind_id = s.ind_id and nr.r = 3) " + f"select ind_id, {r('raw + density')} as fitness from f order by raw > 0, raw + density, ind_id limit 60",
        "pareto_front": with_(POINTS, "lv as (select ind_id, 0 as level from pt union select d.j, lv.level + 1 from lv join dom d on d.i = lv.ind_id)") + "select ind_id, max(level)::int as front from lv group by 1",
        "half_uniform_xover": mapped_sql(f"case when {u_sql(5)} < 0.5 then g[k] else h[k] end", "par"),
        "discrete_xover": mapped_sql(r(f"case when {u_sql(5)} < 0.3 then r[k] else s[k] end"), "par"),
        "linear_xover_all": with_(GENES, PAIRS) + "select ind_id, " + ", ".join(f"list_transform(range(1, len(g) + 1), lambda k: {r(f'least(greatest(r[k] * {a} + s[k] * {b}, 0), 1)')}) as son{i}" for i, (a, b) in enumerate(((0.5, 0.5), (1.5, -0.5), (-0.5, 1.5)))) + " from par",
        "several_loci_mutation": with_(GENES, f"us as (select *, list_sort(list_transform(range(1, len(g) + 1), lambda k: {u_sql(1)}))[7] as bar from pop)") + f"select ind_id, list_transform(range(1, len(g) + 1), lambda k: case when {u_sql(1)} <= bar then {other} else g[k] end) as son from us",
        "muhlenbein_mutation": stepped(15, 0.4),
        "modal_discrete_mutation": stepped(16, 0.4),
        "modal_continuous_mutation": mapped_sql(r(f"case when {u_sql(1)} < 0.6 then least(greatest(r[k] + {side} * 0.1::double * ({' + '.join(triangles)}), 0), 1) else r[k] end")),
        "non_uniform_mutation": mapped_sql(r(f"case when {u_sql(1)} < 0.4 then least(greatest(case when {digit(99)} < 0.5 then r[k] - r[k] * {part} else r[k] + (1 - r[k]) * {part} end, 0), 1) else r[k] end")),
        "mixed_non_uniform_mutation": with_(GENES, f"m as (select ind_id, k, case when {u_sql(1)} < 0.4 then case when {digit(99)} < 0.5 then r[k] - r[k] * {part} else r[k] + (case when k in (11, 12) then 4 else 1 end - r[k]) * {part} end end as y, r[k] as x from pop, (select unnest(range(1, 65)) as k))") + f"select ind_id, list({r('case when y is null then x when k <= 10 then y else round(y) end')} order by k) as son from m group by ind_id",
        "medoid_pair_mutation": with_(GENES, f"m as (select ind_id, list_transform(range(1, len(g) + 1), lambda k: case when {u_sql(1)} < 0.3 then {other} else g[k] end) as m from pop)") + "select ind_id, list_transform(range(1, len(m) + 1), lambda k: (case when k = 2 and m[2] = m[1] then case when m[2] + 1 < 5 then m[2] + 1 else greatest(m[2] - 1, 0) end else m[k] end)::int) as son from m",
        "relabel_genotype": ordered("g[k]"),
        "merge_mutation": ordered(f"case when g[k] <= 0 then g[k] else len(list_filter(range(1, g[k] + 1), lambda c: not ({by_label(1, 'c')} < 0.5 and {top} - c >= 2))) end"),
        "split_mutation": with_(GENES, f"m as (select ind_id, k, g[k] as x, {top} + len(list_filter(range(0, g[k]), lambda c: {by_label(1, 'c')} < 0.5)) as new, {by_label(1, 'g[k]')} < 0.5 and {u_sql(77)} < 0.5 as go from pop, (select unnest(range(1, 65)) as k))") + "select ind_id, list((case when go and new < 7 then new else x end)::int order by k) as son from m group by ind_id",
        "reclassify_mutation": ordered(f"case when list_contains(st, g[k]) then g[k] else st[1 + floor({u_sql(77)} * len(st))::int] end", f"(select *, list_filter(range(0, {top}), lambda c: {by_label(1, 'c')} >= 0.5 or c < 2) as st from pop)"),
        "implant_xover": ordered(f"case when h[k] < {top} and {by_label(1, 'h[k]')} < 0.5 then h[k] when {by_label(1, 'g[k]')} < 0.5 and {u_sql(5)} < 0.5 then floor({u_sql(77)} * {top}) else g[k] end::int", "par"),
        "best_cut_points": with_(USER, flat2, stats, "tr as (select dim, k, low, high, n, (high - low) / k as w, least(greatest(ceil((v - low) / ((high - low) / k)), 1), k) as slot from flat join st using (dim), (select unnest(range(1, 11)) as k) where high > low)", "ct as (select dim, k, low, high, w, slot, count(*) as c from tr group by all)", "ls as (select dim, k, low, high, sum(case when c < 2 then 'inf'::double else -c * ln((c - 1) / w) end) as loss from ct group by all)", "bs as (select *, row_number() over (partition by dim order by loss, k) as r from ls)") + f"select dim::int as dim, {rl('list_transform(range(1, k), lambda j: low + (high - low) * j / k)')} as cuts from bs where r = 1",
        "interval_closures": "select l_orderkey, sum((l_quantity >= 10 and l_quantity <= 20)::int)::bigint as closed_closed, sum((l_quantity >= 10 and l_quantity < 20)::int)::bigint as closed_open, sum((l_quantity > 10 and l_quantity <= 20)::int)::bigint as open_closed, sum((l_quantity > 10 and l_quantity < 20)::int)::bigint as open_open from lineitem group by 1",
        "population_ftwcv": "with f as (" + " union all ".join(f"select {t}::bigint as ind_id, ftwcv as f from ({out['ftwcv'].replace('% 3', f'% {t}')})" for t in RULES) + ") select ind_id, round(case when ind_id >= 4 then 1.5 * max(f) over () - f else min(f) over () end, 6) + 0.0 as ftwcv from f",
    }
    for name in RATED:
        value = name.removeprefix("population_")
        # the SQL of one assignment, with its number of clusters (3, and 6 ordered pairs) replaced
        each = [out[value].replace("% 3", f"% {t}").replace("/ 3", f"/ {t}").replace("/ 6", f"/ {t * (t - 1)}") for t in RULES]
        out[name] = " union all ".join(f"select {t}::bigint as ind_id, {value} from ({sql})" for t, sql in zip(RULES, each, strict=True))
    out["population_dbcv"] = " union all ".join(f"select {t}::bigint as ind_id, dbcv from ({dbcv_sql('maxmin').replace('% 3', f'% {t}')})" for t in RULES)
    whole = [out[k] for k in ("rmsstd", "silhouette", "xie_beni", "davies_bouldin", "s_dbw", "twcv", "ftwcv")] + [dbcv_sql("maxmin")]
    out["full_evaluation"] = "select * from " + " cross join ".join(f"({sql})" for sql in whole)
    exact = out["class_metrics"].replace("round(", "(").replace(", 6) + 0.0", ") + 0.0")
    out["class_macros"] = "select " + ", ".join(f"{r(f'sum({c} * n) / sum(n)')} as {c}" for c in ("precision", "recall", "f1", "specificity")) + f" from ({exact}) join (select label % 3 as class, count(*) as n from (select vec_id // 5 as bag, arg_min(label, vec_id) as label from embeddings group by 1) group by 1) using (class)"
    return out
