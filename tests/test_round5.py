"""Steps that grew faster than their input: silhouettes of populations and of changed labels, draws by locus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.functions import kernels
from satchel.operators import evoclusters as ec
from satchel.operators import indices, joins, silhouettes


def bags_of(seed, n, d=3, most=4, spread=3.0):
    g = np.random.Generator(np.random.PCG64(seed))
    rows = [(i * 2, (g.normal(0, 1, (int(g.integers(1, most + 1)), d)) + g.uniform(0, spread, d)).tolist()) for i in range(n)]
    return [*rows, (2 * n, rows[0][1]), (2 * n + 2, rows[0][1])]  # copies


def table(spark, rows):
    return spark.createDataFrame(rows, "bag_idx long, bag array<array<double>>").repartition(3)


def of(rows):
    return kernels.sheets([np.asarray(b).ravel() for _, b in rows], [len(b) for _, b in rows])


@pytest.mark.parametrize("kind", list(kernels.HAUSDORFF))
def test_both_ways_equal_the_distances(monkeypatch, kind):
    monkeypatch.setattr(kernels, "TILE", 12)
    a, b = bags_of(1, 30), bags_of(2, 25)
    for x, y in ((a, b), (a, a), ([(0, [[np.inf, 0.0, 1.0]]), *a], b)):
        with np.errstate(all="ignore"):
            to, back = kernels.both_ways(kind, of(x), of(y))
            for i, (_, p) in enumerate(x):
                for j, (_, q) in enumerate(y):
                    assert to[i, j] == pytest.approx(kernels.distance(kind, p, q), rel=1e-9, abs=1e-12, nan_ok=True)
                    assert back[i, j] == pytest.approx(kernels.distance(kind, q, p), rel=1e-9, abs=1e-12, nan_ok=True)


LABELS = {1: lambda i: i % 3, 2: lambda i: 0, 3: lambda i: -1 if i % 5 == 0 else i % 2, 4: lambda i: 2 if i == 7 else 0, 5: lambda i: 0 if i == 3 else -1}


@pytest.mark.parametrize("distance", ["maxmin", "mean"])
def test_silhouettes_equal_those_of_the_pair_table(spark, monkeypatch, distance):
    monkeypatch.setattr(joins, "BLOCK", 16)
    rows = bags_of(3, 40)
    bags = table(spark, rows)
    labels = spark.createDataFrame([(k, b, f(i)) for k, f in LABELS.items() for i, (b, _) in enumerate(rows)], "ind_id long, bag_idx long, cluster int")
    want = {r.ind_id: r.silhouette for r in indices.silhouette(joins.pair_table(bags, None, distance), labels, ("ind_id",)).collect()}
    sums = silhouettes.cluster_sums(bags, labels, distance, 16)
    got = {r.ind_id: r.silhouette for r in silhouettes.silhouettes(bags, labels, distance, sums).collect()}
    assert set(got) == set(want) and got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_changed_labels_equal_whole_silhouettes(spark):
    rows = bags_of(4, 20)
    bags = table(spark, rows)
    given = {k: [LABELS[k](i) for i in range(len(rows))] for k in (1, 2, 3, 4)}
    labels = spark.createDataFrame([(k, b, c) for k, g in given.items() for (b, _), c in zip(rows, g, strict=True)], "ind_id long, bag_idx long, cluster int")
    places = [0, 3, 5, 7, 21]
    loci = spark.createDataFrame([(k, rows[i][0]) for k in given for i in places], "ind_id long, bag_idx long")
    got = {(r.ind_id, r.bag_idx, r.label): r.silhouette for r in silhouettes.changed(bags, labels, loci, 3, block=8).collect()}
    options = [(k, i, c) for k in given for i in places for c in range(3)]
    every = [(n, rows[j][0], c if j == i else x) for n, (k, i, c) in enumerate(options) for j, x in enumerate(given[k])]
    whole = spark.createDataFrame(every, "ind_id long, bag_idx long, cluster int")
    want = {(k, rows[i][0], c): r for (k, i, c), r in zip(options, [x.silhouette for x in indices.silhouette(joins.pair_table(bags), whole, ("ind_id",)).orderBy("ind_id").collect()], strict=True)}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_guided_mutation_makes_no_genotype_per_option(spark, monkeypatch):
    rows = table(spark, bags_of(5, 30))
    space = ec.Space(rows, 2)
    pop = spark.createDataFrame([(k, [(i * k) % 2 for i in range(32)], None) for k in (1, 3)], "ind_id long, genotype array<int>, fitness double")
    monkeypatch.setattr(ec.Space, "rated", None)  # rating every changed genotype would need it
    monkeypatch.setattr(ec, "pair_table", None)
    assert {len(r.genotype) for r in space.guided_mutation(pop, "silhouette", 5, 0.5).collect()} == {32}


def test_label_mutations_of_long_genotypes(spark):
    from satchel.functions.columns import draw_array
    from satchel.operators import variation as V

    n = F.lit(20_000)  # minutes, if draws were made for every locus
    g = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i % 4).cast("int"))
    us, vs, ws = draw_array(1, F.lit(5), F.col("id")), draw_array(2, n, F.col("id")), draw_array(3, n, F.col("id"))
    row = spark.range(1).select(V.merged(g, us, 0.5).alias("m"), V.split(g, us, vs, 0.5, 8).alias("s"), V.reclassified(g, us, vs, 0.5).alias("r"), V.implanted(g, F.reverse(g), us, vs, ws, 0.5, 0.5).alias("i")).first()
    assert all(len(x) == 20_000 for x in row)


@pytest.mark.parametrize("expand_all", [False, True])
def test_density_clusters_of_blocks_equal_those_of_pairs(spark, monkeypatch, expand_all):
    from satchel.operators import clusterers, spatial

    monkeypatch.setattr(spatial, "BLOCK", 8)
    rows = table(spark, bags_of(6, 45, 2, 2, 6.0))
    got = {}
    for pruned in (True, False):
        if not pruned:
            monkeypatch.setattr(spatial, "BOUNDED", ())  # all pairs as rows
        made = clusterers.OPTICS(0.8, 4, compat_expand_all=expand_all)
        got[pruned] = [sorted(map(repr, f.collect())) for f in (clusterers.DBSCAN(0.8, 4).fit(rows), made.fit(rows), made.core_distances(rows), joins.range_counts(rows, rows, 0.8))]
    assert got[True] == got[False]


def test_medoids_without_comparing_members(spark, monkeypatch):
    from satchel.operators import centres

    odd = [(0, [[float("nan"), 1.0]]), (1, [[0.0, 0.0], [1.0, 0.0]]), (2, [[1.0, 1.0]]), (3, [[2.0, float("nan")]]), (4, [[float("nan"), float("nan")]])]
    rule = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "bag_idx long, cluster int")
    assert {r.cluster: r.bag_idx for r in centres.medoids(table(spark, odd), rule).collect()} == {0: 1, 1: 3}
    monkeypatch.setattr(centres, "_to_own_cluster", None)
    assert [(r.cluster, r.bag_idx, r.d) for r in centres.medoids(table(spark, odd), rule.where("cluster = 0")).collect()] == [(0, 1, 0.0)]


def test_rules_in_blocks_equal_rules_one_by_one(spark, monkeypatch):
    from satchel.operators import rules

    monkeypatch.setattr(rules, "MOST", 5)
    monkeypatch.setattr(rules, "ROWS", 7)
    g = np.random.Generator(np.random.PCG64(8))
    nan = float("nan")
    rows = [(i, None if i == 9 else i % 3, [[float(v) for v in np.round(g.normal(0, 1, 2 + (i + k) % 2), 1)] for k in range(i % 4)]) for i in range(30)] + [(30, 1, [[nan, 0.0]])]
    made = [(k, [(int(g.integers(0, 3)), int(g.choice([-1, 1])), float(np.round(g.normal(0, 1), 1))) for _ in range(k % 3)], None if k == 4 else k % 3) for k in range(12)] + [(12, [(0, 1, nan)], 1)]
    table = spark.createDataFrame(rows, "id long, label int, instances array<array<double>>")
    judged = spark.createDataFrame(made, rules.RULE)
    each = table.where("label is not null").crossJoin(judged).withColumn("fired", F.exists("instances", lambda x: F.forall("conditions", lambda c: F.coalesce(c["sign"] * F.get(x, c["dim"]) >= c["sign"] * c["bound"], F.lit(False)))))
    mine, fired = F.col("label") == F.col("cls"), F.col("fired")
    want = each.groupBy("rule_id").agg(F.count_if(mine & fired), F.count_if(~mine & fired), F.count_if(mine & ~fired), F.count_if(~mine & ~fired))
    assert sorted(map(tuple, rules.confusions(table, judged).collect())) == sorted(map(tuple, want.collect()))
