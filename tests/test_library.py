"""The library on hand-sized bags with known answers, edge cases and properties."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.functions import columns as C
from satchel.functions import kernels
from satchel.operators import centres, clusterers, evolution, external, indices, joins, multiobjective, niches, population, programs, transforms, variation
from satchel.plans import catalog
from satchel.sources import files, views

TOY = [(0, [[0.0, 0.0], [0.0, 2.0]], 0), (1, [[3.0, 4.0]], 1), (2, [[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]], 1)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "bag_idx long, bag array<array<double>>, label int")


@pytest.fixture(scope="module")
def blobs(spark):
    g = np.random.Generator(np.random.PCG64(1))
    rows = [(i, (g.normal(0, 0.3, (int(g.integers(1, 5)), 2)) + [10 * (i % 3), 0]).tolist(), i % 3) for i in range(30)]
    return spark.createDataFrame(rows, "bag_idx long, bag array<array<double>>, label int")


def test_hausdorff_golden():
    a, b = TOY[0][1], TOY[2][1]
    far = (0 + 13**0.5 + 72**0.5) / 3
    want = {"maxmin": (2, 72**0.5), "minmin": (0, 0), "meanmin": (1, far), "mean": (4.848472, 4.848472)}
    for kind, (x, y) in want.items():
        assert kernels.distance(kind, a, b) == pytest.approx(x, abs=1e-6)
        assert kernels.distance(kind, b, a) == pytest.approx(y, abs=1e-6)


def test_expressions_agree_with_kernels(toy):
    pairs = toy.select(F.col("bag_idx").alias("i"), F.col("bag").alias("x")).join(toy.select(F.col("bag_idx").alias("j"), F.col("bag").alias("y")), F.col("i") != F.col("j"))
    bags = {i: b for i, b, _ in TOY}
    for kind in kernels.HAUSDORFF:
        for r in pairs.select("i", "j", C.hausdorff(kind, F.col("x"), F.col("y")).alias("d")).collect():
            assert r.d == pytest.approx(kernels.distance(kind, bags[r.i], bags[r.j]))


def test_transport_is_optimal():
    g = np.random.Generator(np.random.PCG64(2))
    for n in (1, 2, 4, 5):
        cost = g.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
        assert kernels.transport(cost) == pytest.approx(best)
    cost = g.random((2, 3))  # equal masses: each row gives 3 units, each column takes 2
    wide = np.repeat(np.repeat(cost, 3, 0), 2, 1)
    best = min(sum(wide[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6))) / 6
    assert kernels.transport(cost) == pytest.approx(best)


def test_distance_properties():
    g = np.random.Generator(np.random.PCG64(3))
    for _ in range(20):
        a, b = g.random((4, 3)), g.random((6, 3))
        d = {k: kernels.distance(k, a, b) for k in kernels.NAMES}
        assert d["minmin"] <= d["meanmin"] <= d["maxmin"] and kernels.distance("maxmin", a, a) == 0
        assert kernels.distance("maxmin", a[::-1], b) == pytest.approx(d["maxmin"])
        assert d["earth_movers"] >= d["minmin"] - 1e-12 and d["mahalanobis"] >= 0
    assert kernels.distance("mahalanobis", [[1.0, 2.0]], [[1.0, 2.0]]) == 0


@pytest.mark.parametrize("block", [2, 256])
def test_joins(toy, blobs, block):
    found = {(r.i, r.j): r.d for r in joins.pair_table(toy, None, "maxmin", block=block).collect()}
    assert len(found) == 6 and found[0, 2] == 2 and found[2, 0] == pytest.approx(72**0.5)
    mirrored = {(r.i, r.j): r.d for r in joins.pair_table(toy, None, "maxmin", True, block).collect()}
    assert mirrored[2, 0] == mirrored[0, 2] == 2
    near = joins.range_join(blobs, blobs, 2.0, block=block).collect()
    assert {(r.i, r.j) for r in near} == {(i, j) for i in range(30) for j in range(30) if i % 3 == j % 3}
    assert joins.nearest_join(blobs, blobs, 4, block=block).groupBy("i").count().where("count = 4").count() == 30
    assert joins.pair_table(toy.limit(0), None).count() == 0


def test_clusterers_find_blobs(blobs):
    truth = {r.bag_idx: r.label for r in blobs.collect()}

    def same(found):
        parts = {}
        for r in found.collect():
            parts.setdefault(r.cluster, set()).add(truth[r.bag_idx])
        return len(parts) == 3 and all(len(p) == 1 for p in parts.values())

    assert same(clusterers.KMeans(3, start=[0, 1, 2]).fit(blobs))
    assert same(clusterers.KMedoids(3, start=[0, 1, 2]).fit(blobs))
    assert same(clusterers.DBSCAN(2.0, 3).fit(blobs))
    assert same(clusterers.LikeClass().fit(blobs))
    order = clusterers.OPTICS(2.0, 3).fit(blobs).orderBy("ord").collect()
    assert len(order) == 30 and sum(r.reach is None for r in order) == 3
    noise = clusterers.DBSCAN(0.0001, 5).fit(blobs)
    assert {r.cluster for r in noise.collect()} == {-2}


def test_empty_cluster_is_repaired(blobs):
    model = clusterers.KMeans(3, start=[0, 3, 6])
    assert {r.cluster for r in model.fit(blobs).collect()} == {0, 1, 2}
    assert clusterers.initial_bags(blobs, 5).count() == 5


def test_indices_prefer_the_true_partition(blobs):
    good = blobs.select("bag_idx", F.col("label").alias("cluster"))
    bad = blobs.select("bag_idx", (F.col("bag_idx") % 2).cast("int").alias("cluster"))
    a, b = indices.full_evaluation(blobs, good), indices.full_evaluation(blobs, bad)
    for name, up in (("silhouette", 1), ("dbcv", 1), ("rmsstd", -1), ("xie_beni", -1), ("davies_bouldin", -1), ("twcv", -1), ("s_dbw", -1)):
        assert up * a[name] > up * b[name], name
    noise = blobs.select("bag_idx", F.lit(-2).alias("cluster"))
    assert indices.silhouette(joins.pair_table(blobs), noise).first()[0] == -1


def test_external_golden(spark):
    cells = spark.createDataFrame([(0, 0, 32), (0, 1, 31), (1, 0, 13), (1, 1, 16)], "cluster int, class int, n long")
    assert external.entropy(cells).first()[0] == pytest.approx(0.9974378487105109)
    assert external.purity(cells).first()[0] == pytest.approx(0.5217391304347826)
    assert external.mapped_accuracy(cells) == pytest.approx(0.5217391304347826)
    assert external.error_rate(cells) == pytest.approx(47.82608695652174)
    got = {r["class"]: r for r in external.per_class(cells).collect()}
    for k, want in {0: (0.5079365079365079, 0.7111111111111111, 0.5925925925925924, 0.3404255319148936), 1: (0.5517241379310345, 0.3404255319148936, 0.4210526315789473, 0.7111111111111111)}.items():
        assert [got[k][m] for m in ("precision", "recall", "f1", "specificity")] == pytest.approx(list(want))
    assert external.macro(external.per_class(cells), "f1") == pytest.approx(0.4210526315789473)
    assert "32" in external.render(cells)


def test_mapping_by_both_ways():
    g = np.random.Generator(np.random.PCG64(4))
    for _ in range(20):
        cells = {(c, k): int(n) for c in range(4) for k in range(5) if (n := g.integers(0, 9))}
        clusters, classes = sorted({c for c, _ in cells}), sorted({k for _, k in cells})
        a, b = external.mapping(cells), external._assigned(clusters, classes, cells)
        assert sum(cells.get(x, 0) for x in a.items()) == sum(cells.get(x, 0) for x in b.items())


def test_transforms_edges(spark):
    rows = spark.createDataFrame([(0, 0, [1.0, 5.0], 1), (0, 1, [2.0, 5.0], 1), (1, 0, [None, 5.0], 0)], "bag_idx long, ord long, x array<double>, label int")
    full = transforms.imputed(rows)
    assert [r.x[0] for r in full.orderBy("bag_idx", "ord").collect()] == [1.0, 2.0, 1.5]
    for kind in ("z1", "z5"):
        assert {r.x[1] for r in transforms.standardised(full, kind).collect()} == {0.0}
    cuts = transforms.cut_points(full, 2)
    assert {tuple(r.x) for r in transforms.discretised(full, cuts).collect()} == {("B1", "All"), ("B2", "All")}
    assert transforms.best_cut_points(full).count() == 2
    with pytest.raises(ValueError):
        transforms.union_of_datasets([spark.createDataFrame([(0, [[1.0]], 1)], "bag_idx long, bag array<array<double>>, label int"), spark.createDataFrame(TOY, "bag_idx long, bag array<array<double>>, label int")])


def test_variation_keeps_domains(spark):
    pop = population.integers(spark, 50, 12, 0, 4, 3).select("ind_id", F.col("genotype").alias("g"))
    n = F.lit(12)
    us, vs, ws = (C.draw_array(s, n, F.col("ind_id")) for s in (1, 2, 3))
    sons = {
        "several": variation.several_loci(F.col("g"), us, vs, 3, 0, 4), "medoid": variation.medoid_pair(F.col("g"), us, vs, 0, 9, 0.5),
        "merged": variation.merged(F.col("g"), us, 0.5), "split": variation.split(F.col("g"), us, vs, 0.5, 6),
        "reclassified": variation.reclassified(F.col("g"), us, vs, 0.5), "implanted": variation.implanted(F.col("g"), F.reverse("g"), us, vs, ws, 0.5, 0.5),
        "ordered": variation.ordered_labels(F.col("g")),
    }
    for r in pop.select("g", *(e.alias(k) for k, e in sons.items())).collect():
        assert sum(a != b for a, b in zip(r.g, r.several, strict=True)) == 3
        assert r.medoid[0] != r.medoid[1]
        for k in ("merged", "reclassified", "implanted", "ordered"):
            assert set(r[k]) == set(range(max(r[k]) + 1)), k
        assert max(r.split) < 6 and len(set(r.merged)) >= min(2, len(set(r.g)))
    real = population.reals(spark, 40, 12, 0.0, 1.0, 5).select("ind_id", F.col("genotype").alias("g"))
    made = [variation.muhlenbein(F.col("g"), us, vs, 0.0, 1.0, p=0.9), variation.geometric(F.col("g"), us, vs, 0.0, 1.0, p=0.9), variation.modal_continuous(F.col("g"), us, vs, 0.0, 1.0), variation.non_uniform(F.col("g"), us, vs, 0.0, 1.0, 3, 10, p=0.9)]
    for r in real.select("g", *(m.alias(f"m{i}") for i, m in enumerate(made))).collect():
        for i in range(4):
            assert all(0 <= v <= 1 for v in r[f"m{i}"])


def test_selectors(spark):
    pop = spark.createDataFrame([(i, [i], float(i)) for i in range(10)], "ind_id long, genotype array<int>, fitness double")
    copies = population.remainder(population.weights(pop), 45, 3).collect()
    assert all(abs(r.copies - r.ind_id) <= 1 for r in copies)
    assert population.universal(population.weights(pop), 45, 0.5).count() == 45
    flat = pop.withColumn("fitness", F.lit(0.0))
    assert population.spun(population.weights(flat), population.slots(spark, 30)).count() == 30
    assert {r.ind_id for r in population.ordered(pop, 3, maximise=False).collect()} == {0, 1, 2}
    assert population.united(pop, pop).count() == 10 and population.without(pop, pop.limit(4)).count() == 6
    assert population.labelled(spark, 5, 6, 2, 4).count() == 5


def test_algorithms_improve(spark):
    evaluate = lambda pop: pop.withColumn("fitness", F.aggregate("genotype", F.lit(0.0), lambda s, v: s + v))
    problem = evolution.integer_problem(16, 0, 2, evaluate)
    for name in ("SG", "SGE", "SS", "G3", "MGG"):
        report = evolution.Report()
        first = problem.evaluate(problem.create(spark, 12, 1)).agg(F.max("fitness")).first()[0]
        last = evolution.run(spark, problem, name, 12, 3, report=report)
        assert last.count() == 12 and len(report.generations) == 3
        if name != "SG":
            assert last.agg(F.max("fitness")).first()[0] >= first
    assert evolution.chc(spark, problem, 16, 12, 3).count() == 12


def test_multiobjective(spark):
    pts = spark.createDataFrame([(0, [3.0, 1.0]), (1, [1.0, 3.0]), (2, [2.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "ind_id long, objectives array<double>")
    assert {r.ind_id: r.front for r in multiobjective.fronts(pts).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}
    d = multiobjective.spea2(pts, 2).collect()
    assert {r.ind_id for r in d if r.raw == 0} == {0, 1, 2}
    flat = spark.createDataFrame([(0, 5.0), (1, 4.0), (2, 3.0)], "ind_id long, fitness double")
    dist = spark.createDataFrame([(0, 1, 0.1), (0, 2, 9.0), (1, 2, 9.0)], "i long, j long, d double")
    assert {r.ind_id: r.fitness for r in niches.cleared_by(flat, dist, 1.0).collect()} == {0: 5.0, 1: 0.0, 2: 3.0}
    shared = {r.ind_id: r.fitness for r in multiobjective.shared_fitness(flat, dist, 1.0).collect()}
    assert shared[2] == 3.0 and shared[0] == pytest.approx(5 / 1.9)
    evaluate = lambda pop: pop.withColumn("objectives", F.array(F.aggregate("genotype", F.lit(0.0), lambda s, v: s + v), -F.element_at("genotype", 1).cast("double")))
    problem = evolution.integer_problem(6, 0, 3, evaluate)
    assert evolution.nsga2(spark, problem, 8, 1).count() == 8
    assert evolution.spea2(spark, problem, 8, 4, 1).count() == 4


def test_truncation_by_neighbours(spark):
    g = np.random.Generator(np.random.PCG64(7))
    x = {i: v for i, v in enumerate(g.integers(0, 6, (25, 2)).astype(float).tolist())}  # with ties and repeated points
    points = spark.createDataFrame(list(x.items()), "ind_id long, objectives array<double>").repartition(5)
    for k in (1, 3, 40):
        left = sorted(x)
        while len(left) > 6:
            near = []
            for i in left:
                others = sorted((((x[i][0] - x[j][0]) ** 2 + (x[i][1] - x[j][1]) ** 2) ** 0.5, j) for j in left if j != i)
                near.append((others[min(k, len(others)) - 1][0], i, others[min(k, len(others)) - 1][1]))
            left.remove(min(near)[2])
        assert {r.ind_id for r in multiobjective.truncated(points, 6, k).collect()} == set(left)
    assert multiobjective.truncated(points.limit(0), 6).count() == 0 and multiobjective.truncated(points, 30).count() == 25
    line = spark.createDataFrame([(0, [0.0, 9.0]), (1, [1.0, 8.0]), (2, [1.5, 7.5]), (3, [9.0, 0.0]), (4, [0.0, 0.0])], "ind_id long, objectives array<double>")
    scored = multiobjective.spea2(line, 1)
    assert {r.ind_id for r in multiobjective.archive(scored, 3, line).collect()} == {0, 1, 3}
    assert multiobjective.archive(scored, 5, line).count() == 5


def test_niching_keeps_the_best(spark):
    evaluate = lambda pop: pop.withColumn("fitness", F.aggregate("genotype", F.lit(0.0), lambda s, v: s + v))
    problem = evolution.integer_problem(8, 0, 2, evaluate)
    first = problem.evaluate(problem.create(spark, 8, 1)).agg(F.max("fitness")).first()[0]
    for step in (evolution.niching("sharing", 3.0, alpha=1.0), evolution.niching("clearing", 3.0, kappa=1)):
        last = evolution.run(spark, problem, step, 8, 2)
        assert last.count() == 8 and last.agg(F.max("fitness")).first()[0] >= first
        assert last.where(F.col("fitness") != F.aggregate("genotype", F.lit(0.0), lambda s, v: s + v)).isEmpty()


def test_operator_wrappers(spark):
    rows = spark.createDataFrame([(0, [[1, 1, 1], [5, 5]], [[2, 2, 2], [6, 6]])], "k long, a array<array<int>>, b array<array<int>>")
    swap = lambda a, b, seed, key: (b, a)
    keep = lambda a, b, seed, key: (a, b)
    a, b = F.col("a"), F.col("b")
    r = rows.select(F.array(*variation.by_component([swap, keep])(a, b, 1, F.col("k"))).alias("s"), F.array(*variation.repeated(swap, 3)(a, b, 1, F.col("k"))).alias("t"), variation.mutated_components([lambda g, *_: F.reverse(g), lambda g, *_: F.slice(g, 1, 1)])(b, 1, F.col("k")).alias("m")).first()
    assert r.s == [[[2, 2, 2], [5, 5]], [[1, 1, 1], [6, 6]]]
    assert len(r.t) == 6 and r.t[:2] == r.t[2:4] == [[[2, 2, 2], [6, 6]], [[1, 1, 1], [5, 5]]]
    assert r.m == [[2, 2, 2], [6]]


def test_reachability_table(spark, tmp_path):
    order = spark.createDataFrame([(1, 7, None, 0.5), (0, 3, 0.2, None)], "ord int, bag_idx long, core double, reach double")
    files.write_reachability(order, str(tmp_path / "order"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "order")).collect())) == [(0, 3, 0.2, None), (1, 7, None, 0.5)]


def test_programs(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert df.select(programs.column(["+", "a", "*", "b", "4"])).first()[0] == 14
    for seed in range(40):
        p = programs.grown(["a", "b", "1"], 15, seed)
        assert len(p) <= 15 and programs.end_of(p, 0) == len(p)
        for kind in ("subtree", "grow", "truncate", "promote", "demote", "one_node", "all_nodes"):
            q = programs.mutated(p, ["a", "b"], 20, seed, kind)
            assert programs.end_of(q, 0) == len(q) <= 20
        x, y = programs.swapped(p, programs.grown(["a"], 9, seed + 1), 15, seed)
        assert programs.end_of(x, 0) == len(x) and programs.end_of(y, 0) == len(y)


def test_grammar():
    g = programs.Grammar({"E": [["E", "+", "E"], ["x"], ["(", "E", ")"]]}, "E")
    assert [g.count("E", k) for k in (1, 2, 3)] == [1, 1, 2]
    a, b = g.derive(7, 1), g.derive(5, 2)
    assert g.size(a) == 7 and g.size(b) == 5
    for seed in range(10):
        x, y = g.crossed(a, b, 12, seed)
        assert g.size(x) <= 12 and g.size(y) <= 12 and g.size(x) + g.size(y) == 12 or (x, y) == (a, b)
        assert g.size(g.regrown(a, 9, seed, "expand")) <= 9
        assert g.size(g.regrown(a, 9, seed, "reduce")) <= 7
    assert set(g.terminals(a)) <= {"x", "+", "(", ")"}


def test_grammar_recursion():
    rules = {"E": [["E", "+", "T"], ["T"]], "T": [["x"], ["(", "E", ")"]]}
    g = programs.Grammar(rules, "E")

    def valid(tree):
        return isinstance(tree, str) or [c if isinstance(c, str) else c[0] for c in tree[1:]] in rules[tree[0]] and all(map(valid, tree[1:]))

    tree = g.derive(9, 1)
    changed = 0
    for seed in range(20):
        more, less = g.recursed(tree, 14, seed), g.unrecursed(tree, seed)
        assert valid(more) and valid(less) and g.size(more) <= 14
        if more != tree:
            changed += 1
            assert g.size(more) > g.size(tree)
            assert all(tree_terms in g.terminals(more) for tree_terms in g.terminals(tree))
        assert less == tree or g.size(less) < g.size(tree)
        assert g.recursed(tree, g.size(tree), seed) == tree
    plain = ["E", ["T", "x"]]
    assert changed and g.recursed(plain, 20, 1) == plain and g.unrecursed(plain, 1) == plain
    assert g.unrecursed(["E", ["E", ["T", "x"]], "+", ["T", "x"]], 1) == plain


def test_experiments(spark, blobs, tmp_path):
    from satchel.operators import experiments

    kept = {}

    def report(title, text):
        kept[title] = text
        return title

    jobs = [("kmeans", {"k": 3, "start": [0, 1, 2]}, "blobs"), ("dbscan", {"epsilon": 0.0, "min_points": 99}, "blobs")]
    found = experiments.run(spark, jobs, lambda name: blobs, report)
    assert found.columns == experiments.RESULT and len(found.columns) == 23
    first, noise = found.collect()
    assert (first["Clusters"], first["Clusterd bags"], first["Unclustered bags"], first["Purity"], first["Rand index"], first["Precision"]) == (3, 30, 0, 1.0, 1.0, 1.0)
    assert first["Silhouete"] > 0.9 and first["Conf Matrix"].count(";") == 2 and noise["Silhouete"] is None
    assert (noise["Clusters"], noise["Unclustered bags"]) == (0, 30) and noise["Conf Matrix"] == "-1: 10 10 10"
    assert "Purity" in kept["kmeans blobs"] and first["Report"] == "kmeans blobs"
    files.write_results(found, str(tmp_path / "results"))
    assert spark.read.option("header", True).csv(str(tmp_path / "results")).columns == experiments.RESULT
    with pytest.raises(ValueError, match="no clusterer named"):
        experiments.run(spark, [("none", {}, "blobs")], lambda name: blobs)


CONFIG = """<experiment><process algorithm-type="a.b.MIGKA"><population-size>3</population-size><max-of-generations>1</max-of-generations>
<rand-gen-factory multi="true"><rand-gen-factory type="r" seed="62"/><rand-gen-factory type="r" seed="63"/></rand-gen-factory>
<evaluator type="e"><dataset multi="true"><dataset>x</dataset><dataset>y</dataset></dataset><num-clusters>3</num-clusters>
<distance type="HausdorffDistance"><config>-hausdorff-type 1</config></distance><metric>twcv</metric></evaluator>
<mutator><mut-prob>0.9</mut-prob><decorated type="m" locus-mut-prob="0.7"/></mutator></process></experiment>"""


def test_evolutionary_configs(spark, blobs):
    from satchel.operators import experiments

    jobs = experiments.evolutionary_jobs(CONFIG)
    assert sorted((name, data, given["seed"]) for name, data, given in jobs) == [("MIGKA", d, s) for d in "xy" for s in (62, 63)]
    assert jobs[0][2] == {"n": 3, "generations": 1, "seed": jobs[0][2]["seed"], "k": 3, "metric": "twcv", "distance": "minmin", "p": 0.7}
    one = CONFIG.replace(' multi="true"', "").replace("<dataset><dataset>x</dataset><dataset>y</dataset></dataset>", "<dataset>x</dataset>").replace('<rand-gen-factory><rand-gen-factory type="r" seed="62"/><rand-gen-factory type="r" seed="63"/></rand-gen-factory>', '<rand-gen-factory seed="62"/>')
    ((name, data, _, last),) = experiments.evolve(one, lambda _: blobs)
    assert (name, data) == ("MIGKA", "x") and last.count() == 3 and last.where("fitness is null").isEmpty()
    with pytest.raises(ValueError, match="no algorithm named"):
        experiments.evolutionary_jobs(CONFIG.replace("MIGKA", "none"))


def test_classification_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, -1)], "id long, label int, predicted int")
    for name in ("one", "two"):
        files.write_classification(rows, str(tmp_path), name, 1.5)
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).count() == 4
    whole = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "global")).orderBy("run").collect()
    assert [(r.run, r.rows, r.success, r.unclassified, r.seconds) for r in whole] == [("one", 4, 0.5, 0.25, 1.5), ("two", 4, 0.5, 0.25, 1.5)]


ARFF = """% comment
@relation toy
@attribute bag_id {b0,b1,b2}
@attribute bag relational
  @attribute f1 numeric
  @attribute f2 numeric
@end bag
@attribute class {no,yes}
@data
b0,"0,0\\n0,2",no
b1,"3,?",yes
b2,"0,0\\n3,4\\n6,8",yes
"""


def test_files(spark, tmp_path):
    (tmp_path / "toy.arff").write_text(ARFF)
    found = {r.bag_id: (r.bag, r.label) for r in files.read_arff(spark, str(tmp_path / "toy.arff")).collect()}
    assert found == {"b0": ([[0.0, 0.0], [0.0, 2.0]], 0), "b1": ([[3.0, None]], 1), "b2": ([[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]], 1)}
    assert [n for n, _ in files.header(spark, str(tmp_path / "toy.arff"))] == ["bag_id", "bag", "bag.f1", "bag.f2", "class"]
    files.write_arff(files.read_arff(spark, str(tmp_path / "toy.arff")), str(tmp_path / "out"))
    again = {r.bag_id: (r.bag, r.label) for r in files.read_arff(spark, str(tmp_path / "out/*")).collect()}
    assert again == found
    (tmp_path / "k.dat").write_text("@relation k\n@attribute v real [0,9]\n@inputs v\n@output c\n@data\na,1,2,x\na,3,4,x\nb,5,?,y\n")
    keel = {r.bag_id: (r.bag, r.label) for r in files.read_keel(spark, str(tmp_path / "k.dat")).collect()}
    assert keel == {"a": ([[1.0, 2.0], [3.0, 4.0]], "x"), "b": ([[5.0, None]], "y")}
    (tmp_path / "m.arff").write_text("@data\n1,2,0,1\n")
    assert files.read_multilabel(spark, str(tmp_path / "m.arff"), 2).first().y == [0.0, 1.0]
    assert files.label_count("<labels><label name='a'/><label name='b'/></labels>") == 2
    job = files.experiment_config("<process algorithm-type='A'><seed>1</seed><seed>2</seed><n>3</n></process>")
    assert [j["seed"] for j in files.expanded(job)] == ["1", "2"]


def test_streaming_prediction(spark, blobs, tmp_path):
    from satchel.streaming.bags import predicted, windowed_bags

    model = clusterers.KMeans(3, start=[0, 1, 2])
    want = {r.bag_idx: r.cluster for r in model.fit(blobs).collect()}
    blobs.write.parquet(str(tmp_path / "in"))
    stream = predicted(spark.readStream.schema(blobs.schema).parquet(str(tmp_path / "in")), model)
    query = stream.writeStream.format("memory").queryName("predicted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.bag_idx: r.cluster for r in spark.table("predicted").collect()} == want
    events = spark.createDataFrame([(1, "2024-01-01 00:05:00", 7, 1.0), (2, "2024-01-01 00:10:00", 7, 2.0), (3, "2024-01-01 05:00:00", 7, 3.0)], "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(len(r.bag) for r in windowed_bags(events).collect()) == [1, 2]


def test_centroids(toy):
    rule = toy.select("bag_idx", F.lit(0).alias("cluster"))
    rows = toy.select("bag_idx", F.posexplode("bag").alias("ord", "x"), "label")
    assert centres.mean_centroids(rows, rule).first().c == pytest.approx([2.0, 3.0])
    assert centres.mean_centroids(rows, rule, True).first().c == pytest.approx([1.5, 2.5])
    assert centres.medoids(toy, rule).first().bag_idx in (0, 1, 2)
    assert {r.cluster: r.n for r in centres.counts(rule, 2).collect()} == {-1: 0, 0: 3, 1: 0}


def test_registered_queries_match_sql(spark):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    sql = catalog.oracle_sql()
    for name in ("flagship", "zscore", "entropy", "uniform_xover"):
        df = catalog.queries()[name](spark, folder)
        rows = con.execute(sql[name])
        at = [d[0] for d in rows.description]
        assert sorted(map(str, (tuple(r) for r in df.select(*at).collect()))) == sorted(map(str, rows.fetchall()))


def test_views(spark):
    assert views.long(views.vector_bags(spark, "/root/testdata/sf0.001")).count() == 500
