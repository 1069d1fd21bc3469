"""Rule classifiers, niches and named generators against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.functions import generators
from satchel.operators import niches, rules


def ranecu(seed1, seed2, n):
    """The published recurrence, one step after the other, in the form that keeps to 32 bits."""
    out = []
    for _ in range(n):
        k = seed1 // 53668
        seed1 = 40014 * (seed1 - k * 53668) - k * 12211
        seed1 += 2147483563 if seed1 < 0 else 0
        k = seed2 // 52774
        seed2 = 40692 * (seed2 - k * 52774) - k * 3791
        seed2 += 2147483399 if seed2 < 0 else 0
        z = seed1 - seed2
        out.append((z + 2147483562 if z < 1 else z) * 4.656613e-10)
    return out


def test_ranecu_equals_the_recurrence_from_any_start(spark):
    rows = spark.range(1, 301).withColumn("u", generators.ranecu(F.col("id"), 12345, 67890))
    assert [r.u for r in rows.orderBy("id").collect()] == ranecu(12345, 67890, 300)
    seeds = generators.streams(spark, 3, 12345, 67890, apart=100).collect()
    assert (seeds[0].seed1, seeds[0].seed2) == (12345, 67890)
    again = [ranecu(s.seed1, s.seed2, 100) for s in seeds]
    assert sum(again, []) == ranecu(12345, 67890, 300)
    assert all(0 <= r.v < 7 for r in rows.select(generators.whole(F.col("u"), 0, 7).alias("v")).collect())


@pytest.fixture(scope="module")
def pop(spark):
    g = random.Random(2)
    base = [[g.randrange(3) for _ in range(9)] for _ in range(12)]
    rows = []
    for i in range(70):
        genes = list(g.choice(base))
        for _ in range(g.randrange(4)):
            genes[g.randrange(9)] = g.randrange(3)
        rows.append((i, genes, float(g.randrange(1, 20))))
    rows += [(100 + k, rows[0][1], 3.0) for k in range(20)]  # copies
    return rows, spark.createDataFrame(rows, "ind_id long, genotype array<int>, fitness double").repartition(4)


def far(x, y):
    return sum(a != b for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("most", [0, 3, 9])
def test_hamming_near_equals_all_pairs(pop, most):
    rows, table = pop
    want = {(i, j): far(x, y) for i, x, _ in rows for j, y, _ in rows if i < j and far(x, y) <= most}
    found = niches.hamming_near(table, most).collect()
    assert len(found) == len(want) and {(r.i, r.j): r.d for r in found} == want


@pytest.mark.parametrize(("alpha", "compat"), [(1.0, False), (2.0, True)])
def test_sharing_equals_all_pairs(pop, alpha, compat):
    rows, table = pop
    found = {r.ind_id: r.fitness for r in niches.shared(table, 4.0, alpha, compat=compat).collect()}
    for i, x, f in rows:
        near = [far(x, y) / 4 for j, y, _ in rows if j != i and far(x, y) < 4]
        s = sum(d**alpha if compat else 1 - d**alpha for d in near) + (0 if compat else 1)
        assert found[i] == pytest.approx(f / s if s else f)


@pytest.mark.parametrize("kappa", [1, 2, 3])
def test_clearing_equals_the_ordered_pass(pop, kappa):
    rows, table = pop
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    gone: set = set()
    for n, (i, x, _) in enumerate(order):
        if i not in gone:
            near = [j for j, y, _ in order[n + 1 :] if far(x, y) < 3 and j not in gone]
            gone |= set(near[kappa - 1 :])
    found = {r.ind_id: r.fitness for r in niches.cleared(table, 3.0, kappa).collect()}
    assert found == {i: 0.0 if i in gone else f for i, _, f in rows}


def test_niches_of_reals_and_of_nobody(spark, pop):
    _, table = pop
    assert niches.cleared(table.limit(0), 3.0).count() == 0 and niches.shared(table.limit(0), 3.0).count() == 0
    reals = spark.createDataFrame([(0, [0.0, 0.0], 2.0), (1, [0.0, 1.0], 1.0), (2, [5.0, 0.0], 1.0)], "ind_id long, genotype array<double>, fitness double")
    assert {r.ind_id: r.fitness for r in niches.cleared(reals, 1.5, kind="euclidean").collect()} == {0: 2.0, 1: 0.0, 2: 1.0}
    assert {r.ind_id: r.fitness for r in niches.shared(reals, 2.0, kind="euclidean").collect()} == pytest.approx({0: 2 / 1.5, 1: 1 / 1.5, 2: 1.0})


@pytest.mark.parametrize("most", [3, 4096])
def test_rules_judged_in_one_scan(spark, monkeypatch, most):
    monkeypatch.setattr(rules, "MOST", most)
    g = np.random.Generator(np.random.PCG64(3))
    data = [(i, None if i == 9 else int(g.integers(0, 3)), np.round(g.normal(0, 1, (int(g.integers(1, 4)), 2)), 1).tolist()) for i in range(60)]
    made = [(k, [(int(g.integers(0, 2)), int(g.choice([-1, 1])), float(np.round(g.normal(), 1))) for _ in range(k % 3)], k % 3) for k in range(8)] + [(20, [(7, 1, 0.0)], 1)]
    rows = spark.createDataFrame(data, "id long, label int, instances array<array<double>>").repartition(3)
    table = spark.createDataFrame(made, rules.RULE)

    def fired(rule, bag):
        return any(all(d < 2 and s * x[d] >= s * b for d, s, b in rule[1]) for x in bag)

    want = {}
    for rule in made:
        cells = [(y == rule[2], fired(rule, bag)) for _, y, bag in data if y is not None]
        want[rule[0]] = tuple(cells.count(c) for c in ((True, True), (False, True), (True, False), (False, False)))
    found = {r.rule_id: (r.tp, r.fp, r.fn, r.tn) for r in rules.confusions(rows, table).collect()}
    assert found == want
    scores = {r.rule_id: r.fitness for r in rules.rated(rules.confusions(rows, table)).collect()}
    tp, fp, fn, tn = want[4]
    assert scores[4] == pytest.approx((tp / (tp + fn) if tp + fn else 0) * (tn / (tn + fp) if tn + fp else 0))
    sets = rows.where("label is not null").withColumn("label", F.array("label", F.lit(1)))
    both = {r.rule_id: r.tp + r.fn for r in rules.multilabel_confusions(sets, table).collect()}
    assert both[1] == 59 and both[0] == sum(y == 0 for _, y, _ in data)
    if most == 4096:
        model = rules.RuleList(3)
        chosen = [r.rule_id for r in model.fit(rows, table).orderBy("place").collect()]
        assert chosen == sorted(scores, key=lambda k: (-scores[k], k))[:3]
        by = {m[0]: m for m in made}
        for r in model.predict(rows).collect():
            first = next((by[k][2] for k in chosen if fired(by[k], data[r.id][2])), model.default)
            assert r.predicted == first and r.label == data[r.id][1]
