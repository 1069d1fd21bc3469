"""Evolutionary clusterers: keyed metrics against the single ones, steps, and short runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.functions.columns import draw_array
from satchel.operators import clusterers, indices, programs, variation
from satchel.operators import evoclusters as ec

GENES = {1: [0, 1, 2] * 4, 2: [0] * 6 + [1] * 6, 3: [0, 0, 0, 1, 1, 1, 2, 2, 2, 0, 1, 2]}


@pytest.fixture(scope="module")
def blobs(spark):
    g = np.random.Generator(np.random.PCG64(4))
    rows = [(i * 3, (g.normal(0, 0.3, (2 + i % 3, 2)) + [10 * (i % 3), 0]).tolist(), i % 3) for i in range(12)]
    return spark.createDataFrame(rows, "bag_idx long, bag array<array<double>>, label int").coalesce(2)


@pytest.fixture(scope="module")
def pop(spark):
    return spark.createDataFrame([(i, g, None) for i, g in GENES.items()], "ind_id long, genotype array<int>, fitness double")


@pytest.mark.parametrize(("distance", "compared"), [("maxmin", 1), ("mean", 2)])
def test_keyed_metrics(spark, blobs, pop, distance, compared):
    space = ec.Space(blobs, 3, distance)
    names = {"rmssd": "rmsstd", "silhouette": "silhouette", "db": "davies_bouldin", "xb": "xie_beni", "sdbw": "s_dbw", "dbcv": "dbcv", "twcv": "twcv"}
    got = {m: {r.ind_id: r.fitness for r in space.rated(space.labels(pop), m).collect()} for m in names}
    clusters = spark.createDataFrame([(3 * k, c) for k, c in enumerate(GENES[compared])], "bag_idx long, cluster int")
    want = indices.full_evaluation(blobs, clusters, distance)
    for m, name in names.items():
        assert got[m][compared] == pytest.approx(want[name], rel=1e-9, abs=1e-12), m
    best = max(got["silhouette"], key=got["silhouette"].get)
    assert best == 1 and min(got["twcv"], key=got["twcv"].get) == 1


def test_metric_without_a_value(spark, blobs):
    one = spark.createDataFrame([(1, [0] * 12, None)], "ind_id long, genotype array<int>, fitness double")
    space = ec.Space(blobs, 3)
    assert space.rated(space.labels(one), "db").first().fitness == math.inf
    assert space.rated(space.labels(one.limit(0)), "sdbw").count() == 0
    with pytest.raises(ValueError):
        space.rated(space.labels(one), "other")


def test_steps(spark, blobs, pop):
    space = ec.Space(blobs, 3)
    moved = {r.ind_id: r.genotype for r in space.kmeans_step(pop, repair=False).collect()}
    for i, g in GENES.items():
        clusters = spark.createDataFrame([(3 * k, c) for k, c in enumerate(g)], "bag_idx long, cluster int")
        assert moved[i] == [r.cluster for r in clusterers.one_step(blobs, clusters, repair=False).orderBy("bag_idx").collect()]
    full = {r.ind_id: r.genotype for r in space.kmeans_step(pop).collect()}
    assert all(set(g) == {0, 1, 2} for g in full.values()) and full[1] == GENES[1]
    for changed in (space.fast_mutation(pop, 5, 0.5), space.guided_mutation(pop, "silhouette", 5, 0.5)):
        rows = {r.ind_id: r.genotype for r in changed.collect()}
        assert set(rows) == set(GENES) and all(len(g) == 12 and set(g) <= {0, 1, 2} for g in rows.values())
        assert any(rows[i] != GENES[i] for i in GENES)
    same = {r.ind_id: r.genotype for r in space.fast_mutation(pop, 5, 0.0).collect()}
    assert same == GENES
    medoids = spark.createDataFrame([(7, [1, 0], None)], "ind_id long, genotype array<int>, fitness double")
    assert [r.cluster for r in space.medoid_labels(medoids).orderBy("bag_idx").collect()][:3] == [1, 0, 0]


@pytest.mark.parametrize("name", list(ec.ALGORITHMS))
def test_runs(blobs, name):
    found = ec.ALGORITHMS[name](blobs, n=4, generations=1).collect()
    length = {"MIGCUK": 2, "MIGGA": 13}.get(name, 12)
    assert len(found) == 4 and all(len(r.genotype) == length and r.fitness is not None for r in found)


def test_mixed_mutation_and_lifts(spark):
    g = spark.createDataFrame([(1, [0.5] * 10 + [2.0, 3.0, 1.0, 0.0])], "ind_id long, g array<double>")
    n = F.lit(14)
    out = g.select(variation.mixed_non_uniform(F.col("g"), draw_array(1, n, F.col("ind_id")), draw_array(2, n, F.col("ind_id")), 1, 10, p=1.0).alias("g")).first().g
    assert all(0 <= x <= 1 for x in out[:10]) and all(x in range(5) for x in out[10:12]) and all(x in (0, 1) for x in out[12:])
    a, b = [["x"], ["+", "x", "y"]], [["y"], ["1"]]
    assert programs.exchanged(a, b, 1, 1) == ([["x"], ["1"]], [["y"], ["+", "x", "y"]])
    assert programs.lifted(lambda t, s: [*t, "!"], a, 1, 0) == [["x", "!"], ["+", "x", "y"]]
    assert programs.lifted(lambda t, s: ["z"], a, 1, every=True) == [["z"], ["z"]]
