"""Typed trees as rows against recursive Python on every program."""

import pytest
from pyspark.sql import functions as F

from satchel.operators import trees

SCHEMA = trees.arithmetic(2, most=15)
P = SCHEMA.primitives


def end(p, i):
    open_ = 1
    while open_:
        open_ += len(P[p[i]].takes) - 1
        i += 1
    return i


def whole(p, kind="number", at=0):
    """The place behind the tree at a place, whose types are checked."""
    assert P[p[at]].returns == kind
    at, takes = at + 1, P[p[at]].takes
    for t in takes:
        at = whole(p, t, at)
    return at


def value(p, x):
    def of(i):
        q, j, args = P[p[i]], i + 1, []
        for _ in q.takes:
            v, j = of(j)
            args.append(v)
        name = q.name
        if not q.takes:
            return (x[int(name[1:])] if name[0] == "x" else 1.0 if name == "true" else float(name)), j
        f = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "neg": lambda a: -a, "<": lambda a, b: float(a < b), "and": min, "not": lambda a: 1 - a, "if": lambda c, a, b: a if c > 0 else b}[name]
        return f(*args), j

    return of(0)[0]


@pytest.fixture(scope="module")
def pop(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trees") / "pop")
    trees.created(spark, SCHEMA, 400, 3, seed=4).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_created_programs_are_whole_typed_and_bounded(pop):
    rows = [r.genotype for r in pop.collect()]
    assert all(whole(p) == len(p) <= 15 for p in rows) and len({tuple(p) for p in rows}) > 200 and max(map(len, rows)) > 10
    checked = pop.select(trees.valid(SCHEMA, F.col("genotype")).alias("ok"), trees.valid(SCHEMA, F.concat("genotype", F.array(F.lit(0)))).alias("more")).distinct().collect()
    assert [tuple(r) for r in checked] == [(True, False)]
    ends = pop.select("genotype", F.expr("floor(size(genotype) / 2)").cast("int").alias("i")).withColumn("e", trees.end_of(SCHEMA, F.col("genotype"), F.col("i"))).collect()
    assert all(r.e == end(r.genotype, r.i) for r in ends)


def test_values_of_all_programs_in_one_plan(spark, pop):
    inputs = spark.createDataFrame([([0.5, -1.0],), ([2.0, 3.0],)], "x array<double>")
    rows = pop.crossJoin(F.broadcast(inputs)).select("genotype", "x", trees.value(SCHEMA, F.col("genotype"), F.col("x")).alias("v")).collect()
    assert len(rows) == 800 and all(r.v == pytest.approx(value(r.genotype, r.x)) for r in rows)


def test_crossover_swaps_subtrees_of_one_type(pop):
    other = pop.select((F.col("ind_id") - 1).alias("ind_id"), F.col("genotype").alias("b"))
    u = (F.rand(3), F.rand(4))
    rows = pop.join(other, "ind_id").withColumn("u", u[0]).withColumn("v", u[1]).withColumn("c", trees.crossed(SCHEMA, F.col("genotype"), F.col("b"), F.col("u"), F.col("v"))).collect()
    moved = 0
    for r in rows:
        a, b, (x, y) = r.genotype, r.b, r.c
        assert all(whole(p) == len(p) <= 15 for p in (x, y)) and sorted(x + y) == sorted(a + b)
        if len(a) > 1:
            i = 1 + int(r.u * (len(a) - 1))
            able = [j for j in range(1, len(b)) if P[b[j]].returns == P[a[i]].returns]
            n = end(a, i) - i
            able = [j for j in able if len(a) - n + end(b, j) - j <= 15 and len(b) - (end(b, j) - j) + n <= 15]
            if able:
                j = able[int(r.v * len(able))]
                assert x == a[:i] + b[j : end(b, j)] + a[end(a, i) :] and y == b[:j] + a[i : end(a, i)] + b[end(b, j) :]
                moved += 1
                continue
        assert (x, y) == (a, b)
    assert moved > 200


@pytest.mark.parametrize("kind", trees.KINDS)
def test_mutations_keep_types_and_sizes(pop, kind):
    rows = pop.select("genotype", trees.mutated(SCHEMA, F.col("genotype"), kind, 7, F.col("ind_id")).alias("m")).collect()
    assert all(whole(r.m) == len(r.m) <= 15 for r in rows) and sum(r.m != r.genotype for r in rows) > 100
    for a, m in rows:
        if kind in ("one_node", "all_nodes"):
            same = [(P[x].returns, len(P[x].takes)) == (P[y].returns, len(P[y].takes)) for x, y in zip(a, m, strict=True)]
            assert all(same) and (kind == "all_nodes" or sum(x != y for x, y in zip(a, m)) <= 1)
        elif kind in ("truncate", "demote"):
            assert len(m) <= len(a) and m[0] == a[0]
        elif kind in ("grow", "promote"):
            assert len(m) >= len(a) and (kind == "grow" or m == a or len(m) > len(a))
    if kind == "demote":
        assert all(any(m == a[:i] + a[j : end(a, j)] + a[end(a, i) :] for i in range(1, len(a)) for j in range(i + 1, end(a, i))) for a, m in rows if a != m)


def test_schema_needs_a_terminal_of_each_type():
    with pytest.raises(ValueError, match="truth"):
        trees.Schema([trees.Primitive("x", "number"), trees.Primitive("not", "truth", ("truth",))], "number")
