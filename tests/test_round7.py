import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.functions import kernels
from satchel.operators import blocks, joins, niches


def bags_of(n, d=3, seed=3):
    g = np.random.default_rng(seed)
    return [(7 * k % n, g.normal(size=(int(g.integers(2, 6)), d)).tolist()) for k in range(n)]


@pytest.mark.parametrize("distance", kernels.NAMES)
def test_pair_table_of_blocks_and_parts_equals_single_distances(spark, monkeypatch, distance):
    monkeypatch.setattr(blocks, "PART", 4)
    rows = bags_of(41)
    table = spark.createDataFrame(rows, "bag_idx long, bag array<array<double>>")
    found = joins.pair_table(table, None, distance, block=9).collect()
    assert len(found) == 41 * 40
    of = dict(rows)
    for r in found:
        assert r.d == pytest.approx(kernels.distance(distance, of[r.i], of[r.j]), abs=1e-9)


def test_each_row_of_all_pairs_is_sent_once_for_each_large_block():
    for n, values in ((123_000, 123_000 * 320), (540_000, 540_000 * 6), (615_000, 615_000 * 64)):
        rows = blocks.size(n, values, joins.BLOCK)
        assert -(-n // rows) <= 10 and rows * values // n * 8 <= blocks.BYTES  # copies of a table, bytes of a block
    assert blocks.size(1000, 1000 * (1 << 23), 256) == 1  # huge bags


def test_all_pairs_leave_a_task_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 8)
    rows = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("v"))

    def compare(x, y, same):
        yield x[["id"]].iloc[:1].assign(a=len(x), b=len(y))

    found = blocks.met(rows, ["id"], F.size("v"), 1000, lambda part, _: part, compare, "id long, a long, b long").collect()
    assert sum(r.a * r.b for r in found) >= 100 * 101 // 2 and max(r.a for r in found) <= 8


@pytest.mark.parametrize(("kind", "radius", "genes"), [("hamming", 5.0, 8), ("hamming", 7.0, 8), ("euclidean", 1.6, 14)])
def test_clearing_without_pairs_equals_its_definition(spark, monkeypatch, kind, radius, genes):
    monkeypatch.setattr(niches, "CHUNK", 7)
    monkeypatch.setattr(niches, "_cleared", lambda *a: pytest.fail("a table of pairs"))
    g = np.random.default_rng(int(radius))
    rows = [(i, (g.integers(0, 3, genes) if kind == "hamming" else g.random(genes)).tolist(), float(g.integers(0, 6))) for i in range(90)]
    rows += [(90 + i, rows[i][1], 2.5) for i in range(10)]
    table = spark.createDataFrame(rows, f"ind_id long, genotype array<{'int' if kind == 'hamming' else 'double'}>, fitness double")
    stay = []
    for i, v, f in sorted(rows, key=lambda r: (-r[2], r[0])):
        gaps = [np.sum(np.array(v) != np.array(w)) if kind == "hamming" else np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()) for _, w, _ in stay]
        if not any(d < radius for d in gaps):
            stay.append((i, v, f))
    want = {r[0]: 0.0 for r in rows} | {i: f for i, _, f in stay}
    assert {r.ind_id: r.fitness for r in niches.cleared(table, radius, kind=kind).collect()} == want
