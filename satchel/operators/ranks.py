"""Places and running sums over a whole table, from range partitions and their totals.

A table is sorted into range partitions, whose number grows with it, and kept; the totals of the partitions (a row each)
are the offsets of what is counted inside them.  So nothing needs a window without a key, and no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import saved

ROWS = 33  # bits of monotonically_increasing_id that count the rows of a partition


def _fresh(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _sorted(df: DataFrame, order: list, at: str, store: Callable) -> DataFrame:
    """df in range partitions, with the partition and the row in it as one number; equal rows can be split."""
    (tie,) = _fresh(df, "_tie")
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    return store(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()))


def _part(at: str) -> Column:
    return F.shiftright(F.col(at), ROWS).cast("int")


def _before(totals: dict[int, float]) -> Column:
    """The sum of the totals of all partitions before one, as an array of partitions."""
    out, upto = [], 0
    for p in range(max(totals, default=0) + 1):
        out.append(upto)
        upto += totals.get(p) or 0
    return F.lit(out)


def numbered(df: DataFrame, order: list, name: str = "place", store: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """df with ``name``: 0, 1, 2, ... in this order; rows that tie in it are numbered in any order.

    ``store`` writes a table and reads it back."""
    (at,) = _fresh(df, "_at")
    kept = _sorted(df, order, at, lambda x: store(x))
    totals = {r[0]: r[1] for r in kept.groupBy(_part(at)).count().collect()}
    place = F.get(_before(totals), _part(at)) + F.col(at).bitwiseAND(F.lit((1 << ROWS) - 1))
    return kept.withColumn(name, place.cast("long")).drop(at)


def running(df: DataFrame, order: list, value: str, name: str = "before") -> tuple[DataFrame, float]:
    """df with ``name``: the sum of ``value`` over all rows before, in this order; and the sum over all."""
    (at,) = _fresh(df, "_at")
    kept = _sorted(df, order, at, saved)
    totals = {r[0]: float(r[1] or 0) for r in kept.groupBy(_part(at)).agg(F.sum(value)).collect()}
    mine = Window.partitionBy(_part(at)).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.get(_before({p: float(t) for p, t in totals.items()}).cast("array<double>"), _part(at)) + F.coalesce(F.sum(value).over(mine), F.lit(0.0))
    return kept.withColumn(name, upto).drop(at), sum(totals[p] for p in sorted(totals))


def last_before(known: DataFrame, at: str, value: str, asked: DataFrame, place: str) -> DataFrame:
    """asked with ``value``: that of the last row of known (at, value) whose ``at`` isn't beyond ``place``; the first one of
    all where there is none.  Rows of known with equal ``at`` are ordered by value."""
    both = known.select(F.col(at).alias("_x"), F.lit(0).alias("_kind"), F.col(value).alias("_value"), F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("_row"))
    both = both.unionByName(asked.select(F.col(place).alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast(known.schema[value].dataType).alias("_value"), F.struct("*").alias("_row")))
    kept = _sorted(both, ["_x", "_kind", "_value"], "_at", saved)
    ends = {r[0]: r[1] for r in kept.where("_kind = 0").groupBy(_part("_at")).agg(F.max_by("_value", "_at")).collect()}  # a row per partition
    first = known.agg(F.min_by(value, F.struct(at, value))).first()[0]
    carry, upto = [], first
    for p in range(max([*ends, 0]) + 2):
        carry.append(upto)
        upto = ends.get(p, upto)
    mine = Window.partitionBy(_part("_at")).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = F.get(F.lit(carry), F.least(_part("_at"), F.lit(len(carry) - 1))).cast(known.schema[value].dataType)
    found = kept.withColumn("_value", F.coalesce(F.last("_value", ignorenulls=True).over(mine), before))
    return found.where("_kind = 1").select("_row.*", F.col("_value").alias(value))
