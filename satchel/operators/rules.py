"""Classifiers made of rules: a whole population judged in one scan, and rule lists as classifiers.

A rule is (rule_id, conditions, cls): all conditions (dim, sign, bound) must hold, sign * x[dim] >= sign * bound.  Rows to be
judged are (id, label, instances), instances being an array of vectors: one for a single-label dataset, many for a bag,
which a rule fires on if it does on any of its instances.  Labels are numbers; a bag may also carry an array of them.

Blocks of rows meet blocks of rules, each pair in a task that compares whole columns; only counts by rule leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import saved

MOST, ROWS = 4096, 4096  # rules and rows of a block
RULE = "rule_id long, conditions array<struct<dim:int,sign:int,bound:double>>, cls int"


def single(rows: DataFrame) -> DataFrame:
    """(id, x, label) as rows to be judged."""
    return rows.select("id", "label", F.array("x").alias("instances"))


def bags_of(bags: DataFrame) -> DataFrame:
    """(bag_idx, bag, label) as rows to be judged."""
    return bags.select(F.col("bag_idx").alias("id"), "label", F.col("bag").alias("instances"))


def fires(instances: Column, rule: Column) -> Column:
    """Whether a rule holds on any instance; a rule without conditions holds on all, a dimension beyond the vector on none."""
    def holds(x: Column, c: Column) -> Column:
        return F.coalesce(c["sign"] * F.get(x, c["dim"]) >= c["sign"] * c["bound"], F.lit(False))

    return F.exists(instances, lambda x: F.forall(rule["conditions"], lambda c: holds(x, c)))


def _narrow(rows: DataFrame, dims: list[int]) -> DataFrame:
    """rows with ``x``, the values of their instances on dims one behind the other, ``gone`` where a vector has none, and size."""
    def on(x: Column) -> Column:
        return F.array(*(F.get(x, F.lit(d)) for d in dims)).cast("array<double>")

    flat = F.flatten(F.transform("instances", on))
    return rows.select("id", "label", F.size("instances").alias("size"), F.transform(flat, lambda v: F.coalesce(v, F.lit(0.0))).alias("x"), F.transform(flat, lambda v: v.isNull()).alias("gone"))


def _fired(rules: pd.DataFrame, at: dict[int, int], values: np.ndarray, gone: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
    """rules x rows: whether a rule holds on any instance; values: dimensions x instances, which begin at starts for each row."""
    holds = np.ones((len(rules), values.shape[1]), bool)
    for k in range(max((len(c) for c in rules.conditions), default=0)):
        some = np.array([r for r, c in enumerate(rules.conditions) if len(c) > k])
        one = [rules.conditions.iloc[r][k] for r in some]
        known = np.array([None not in (c["dim"], c["sign"], c["bound"]) and c["dim"] in at for c in one])
        holds[some[~known]] = False
        some, one = some[known], [c for c, ok in zip(one, known, strict=True) if ok]
        if len(some):
            dim, sign, bound = np.array([at[c["dim"]] for c in one]), np.array([c["sign"] for c in one], float), np.array([c["bound"] for c in one], float)
            with np.errstate(invalid="ignore"):
                x = values[dim] * sign[:, None]
                ok = (x >= (sign * bound)[:, None]) | np.isnan(x)  # not a number is above all numbers, as in Spark
            if gone is not None:
                ok &= ~gone[dim]
            holds[some] &= ok
    return np.logical_or.reduceat(holds, starts, axis=1) if len(starts) else np.zeros((len(rules), 0), bool)


def _counted(rows: DataFrame, rules: DataFrame, belongs) -> DataFrame:
    """rule_id, tp, fp, fn, tn; belongs(labels, class) gives whether rows have the class, and whether that is known."""
    rules = saved(rules.select("rule_id", "conditions", "cls"))
    dims = sorted(r[0] for r in rules.select(F.explode("conditions.dim")).distinct().collect() if r[0] is not None and r[0] >= 0)  # dimensions
    narrow = saved(_narrow(rows.where("label is not null"), dims))
    n, m = max(1, -(-narrow.count() // ROWS)), max(1, -(-rules.count() // MOST))
    a = narrow.withColumn("p", F.pmod(F.xxhash64("id", "x"), F.lit(n)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    b = rules.withColumn("s", F.pmod(F.xxhash64("rule_id"), F.lit(m)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = {d: k for k, d in enumerate(dims)}

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rule_id", "tp", "fp", "fn", "tn")})]
        if len(x) and len(y):
            x = pd.concat([x[x["size"] > 0], x[~(x["size"] > 0)]])  # on rows without instances nothing fires
            sizes = x["size"].to_numpy()[x["size"].to_numpy() > 0]
            shape = int(sizes.sum()), len(dims)
            values, gone = (np.ascontiguousarray(np.concatenate([*(np.asarray(v, kind) for v in x[c].iloc[: len(sizes)]), np.zeros(0, kind)]).reshape(shape).T) for c, kind in (("x", float), ("gone", bool)))
            gone = gone if gone.any() else None
            step = max(1, (1 << 21) // max(1, shape[0]))
            known = {c: belongs(x.label, c) for c in set(y.cls.dropna().tolist())}
            for k in range(0, len(y), step):
                some = y.iloc[k : k + step]
                fired = np.zeros((len(some), len(x)), bool)
                fired[:, : len(sizes)] = _fired(some, at, values, gone, np.cumsum(sizes) - sizes)
                mine = np.stack([known[c][0] if c == c and c is not None else np.zeros(len(x), bool) for c in some.cls])
                sure = np.stack([known[c][1] if c == c and c is not None else np.zeros(len(x), bool) for c in some.cls])
                tp, fp = (fired & mine & sure).sum(1), (fired & ~mine & sure).sum(1)
                out.append(pd.DataFrame({"rule_id": some.rule_id, "tp": tp, "fp": fp, "fn": (mine & sure).sum(1) - tp, "tn": (~mine & sure).sum(1) - fp}))
        return pd.concat(out)

    parts = a.groupBy("p", "q").cogroup(b.groupBy("r", "s")).applyInPandas(compare, "rule_id long, tp long, fp long, fn long, tn long")
    return parts.groupBy("rule_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))


def confusions(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, tp, fp, fn, tn of each rule as a detector of its class; rows without a label aren't counted."""
    return _counted(rows, rules, lambda labels, c: ((labels == c).to_numpy(bool), np.ones(len(labels), bool)))


def multilabel_confusions(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """confusions of rows whose ``label`` is an array of all their labels."""
    def belongs(labels: pd.Series, c) -> tuple[np.ndarray, np.ndarray]:
        mine = np.array([any(v == c for v in some) for some in labels], bool)
        return mine, mine | np.array([all(v is not None and v == v for v in some) for some in labels], bool)  # as in SQL

    return _counted(rows, rules, belongs)


def rated(confused: DataFrame) -> DataFrame:
    """rule_id, sensitivity, specificity, precision, f1, accuracy and fitness (sensitivity times specificity), 0 where a
    denominator is."""
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = confused.select("rule_id", part(tp, tp + fn).alias("sensitivity"), part(tn, tn + fp).alias("specificity"), part(tp, tp + fp).alias("precision"), part(2 * tp, 2 * tp + fp + fn).alias("f1"), part(tp + tn, tp + fp + fn + tn).alias("accuracy"))
    return out.withColumn("fitness", F.col("sensitivity") * F.col("specificity"))


class RuleList:
    """A classifier of the k best rules: the first one that fires gives the class, else the most frequent class does."""

    def __init__(self, k: int = 10) -> None:
        self.k, self.rules, self.default = k, None, None

    def fit(self, rows: DataFrame, rules: DataFrame) -> DataFrame:
        """The chosen rules (place, rule_id, fitness), by fitness on rows."""
        scored = saved(rated(confusions(rows, rules)))
        best = scored.orderBy(F.desc("fitness"), "rule_id").limit(min(self.k, MOST))
        most = rows.where("label is not null").groupBy("label").count().agg(F.max_by("label", F.struct("count", -F.col("label")))).first()[0]
        self.default = most
        placed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("fitness")).alias("f"), "rule_id"))).alias("b")).select(F.posexplode("b").alias("place", "s"))
        chosen = placed.select("place", "s.rule_id", (-F.col("s.f")).alias("fitness"))
        self.rules = saved(chosen.join(rules, "rule_id"))  # k rows
        return self.rules.select("place", "rule_id", "fitness")

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, label, predicted) as write_classification and the rates take them; batch or stream."""
        pack = self.rules.agg(F.sort_array(F.collect_list(F.struct("place", "cls", "conditions"))).alias("rules"))
        first = F.get(F.filter("rules", lambda r: fires(F.col("instances"), r)), F.lit(0))["cls"]
        return rows.crossJoin(F.broadcast(pack)).select("id", "label", F.coalesce(first, F.lit(self.default)).cast("int").alias("predicted"))


CLASSIFIERS = {"rule_list": RuleList}
