"""External metrics: clusters against classes, predictions against labels, multi-label predictions.

A confusion table is (cluster, class, n), one row per cell; the driver holds cells, never rows of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    """Of (cluster, label): n by cell; unassigned bags as cluster -1; rows without a class are left out."""
    return rows.where("label is not null").groupBy(F.greatest("cluster", F.lit(-1)).alias("cluster"), F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def entropy(cells: DataFrame) -> DataFrame:
    """Weighted entropy (bits) of the classes in each cluster."""
    c = cells.where("cluster >= 0").withColumn("t", F.sum("n").over(Window.partitionBy("cluster")))
    return c.agg((-F.sum(F.col("n") * F.log2(F.col("n") / F.col("t"))) / F.sum("n")).alias("entropy"))


def purity(cells: DataFrame) -> DataFrame:
    best = cells.where("cluster >= 0").groupBy("cluster").agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return best.agg((F.sum("m") / F.sum("t")).alias("purity"))


def mapping(cells: dict[tuple[int, int], int]) -> dict[int, int]:
    """Cluster to class, injective, with the fewest errors; -1 for a cluster without a class."""
    return _assigned(sorted({c for c, _ in cells if c >= 0}), sorted({k for _, k in cells}), cells)


def _assigned(clusters: list[int], classes: list[int], cells: dict[tuple[int, int], int]) -> dict[int, int]:
    """The assignment problem, by shortest augmenting paths with potentials; clusters and classes are taken in their order."""
    n, m = len(clusters), max(len(classes), len(clusters))
    cost = [[-cells.get((c, classes[j]), 0) if j < len(classes) else 0 for j in range(m)] for c in clusters]
    u, v, owner = [0.0] * n, [0.0] * m, [-1] * m
    for i in range(n):
        far, before, done, j, row = [float("inf")] * m, [-1] * m, [False] * m, -1, i
        while True:
            if j >= 0:
                done[j] = True
            for k in range(m):
                if not done[k] and (d := cost[row][k] - u[row] - v[k] + (far[j] if j >= 0 else 0)) < far[k]:
                    far[k], before[k] = d, j
            k = min((k for k in range(m) if not done[k]), key=far.__getitem__)
            if owner[k] < 0:
                break
            j, row = k, owner[k]
        reach = far[k]
        u[i] += reach
        for x in range(m):
            if done[x]:
                u[owner[x]] += reach - far[x]
                v[x] -= reach - far[x]
        while k >= 0:
            owner[k] = owner[before[k]] if before[k] >= 0 else i
            k = before[k]
    out = dict.fromkeys(clusters, -1)
    for j, i in enumerate(owner[: len(classes)]):
        if i >= 0 and cells.get((clusters[i], classes[j]), 0):
            out[clusters[i]] = classes[j]
    return out


def mapped(cells: DataFrame) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    known = {(r[0], r[1]): r[2] for r in cells.select("cluster", "class", "n").collect()}
    return mapping(known), known


def mapped_accuracy(cells: DataFrame) -> float:
    """Share of assigned bags whose cluster is mapped to their class."""
    to, known = mapped(cells)
    return sum(n for (c, k), n in known.items() if to.get(c) == k) / max(1, sum(n for (c, _), n in known.items() if c >= 0))


def accuracy(cells: DataFrame) -> DataFrame:
    """mapped_accuracy and error_rate as one row."""
    return cells.sparkSession.createDataFrame([(float(mapped_accuracy(cells)), float(error_rate(cells)))], "accuracy double, error_rate double")


def real_clusters(rows: DataFrame) -> DataFrame:
    """Of (cluster, label): how many clusters have members, how many classes occur, and how many bags are unassigned."""
    inside = F.when(F.col("cluster") >= 0, F.col("cluster"))
    return rows.agg(F.count_distinct(inside).alias("clusters"), F.count_distinct("label").alias("classes"), F.count_if(F.col("cluster") < 0).alias("unassigned"))


def class_sizes(rows: DataFrame) -> DataFrame:
    """Of (cluster, label): the bags of each class, and those of them that are in a cluster."""
    return rows.where("label is not null").groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") >= 0).alias("assigned"))


def rand_index(cells: DataFrame) -> DataFrame:
    """The pair-counting Rand index."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    c = cells.where("cluster >= 0")
    both = c.agg(pairs("n").alias("both"), F.sum("n").alias("t"))
    rows = c.groupBy("cluster").agg(F.sum("n").alias("n")).agg(pairs("n").alias("rows"))
    cols = c.groupBy("class").agg(F.sum("n").alias("n")).agg(pairs("n").alias("cols"))
    every = F.col("t") * (F.col("t") - 1) / 2
    return both.join(rows).join(cols).select(((every + 2 * F.col("both") - F.col("rows") - F.col("cols")) / every).alias("rand_index"))  # one row each


def per_class(cells: DataFrame) -> DataFrame:
    """class, precision, recall, f1, specificity under the mapping; unassigned bags of a class count as missed."""
    to, known = mapped(cells)
    classes = sorted({k for _, k in known})
    total = sum(n for (c, _), n in known.items() if c >= 0)
    rows = []
    for k in classes:
        mine = {c for c, m in to.items() if m == k}
        tp = sum(n for (c, j), n in known.items() if c in mine and j == k)
        fp = sum(n for (c, j), n in known.items() if c in mine and j != k)
        fn = sum(n for (c, j), n in known.items() if c not in mine and j == k)
        tn = total - tp - fp - sum(n for (c, j), n in known.items() if c not in mine and j == k and c >= 0)
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        rows.append((k, p, r, 2 * p * r / (p + r) if p + r else 0.0, tn / (tn + fp) if tn + fp else 0.0))
    return cells.sparkSession.createDataFrame(rows, "class int, precision double, recall double, f1 double, specificity double")


def error_rate(cells: DataFrame) -> float:
    """Percent of bags that are unassigned or in a cluster of another class."""
    to, known = mapped(cells)
    return 100 * (1 - sum(n for (c, k), n in known.items() if c >= 0 and to.get(c) == k) / sum(known.values()))


def macro(values: DataFrame, measure: str, sizes: dict[int, int] | None = None) -> float:
    """Of per_class: the value of class 1 if there are two classes, else the mean weighted by class size."""
    rows = {r["class"]: r[measure] for r in values.collect()}
    if set(rows) == {0, 1}:
        return rows[1]
    sizes = sizes or dict.fromkeys(rows, 1)
    return sum(rows[k] * sizes.get(k, 0) for k in rows) / max(1, sum(sizes.get(k, 0) for k in rows))


def macros(cells: DataFrame) -> DataFrame:
    """The macro value of each measure of per_class as one row, weighted by the sizes of classes (class 1's of two)."""
    values = per_class(cells)
    sizes = {r[0]: r[1] for r in cells.groupBy("class").agg(F.sum("n")).collect()}
    names = ("precision", "recall", "f1", "specificity")
    return cells.sparkSession.createDataFrame([tuple(float(macro(values, n, sizes)) for n in names)], ", ".join(f"{n} double" for n in names))


def render(cells: DataFrame) -> str:
    to, known = mapped(cells)
    classes = sorted({k for _, k in known})
    lines = ["cluster " + " ".join(f"{k:>8}" for k in classes) + "  class"]
    lines += [f"{c:>7} " + " ".join(f"{known.get((c, k), 0):>8}" for k in classes) + f"  {to.get(c, -1)}" for c in sorted({c for c, _ in known})]
    return "\n".join(lines)


# Predictions: (label, predicted), -1 for none


def rates(rows: DataFrame) -> DataFrame:
    part = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    none = F.col("predicted") < 0
    right = F.col("predicted") == F.col("label")
    return rows.agg(part(right).alias("success"), part(~right & ~none).alias("fail"), part(none).alias("unclassified"))


def kappa(rows: DataFrame) -> DataFrame:
    """Cohen's kappa; 1 where the denominator is 0."""
    cells = rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    n = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("a"))
    by = cells.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("x")).join(cells.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("y")), "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("e"))
    value = F.try_divide(F.col("t") * F.col("a") - F.col("e"), F.col("t") * F.col("t") - F.col("e"))
    return n.join(by).select(F.coalesce(value, F.lit(1.0)).alias("kappa"))  # one row each


def geometric_mean(rows: DataFrame) -> DataFrame:
    """Root of the product of recalls, by the number of classes that occur."""
    r = rows.groupBy("label").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("r"))
    return r.agg(F.when(F.min("r") == 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("r") > 0, F.col("r")))) / F.count("r"))).alias("geometric_mean"))


def auc(rows: DataFrame) -> DataFrame:
    """(1 + TPR - FPR) / 2 of two classes, class 1 positive; the mean over ordered pairs of more."""
    cells = rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    k = rows.select(F.col("label").alias("i")).distinct()
    pairs = k.join(k.toDF("j"), F.col("i") != F.col("j"))  # classes

    def pick(a: Column, b: Column) -> Column:
        return F.sum(F.when((F.col("label") == a) & (F.col("predicted") == b), F.col("n")).otherwise(0))

    i, j = F.col("i"), F.col("j")
    rows = pairs.join(cells, (cells.label == i) | (cells.label == j)).groupBy("i", "j").agg(pick(i, i).alias("tp"), pick(i, j).alias("fn"), pick(j, i).alias("fp"), pick(j, j).alias("tn"))
    tpr, fpr = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0)), F.coalesce(F.try_divide("fp", F.col("fp") + F.col("tn")), F.lit(0.0))
    return rows.agg(F.avg((1 + tpr - fpr) / 2).alias("auc"))


def multilabel(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """13 metrics of 0/1 array columns; terms that aren't defined leave their mean."""
    t, g = F.col(truth), F.col(guess)
    # numbered before the rows are taken apart
    flags = rows.withColumn("id", F.monotonically_increasing_id()).select("id", F.posexplode(F.arrays_zip(t.alias("t"), g.alias("g"))).alias("label", "s")).select("id", "label", F.col("s.t").cast("int").alias("t"), F.col("s.g").cast("int").alias("g"))
    tp, fp, fn, tn = (F.sum(((F.col("t") == a) & (F.col("g") == b)).cast("int")) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))

    def ratio(a, b):
        return F.try_divide(a, b)

    def counted(by: str) -> DataFrame:
        return flags.groupBy(by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))

    c = {n: F.col(n) for n in ("tp", "fp", "fn", "tn")}
    p, r = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tp"], c["tp"] + c["fn"])
    f = ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])
    half = (1 + r - F.coalesce(ratio(c["fp"], c["fp"] + c["tn"]), F.lit(0.0))) / 2
    by_row = counted("id").agg(F.avg(ratio(c["tp"], c["tp"] + c["fp"] + c["fn"])).alias("accuracy"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg((c["fp"] + c["fn"]) / (c["tp"] + c["fp"] + c["fn"] + c["tn"])).alias("hamming_loss"), F.avg((c["fp"] + c["fn"] == 0).cast("double")).alias("subset_accuracy"))
    by_label = counted("label").agg(F.avg(f).alias("macro_f"), F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(half).alias("macro_auc"))
    micro = flags.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn")).select(p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f"), half.alias("micro_auc"))
    return by_row.join(by_label).join(micro)  # one row each


def label_accuracy(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    z = F.arrays_zip(F.col(truth).alias("t"), F.col(guess).alias("g"))
    return rows.select(F.posexplode(z).alias("label", "s")).groupBy("label").agg(F.avg((F.col("s.t") == F.col("s.g")).cast("double")).alias("accuracy"))
