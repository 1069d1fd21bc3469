"""Jobs by name: a clusterer with options on a dataset gives one row of metrics; an XML config gives evolutionary jobs.

The loops run over jobs, which a user lists; the data of a job stay in DataFrames, and the driver holds its metrics only.
"""

from __future__ import annotations

import inspect
import itertools
import re
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import HAUSDORFF, NAMES
from ..sources.files import evaluation_text, experiment_config
from . import external, indices
from .clusterers import CLUSTERERS
from .evoclusters import ALGORITHMS
from .lineage import saved

# The header of the results file
RESULT = ["Algorithm", "Configuration", "Dataset", "Distance Function", "Clusters", "Clusterd bags", "Unclustered bags", "RMSSD", "Silhouete", "XB", "DB", "S_Dbw", "DBCV", "Entropy", "Purity", "Rand index", "Precision", "Recall", "F1", "Specificity", "Conf Matrix", "Time", "Report"]
COUNTS = ("Clusters", "Clusterd bags", "Unclustered bags")
TEXTS = ("Algorithm", "Configuration", "Dataset", "Distance Function", "Conf Matrix", "Report")
SCHEMA = ", ".join(f"`{c}` {'long' if c in COUNTS else 'string' if c in TEXTS else 'double'}" for c in RESULT)


def evaluated(bags: DataFrame, found: DataFrame, distance: str = "maxmin") -> tuple[dict, str]:
    """All metrics of an assignment (bag_idx, cluster) under the names of the results file, and its confusion table as text.

    Bags without a label count in the internal indices only; what isn't defined is null."""
    found = saved(found.select("bag_idx", "cluster"))
    rows = found.join(bags.select("bag_idx", "label"), "bag_idx")
    cells = saved(external.confusion(rows))
    inner = indices.full_evaluation(bags, found, distance)
    n = rows.agg(F.count_if(F.col("cluster") >= 0).alias("inside"), F.count_if(F.col("cluster") < 0).alias("outside")).first()
    table = {(r.cluster, r["class"]): r.n for r in cells.collect()}
    outer: dict = {}
    if table:
        per = saved(external.per_class(cells))
        sizes = {k: sum(v for (_, c), v in table.items() if c == k) for _, k in table}
        outer = {"Rand index": external.mapped_accuracy(cells)} | {label: external.macro(per, name, sizes) for label, name in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("Specificity", "specificity"))}
    classes = sorted({k for _, k in table})
    line = "; ".join(f"{c}: " + " ".join(str(table.get((c, k), 0)) for k in classes) for c in sorted({c for c, _ in table}))
    metrics = {
        "Clusters": external.real_clusters(rows).first()["clusters"],
        "Clusterd bags": n.inside,
        "Unclustered bags": n.outside,
        **{label: inner.get(name) for label, name in (("RMSSD", "rmsstd"), ("Silhouete", "silhouette"), ("XB", "xie_beni"), ("DB", "davies_bouldin"), ("S_Dbw", "s_dbw"), ("DBCV", "dbcv"))},
        "Entropy": external.entropy(cells).first()[0],
        "Purity": external.purity(cells).first()[0],
        **{k: outer.get(k) for k in ("Rand index", "Precision", "Recall", "F1", "Specificity")},
        "Conf Matrix": line,
    }
    return metrics, external.render(cells)


def run(spark: SparkSession, jobs: Iterable[tuple[str, dict, str]], dataset: Callable[[str], DataFrame], report: Callable[[str, str], str] | None = None) -> DataFrame:
    """One row of RESULT per job (name of a clusterer, its options, name of a dataset).

    dataset(name) gives bags (bag_idx, bag, label).  report(title, text) stores the whole evaluation and returns where; null
    without it.  OPTICS orders bags and assigns none, so it can't be a job.  An unknown name is an error that lists the known."""
    rows = []
    for name, options, data in jobs:
        if name not in CLUSTERERS or name == "optics":
            raise ValueError(f"no clusterer named {name}; there are {', '.join(k for k in CLUSTERERS if k != 'optics')}")
        clusterer, bags = CLUSTERERS[name](**options), dataset(data)
        distance, began = getattr(clusterer, "distance", "maxmin"), time.perf_counter()
        found = saved(clusterer.fit(bags))
        seconds = time.perf_counter() - began
        metrics, table = evaluated(bags, found, distance)
        said = " ".join(f"{k}={v}" for k, v in options.items())
        numbers = {k: v for k, v in metrics.items() if k not in TEXTS and v is not None}
        where = report(f"{name} {data}", evaluation_text(f"{name} {said}".strip(), numbers, table)) if report else None
        rows.append({"Algorithm": name, "Configuration": said, "Dataset": data, "Distance Function": distance, **metrics, "Time": seconds, "Report": where})
    return spark.createDataFrame([tuple(r[c] for c in RESULT) for r in rows], SCHEMA)  # one row per job


def singles(node) -> list:
    """All configs that a parsed one stands for: an element with multi="true" is any one of the elements in it."""
    if isinstance(node, list):
        return [list(c) for c in itertools.product(*map(singles, node))]
    if not isinstance(node, dict):
        return [node]
    if node.get("@multi") == "true":
        inside = itertools.chain.from_iterable(v if isinstance(v, list) else [v] for k, v in node.items() if k != "@multi")
        return [s for x in inside for s in singles(x)]
    return [dict(zip(node, c, strict=True)) for c in itertools.product(*(singles(v) for v in node.values()))]


def distance_of(element: dict) -> str:
    """The name of a distance element: the type without packages and "Distance"; the Hausdorff kind is an option."""
    name = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", element["@type"].rpartition(".")[2].removesuffix("Distance")).lower()
    if name == "hausdorff":
        kind = re.search(r"-hausdorff-type\s+(\d)", element.get("config", ""))
        return {v: k for k, v in HAUSDORFF.items()}[int(kind[1]) if kind else 0]
    if name not in NAMES:
        raise ValueError(f"no distance named {name}; there are {', '.join(NAMES)}")
    return name


def evolutionary_jobs(text: str) -> list[tuple[str, str, dict]]:
    """(algorithm, dataset, arguments) of every single job of an XML config; what an algorithm doesn't take is left out."""
    out = []
    for job in singles(experiment_config(text)):
        for process in job["process"] if isinstance(job["process"], list) else [job["process"]]:
            name = process["@algorithm-type"].rpartition(".")[2]
            if name not in ALGORITHMS:
                raise ValueError(f"no algorithm named {name}; there are {', '.join(ALGORITHMS)}")
            rated, mutator = process["evaluator"], process.get("mutator", {})
            inner = mutator.get("decorated", {})
            given = {
                "n": (int, process.get("population-size")),
                "generations": (int, process.get("max-of-generations")),
                "seed": (int, process.get("rand-gen-factory", {}).get("@seed")),
                "k": (int, rated.get("num-clusters")),
                "kmin": (int, rated.get("kmin")),
                "kmax": (int, rated.get("kmax")),
                "metric": (str.lower, rated.get("metric")),
                "distance": (distance_of, rated.get("distance")),
                "p": (float, inner.get("@locus-mut-prob") if isinstance(inner, dict) else None),
                "p_mutate": (float, mutator.get("mut-prob")),
            }
            takes = inspect.signature(ALGORITHMS[name]).parameters
            out.append((name, rated["dataset"], {k: kind(v) for k, (kind, v) in given.items() if v is not None and k in takes}))
    return out


def evolve(text: str, dataset: Callable[[str], DataFrame]) -> list[tuple[str, str, dict, DataFrame]]:
    """(algorithm, dataset, arguments, last population) of each job of an XML config."""
    return [(name, data, given, ALGORITHMS[name](dataset(data), **given)) for name, data, given in evolutionary_jobs(text)]
