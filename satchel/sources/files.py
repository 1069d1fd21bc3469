"""ARFF and KEEL files, label counts, and result sinks.  Headers are read on the driver, data lines are parsed in plans."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", re.I)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) != '' and not startswith(trim(value), '%')")


def header(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, type) of the attributes, in order; those of a relational attribute as relation.name."""
    out, inside = [], None
    for r in _lines(spark, path).where("startswith(trim(value), '@')").collect():
        line = r[0].strip()
        if m := _ATTRIBUTE.match(line):
            name, kind = m[1].strip("'\""), m[2].strip()
            if kind.lower() == "relational":
                inside = name
                out.append((name, "relational"))
            else:
                out.append((f"{inside}.{name}" if inside else name, kind))
        elif line.lower().startswith("@end"):
            inside = None
    return out


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Multi-instance ARFF: (bag_id, bag, label); ? is null, labels are numbered in the order of the header.

    Lines of one bag id are one bag (its parts in the order of their text).
    """
    known = header(spark, path)
    classes = [v.strip().strip("'\"") for v in known[-1][1].strip("{} ").split(",")]
    data = _lines(spark, path).where("not startswith(trim(value), '@')")
    part = lambda k: F.regexp_extract(F.trim("value"), r"^('[^']*'|\"[^\"]*\"|[^,]*),\s*('[^']*'|\"[^\"]*\"),\s*(.*)$", k)
    clean = lambda c: F.regexp_replace(c, "^['\"]|['\"]$", "")
    rows = F.transform(F.split(clean(part(2)), r"\\n"), lambda r: F.transform(F.split(r, ","), lambda v: F.when(F.trim(v) != "?", F.trim(v)).cast("double")))
    parsed = data.select(clean(part(1)).alias("bag_id"), rows.alias("bag"), (F.array_position(F.array(*(F.lit(c) for c in classes)), clean(F.trim(part(3)))) - 1).cast("int").alias("label"))
    grouped = parsed.groupBy("bag_id").agg(F.sort_array(F.collect_list("bag")).alias("b"), F.first("label").alias("label"))
    return grouped.select("bag_id", F.flatten("b").alias("bag"), "label")


def write_arff(bags: DataFrame, path: str, relation: str = "bags", classes: tuple = (0, 1)) -> None:
    """(bag_id, bag, label) as one folder of text files: part 0 begins with the header."""
    spark = bags.sparkSession
    d = bags.select(F.size(F.col("bag")[0])).first()[0]
    head = [f"@relation {relation}", "@attribute bag_id string", "@attribute bag relational", *(f"  @attribute f{i + 1} numeric" for i in range(d)), "@end bag", f"@attribute class {{{','.join(map(str, classes))}}}", "@data"]
    inst = F.array_join(F.transform("bag", lambda x: F.array_join(F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("?"))), ",")), "\\n")
    body = bags.select(F.concat_ws(",", "bag_id", F.concat(F.lit('"'), inst, F.lit('"')), F.coalesce(F.col("label").cast("string"), F.lit("?"))).alias("value"))
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/0-header")
    body.write.text(f"{path}/1-data")


def read_keel(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows bagId, v1, ..., vd, class: (bag_id, bag, label text), instances in the order of their values."""
    data = _lines(spark, path).where("not startswith(trim(value), '@')").select(F.transform(F.split("value", ","), lambda v: F.trim(v)).alias("v"))
    rows = data.select(F.col("v")[0].alias("bag_idx"), F.transform(F.slice("v", F.lit(2), F.size("v") - 2), lambda x: F.when(x != "?", x).cast("double")).alias("x"), F.element_at("v", -1).alias("y"))
    bags = rows.groupBy("bag_idx").agg(F.sort_array(F.collect_list("x")).alias("bag"), F.min("y").alias("label"))
    return bags.withColumnRenamed("bag_idx", "bag_id")


def read_multilabel(spark: SparkSession, path: str, labels: int) -> DataFrame:
    """Rows of numbers whose last ``labels`` columns are 0/1: (x, y)."""
    data = _lines(spark, path).where("not startswith(trim(value), '@')").select(F.transform(F.split("value", ","), lambda v: F.trim(v).cast("double")).alias("v"))
    n = F.size("v") - labels
    return data.select(F.slice("v", F.lit(1), n).alias("x"), F.slice("v", n + 1, F.lit(labels)).alias("y"))


def label_count(text: str) -> int:
    """Number of label elements in an XML text."""
    return sum(1 for e in ET.fromstring(text).iter() if e.tag.rpartition("}")[2] == "label")


def experiment_config(text: str) -> dict:
    """An XML job as nested dicts: attributes under @name, repeated elements as lists."""
    def one(e):
        out: dict = {f"@{k}": v for k, v in e.attrib.items()}
        for c in e:
            out.setdefault(c.tag, []).append(one(c))
        if not out:
            return (e.text or "").strip()
        return {k: v[0] if isinstance(v, list) and len(v) == 1 else v for k, v in out.items()}

    return one(ET.fromstring(text))


def expanded(config: dict) -> list[dict]:
    """All single jobs of a config whose lists under keys marked multi stand for alternatives."""
    jobs = [{}]
    for k, v in config.items():
        options = v if isinstance(v, list) else [v]
        jobs = [{**j, k: o} for j in jobs for o in options]
    return jobs


def write_optics(order: DataFrame, path: str) -> None:
    """One line per bag in cluster order; UNDEFINED for what isn't defined."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("UNDEFINED"))
    order.orderBy("ord").select(F.concat_ws(" ", F.col("ord").cast("string"), F.col("bag_idx").cast("string"), said("core"), said("reach")).alias("value")).write.text(path)


def write_reachability(order: DataFrame, path: str) -> None:
    """The reachability table (ord, bag_idx, core, reach) as Parquet, in ranges of the cluster order; null where undefined."""
    order.repartitionByRange("ord").sortWithinPartitions("ord").write.mode("overwrite").parquet(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def evaluation_text(name: str, metrics: dict[str, float], confusion: str) -> str:
    width = max(map(len, metrics), default=0)
    return "\n".join([f"=== {name} ===", confusion, "", *(f"{k:<{width}}  {v:.12g}" for k, v in metrics.items())])


def write_classification(rows: DataFrame, folder: str, name: str, seconds: float | None = None) -> None:
    """Of predictions (id, label, predicted; predicted -1 for none) of one run: every row as CSV below ``folder``/name, and
    one row of rates appended to ``folder``/global."""
    from ..operators import external

    rows.select("id", "label", "predicted").write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    parts = [external.rates(rows), external.kappa(rows), external.geometric_mean(rows), external.auc(rows)]
    whole = rows.agg(F.count(F.lit(1)).alias("rows"))
    for one in parts:
        whole = whole.join(one)  # one row each
    whole = whole.select(F.lit(name).alias("run"), "rows", "success", "fail", "unclassified", "kappa", "geometric_mean", "auc", F.lit(seconds).cast("double").alias("seconds"))
    write_results(whole, f"{folder}/global")


def survey_text(rows: DataFrame, names: list[str] | None = None) -> str:
    """A survey of clusters (centres.survey) as text: a line of means and one of deviations for each attribute."""
    found = {(r.cluster, r.dim): r for r in rows.collect()}  # clusters times attributes
    clusters, dims = sorted({c for c, _ in found}), sorted({d for _, d in found})
    sizes = {c: next(r.bags for (k, _), r in found.items() if k == c) for c in clusters}
    cell = lambda v: "" if v is None else f"{v:.4f}"
    lines = [["Attribute", *("Full data" if c < 0 else str(c) for c in clusters)], ["", *(f"({sizes[c]})" for c in clusters)]]
    for d in dims:
        lines.append([names[d] if names else f"x{d}", *(cell(found[c, d].mean) if (c, d) in found else "" for c in clusters)])
        lines.append(["", *(f"+/-{cell(found[c, d].std)}" if (c, d) in found and found[c, d].std is not None else "" for c in clusters)])
    widths = [max(len(line[k]) for line in lines) for k in range(len(clusters) + 1)]
    return "\n".join("  ".join(x.rjust(w) if k else x.ljust(w) for k, (x, w) in enumerate(zip(line, widths, strict=True))).rstrip() for line in lines)
