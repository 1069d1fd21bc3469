"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def saved_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; only where that is unset and the master is local, below a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bags-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def saved(df: DataFrame) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back."""
    path = saved_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def light(df: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """df kept, with a broadcast hint if its files are small: a row per bag joins the pair table without dealing its rows."""
    kept = saved(df)
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(kept) if size <= most_bytes else kept
