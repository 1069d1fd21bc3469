"""Bag views over the tables: (bag_idx, bag, label), bag being array<array<double>> in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nested(instances: DataFrame) -> DataFrame:
    """Bags of (bag_idx, ord, x, label): instances in the order of ord, the label of the first one."""
    grouped = instances.groupBy("bag_idx").agg(F.sort_array(F.collect_list(F.struct("ord", "x"))).alias("b"), F.min_by("label", "ord").alias("label"))
    return grouped.select("bag_idx", F.col("b.x").alias("bag"), F.col("label").cast("int"))


def long(bags: DataFrame) -> DataFrame:
    """One row per instance: bag_idx, inst_idx, x, label."""
    return bags.select("bag_idx", F.posexplode("bag").alias("inst_idx", "x"), "label")


def _plain(c: str) -> Column:
    return F.col(c) + F.lit(0.0)  # -0.0 becomes 0.0


def vector_instances(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 5).alias("bag_idx"), F.col("vec_id").alias("ord"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


def vector_bags(spark: SparkSession, folder: str) -> DataFrame:
    return nested(vector_instances(spark, folder))


def user_instances(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("bag_idx"), F.col("event_id").alias("ord"), F.array(_plain("value"), F.hour("ts").cast("double")).alias("x"), (F.col("user_id") % 2).alias("label"))


def user_bags(spark: SparkSession, folder: str) -> DataFrame:
    return nested(user_instances(spark, folder))


def order_instances(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end").alias("label"))
    x = F.array(*(_plain(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    return items.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("bag_idx"), F.struct("l_linenumber", x.alias("x")).alias("ord"), x.alias("x"), "label")


def order_bags(spark: SparkSession, folder: str) -> DataFrame:
    return nested(order_instances(spark, folder))


def supplier_instances(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 2).alias("label"))
    x = F.array(*(_plain(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    return items.join(suppliers, "l_suppkey").select(F.col("l_suppkey").alias("bag_idx"), F.struct("l_orderkey", "l_linenumber", x.alias("x")).alias("ord"), x.alias("x"), "label")
