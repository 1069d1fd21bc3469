from pyspark.sql import functions as F

from satchel.llm import ngram_join, shared


def test_tables_of_millions_of_hashes_are_not_broadcast(spark):
    few = shared.written(spark.range(1000).select(F.xxhash64("id").alias("h")), "few")
    many = shared.written(spark.range(600_000).select(F.xxhash64("id").alias("h")), "many")
    assert shared.light(few) is not few and shared.light(many) is many
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        shared.modest_broadcasts(spark)
        assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) == shared.LIGHT
        assert ngram_join.BROADCAST_ROWS * 16 <= shared.LIGHT
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
