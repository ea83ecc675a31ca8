"""The engine's tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type_id, x, y, z, m) of the embeddings' first four dimensions."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("type_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyzm")])


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(composition_id, position, multiplicity, child_id): orders and their parts."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("composition_id"), F.col("l_linenumber").alias("position"), F.col("l_quantity").cast("long").alias("multiplicity"), F.col("l_partkey").alias("child_id")
    )


def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type_id): orders by status."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type_id"))
