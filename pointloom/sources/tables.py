"""Points taken from relational tables, and the modular test cloud. Schema: pid, x, y, z (single precision)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), e[0].alias("x"), e[1].alias("y"), e[2].alias("z"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, price in thousands, discount in per cent; + 0.0 removes negative zeros."""
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("float").alias("x"),
        (F.col("l_extendedprice") / 1000).cast("float").alias("y"), (F.col("l_discount") * 100 + F.lit(0.0)).cast("float").alias("z"),
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each day: x the user, y the hour of the day, z the value."""
    return read(spark, sf_dir, "events").select(
        F.to_date("ts").alias("frame"), F.col("event_id").alias("pid"), F.col("user_id").cast("float").alias("x"),
        F.hour("ts").cast("float").alias("y"), F.col("value").cast("float").alias("z"),
    )


def from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("float").alias("x"), (F.col("p_retailprice") / 100).cast("float").alias("y"), (F.col("p_partkey") % 50).cast("float").alias("z"))


def modular_cloud(spark: SparkSession, n: int) -> DataFrame:
    """x = (3i + 1) mod 97, y = (5i + 7) mod 89, z = (7i + 13) mod 83 for i < n (fixed values of the test cloud)."""
    i = F.col("id")
    return spark.range(n).select(i.alias("pid"), ((i * 3 + 1) % 97).cast("float").alias("x"), ((i * 5 + 7) % 89).cast("float").alias("y"), ((i * 7 + 13) % 83).cast("float").alias("z"))
