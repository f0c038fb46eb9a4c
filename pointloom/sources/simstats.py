"""Statistics files of simulators: a name, a number and a comment on each line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame, by: Sequence[str] = (), column: str = "value") -> DataFrame:
    """(by, name, value) of the lines that hold a name and a number; others are skipped."""
    shape = r"^\s*([A-Za-z_][\w.:]*)\s+([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\b"
    return lines.select(*by, F.regexp_extract(column, shape, 1).alias("name"), F.regexp_extract(column, shape, 2).alias("_v")).where("name <> ''").select(*by, "name", F.col("_v").cast("double").alias("value"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value) of all files under a path."""
    return parse(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), ["file"])


def rates(stats: DataFrame, by: Sequence[str], hits: str = ".hits", misses: str = ".misses") -> DataFrame:
    """(by, unit, hits, misses, hit_rate) of the units that count both."""
    unit = F.regexp_replace("name", r"\.(?:hits|misses)$", "")
    of = lambda end: F.max(F.when(F.endswith("name", F.lit(end)), F.col("value")))
    both = stats.withColumn("unit", unit).groupBy(*by, "unit").agg(of(hits).alias("hits"), of(misses).alias("misses")).where("hits IS NOT NULL AND misses IS NOT NULL")
    return both.withColumn("hit_rate", F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")))
