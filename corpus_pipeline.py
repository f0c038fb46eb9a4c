"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import line_dedup, mixing, near_dedup, piece_codec, quality
from pointloom.llm.common import Stage
from pointloom.llm.queries import piece_model


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that stay in another document."""
    return line_dedup.drop_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them, each at least once."""
    return mixing.mix(docs, Stage(spark, "mix"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded text of each document."""
    return piece_codec.encode_documents(docs, piece_model())


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_shared_lines),
    ("minhash near-dedup", one_of_each),
    ("source mixing", mixed),
    ("piece encoding and decoding", encoded),
]

#: SQL can express neither the classifier nor the near-duplicates nor the encoding; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = stage.table(step(spark, docs, sf_dir), f"stage{k}")
    return docs
