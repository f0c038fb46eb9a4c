"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import EXACT_SQL, exact_dedup
from .line_dedup import LINES_SQL, line_bitmaps
from .mixing import mix_sql, plan_mix
from .near_dedup import near_classes
from .pii import find_personal_data
from .piece_codec import encode_documents
from .common import Stage
from .toxicity import score_documents
from . import quality
from .topk import TOP_SQL, top_k
from .url_filter import Rule, judge_sql, judge_urls

#: Rules of op6: (host, path, verdict).
URL_RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def piece_model() -> str:
    """Place of the piece vocabulary; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_bitmaps(_read(spark, sf_dir, "documents"), with_text=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(_read(spark, sf_dir, "documents"), Stage(spark, "mix"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_read(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "n_spans")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_read(spark, sf_dir, "documents"), piece_model())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_line_dedup": op2_line_dedup,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality": op4_quality,
        "op5_near_dedup": op5_near_dedup,
        "op6_url_filter": op6_url_filter,
        "op7_exact_top_k": op7_exact_top_k,
        "op8_source_mixing": op8_source_mixing,
        "op9_personal_data": op9_personal_data,
        "op10_piece_codec": op10_piece_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINES_SQL, "op3_exact_dedup": EXACT_SQL, "op6_url_filter": judge_sql(URL_RULES), "op7_exact_top_k": TOP_SQL, "op8_source_mixing": mix_sql()}
