"""Queries over the driver's tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .archive import ARCHIVE_SQL, op9_archive_converter
from .bitslice_topk import TOP_K_SQL, op8_bit_sliced_top_k
from .decontaminate import CONTAMINATION_SQL, contamination
from .interpolated_lm import op2_deleted_interpolation
from .ordinal_toxicity import op5_ordinal_toxicity
from .pairwise_quality import op4_pairwise_quality
from .pieces import op7_sentencepiece_viterbi
from .simhash import simhash_components
from .token_counts import op3_offset_token_counts
from .url_templates import URL_SQL, op10_url_template_filter


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``, as ``simhash_components`` has them."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` against all of ``benchmark``, as ``contamination`` has it."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_offset_token_counts": op3_offset_token_counts,
    "op4_pairwise_quality": op4_pairwise_quality,
    "op5_ordinal_toxicity": op5_ordinal_toxicity,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_sentencepiece_viterbi": op7_sentencepiece_viterbi,
    "op8_bit_sliced_top_k": op8_bit_sliced_top_k,
    "op9_archive_converter": op9_archive_converter,
    "op10_url_template_filter": op10_url_template_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op6_benchmark_decontamination": CONTAMINATION_SQL,
    "op8_bit_sliced_top_k": TOP_K_SQL,
    "op9_archive_converter": ARCHIVE_SQL,
    "op10_url_template_filter": URL_SQL,
}
