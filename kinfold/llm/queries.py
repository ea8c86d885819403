"""The registered queries of the corpus operators, one per operator, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hardneg, langid, linededup, mixing, nearest, pii, prefixtrie, quality, simhash, substring, suffix, toxicity
from .common import documents


def _over_documents(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _over_documents(quality.query),
        "op2_mix_sources": _over_documents(mixing.query),
        "op3_simhash": _over_documents(simhash.query),
        "op4_pii": _over_documents(pii.query),
        "op5_decontamination": lambda spark, sf_dir: decontam.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
        "op6_substring_dedup": _over_documents(substring.query),
        "op7_line_dedup": _over_documents(linededup.query),
        "op8_suffix_dedup": _over_documents(suffix.query),
        "op9_toxicity": lambda spark, sf_dir: toxicity.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op10_language_id": _over_documents(langid.query),
        "op11_hard_negatives": lambda spark, sf_dir: hardneg.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op12_prefix_trie": lambda spark, sf_dir: prefixtrie.query(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        "op13_nearest_neighbours": lambda spark, sf_dir: nearest.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.SQL,
        "op4_pii": pii.SQL,
        "op6_substring_dedup": substring.SQL,
        "op7_line_dedup": linededup.SQL,
        "op8_suffix_dedup": suffix.SQL,
        "op11_hard_negatives": hardneg.SQL,
        "op12_prefix_trie": prefixtrie.SQL,
    }
