"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import bpe, fingerprints, language, licenses, lines, lm, mixing, near, negatives, oracle, quality, resampling, secrets, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": near.op1_ngram_join,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_lm_score": lm.op4_lm_score,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_language_id": language.op6_language_id,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_license_scan": licenses.op12_license_scan,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
