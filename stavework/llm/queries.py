"""The corpus operators as named queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stavework.llm import (
    centroid_clustering,
    decontamination,
    exact_dedup,
    html_text,
    language_id,
    line_dedup,
    merkle_manifest,
    phrase_fingerprint,
    quality,
    secret_scan,
    sentencepiece_bpe,
    simhash,
    substring_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.query,
    "op2_benchmark_decontamination": decontamination.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_document_fingerprints": phrase_fingerprint.query,
    "op6_line_dedup": line_dedup.query,
    "op7_html_extraction": html_text.query,
    "op8_sentencepiece": sentencepiece_bpe.query,
    "op9_quality_classifier": quality.query,
    "op10_language_id": language_id.query,
    "op11_merkle_manifest": merkle_manifest.query,
    "op12_centroid_clustering": centroid_clustering.query,
    "op13_exact_dedup": exact_dedup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op11_merkle_manifest": merkle_manifest.ORACLE_SQL,
    "op12_centroid_clustering": centroid_clustering.ORACLE_SQL,
    "op13_exact_dedup": exact_dedup.ORACLE_SQL,
}
