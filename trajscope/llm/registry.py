"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, licenses, merkle, mixture, ngram_join, pieces, quality, secrets, spelling, suffix_dedup, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language.op1_language_id,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_license_scans": licenses.op5_license_scans,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_warc": warc.op10_warc,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_source_mixture": mixture.op12_source_mixture,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op7_secret_scans": secrets.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_source_mixture": mixture.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
