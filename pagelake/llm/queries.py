"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, huffman, lines, media, ngrams, quality, simhash, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring.op1,
    "op2_mpeg_audio": media.op2,
    "op3_simhash_near_dedup": simhash.op3,
    "op4_toxicity_cnn": toxicity.op4,
    "op5_huffman_token_ids": huffman.op5,
    "op6_benchmark_decontamination": decontam.op6,
    "op7_quality_classifier": quality.op7,
    "op8_deleted_interpolation": ngrams.op8,
    "op9_byte_level_bpe": bpe.op9,
    "op10_line_dedup": lines.op10,
    "line_dedup_every_line": lines.every_line,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": substring.SQL, "op10_line_dedup": lines.SQL, "line_dedup_every_line": lines.EVERY_SQL}
