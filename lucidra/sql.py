"""Scalar functions registered for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lucidra.functions import text


def register(spark: SparkSession) -> list[str]:
    """Register the Arrow functions under their names; returns the names."""
    names = ["normalize_answer", "token_f1", "exact_match", "question_hash", "unique_strings", "parse_sequence", "resolve_placeholders", "canonical_hash"]
    for n in names:
        spark.udf.register(n, getattr(text, n))
    return names
