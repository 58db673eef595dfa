"""Corrections: conservative records, fallbacks, overlay and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.anchors import anchor_merge, diff_ops

APPLIED, FALLBACK = "applied", "fallback_baseline"


def correction_records(answers: DataFrame, corrector: str, style: str) -> DataFrame:
    """Records of a corrector's answers (baseline_text, option_text, corrector_text, corrector_error).

    Only edits of the answer that touch where the readings differ are taken. An
    answer that failed (a non-empty error or no text) keeps the baseline.
    """
    failed = F.col("corrector_text").isNull() | (F.coalesce("corrector_error", F.lit("")) != "")
    rows = answers.withColumn("_failed", failed).withColumn("_try", F.when(failed, F.col("baseline_text")).otherwise(F.col("corrector_text")))
    rows = rows.withColumn("_m", anchor_merge(F.col("baseline_text"), F.col("option_text"), F.col("_try")))
    rows = rows.withColumn("_a", F.size(diff_ops(F.col("baseline_text"), F.col("option_text"))))
    kept = [c for c in answers.columns if c not in ("corrector_text", "corrector_error")]
    changed = F.col("_m.merged_text") != F.col("baseline_text")
    return rows.select(
        *kept,
        F.col("_a").alias("anchor_count"),
        F.lit(corrector).alias("corrector_name"),
        F.lit(style).alias("corrector_prompt_style"),
        F.when(F.col("_failed"), "").otherwise(F.col("corrector_text")).alias("corrector_text"),
        F.col("_m.merged_text").alias("conservative_merged_text"),
        F.size("_m.applied_ops").alias("applied_op_count"),
        (~F.col("_failed") & (F.col("_try") != F.col("baseline_text"))).alias("raw_changed"),
        changed.alias("merged_changed"),
        F.when(F.col("_failed"), FALLBACK).otherwise(APPLIED).alias("corrector_status"),
        F.coalesce("corrector_error", F.lit("")).alias("corrector_error"),
    )


def overlay(rows: DataFrame, corrections: DataFrame, keys: Sequence[str], text: str, corrected: str, ordinal: str | None = None) -> DataFrame:
    """Texts replaced by corrections of the same keys, the last one winning; ``corrected`` tells which."""
    last = corrections.where(F.col(corrected).isNotNull())
    last = last.groupBy(*keys).agg((F.max_by(corrected, ordinal) if ordinal else F.max(corrected)).alias("_new"))
    joined = rows.join(last, list(keys), "left")
    return joined.withColumn("was_corrected", F.col("_new").isNotNull()).withColumn(text, F.coalesce("_new", F.col(text))).drop("_new")


def counters(rows: DataFrame, groups: Sequence[str], status: str) -> DataFrame:
    """Rows processed, applied and fallen back."""
    return rows.groupBy(*groups).agg(F.count("*").alias("processed"), F.count_if(F.col(status) == APPLIED).alias("applied"), F.count_if(F.col(status) == FALLBACK).alias("fallback"))
