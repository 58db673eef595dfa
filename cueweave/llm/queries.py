"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from .encode import encode, token_counts
from .langid import fit_profiles, label_language, languages_of, mislabelled
from .lookalike import consistent_form, same_look_classes, same_look_pairs
from .moderation import fit, moderate, rates
from .packing import fill_report, pack
from .repetition import repetition_of, table_cutoffs
from .runs import collapse_runs


def _screen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir, "cues").select(F.lit("cues").alias("tab"), "source_id", F.col("cue_id").alias("item_id"), "text")
    merged = load(spark, sf_dir, "corrections").select(F.lit("corrections").alias("tab"), "source_id", F.col("correction_id").alias("item_id"), F.col("merged_text").alias("text"))
    return cues.unionByName(merged)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(_screen_texts(spark, sf_dir), ["tab", "source_id"], "item_id", "text").select("tab", "id_a", "id_b")


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    texts = _screen_texts(spark, sf_dir).dropDuplicates(["tab", "item_id"])
    return texts.select("tab", "item_id", consistent_form(spark, "text").alias("form"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of texts that look the same and differ, with its class and number of links."""
    return same_look_classes(_screen_texts(spark, sf_dir), ["tab", "source_id"], "item_id", "text").select("tab", F.col("id").alias("item_id"), "class_id", "links")


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, of one row or more, with its count and duration."""
    segments = load(spark, sf_dir, "segments").where("window_id is not null")
    return collapse_runs(segments, ["source_id", "window_id"], "start_ms", "end_ms", "segment_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_runs(spark, sf_dir).where("rows > 1").select(F.col("first_id").alias("first_segment_id"), F.col("last_id").alias("last_segment_id"))


def _labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir, "cues").select(F.lit("cues").alias("tab"), F.col("cue_id").alias("item_id"), "text", F.col("lang_tag").alias("label"))
    documents = load(spark, sf_dir, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("label"))
    return cues.unionByName(documents)


def _profiles(spark: SparkSession, sf_dir: str):
    labelled = _labelled_texts(spark, sf_dir).select(F.concat_ws(":", "tab", "item_id").alias("key"), label_language(F.col("label")).alias("lang"), "text")
    return fit_profiles(load(spark, sf_dir, "language_samples"), labelled)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = mislabelled(_labelled_texts(spark, sf_dir), _profiles(spark, sf_dir), "text", "label", ["tab", "item_id"])
    return wrong.distinct()


def p4_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of each text with its language and confidence."""
    found = languages_of(_labelled_texts(spark, sf_dir), _profiles(spark, sf_dir), "text", ["tab", "item_id"]).distinct()
    return found.select("tab", "item_id", F.posexplode("stretches").alias("stretch", "s")).select("tab", "item_id", "stretch", "s.*")


def p5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each answer that is repeated, with the cutoff of its stratum."""
    cutoffs = table_cutoffs(load(spark, sf_dir, "language_samples"), "lang", "text")
    answers = load(spark, sf_dir, "recognitions")
    return repetition_of(answers, "result_id", "normalized_text", "generated_token_count", cutoffs).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_repetition(spark, sf_dir).where("repeats").select("result_id").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, position and size of each document or piece, for each budget."""
    budgets = [tuple(r) for r in load(spark, sf_dir, "token_budgets").select("budget_id", "capacity_tokens").dropna().distinct().orderBy("budget_id").collect()]
    sizes = token_counts(load(spark, sf_dir, "documents"), "doc_id", "text")
    packed = pack(sizes, "doc_id", "tokens", [capacity for _, capacity in budgets])
    budget_id = F.element_at(F.array(*[F.lit(b) for b, _ in budgets]), F.col("budget") + 1)
    return packed.select(budget_id.alias("budget_id"), "capacity", "container_id", "doc_id", "piece", "start_in_item", "start_in_container", "size")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and share of space used, for each budget."""
    return fill_report(p7_containers(spark, sf_dir).withColumnRenamed("budget_id", "budget")).withColumnRenamed("budget", "budget_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and number of harmful passages of each document."""
    documents = load(spark, sf_dir, "documents")
    model = fit(load(spark, sf_dir, "moderation_examples"), load(spark, sf_dir, "language_samples"))
    return moderate(documents, model, "text", ["doc_id", "source"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("verdict <> 'none'").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmful documents and their share, for each source."""
    return rates(p8_scores(spark, sf_dir), "source")


QUERIES = {
    "p1_found": p1_found,
    "p1_consistent": p1_consistent,
    "p1_classes": p1_classes,
    "p3_found": p3_found,
    "p3_runs": p3_runs,
    "p4_found": p4_found,
    "p4_stretches": p4_stretches,
    "p5_found": p5_found,
    "p5_repetition": p5_repetition,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

SQL: dict[str, str] = {}
