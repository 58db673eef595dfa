"""Manifests, image folders and ledgers as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relate import same_frame

MANIFEST = "index int, frame_index int, segment_index int, raw_index bigint, window_id int, bbox array<int>, start_ms bigint, end_ms bigint, image string, original string, masked string, mask string, lines string, masked_pixel_count bigint"
# Suffixes of images.
SUFFIXES = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")
LEDGER = "variant_id string, release_tag string, status string, release_published_at string, last_tested_at string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest with the entry they name; blank lines and rows without one are skipped."""
    rows = spark.read.schema(MANIFEST).json(path)
    entry = F.element_at(F.split(F.coalesce("image", "original", "masked"), "/"), -1)
    return rows.withColumn("entry", entry).where(F.col("entry").isNotNull() & (F.col("entry") != ""))


def masked_entries(rows: DataFrame) -> DataFrame:
    """All entries that share a frame with a masked one."""
    return same_frame(rows, F.coalesce("masked_pixel_count", F.lit(0)) > 0, ["frame_index"])


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Images under a folder by their relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = files.where(F.lower("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$"))
    base = root.removeprefix("file://").rstrip("/")
    relative = F.regexp_replace("path", r"^\w+:/+", "/")
    return wanted.select(F.substr(relative, F.lit(len(base) + 2)).alias("entry"), "path", "length", "content")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON ledger file."""
    whole = spark.read.schema(f"entries array<struct<{LEDGER.replace(' string', ':string')}>>").option("multiLine", "true").json(path)
    return whole.select(F.explode("entries").alias("e")).select("e.*")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """Names and values of a file of ``NAME=value`` lines; comments, ``export`` and paired quotes go."""
    line = F.regexp_replace(F.trim("value"), r"^export\s+", "")
    rows = spark.read.text(path).select(line.alias("l")).where(~F.col("l").startswith("#") & F.contains("l", F.lit("=")))
    value = F.trim(F.regexp_extract("l", r"^[^=]*=(.*)$", 1))
    return rows.select(F.trim(F.regexp_extract("l", r"^([^=]*)=", 1)).alias("name"), F.regexp_replace(value, r"^(['\"])(.*)\1$", "$2").alias("value")).where("name <> ''")


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files of a folder against expected digests (name, sha256): name, found, matches."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return expected.join(found, "name", "left").select("name", "found", F.col("found").eqNullSafe(F.col("sha256")).alias("matches"))
