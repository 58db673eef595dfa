"""Problem 2: periods and gaps of segments and cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.intervals import periods_and_gaps
from .session import load

GAP_LIMIT_MS = 600_000


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = load(spark, sf_dir, "segments").where("window_id is not null")
    segments = segments.select(F.lit("segments").alias("tab"), "source_id", "window_id", "start_ms", "end_ms", F.col("segment_id").alias("row_id"))
    cues = load(spark, sf_dir, "cues")
    cues = cues.select(F.lit("cues").alias("tab"), "source_id", F.lit(-1).alias("window_id"), "start_ms", "end_ms", F.col("cue_id").alias("row_id"))
    found = periods_and_gaps(segments.unionByName(cues), ["tab", "source_id", "window_id"], "start_ms", "end_ms", "row_id")
    wanted = ((F.col("kind") == "period") & F.col("multi")) | ((F.col("kind") == "gap") & (F.col("end_ms") - F.col("start_ms") <= GAP_LIMIT_MS))
    return found.where(wanted).select("tab", "source_id", "window_id", "kind", "start_ms", "end_ms")


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": f"""
WITH r AS (
  SELECT DISTINCT 'segments' AS tab, source_id, window_id, start_ms, end_ms, segment_id AS row_id FROM segments
  WHERE window_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms > start_ms
  UNION ALL
  SELECT DISTINCT 'cues', source_id, -1, start_ms, end_ms, cue_id FROM cues WHERE start_ms IS NOT NULL AND end_ms > start_ms
), m AS (
  SELECT *, max(end_ms) OVER (PARTITION BY tab, source_id, window_id ORDER BY start_ms, end_ms, row_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM r
), f AS (
  SELECT *, sum(CASE WHEN prev_end IS NULL OR start_ms > prev_end THEN 1 ELSE 0 END)
    OVER (PARTITION BY tab, source_id, window_id ORDER BY start_ms, end_ms, row_id) AS island FROM m
), g AS (
  SELECT tab, source_id, window_id, island, min(start_ms) AS s, max(end_ms) AS e, count(*) AS n FROM f GROUP BY ALL
), h AS (
  SELECT *, lead(s) OVER (PARTITION BY tab, source_id, window_id ORDER BY s) AS nxt FROM g
)
SELECT tab, source_id, window_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM g WHERE n > 1
UNION ALL
SELECT tab, source_id, window_id, 'gap', e, nxt FROM h WHERE nxt - e <= {GAP_LIMIT_MS}
""",
}
