"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .scan import bucket_of, carry_in, packed_keys, stitch, with_carry

#: Width of a scan bucket. It bounds a task's group: at most this many distinct starts.
BUCKET_MS = 3_600_000


def interval_pieces(df: DataFrame, keys: Sequence[str], start: str, end: str, row_id: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Islands of each (keys, bucket): _k (the keys), _b, _no, p_start, p_end, lo, hi, prev_end, cont, last.

    Starts are sorted per entity and compared with the running maximum of the
    ends before them, which includes the carry from earlier buckets; a start
    beyond it opens an island (touching intervals join). Rows of one start are
    aggregated first, so that a bucket never holds more rows than milliseconds.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    rows = rows.select(packed_keys(keys), F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(row_id).alias("_id"))
    rows = rows.withColumn("_b", bucket_of("_start", bucket_ms))
    keys = ["_k"]
    carries = carry_in(rows, keys, "_b", F.max("_end"), "max")
    starts = rows.groupBy(*keys, "_b", "_start").agg(F.max("_end").alias("_end"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    whole = Window.partitionBy(*keys, "_b")
    scan = whole.orderBy("_start")
    before = F.greatest(F.col("carry"), F.max("_end").over(scan.rowsBetween(Window.unboundedPreceding, -1)))
    marked = with_carry(starts, carries, keys, "_b").withColumn("_before", before)
    marked = marked.withColumn("_new", F.col("_before").isNull() | (F.col("_start") > F.col("_before")))
    marked = marked.withColumn("_no", F.sum(F.col("_new").cast("long")).over(scan))
    pieces = marked.groupBy(*keys, "_b", "_no").agg(
        F.min("_start").alias("p_start"),
        F.max("_end").alias("p_end"),
        F.min("_lo").alias("lo"),
        F.max("_hi").alias("hi"),
        F.min(F.when(F.col("_new"), F.col("_before"))).alias("prev_end"),
        (F.col("_no") == 0).alias("cont"),
    )
    return pieces.withColumn("last", F.col("_no") == F.max("_no").over(whole))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, row_id: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Periods and gaps per entity: keys, kind, start_ms, end_ms, multi.

    ``kind`` is ``period`` or ``gap``; ``multi`` tells whether a period has two
    or more rows (always false for gaps). Intervals that overlap, nest or touch
    form one period. Rows with a null start or end, or an end not after the
    start, are left out. Rows with equal ``row_id`` are one row. Null keys are a
    key of their own. Other columns are ignored; an empty table gives no rows.
    """
    pieces = stage(interval_pieces(df, keys, start, end, row_id, bucket_ms), "interval-pieces")
    merged = stitch(pieces, ["_k"], "_b", "_no", "cont", "last", {"p_start": F.min("p_start"), "p_end": F.max("p_end"), "lo": F.min("lo"), "hi": F.max("hi")})
    periods = merged.select("_k.*", F.lit("period").alias("kind"), F.col("p_start").alias("start_ms"), F.col("p_end").alias("end_ms"), (F.col("lo") != F.col("hi")).alias("multi"))
    gaps = pieces.where(~F.col("cont") & F.col("prev_end").isNotNull())
    gaps = gaps.select("_k.*", F.lit("gap").alias("kind"), F.col("prev_end").alias("start_ms"), F.col("p_start").alias("end_ms"), F.lit(False).alias("multi"))
    return periods.unionByName(gaps)
