"""Ordered scans over groups of any size.

A window over a whole entity puts the entity into one task. The scans here cut
each entity into buckets of its order column, scan the buckets apart, and carry
what a bucket needs from the ones before it through a summary of one row per
bucket. ``stitch`` then joins the pieces that cross bucket borders, of which
there are at most two per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket_of(column: str, width: int) -> Column:
    """Whole number of the bucket, also below zero."""
    value = F.col(column).cast("long")
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def carry_in(rows: DataFrame, keys: Sequence[str], bucket: str, summary: Column, combine: str) -> DataFrame:
    """For each (keys, bucket) what the buckets before it hand over, as ``carry``.

    ``summary`` is an aggregate per bucket, combined map-side before the shuffle.
    ``combine`` is ``max`` (running maximum of the summaries), ``last`` (the
    summary of the nearest earlier bucket) or ``next`` (of the nearest later one).
    """
    per_bucket = rows.groupBy(*keys, bucket).agg(summary.alias("_s"))
    order = Window.partitionBy(*keys).orderBy(bucket)
    if combine == "max":
        carried = F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    elif combine == "last":
        carried = F.lag("_s").over(order)
    elif combine == "next":
        carried = F.lead("_s").over(order)
    else:
        raise ValueError(f"unknown combine {combine!r}")
    return per_bucket.select(*keys, bucket, carried.alias("carry"))


def with_carry(rows: DataFrame, carries: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """``rows`` with the ``carry`` of their bucket; null keys meet null keys.

    Where ``keys`` is one column that is never null, such as that of
    ``packed_keys``, the join is a plain one and keeps the partitioning of the
    windows around it.
    """
    by = [*keys, bucket]
    if not any(rows.schema[k].nullable for k in keys):
        return rows.join(carries, by, "left")
    right = carries.select(*[F.col(k).alias(f"_r_{k}") for k in by], "carry")
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return rows.join(right, cond, "left").drop(*[f"_r_{k}" for k in by])


def packed_keys(keys: Sequence[str]) -> Column:
    """All keys as one column that is never null and in which nulls are equal."""
    return F.struct(*[F.col(k) for k in keys]).alias("_k")


def with_neighbour(rows: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], fields: Sequence[str], name: str, ahead: bool = False) -> DataFrame:
    """``rows`` with ``order`` and ``fields`` of the row before (or ahead) of their keys as a struct.

    Within a bucket that is a window; the first (or last) row of a bucket takes
    the last (or first) row of the nearest bucket with rows. ``order`` must rise
    with the bucket and tell rows apart.
    """
    row = F.struct(*dict.fromkeys([*order, *fields]))
    carries = carry_in(rows, keys, bucket, F.min(row) if ahead else F.max(row), "next" if ahead else "last")
    scan = Window.partitionBy(*keys, bucket).orderBy(*order)
    inside = F.lead(row).over(scan) if ahead else F.lag(row).over(scan)
    return with_carry(rows, carries, keys, bucket).withColumn(name, F.coalesce(inside, F.col("carry"))).drop("carry")


def stitch(pieces: DataFrame, keys: Sequence[str], bucket: str, order: str, cont: str, last: str, aggregates: Mapping[str, Column]) -> DataFrame:
    """Join pieces across bucket borders.

    ``cont`` marks a piece that continues the last piece of an earlier bucket,
    ``last`` the last piece of its bucket. Pieces that are neither pass through;
    the rest, at most two per bucket, are chained by a cumulative count.
    ``pieces`` is read twice, so it should be a staged table.
    """
    names = list(aggregates)
    inner = pieces.where(~F.col(cont) & ~F.col(last)).select(*keys, *names)
    chain = F.sum(F.when(F.col(cont), 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy(bucket, order))
    edges = pieces.where(F.col(cont) | F.col(last)).withColumn("_chain", chain)
    joined = edges.groupBy(*keys, "_chain").agg(*[a.alias(n) for n, a in aggregates.items()]).select(*keys, *names)
    return inner.unionByName(joined)


def numbered(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with a row number per keys from 1, in order of ``bucket`` and ``order``.

    Each bucket is numbered apart and shifted by the rows of the buckets before
    it, so no task sorts a whole entity.
    """
    rows = df.withColumn("_nk", F.struct(*[F.col(k) for k in keys]))
    counts = rows.groupBy("_nk", bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_nk").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_nk", bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("carry"))
    place = F.row_number().over(Window.partitionBy("_nk", bucket).orderBy(*order))
    return with_carry(rows, shift, ["_nk"], bucket).withColumn(name, (F.col("carry") + place).cast("long")).drop("carry", "_nk")
