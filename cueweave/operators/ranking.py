"""Ranks, limits per group and interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .scan import with_carry


def sole_best(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The row that leads by ``order``, or none if it ties with the next.

    Only the first two rows are taken, which each task finds for itself.
    """
    first = df.orderBy(*order).limit(2)
    ranked = first.withColumn("_rank", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    ranked = ranked.withColumn("_ties", F.sum(F.when(F.col("_rank") == 1, 1).otherwise(0)).over(Window.partitionBy(F.lit(1))))
    return ranked.where("_rank = 1 and _ties = 1").drop("_rank", "_ties")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each task's groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def placed(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with a place from 1 in each group, by an order of any kind, however large a group is.

    The rows are cut into ranges of (groups, order) and staged with the number
    of their range; each range is numbered apart and shifted by the rows of the
    group in the ranges before it. ``order`` must tell rows apart.
    """
    keys = [F.col(g) for g in groups]
    ranges = stage(df.repartitionByRange(*keys, *order).withColumns({"_range": F.spark_partition_id(), "_k": F.struct(*groups) if groups else F.struct(F.lit(0))}), "ranges")
    counts = ranges.groupBy("_k", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_k", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("carry"))
    inside = F.row_number().over(Window.partitionBy("_k", "_range").orderBy(*order))
    return with_carry(ranges, shift, ["_k"], "_range").withColumn(name, (F.col("carry") + inside).cast("long")).drop("carry", "_k", "_range")


def ranked_attempts(df: DataFrame, groups: Sequence[str], attempts: str, position: str) -> DataFrame:
    """Place in each group: untried first, then fewest attempts, then list order."""
    return placed(df, groups, [F.coalesce(F.col(attempts), F.lit(0)), F.col(position)], "place")


def round_robin(df: DataFrame, group: str, order: Sequence[Column], group_order: Column, limit: int | None = None, reserved: Column | None = None) -> DataFrame:
    """Rows interleaved over groups: all first ones, then all second ones; ``slot`` counts from 1.

    With ``limit``, as many slots stay; with ``reserved``, the last of them goes
    to the first row it holds for, if none is among them already. Neither a
    group nor a turn need fit one task.
    """
    slots = placed(placed(df, [group], order, "_turn"), [], [F.col("_turn"), group_order], "slot").drop("_turn")
    if limit is None:
        return slots
    if reserved is None:
        return slots.where(F.col("slot") <= limit)
    held = slots.agg(F.min(F.when(reserved, F.col("slot"))).alias("_held"))  # one row
    near = slots.join(F.broadcast(held), F.lit(True))
    late = F.coalesce(F.col("_held") > limit, F.lit(False))
    kept = near.where((F.col("slot") < limit) | ((F.col("slot") == limit) & ~late) | (late & (F.col("slot") == F.col("_held"))))
    return kept.withColumn("slot", F.least("slot", F.lit(limit))).drop("_held")


def budgeted(df: DataFrame, group: str, order: Sequence[Column], budget: str, total: int) -> DataFrame:
    """Greedy selection in order: at most the group's budget each, ``total`` in all."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    taken = df.withColumn("_n", within).where(F.col("_n") <= F.col(budget)).drop("_n")
    return taken.orderBy(*order).limit(total)


def listed_first(df: DataFrame, listing: DataFrame, key: str, position: str) -> DataFrame:
    """Rows with the position of a listing, or null: order them by position (nulls last), then key."""
    return df.join(listing.select(key, position), key, "left")


def pending(ledger: DataFrame, allowed: DataFrame, keys: Sequence[str], status: str = "status", passed: str = "passed") -> DataFrame:
    """Passed entries that are not allowed yet."""
    return ledger.where(F.col(status) == passed).join(allowed.select(*keys).distinct(), list(keys), "left_anti")


def first_matching(assets: DataFrame, patterns: DataFrame, group: str, name: str, pattern: str, ordinal: str) -> DataFrame:
    """First asset of each group whose name fits each pattern of the group."""
    met = assets.join(patterns, group).where(F.expr(f"{name} rlike {pattern}"))
    return met.groupBy(group, pattern).agg(F.min_by(name, ordinal).alias(name), F.min(ordinal).alias(ordinal))


def complete_selection(assets: DataFrame, patterns: DataFrame, group: str, name: str, pattern: str, ordinal: str, digest: str) -> DataFrame:
    """The assets of ``first_matching`` with their digests, for groups in which each pattern met one and all of these have a digest."""
    met = assets.join(patterns, group).where(F.expr(f"{name} rlike {pattern}"))
    chosen = met.groupBy(group, pattern).agg(F.min_by(F.struct(name, digest), ordinal).alias("_c"), F.min(ordinal).alias(ordinal)).select(group, pattern, "_c.*", ordinal)
    wanted = patterns.groupBy(group).agg(F.count_distinct(pattern).alias("_wanted"))
    whole = chosen.groupBy(group).agg(F.count(digest).alias("_whole")).join(wanted, group).where("_whole = _wanted")
    return chosen.join(whole.select(group), group, "left_semi")
