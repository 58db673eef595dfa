"""Recognise each distinct image once: distinct plan, fan-out, strict joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_key(pixels: Column, *shape: Column) -> Column:
    """Exact identity of an image: its shape and a digest of its bytes."""
    return F.concat_ws(":", *[s.cast("string") for s in shape], F.sha2(pixels, 256))


def distinct_plan(df: DataFrame, identity: Sequence[str], ordinal: str) -> DataFrame:
    """One row per identity: first ordinal and group size. Sizes sum to the rows."""
    return df.groupBy(*identity).agg(F.min(ordinal).alias("first_ordinal"), F.count("*").alias("group_size"))


def fan_out(df: DataFrame, results: DataFrame, identity: Sequence[str], how: str = "inner") -> DataFrame:
    """Results of distinct rows brought back to every row of ``df``; null identities meet.

    A hot identity is a skewed join, whose side of rows the adaptive plan splits.
    """
    right = results.select(*[F.col(c).alias(f"_r_{c}") for c in identity], *[c for c in results.columns if c not in identity])
    on = F.lit(True)
    for c in identity:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(right, on, how).drop(*[f"_r_{c}" for c in identity])


def recognise_distinct(df: DataFrame, identity: Sequence[str], ordinal: str, recogniser, columns: Sequence[str]) -> DataFrame:
    """Each distinct identity recognised once, its text fanned out to all its rows.

    ``recogniser`` takes a table of one row per identity with ``columns`` and
    gives it back with a ``text``.
    """
    firsts = df.groupBy(*identity).agg(F.min_by(F.struct(*columns), ordinal).alias("_c")).select(*identity, "_c.*")
    return fan_out(df, recogniser(firsts).select(*identity, "text"), identity)


def strict_zip(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by position; a key missing on either side fails the job instead of losing the row."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), "full_outer")
    both = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("inputs and texts differ in length"))).otherwise(F.lit(True))
    return joined.where(both).drop("_l", "_r")


def upsert(primary: DataFrame, extra: DataFrame, keys: Sequence[str], ordinal: str, tags: str = "source_tags") -> DataFrame:
    """Rows of ``primary`` with the tags of both, then rows only ``extra`` has.

    Repeated keys of ``extra`` union their tags in order. ``side`` (0, 1) and
    ``ordinal`` give the order.
    """
    values = [c for c in primary.columns if c not in (*keys, tags)]
    # Each tag's first place is found map-side, so that a list holds different tags only.
    places = extra.select(*keys, F.posexplode(tags).alias("_p", "_t"), F.col(ordinal).alias("_o")).groupBy(*keys, "_t").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    tagged = places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda x: x["_t"]).alias("_tags"))
    first = extra.groupBy(*keys).agg(F.min_by(F.struct(*values), ordinal).alias("_v"))
    once = fan_out(first, tagged, keys, "left")
    right = once.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_v", "_tags")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = primary.withColumn("_p", F.lit(True)).join(right, on, "full_outer")
    mine = F.col("_p").isNotNull()
    empty = F.array().cast("array<string>")
    return joined.select(
        *[F.when(mine, F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys],
        *[F.when(mine, F.col(v)).otherwise(F.col(f"_v.{v}")).alias(v) for v in values],
        F.array_distinct(F.concat(F.coalesce(F.col(tags), empty), F.coalesce(F.col("_tags"), empty))).alias(tags),
        F.when(mine, 0).otherwise(1).alias("side"),
    )
