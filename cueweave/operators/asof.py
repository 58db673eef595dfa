"""As-of lookups: the latest state at or before a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import bucket_of, carry_in, packed_keys, with_carry


def as_of(rows: DataFrame, states: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], width: int) -> DataFrame:
    """``rows`` with the ``values`` of the latest state of their keys at or before ``at``, or nulls.

    Rows and states are scanned together in buckets of ``width``; a bucket
    begins with the last state of the buckets before it, so no task holds a
    whole key. Of states at one time the one with the greatest values holds.
    Rows with a null time get nulls.
    """
    state = F.struct(F.col(at).alias("_at"), *[F.col(v).alias(v) for v in values])
    known = states.where(F.col(at).isNotNull()).select(packed_keys(keys), F.col(at).alias("_t"), state.alias("_state")).withColumn("_b", bucket_of("_t", width))
    known = known.groupBy("_k", "_b", "_t").agg(F.max("_state").alias("_state"))
    asked = rows.select(packed_keys(keys), F.col(at).alias("_t"), F.struct(*rows.columns).alias("_row")).withColumn("_b", bucket_of("_t", width))
    both = known.select("_k", "_b", "_t", "_state", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    both = both.unionByName(asked.select("_k", "_b", "_t", F.lit(None).cast(known.schema["_state"].dataType).alias("_state"), "_row"))
    before = carry_in(both, ["_k"], "_b", F.max("_state"), "max")
    order = Window.partitionBy("_k", "_b").orderBy("_t", F.col("_row").isNotNull())
    latest = F.last("_state", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = with_carry(both, before, ["_k"], "_b").withColumn("_latest", F.when(F.col("_t").isNotNull(), F.coalesce(latest, F.col("carry"))))
    return out.where("_row is not null").select("_row.*", *[F.col(f"_latest.{v}").alias(v) for v in values])
