"""Weighted percentiles and the two-phase line statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_percentile(df: DataFrame, groups: Sequence[str], value: str, weight: str, share: float, name: str = "percentile") -> DataFrame:
    """Lowest value whose weight with all lower ones reaches ``share`` of the whole.

    Equal values are added up first, with map-side combine, so that the running
    sum passes over different values only.
    """
    summed = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*groups, value).agg(F.sum(weight).alias("_w"))
    scan = Window.partitionBy(*groups).orderBy(value)
    running = summed.withColumn("_run", F.sum("_w").over(scan)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*groups)))
    reached = running.where(F.col("_run") >= F.col("_all") * share)
    return reached.groupBy(*groups).agg(F.min(value).alias(name))


def weighted_median(df: DataFrame, groups: Sequence[str], value: str, weight: str, name: str = "median") -> DataFrame:
    return weighted_percentile(df, groups, value, weight, 0.5, name)


def histogram_percentile(df: DataFrame, groups: Sequence[str], value: str, percents: dict[str, float], count: str | None = None) -> DataFrame:
    """Percentiles by rank with linear interpolation, of values or of counted values; null values do not count.

    Equal values are added up first; a running sum over the different ones, which
    spills where they are many, gives the values at the two ranks around each
    percentile.
    """
    summed = df.groupBy(*groups, value).agg((F.count("*") if count is None else F.sum(count)).alias("_n"))
    scan = Window.partitionBy(*groups).orderBy(value)
    present = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    running = summed.withColumn("_run", F.sum(present).over(scan)).withColumn("_all", F.sum(present).over(Window.partitionBy(*groups)))
    at = {n: (F.col("_all") - 1) * F.lit(p / 100) for n, p in percents.items()}
    reached = [F.min(F.when(F.col(value).isNotNull() & (F.col("_run") > f(rank)), F.col(value))).cast("double").alias(f"_{side}_{n}") for n, rank in at.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = running.groupBy(*groups).agg(F.first("_all").alias("_all"), *reached)
    between = {n: F.when(F.col(f"_low_{n}") == F.col(f"_high_{n}"), F.col(f"_low_{n}")).otherwise((F.ceil(rank) - rank) * F.col(f"_low_{n}") + (rank - F.floor(rank)) * F.col(f"_high_{n}")) for n, rank in at.items()}
    return found.select(*groups, *[c.alias(n) for n, c in between.items()])


# Quantile of the pivot and the bands around the main thickness.
PIVOT = 0.60
BANDS = {"main_min_thickness": (3.0, 0.84), "furigana_min_thickness": (2.0, 0.18), "furigana_max_thickness": (2.0, 0.76), "max_cross_gap": (2.0, 1.4)}
MIN_FLOW_OVERLAP = 0.20


def line_stats(lines: DataFrame, groups: Sequence[str], thickness: str = "thickness", area: str = "area", repeat: str | None = None) -> DataFrame:
    """Main thickness and bands of each group of lines; no row for groups of fewer than two lines.

    The main thickness is the weighted median of lines at or above the weighted
    pivot quantile. ``repeat`` names a column of how many lines a row stands for.
    """
    if repeat is not None:
        lines = lines.withColumn("_area", F.col(area) * F.col(repeat))
        area = "_area"
    pivot = weighted_percentile(lines, groups, thickness, area, PIVOT, "_pivot")
    upper = lines.join(pivot, list(groups)).where(F.col(thickness) >= F.col("_pivot"))
    main = weighted_median(upper, groups, thickness, area, "main_thickness")
    many = lines.groupBy(*groups).agg((F.sum(repeat) if repeat else F.count("*")).alias("lines")).where("lines >= 2")
    out = main.join(many, list(groups)).where("main_thickness > 0")
    for name, (least, factor) in BANDS.items():
        out = out.withColumn(name, F.greatest(F.lit(least), F.col("main_thickness") * factor))
    return out.withColumn("min_flow_overlap_ratio", F.lit(MIN_FLOW_OVERLAP))


def with_line_stats(lines: DataFrame, groups: Sequence[str], thickness: str = "thickness", area: str = "area") -> DataFrame:
    """Every line with the statistics of its group, or nulls."""
    return lines.join(line_stats(lines, groups, thickness, area), list(groups), "left")
