"""Relations between spans and sets: theta semi-joins, boxes, frames, panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import line_gap, overlap_ratio


def box_union(df: DataFrame, groups: Sequence[str], left: str = "box_left", top: str = "box_top", right: str = "box_right", bottom: str = "box_bottom") -> DataFrame:
    """Smallest box around all boxes of a group, edges inclusive."""
    return df.groupBy(*groups).agg(F.min(left).alias(left), F.min(top).alias(top), F.max(right).alias(right), F.max(bottom).alias(bottom))


def matches_any(candidates: DataFrame, mains: DataFrame, keys: Sequence[str], cross: tuple[str, str], flow: tuple[str, str], max_gap: Column | float, min_overlap: Column | float) -> DataFrame:
    """Candidates near any main line of their keys that overlaps them along the flow."""
    right = mains.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in (*cross, *flow)])
    gap = line_gap(F.col(cross[0]), F.col(cross[1]), F.col(f"_m_{cross[0]}"), F.col(f"_m_{cross[1]}"))
    overlap = overlap_ratio(F.col(flow[0]), F.col(flow[1]), F.col(f"_m_{flow[0]}"), F.col(f"_m_{flow[1]}"))
    left = candidates.alias("c")
    on = [F.col(f"c.{k}") == F.col(f"m.{k}") for k in keys]
    condition = (gap <= max_gap) & (overlap >= min_overlap)
    for c in on:
        condition = condition & c
    return left.join(right.alias("m"), condition, "left_semi")


def touches_spans(start: Column, end: Column, ranges: Column, points: Column) -> Column:
    """Whether a span touches uncertain ranges (half-open) or points; see the anchor merge."""
    at_point = F.exists(points, lambda p: (p >= start) & (p <= end))
    in_range = F.exists(ranges, lambda r: (r["start"] <= start) & (start < r["end"]))
    overlaps = F.exists(ranges, lambda r: (r["start"] < end) & (start < r["end"]))
    return F.when(start == end, at_point | in_range).otherwise(overlaps | at_point)


def same_frame(df: DataFrame, flagged: Column, keys: Sequence[str]) -> DataFrame:
    """All rows that share a frame with a flagged row."""
    return df.join(df.where(flagged).select(*keys).distinct(), list(keys), "left_semi")


def panel_entries(panels: Sequence[DataFrame], key: str, intersection: bool, allowed: DataFrame | None = None) -> DataFrame:
    """Entries in all panels, or in any, and among the allowed ones."""
    out = panels[0].select(key)
    for panel in panels[1:]:
        out = out.intersect(panel.select(key)) if intersection else out.union(panel.select(key))
    out = out.distinct()
    return out if allowed is None else out.intersect(allowed.select(key))


def find_entry(entries: DataFrame, name: str, number: str, position: str, query: str) -> DataFrame:
    """Entry by exact name, else by number, else the first by prefix."""
    wanted = query.strip()
    rank = F.when(F.col(name) == wanted, 0).when(F.col(number) == (int(wanted) if wanted.isdigit() else -1), 1).when(F.col(name).startswith(wanted), 2)
    return entries.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", position).limit(1).drop("_rank")
