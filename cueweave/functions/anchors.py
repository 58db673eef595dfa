"""Edit operations between two texts and the conservative merge along them.

Opcodes are those of ``difflib`` (with its junk heuristic from 200 characters),
which no built-in gives; they run as Arrow UDFs on rows already known to differ.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Sequence

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KANJI = regex.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0002A6DF\U0002A700-\U0002EBEF\U00030000-\U0003134F]")

OPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("index", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("left_start", T.IntegerType()),
            T.StructField("left_end", T.IntegerType()),
            T.StructField("right_start", T.IntegerType()),
            T.StructField("right_end", T.IntegerType()),
            T.StructField("left", T.StringType()),
            T.StructField("right", T.StringType()),
        ]
    )
)
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
MERGE = T.StructType(
    [
        T.StructField("merged_text", T.StringType()),
        T.StructField("diff_ranges", T.ArrayType(SPAN)),
        T.StructField("diff_points", T.ArrayType(T.IntegerType())),
        T.StructField("applied_ops", OPS),
    ]
)


def edits(left: str, right: str) -> list[tuple]:
    """(index, tag, left span, right span, fragments) of every difference, counted from 1."""
    codes = [c for c in difflib.SequenceMatcher(None, left, right).get_opcodes() if c[0] != "equal"]
    return [(n, tag, a, b, c, d, left[a:b], right[c:d]) for n, (tag, a, b, c, d) in enumerate(codes, 1)]


def union_of(spans: Iterable[Sequence[int]]) -> list[tuple[int, int]]:
    """Spans joined where they meet; empty ones go."""
    joined: list[tuple[int, int]] = []
    for start, end in sorted(tuple(s) for s in spans):
        if start >= end:
            continue
        if joined and start <= joined[-1][1]:
            start, end = joined[-1][0], max(joined.pop()[1], end)
        joined.append((start, end))
    return joined


def meets(start: int, end: int, ranges: Sequence[Sequence[int]], points: Iterable[int]) -> bool:
    """Whether an edit touches an uncertain place.

    An insertion touches a point of its own place or a range it stands in; a
    change touches ranges it overlaps and points on or between its borders.
    """
    if start == end:
        return start in points or any(a <= start < b for a, b in ranges)
    return any(a < end and start < b for a, b in ranges) or any(start <= p <= end for p in points)


def merge(baseline: str, option: str, candidate: str) -> tuple[str, list, list, list]:
    """Baseline with those edits of the candidate that touch where baseline and option differ."""
    anchors = edits(baseline, option)
    ranges = union_of((op[2], op[3]) for op in anchors)
    points = sorted({op[2] for op in anchors if op[2] == op[3]})
    applied = [op for op in edits(baseline, candidate) if meets(op[2], op[3], ranges, points)]
    parts, at = [], 0
    for op in applied:
        parts += [baseline[at : op[2]], op[7]]
        at = op[3]
    return "".join([*parts, baseline[at:]]), ranges, points, applied


def kanji_pairs(baseline: str, option: str) -> list[str]:
    """Pairs of different ideographs that one-to-one replacements exchange, each in code order, once."""
    pairs = {"".join(sorted(op[6] + op[7])) for op in edits(baseline, option) if op[1] == "replace" and len(op[6]) == len(op[7]) == 1 and _KANJI.match(op[6]) and _KANJI.match(op[7])}
    return sorted(pairs)


def _rows(function, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None for v in values) else function(*values) for values in zip(*columns)], dtype="object")


def diff_ops(left: Column, right: Column) -> Column:
    """Edits of two texts as an array; null if either is null. Serves as the focus context, too."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _rows(lambda x, y: [dict(zip((f.name for f in OPS.elementType), op)) for op in edits(x, y)], a, b)

    return F.pandas_udf(run, OPS)(left, right)


def anchor_merge(baseline: Column, option: Column, candidate: Column) -> Column:
    """Conservative merge of a candidate: merged_text, diff_ranges, diff_points, applied_ops."""

    def one(base: str, opt: str, cand: str) -> dict:
        text, ranges, points, applied = merge(base, opt, cand)
        names = [f.name for f in OPS.elementType]
        return {"merged_text": text, "diff_ranges": [{"start": a, "end": b} for a, b in ranges], "diff_points": points, "applied_ops": [dict(zip(names, op)) for op in applied]}

    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        found = [one(x or "", y or "", z or "") for x, y, z in zip(a, b, c)]
        return pd.DataFrame(found, columns=[f.name for f in MERGE])

    return F.pandas_udf(run, MERGE)(baseline, option, candidate)


def kanji_families(baseline: Column, option: Column) -> Column:
    """Exchanged pairs of ideographs of two texts, as an array."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _rows(kanji_pairs, a, b)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(baseline, option)
