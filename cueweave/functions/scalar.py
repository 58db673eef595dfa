"""Scalar functions on times, boxes, JSON answers and keys, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PTS_PER_MS = 90
TALL_RATIO = 2.0


def pts_to_ms(pts: Column) -> Column:
    """Milliseconds of a 90 kHz stamp, halves up."""
    return F.floor((pts + PTS_PER_MS // 2) / F.lit(PTS_PER_MS)).cast("long")


def least_duration(start_ms: Column, end_ms: Column) -> Column:
    """The end, at least a millisecond after the start."""
    return F.greatest(end_ms, start_ms + 1)


def srt_timestamp(ms: Column, compat: bool = True) -> Column:
    """``HH:MM:SS,mmm``; negative times count as zero, null stays null.

    ``compat`` cuts a double of seconds, which prints some values one
    millisecond low; otherwise the value is exact.
    """
    ms = F.when(ms.isNotNull(), F.greatest(ms, F.lit(0))).cast("long")
    if compat:
        ms = F.floor((ms.cast("double") / F.lit(1000.0)) * F.lit(1000.0)).cast("long")
    hours, minutes = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d,%03d", hours, minutes, F.floor(ms / 1000) % 60, ms % 1000))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(width <= 0, F.lit(0.0)).otherwise(height.cast("double") / width)


def is_tall(width: Column, height: Column) -> Column:
    return aspect_ratio(width, height) >= TALL_RATIO


def line_gap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Cells between two inclusive spans, 0 if they meet."""
    return F.greatest(F.lit(0), start_b - end_a - 1, start_a - end_b - 1)


def overlap_ratio(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Share of the shorter of two inclusive spans that both cover."""
    shared = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1)
    return shared / F.greatest(F.lit(1), F.least(end_a - start_a, end_b - start_b) + 1)


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def ordered_union(*tags: Column) -> Column:
    """Tags of all arrays once, in order of their first place."""
    return F.array_distinct(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in tags]))


_PARTS = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>>>>"


def answer_text(body: Column) -> Column:
    """Text and thoughts of a model's JSON answer: the parts of its candidates, joined."""
    empty = F.array().cast("array<struct<text:string,thought:boolean>>")
    parts = F.flatten(F.transform(F.from_json(body, _PARTS)["candidates"], lambda c: F.coalesce(c["content"]["parts"], empty)))

    def joined(wanted: bool) -> Column:
        kept = F.filter(F.coalesce(parts, empty), lambda p: (F.coalesce(p["thought"], F.lit(False)) == wanted) & p["text"].isNotNull())
        return F.trim(F.array_join(F.transform(kept, lambda p: p["text"]), ""))

    return F.struct(joined(False).alias("text"), joined(True).alias("thoughts"))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a header of seconds or an HTTP date, not below 0; null if it is neither."""
    seconds = F.trim(header).try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(F.trim(header), r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = (F.unix_micros(date) - F.unix_micros(now.cast("timestamp"))) / F.lit(1e6)
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds)).when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def retry_delay(body: Column) -> Column:
    """Seconds of the first number among ``error.details[].retryDelay``, such as ``1.5s``; not below 0."""
    details = F.from_json(body, "struct<error:struct<details:array<struct<retryDelay:string>>>>")["error"]["details"]
    delays = F.transform(details, lambda d: F.regexp_replace(F.trim(d["retryDelay"]), "s$", "").try_cast("double"))
    first = F.try_element_at(F.filter(delays, lambda x: x.isNotNull()), F.lit(1))
    return F.when(first.isNotNull(), F.greatest(F.lit(0.0), first))


def request_key(fields: Sequence[Column]) -> Column:
    """Key of a request: a digest of its fields, nulls marked, in the order given."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields]), 256)


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


def safe_int(text: Column) -> Column:
    """An integer, or null if the text is none."""
    return text.try_cast("int")


def safe_box(values: Column) -> Column:
    """Four integers of an array of texts, or null."""
    numbers = F.transform(values, lambda v: v.try_cast("int"))
    return F.when((F.size(values) == 4) & ~F.exists(numbers, lambda v: v.isNull()), numbers)


def prompt_for_shape(shape: Column, prompts: dict[str, str], default: str) -> Column:
    """Prompt of a shape."""
    out = F.lit(default)
    for name, prompt in prompts.items():
        out = F.when(shape == name, prompt).otherwise(out)
    return out


def window_start(now: Column, last: Column, lookback_days: int = 120, overlap_days: int = 14) -> Column:
    """Start of a rescan: the later of a look-back from now and an overlap before the last scan."""
    back = now - F.make_dt_interval(F.lit(lookback_days))
    return F.greatest(back, F.coalesce(last - F.make_dt_interval(F.lit(overlap_days)), back))


def remaining_seconds(rows_left: Column, prior_rate: Column, done: Column, elapsed: Column) -> Column:
    """Seconds left: rows at the observed rate once any are done, at the prior rate before."""
    observed = F.when(done > 0, elapsed / done)
    return F.greatest(F.lit(0.0), rows_left * F.coalesce(observed, prior_rate))


# The prompts of the recogniser and the roles that may ask twice.
FIRST_PROMPT = "OCR:"
SECOND_PROMPT = "Output only the exact text."
FALLBACK_ROLES = ("ocr", "ocr-fast")


def length_fallback(role: Column, prompt: Column) -> Column:
    """Whether an answer cut off at the limit may be asked again with the second prompt."""
    return role.isin(*FALLBACK_ROLES) & (prompt == FIRST_PROMPT)
