"""Text functions: normal forms, folds, and the assessment of differences.

All are column expressions. Only compatibility composition (NFKC) has no
built-in; it runs as an Arrow UDF that gets nothing but rows with characters
beyond ASCII. Null texts count as empty, as in the assessed data.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dashes and tildes that count as one.
DASHES = "‐‑‒–—―ーｰ─━〜～"
DASHES_TO = "-" * 10 + "~~"
# Small kana and the full-size kana they are taken for.
SMALL_KANA = "ぁぃぅぇぉっゃゅょゎゕゖァィゥェォッャュョヮヵヶ"
FULL_KANA = "あいうえおつやゆよわかけアイウエオツヤユヨワカケ"
# Kana before which a geminate sign is dropped.
GEMINATED = "かきくけこさしすせそたちつてとぱぴぷぺぽカキクケコサシスセソタチツテトパピプペポ"
GEMINATED_KATAKANA = "カキクケコサシスセソタチツテトパピプペポ"

#: Blank characters as Python's split() sees them; Java's class lacks the four separators.
BLANK = r"(?U)[\s\x{1C}-\x{1F}]"
MARKS = r"[\p{P}\p{S}\p{Z}]"


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC of a text; rows of ASCII never reach Python's normalizer."""
    udf = F.pandas_udf(_nfkc, T.StringType())
    return F.coalesce(udf(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _lines(text: Column) -> Column:
    """Blanks collapsed within lines, empty lines dropped."""
    lines = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n")
    squeezed = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, BLANK + "+", " "), r"^ | $", ""))
    return F.array_join(F.filter(squeezed, lambda x: x != ""), "\n")


def recognised_text(text: Column) -> Column:
    """A recogniser's answer without control tokens, fences and stray blanks."""
    text = F.regexp_replace(text, r"\r\n|\r", "\n")
    text = F.regexp_replace(text, r"<\|[^>]+\|>", "")
    return _lines(F.regexp_replace(F.regexp_replace(text, "```text", ""), "```", ""))


def canonical_text(text: Column) -> Column:
    return _lines(F.translate(nfkc(F.coalesce(text, F.lit(""))), DASHES, DASHES_TO))


def without_blanks(canonical: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(canonical, BLANK + "+", ""), "-{2,}", "-")


def equivalence_text(text: Column) -> Column:
    """Canonical text without blanks, runs of dashes as one."""
    return without_blanks(canonical_text(text))


def punctuation_fold(equivalent: Column) -> Column:
    """Without punctuation, symbols and separators; takes the equivalence text."""
    return F.regexp_replace(equivalent, MARKS, "")


def generic_fold(equivalent: Column) -> Column:
    return equivalent


def japanese_fold(equivalent: Column) -> Column:
    """Small kana, geminate signs and trailing long vowels folded; takes the equivalence text."""
    folded = F.regexp_replace(equivalent, rf"(?<=[ぁ-ゖァ-ヶ])一(?=\z|\n|{MARKS})", "-")
    folded = F.translate(folded, SMALL_KANA, FULL_KANA)
    folded = F.regexp_replace(folded, f"つ(?=[{GEMINATED}])", "")
    return F.regexp_replace(folded, f"ツ(?=[{GEMINATED_KATAKANA}])", "")


@dataclass(frozen=True)
class FoldProfile:
    """A named orthographic fold, chosen when the plan is built."""

    name: str
    fold: callable
    note: str


GENERIC = FoldProfile("generic", generic_fold, "same after the fold of the profile")
JAPANESE = FoldProfile("ja-subtitle-ocr", japanese_fold, "only small kana, geminates or trailing long vowels differ")
PROFILES = {p.name: p for p in (GENERIC, JAPANESE)}

# Labels of differences, the first that holds.
LABELS = ("exact_match", "normalized_equivalent", "punctuation_equivalent", "orthographic_equivalent", "meaningful_difference")


def assess_difference(reference: Column, candidate: Column, profile: FoldProfile = JAPANESE) -> Column:
    """How two texts differ: label, meaningful, char_error_rate, edit_distance, both forms and a note.

    The rate is the edit distance over the length of the reference in its
    equivalence form (1 at least), and 0 for the first two labels.
    """
    reference, candidate = F.coalesce(reference, F.lit("")), F.coalesce(candidate, F.lit(""))
    left, right = equivalence_text(reference), equivalence_text(candidate)
    label = (
        F.when(reference == candidate, LABELS[0])
        .when(left == right, LABELS[1])
        .when(punctuation_fold(left) == punctuation_fold(right), LABELS[2])
        .when(profile.fold(left) == profile.fold(right), LABELS[3])
        .otherwise(LABELS[4])
    )
    distance = F.when(left == right, 0).otherwise(F.levenshtein(left, right))
    notes = ("raw texts are equal", "only width, blanks or dashes differ", "only punctuation and blanks differ", profile.note, "letters differ after normalisation")
    note = F.element_at(F.create_map(*[F.lit(x) for pair in zip(LABELS, notes) for x in pair]), label)
    return F.struct(
        label.alias("label"),
        (label == LABELS[4]).alias("meaningful"),
        (reference == candidate).alias("raw_equal"),
        (left == right).alias("canonical_equal"),
        label.isin(*LABELS[:3]).alias("punctuation_equal"),
        (label != LABELS[4]).alias("orthographic_equal"),
        (distance / F.greatest(F.length(left), F.lit(1))).alias("char_error_rate"),
        distance.alias("edit_distance"),
        left.alias("reference_form"),
        right.alias("candidate_form"),
        note.alias("note"),
    )


# Code point ranges of ideographs.
KANJI = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}]"


def is_kanji(text: Column) -> Column:
    """Whether a text is one ideograph."""
    return text.rlike(f"^{KANJI}$") & (F.length(text) == 1)


def swap_pair(text: Column, family: Column) -> Column:
    """Text with one character of a pair replaced by the other: option_text, current_char, alternate_char.

    Null unless exactly one of the two occurs.
    """
    one, two = F.substring(family, 1, 1), F.substring(family, 2, 1)
    has_one, has_two = F.contains(text, one), F.contains(text, two)
    current = F.when(has_one, one).otherwise(two)
    other = F.when(has_one, two).otherwise(one)
    swapped = F.struct(F.replace(text, current, other).alias("option_text"), current.alias("current_char"), other.alias("alternate_char"))
    return F.when((F.length(family) == 2) & (has_one != has_two), swapped)


def strip_blanks(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")
