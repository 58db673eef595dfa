"""Disagreement surfaces between readings, and the family of exchanged ideographs behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.anchors import kanji_families
from ..functions.scalar import aspect_ratio, is_tall
from ..functions.text import JAPANESE, FoldProfile, assess_difference, swap_pair
from .dedupe import upsert
from .ranking import sole_best

# Branch, role, shape, tag and kind of each surface.
WIDE = {"branch": "alternate_read_non_tall", "role": "ocr-fast", "kind": "min32768", "tag": "hybrid_detector"}
TALL = {"branch": "repeat_drift_tall", "role": "detector", "kind": "temp0_repeat", "tag": "hybrid_detector"}
REPEAT = {"branch": "p2_meaningful_temp0", "role": "detector", "kind": "temp0_repeat", "tag": "p2_meaningful_temp0"}
FAMILY = {"branch": "dominant_family_addon", "role": "dominant-family-addon", "kind": "family_pair_swap", "tag": "dominant_family_addon"}
# Limits of an eligible family.
LEAST_SUPPORT = 2
MOST_AGREEMENT_PER_SUPPORT = 10


def _surface(rows: DataFrame, spec: dict, profile: FoldProfile) -> DataFrame:
    out = rows.withColumn("_d", assess_difference(F.col("baseline_text"), F.col("option_text"), profile))
    return out.select(
        *rows.columns,
        F.lit(spec["branch"]).alias("detector_branch"),
        F.lit(spec["role"]).alias("option_role"),
        F.col("_d.label").alias("diff_label"),
        F.col("_d.meaningful").alias("meaningful"),
        F.col("_d.char_error_rate").alias("char_error_rate"),
        F.array(F.lit(spec["tag"])).alias("source_tags"),
        F.lit(spec["kind"]).alias("alternate_source_kind"),
    )


def with_shape(prepared: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Rows with their ratio and shape, ``tall`` or ``wide``."""
    w, h = F.col(width), F.col(height)
    return prepared.withColumn("ratio", aspect_ratio(w, h)).withColumn("shape", F.when(is_tall(w, h), "tall").otherwise("wide"))


def disagreements(baseline: DataFrame, option: DataFrame, keys: Sequence[str], spec: dict, meaningful_only: bool = False, profile: FoldProfile = JAPANESE) -> DataFrame:
    """Rows whose readings differ: the equal ones go before any text is assessed."""
    joined = baseline.join(option.select(*keys, "option_text"), list(keys))
    differing = joined.where(~F.col("baseline_text").eqNullSafe(F.col("option_text")))
    out = _surface(differing, spec, profile)
    return out.where("meaningful") if meaningful_only else out


def detector_surface(prepared: DataFrame, fast: DataFrame, repeat: DataFrame, keys: Sequence[str], ordinal: str, wider: bool = False, profile: FoldProfile = JAPANESE) -> DataFrame:
    """The surface of a mode: wide rows read again fast, tall rows repeated; wider adds meaningful repeats of all rows.

    ``prepared`` has keys, shape and ``baseline_text``; the readings have keys
    and ``option_text``.
    """
    wide = disagreements(prepared.where("shape = 'wide'"), fast, keys, WIDE, profile=profile)
    tall = disagreements(prepared.where("shape = 'tall'"), repeat, keys, TALL, profile=profile)
    surface = wide.unionByName(tall)
    if not wider:
        return surface.withColumn("side", F.lit(0))
    return upsert(surface, disagreements(prepared, repeat, keys, REPEAT, True, profile), keys, ordinal)


def agreement_rows(rows: DataFrame, surface: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with text that are not on the surface."""
    return rows.join(surface.select(*keys).distinct(), list(keys), "left_anti").where("baseline_text <> ''")


def member_counts(sets: DataFrame, members: str, name: str) -> DataFrame:
    """Rows per member of an array of different members: support, alone (pure), with others (mixed)."""
    each = sets.where(F.size(members) > 0).select(F.explode(members).alias(name), F.size(members).alias("_n"))
    return each.groupBy(name).agg(F.count("*").alias("support_rows"), F.count_if(F.col("_n") == 1).alias("pure_rows"), F.count_if(F.col("_n") > 1).alias("mixed_rows"))


def family_counts(surface: DataFrame) -> DataFrame:
    """Counts per family of exchanged ideographs."""
    return member_counts(surface.select(kanji_families(F.col("baseline_text"), F.col("option_text")).alias("_f")), "_f", "family")


def family_agreement(agreeing: DataFrame, families: DataFrame, text: str = "baseline_text") -> DataFrame:
    """Agreeing rows per family whose text has exactly one of its two characters.

    Rows and families meet on their characters, not each with each.
    """
    chars = families.select("family", F.explode(F.array(F.substring("family", 1, 1), F.substring("family", 2, 1))).alias("_c")).distinct()
    # One row: the characters of all families, of which there are no more than ideographs; texts go on with theirs only.
    wanted = chars.agg(F.concat_ws("", F.collect_set("_c")).alias("_all"))
    held = F.filter(F.array_distinct(F.split(F.col(text), "")), lambda c: F.contains(F.col("_all"), c))
    rows = agreeing.join(F.broadcast(wanted), F.lit(True)).select(held.alias("_cs")).where("size(_cs) > 0").withColumn("_row", F.monotonically_increasing_id())
    hits = rows.select("_row", F.explode("_cs").alias("_c")).join(chars, "_c").groupBy("_row", "family").agg(F.count("*").alias("_n"))
    return hits.where("_n = 1").groupBy("family").agg(F.count("*").alias("agreement_rows"))


def dominant_family(surface: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one family that leads, with its counts; no row where the first two tie.

    More support, more pure rows, fewer mixed and fewer agreeing rows lead.
    """
    counts = family_counts(surface)
    agreement = family_agreement(agreement_rows(rows, surface, keys), counts)
    stats = counts.join(agreement, "family", "left").withColumn("agreement_rows", F.coalesce("agreement_rows", F.lit(0)))
    eligible = stats.where((F.col("support_rows") >= LEAST_SUPPORT) & (F.col("pure_rows") >= 1) & (F.col("agreement_rows") >= 1) & (F.col("agreement_rows") <= F.col("support_rows") * MOST_AGREEMENT_PER_SUPPORT))
    return sole_best(eligible, [F.desc("support_rows"), F.desc("pure_rows"), F.asc("mixed_rows"), F.asc("agreement_rows")])


def family_addon(surface: DataFrame, rows: DataFrame, keys: Sequence[str], profile: FoldProfile = JAPANESE) -> DataFrame:
    """Agreeing rows with the dominant family's other character as their option."""
    best = dominant_family(surface, rows, keys)  # one row at most
    met = agreement_rows(rows, surface, keys).join(F.broadcast(best), F.lit(True), "inner")
    met = met.withColumn("_s", swap_pair(F.col("baseline_text"), F.col("family"))).where("_s is not null")
    out = _surface(met.withColumn("option_text", F.col("_s.option_text")), FAMILY, profile)
    return out.select(
        *[c for c in out.columns if c not in ("_s", "family", "support_rows", "pure_rows", "mixed_rows", "agreement_rows")],
        F.col("family").alias("dominant_family"),
        F.col("_s.current_char").alias("family_current_char"),
        F.col("_s.alternate_char").alias("family_alternate_char"),
        F.col("support_rows").alias("family_support_rows"),
        F.col("pure_rows").alias("family_pure_rows"),
        F.col("mixed_rows").alias("family_mixed_rows"),
        F.col("agreement_rows").alias("family_agreement_rows"),
    )


