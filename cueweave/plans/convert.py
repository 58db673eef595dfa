"""The whole pipeline: streams to cues, with detection and correction of doubtful readings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correct, dedupe, detect, timeline
from ..raster.layout import masked_frames
from ..recognizers import Settings, recognised
from ..session import stage
from ..sinks import write_records, write_srt
from ..sources import sup
from .requests import ConvertRequest

KEYS = ["source_id", "first_ordinal"]
IMAGE = ["width", "height", "pixels"]
LAYOUT = ["top", "left", "right", "window_id"]


@dataclass(frozen=True)
class Converted:
    """Tables of a conversion; ``counters`` are computed when asked for."""

    prepared: DataFrame
    cues: DataFrame
    disagreements: DataFrame | None = None
    corrections: DataFrame | None = None
    texts: DataFrame | None = None

    def counters(self) -> dict[str, int]:
        out = {"processed": self.prepared.count(), "written": self.cues.count()}
        if self.texts is not None and (unread := self.texts.where("error <> ''").count()):
            out["unread"] = unread
        if self.disagreements is not None:
            out["detected"] = self.disagreements.count()
        if self.corrections is not None:
            row = correct.counters(self.corrections.withColumn("_g", F.lit(0)), ["_g"], "corrector_status").first()
            out |= {"applied": row["applied"] if row else 0, "fallback": row["fallback"] if row else 0}
        return out


def prepared_frames(spark: SparkSession, path: str, max_items: int | None = None, mask_aids: bool = False) -> DataFrame:
    """Timed window images of streams with shape and image key, decoded once and staged."""
    frames = sup.window_frames(sup.display_sets(sup.packets(spark, path)), max_items)
    if mask_aids:
        frames = stage(frames, "frames")
        masked = masked_frames(frames, KEYS).select(*KEYS, F.col("pixels").alias("_masked"))
        frames = frames.join(masked, KEYS).withColumn("pixels", F.col("_masked")).drop("_masked")
    frames = detect.with_shape(frames).withColumn("image_key", dedupe.image_key(F.col("pixels"), F.col("width"), F.col("height")))
    return stage(frames, "prepared")


def read_texts(frames: DataFrame, settings: Settings, by_shape: bool = False) -> DataFrame:
    """Texts of frames (KEYS, text, error): each distinct image is recognised once."""
    identity = ["image_key", "shape"] if by_shape else ["image_key"]
    firsts = frames.groupBy(*identity).agg(F.min_by(F.struct(*IMAGE), F.struct(*KEYS)).alias("_i")).select(*identity, "_i.*")
    answers = recognised(firsts, settings, identity)
    return dedupe.fan_out(frames.select(*KEYS, *identity), answers, identity).select(*KEYS, "text", "error")


def baseline_texts(frames: DataFrame, request: ConvertRequest) -> DataFrame:
    """Readings of the mode: one recogniser, or a fast one for wide and the usual for tall images."""
    if request.ocr_mode == "default":
        return read_texts(frames, request.recogniser)
    fast = request.fast_recogniser or request.recogniser
    wide = read_texts(frames.where("shape = 'wide'"), fast)
    return wide.unionByName(read_texts(frames.where("shape = 'tall'"), request.recogniser))


def convert(spark: SparkSession, request: ConvertRequest) -> Converted:
    """Tables of a conversion; nothing is written yet but staged tables."""
    request = request.checked()
    frames = prepared_frames(spark, request.input_sup, request.max_items, request.mask_aids)
    texts = stage(baseline_texts(frames, request), "baseline")
    rows = dedupe.strict_zip(frames, texts.select(*KEYS, F.coalesce("text", F.lit("")).alias("baseline_text")), KEYS)
    surface = corrections = None
    final = rows.withColumn("text", F.col("baseline_text"))
    if request.detector_output is not None or request.corrector != "off":
        again = request.detector or request.recogniser
        wide = read_texts(frames.where("shape = 'wide'"), request.fast_recogniser or again).select(*KEYS, F.coalesce("text", F.lit("")).alias("option_text"))
        repeat = read_texts(frames if request.detector_mode == "wider" else frames.where("shape = 'tall'"), again).select(*KEYS, F.coalesce("text", F.lit("")).alias("option_text"))
        facts = rows.select(*KEYS, "raw_index", "window_id", "start_ms", "end_ms", "ratio", "shape", "baseline_text")
        surface = stage(detect.detector_surface(facts, wide, repeat, KEYS, "first_ordinal", request.detector_mode == "wider"), "surface")
        if request.family_addon:
            addon = detect.family_addon(surface, facts, KEYS).withColumn("side", F.lit(2))
            surface = stage(surface.unionByName(addon, allowMissingColumns=True), "surface-with-family")
    if request.corrector != "off":
        asked = frames.join(surface.select(*KEYS), KEYS, "left_semi")
        answers = read_texts(asked, request.corrector_settings, by_shape=True)
        joined = surface.join(answers.select(*KEYS, F.col("text").alias("corrector_text"), F.col("error").alias("corrector_error")), KEYS)
        corrections = stage(correct.correction_records(joined, request.corrector_settings.name, request.corrector), "corrections")
        final = correct.overlay(final, corrections, KEYS, "text", "conservative_merged_text").drop("was_corrected")
    segments = timeline.text_segments(final.select(*KEYS, "start_ms", "end_ms", "text", *LAYOUT))
    cues = timeline.cues(segments, request.srt_policy, ["source_id"], LAYOUT, "first_ordinal")
    return Converted(frames, cues, surface, corrections, texts)


def execute(spark: SparkSession, request: ConvertRequest) -> dict[str, int]:
    """Convert one stream and write its files; gives the counters."""
    done = convert(spark, request)
    write_srt(done.cues, request.output_srt, request.compat_times)
    if request.detector_output is not None:
        write_records(done.disagreements, request.detector_output)
    if request.corrector_output is not None:
        write_records(done.corrections, request.corrector_output)
    return done.counters()
