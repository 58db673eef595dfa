"""Sinks: subtitle text, JSON lines, image exports with manifests, atomic single files."""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path
from typing import TextIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.scan import bucket_of, numbered
from .operators.timeline import frame_and_segment, srt_blocks
from .raster.kernels import bmp, outlined, png, read_png
from .sources.sup import SETS_PER_BUCKET

ENCODERS = {"png": lambda p: png(p), "png-fast": lambda p: png(p, 1), "bmp": bmp}
_SUFFIX = {"png": "png", "png-fast": "png", "bmp": "bmp"}
# Outline colours of line roles.
ROLE_COLOURS = {"main": (0, 120, 255), "furigana": (255, 60, 60), "other": (150, 150, 150)}
DIAGNOSTICS_LIMIT = 1 << 20


def atomic_write(path: str | Path, write: Callable[[TextIO], None], encoding: str = "utf-8", newline: str | None = "\n") -> None:
    """A file that is there whole or not at all; an older one survives a failure."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding=encoding, newline=newline) as out:
            write(out)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def atomic_json(path: str | Path, value: object, ascii_only: bool = False, indent: int | None = 2) -> None:
    atomic_write(path, lambda out: out.write(json.dumps(value, ensure_ascii=ascii_only, indent=indent) + "\n"))


def atomic_jsonl(path: str | Path, rows: Iterable[dict], ascii_only: bool = False) -> None:
    atomic_write(path, lambda out: out.writelines(json.dumps(r, ensure_ascii=ascii_only) + "\n" for r in rows))


def write_srt(cues: DataFrame, path: str | Path, compat: bool = True) -> None:
    """Cues of one source as one file. The driver takes one partition at a time."""
    blocks = cues.orderBy("cue_index").select(srt_blocks(cues, compat=compat).alias("block"))
    atomic_write(path, lambda out: out.writelines(r.block for r in blocks.toLocalIterator()))


def write_srt_files(cues: DataFrame, path: str, source: str = "source_id", compat: bool = True) -> None:
    """Cues of all sources as one folder of text each, written by the executors."""
    blocks = cues.withColumn("_block", F.regexp_replace(srt_blocks(cues, compat=compat), r"\n\z", ""))
    placed = blocks.repartition(source).sortWithinPartitions(source, "cue_index").select(source, F.col("_block").alias("value"))
    placed.write.partitionBy(source).text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Detector or correction records as JSON lines; nulls are written."""
    records.write.option("ignoreNullFields", "false").json(path)


def manifest(frames: DataFrame, order: Sequence[str] = ("first_ordinal",)) -> DataFrame:
    """Manifest rows of window frames: index, frame and segment numbers, box, times and image name."""
    rows = frame_and_segment(frames, ["source_id"], list(order), ["raw_index", "start_ms"], ("raw_index", SETS_PER_BUCKET))
    rows = numbered(rows.withColumn("_b", bucket_of("raw_index", SETS_PER_BUCKET)), ["source_id"], "_b", list(order), "index")
    name = F.format_string("%06d_w%d.png", F.col("frame_index"), F.col("window_id"))
    return rows.select("source_id", "index", "frame_index", "segment_index", "raw_index", "window_id", F.array("left", "top", "right", "bottom").alias("bbox"), "start_ms", "end_ms", name.alias("name"), *[c for c in rows.columns if c in ("width", "height", "pixels", "first_ordinal")])


def _write_images(rows: DataFrame, folder: str, columns: dict[str, Callable[[tuple], np.ndarray]], used: Sequence[str], encoding: str) -> DataFrame:
    """Images of each row written under ``folder``; gives the rows without what they were made from."""
    keep = [c for c in rows.columns if c not in used]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                for kind, draw in columns.items():
                    target = Path(folder, kind, Path(row["name"]).with_suffix("." + _SUFFIX[encoding]))
                    target.parent.mkdir(parents=True, exist_ok=True)
                    partial = target.with_name(f".{target.name}.{os.getpid()}")
                    partial.write_bytes(ENCODERS[encoding](draw(row)))
                    os.replace(partial, target)
            yield part[keep]

    return rows.mapInPandas(run, ddl)


def _pixels(row: dict, name: str = "pixels") -> np.ndarray:
    return np.frombuffer(row[name], dtype=np.uint8).reshape(row["height"], row["width"])


def export_images(frames: DataFrame, folder: str, encoding: str = "png") -> DataFrame:
    """Images of window frames under a mounted folder, and their manifest.

    Each task writes its own files, whole or not at all, so a task that runs
    twice leaves the same ones.
    """
    rows = manifest(frames)
    out = _write_images(rows, folder, {"images": _pixels}, ("width", "height", "pixels", "first_ordinal"), encoding)
    return out.withColumn("image", F.concat(F.lit("images/"), "name")).drop("name")


def spill_images(frames: DataFrame, folder: str, key: str = "image_key", encoding: str = "png") -> DataFrame:
    """Each different image once under a mounted folder, named by its key: key, image. ``read_spilled`` reads them back."""
    once = frames.groupBy(key).agg(F.first(F.struct("width", "height", "pixels")).alias("_i")).select(key, "_i.*").withColumn("name", F.concat(key, F.lit("." + _SUFFIX[encoding])))
    out = _write_images(once, folder, {"images": _pixels}, ("width", "height", "pixels"), encoding)
    return out.withColumn("image", F.concat(F.lit("images/"), "name")).drop("name")


def read_spilled(spilled: DataFrame, folder: str) -> DataFrame:
    """Spilled PNG images with width, height and grey pixels."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spilled.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            grey = [read_png(Path(folder, image).read_bytes()) for image in part["image"]]
            yield part.assign(width=[g.shape[1] for g in grey], height=[g.shape[0] for g in grey], pixels=[g.tobytes() for g in grey])

    return spilled.mapInPandas(run, f"{ddl}, width int, height int, pixels binary")


def export_masks(frames: DataFrame, masked: DataFrame, folder: str) -> DataFrame:
    """Original, masked, mask and line images, and a manifest with counts of lines by role."""
    details = masked.select("source_id", "first_ordinal", F.col("pixels").alias("masked_pixels"), "mask", "orientation", "component_count", "selected_count", "masked_pixel_count", "lines")
    rows = manifest(frames).join(details, ["source_id", "first_ordinal"])
    count = lambda role: F.size(F.filter("lines", lambda x: x["role"] == role))
    rows = rows.withColumn("main_line_count", count("main")).withColumn("furigana_line_count", count("furigana"))

    def with_lines(row: dict) -> np.ndarray:
        return outlined(_pixels(row), [(x["left"], x["top"], x["right"], x["bottom"], ROLE_COLOURS[x["role"]]) for x in row["lines"]])

    kinds = {"original": _pixels, "masked": lambda r: _pixels(r, "masked_pixels"), "mask": lambda r: _pixels(r, "mask"), "lines": with_lines}
    out = _write_images(rows, folder, kinds, ("width", "height", "pixels", "masked_pixels", "mask", "lines", "first_ordinal"), "png")
    for kind in kinds:
        out = out.withColumn(f"{kind}_image", F.concat(F.lit(f"{kind}/"), "name"))
    return out.drop("name")


def append_answers(answers: DataFrame, path: str) -> None:
    """New answers added to the cache table."""
    answers.write.mode("append").parquet(path)


def cached_answers(spark: SparkSession, path: str, schema: str = "key string, text string") -> DataFrame:
    """The cache table; files that cannot be read are misses."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


class DiagnosticLog:
    """Events appended to a file of JSON lines, turned over at a limit; failures are swallowed."""

    def __init__(self, path: str | Path, limit: int = DIAGNOSTICS_LIMIT):
        self.path, self.limit = Path(path), limit

    def add(self, event: str, **fields: object) -> Path | None:
        try:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            if self.path.exists() and self.path.stat().st_size >= self.limit:
                os.replace(self.path, self.path.with_suffix(self.path.suffix + ".1"))
            row = {"time": time.time(), "event": event, "pid": os.getpid(), "thread": threading.current_thread().name} | fields
            with self.path.open("a", encoding="utf-8") as out:
                out.write(json.dumps(row, ensure_ascii=False, sort_keys=True, default=str) + "\n")
            return self.path
        except Exception:  # noqa: BLE001
            return None
