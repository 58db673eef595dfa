"""Queries of the bitmap stream, layout, recogniser and stateful operators.

The tables hold no bitmaps, so every segment is drawn as a small one and coded
to packets: the streams cover the whole table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries_core import _SEG, fold_sql, segments
from .queries_core import SQL as SQL_CORE
from .raster.layout import analysed, counted_lines, masked_uses
from .raster.kernels import BACKGROUND, encode_many
from .recognizers import Answer, Settings, recognised, register
from .operators import dedupe, stats, timeline
from .session import load, shared_dir, spread, stage
from .sources import sup, sup_writer
from .streaming.stateful import open_islands, stream_islands

INK = {1: (235, 128, 128, 255), 2: (120, 128, 128, 255)}
#: Cells of a drawn glyph, and glyphs of a drawn line.
CELL, GLYPHS = 6, 4


def glyphs(texts: Sequence[str]) -> np.ndarray:
    """For each text a bitmap of blocks that stands for it, a row of small blocks above some."""
    digests = np.frombuffer(b"".join(hashlib.md5(t.encode("utf-8")).digest() for t in texts), dtype=np.uint8).reshape(len(texts), 16)
    out = np.zeros((len(texts), CELL * 3, CELL * GLYPHS), dtype=np.uint8)
    rows = np.arange(CELL * 3)
    for i in range(GLYPHS):
        x = i * CELL
        block = (rows >= CELL * 2 - digests[:, i, None] % 3) & (rows < CELL * 3 - 1)
        out[:, :, x + 1 : x + CELL - 1] = (block * (1 + digests[:, 4 + i, None] % 2))[:, :, None]
        above = digests[:, 8 + i] % 2
        out[:, 2:5, x + 1 : x + 3] = above[:, None, None]
        out[:, 2:5, x + 3] = (above * (digests[:, 12 + i] % 2))[:, None]
    return out


def drawn_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the display sets of one stream per source, one for each timed segment, in order of starts.

    A partition holds whole streams, in order: drawing needs no more than their
    segments in order, and decoding goes on from there without a shuffle.
    """
    rows = segments(spark, sf_dir).where("start_ms is not null and end_ms > start_ms and text is not null and source_id is not null")
    rows = spread(rows.select("source_id", "start_ms", "segment_id", F.coalesce("window_id", F.lit(0)).alias("window_id"), F.coalesce("box_left", F.lit(0)).alias("x"), F.coalesce("box_top", F.lit(0)).alias("y"), "text"), "source_id")
    rows = rows.sortWithinPartitions("source_id", "start_ms", "segment_id")
    schema = pa.schema([("source_id", pa.string()), ("raw_index", pa.int64()), ("data", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        palette, source, number = sup_writer.palette_payload(INK), None, 0
        for part in parts:
            sources, starts, _, windows, xs, ys, texts = (c.to_pylist() for c in part.columns)
            coded, numbers, data = encode_many(glyphs(texts)), [], []
            for of, start, window, x, y, runs in zip(sources, starts, windows, xs, ys, coded):
                source, number = of, number + 1 if of == source else 1
                numbers.append(number)
                data.append(sup_writer.coded_set(start * 90 % (1 << 32), [(window, x % 1920, y % 1080, CELL * GLYPHS, CELL * 3, runs)], palette))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "source_id string, raw_index bigint, data binary")


def drawn_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of the drawn streams."""
    return sup.packets_of(drawn_sets(spark, sf_dir))


class GlyphReader:
    """Recogniser of the drawn glyphs: for each, the height and ink of its block and the width of the small one above."""

    def __init__(self, options: dict):
        pass

    def recognise(self, pixels: np.ndarray, prompt: str) -> Answer:
        inked, read = pixels != BACKGROUND, ""
        for x in range(0, GLYPHS * CELL, CELL):
            height = int(inked[:, x + 3].sum())
            above = int(inked[:, x].sum() > height) + int(inked[:, x + 2].sum() > height)
            read += f"{height - CELL + 1}{1 if pixels[-1, x] == 255 - INK[1][0] else 2}{above}"
        return Answer(read)

    def close(self) -> None:
        pass


register("glyphs", GlyphReader)


def drawn_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames of all windows without their pixels, and the different images."""
    return sup.window_numbers(drawn_sets(spark, sf_dir))


def keyed(images: DataFrame) -> DataFrame:
    """``images`` with their identity, hash and shape, as one column."""
    return images.withColumn("_key", F.concat("image_hash", F.encode(F.concat_ws("x", "width", "height"), "utf-8")))


def _byte(i: int) -> str:
    return f"CAST('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER)"


# The drawn streams are a function of the segments: what is drawn, where, when, and what a reader of it says.
_LOOK = " || ".join(f"CAST({_byte(i)} % 3 AS VARCHAR) || CAST(1 + {_byte(4 + i)} % 2 AS VARCHAR) || CASE WHEN {_byte(8 + i)} % 2 = 1 THEN CAST(1 + {_byte(12 + i)} % 2 AS VARCHAR) ELSE '0' END" for i in range(GLYPHS))
_ABOVE = " OR ".join(f"{_byte(8 + i)} % 2 = 1" for i in range(GLYPHS))
_TALLEST = f"greatest({', '.join(f'{_byte(i)} % 3' for i in range(GLYPHS))})"
_SETS = f"""{_SEG}, v AS (SELECT *, md5(text) AS h FROM s WHERE start_ms IS NOT NULL AND end_ms > start_ms AND text IS NOT NULL AND source_id IS NOT NULL),
n AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS raw_index, start_ms * 90 % 4294967296 AS pts, coalesce(window_id, 0) AS window_id,
coalesce(box_left, 0) % 1920 + 1 AS l, coalesce(box_top, 0) % 1080 + CASE WHEN {_ABOVE} THEN 2 ELSE {CELL * 2} - {_TALLEST} END AS t, coalesce(box_top, 0) % 1080 + {CELL * 3 - 2} AS b, {_LOOK} AS look FROM v)"""
_TIMED = f"""{_SETS}, x AS (SELECT *, raw_index * 256 + window_id AS ordinal, lead(pts) OVER (PARTITION BY source_id ORDER BY raw_index) AS nxt FROM n),
t AS (SELECT *, CASE WHEN coalesce(nxt, pts) > pts THEN nxt WHEN nxt IS NULL THEN pts + 180000 ELSE greatest(pts + 90, greatest(0, nxt - 90)) END AS e FROM x)"""
_FRAMES = f"""{_TIMED}, {fold_sql('t', 'source_id, window_id, l, t, b', 'ordinal', 'look', 'pts', 'e', 180)},
frames AS (SELECT source_id, min(ordinal) AS first_ordinal, window_id, l, t, b, look, (min(pts) + 45) // 90 AS start_ms, greatest((max(e) + 45) // 90, (min(pts) + 45) // 90 + 1) AS end_ms, count(*) AS rows FROM fi GROUP BY source_id, window_id, l, t, b, run, island, look)"""

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


@query(f"WITH {_SETS} SELECT source_id, raw_index, TRUE AS complete, {CELL * GLYPHS - 2} AS surface_width, window_id, l AS left, t AS top, l + {CELL * GLYPHS - 3} AS right, b AS bottom FROM n")
def display_sets(spark, sf_dir):
    """Decoded windows of all display sets, with composed surfaces."""
    sets = sup.decoded_sets(drawn_sets(spark, sf_dir), surface=True, pixels="none")
    shown = sets.select("source_id", "raw_index", "complete", F.col("surface.width").alias("surface_width"), F.explode_outer("windows").alias("w"))
    return shown.select("source_id", "raw_index", "complete", "surface_width", "w.window_id", "w.left", "w.top", "w.right", "w.bottom")


@query(f"WITH {_FRAMES} SELECT source_id, first_ordinal, window_id, l AS left, t AS top, start_ms, end_ms, rows, min(first_ordinal) OVER (PARTITION BY source_id, look) AS first_alike FROM frames")
def window_frames(spark, sf_dir):
    """Images of windows with their times, and the first one of the source that looks alike."""
    frames = stage(drawn_frames(spark, sf_dir)[0], "window-frames")
    alike = frames.groupBy("source_id", "image_hash").agg(F.min("first_ordinal").alias("first_alike"))
    return frames.join(alike, ["source_id", "image_hash"]).select("source_id", "first_ordinal", "window_id", "left", "top", "start_ms", "end_ms", "rows", "first_alike")


@query(f"""WITH {_TIMED}, {fold_sql('t', 'source_id', 'raw_index', 'look', 'pts', 'e', 180)}
SELECT source_id, min(raw_index) AS first_ordinal, (min(pts) + 45) // 90 AS start_ms, greatest((max(e) + 45) // 90, (min(pts) + 45) // 90 + 1) AS end_ms, {CELL * GLYPHS - 2} AS width, arg_min(b - t + 1, raw_index) AS height FROM fi GROUP BY source_id, run, island""")
def screen_frames(spark, sf_dir):
    frames = sup.frames(sup.decoded_sets(drawn_sets(spark, sf_dir), surface=True))
    return frames.select("source_id", "first_ordinal", "start_ms", "end_ms", "width", "height")


@query(f"WITH {_SETS} SELECT {CELL * GLYPHS} AS width, {CELL * 3} AS height, count(DISTINCT look) AS objects FROM n")
def unique_objects(spark, sf_dir):
    """Number of different bitmaps of all streams, by size."""
    return sup.unique_objects(drawn_packets(spark, sf_dir)).groupBy("width", "height").agg(F.count("*").alias("objects"))


@query()
def layout_statistics(spark, sf_dir):
    """Statistics of text lines per source and orientation."""
    frames, images = drawn_frames(spark, sf_dir)
    uses = keyed(frames).groupBy("source_id", "_key").agg(F.count("*").alias("_n"))
    return stats.line_stats(stage(counted_lines(uses, analysed(keyed(images), ["_key"]), ["source_id"]), "lines"), ["source_id", "orientation"], repeat="_n")


@query()
def masked_layout(spark, sf_dir):
    """Roles and masked pixels of every drawn image."""
    frames, images = drawn_frames(spark, sf_dir)
    masked = masked_uses(stage(keyed(frames).select("source_id", "first_ordinal", "_key"), "drawn"), keyed(images))
    roles = F.transform("lines", lambda x: x["role"])
    return masked.select("source_id", "first_ordinal", "orientation", "component_count", "selected_count", "masked_pixel_count", F.array_join(roles, ",").alias("roles"))


@query(f"""WITH {_FRAMES}, bounds AS (SELECT DISTINCT source_id, unnest([start_ms, end_ms]) AS p FROM frames),
iv AS (SELECT source_id, p AS s0, lead(p) OVER (PARTITION BY source_id ORDER BY p) AS e0 FROM bounds),
a AS (SELECT iv.source_id, s0, e0, q.look, min((q.t, q.l, q.window_id, q.first_ordinal)) AS place FROM iv JOIN frames q ON q.source_id = iv.source_id AND q.start_ms < e0 AND q.end_ms > s0 GROUP BY ALL),
y AS (SELECT source_id, s0, e0, string_agg(look, chr(10) ORDER BY place) AS text FROM a GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(e0) OVER o = s0 AND lag(text) OVER o = text THEN 0 ELSE 1 END AS new FROM y WINDOW o AS (PARTITION BY source_id ORDER BY s0)),
z AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY s0) AS cue_index FROM f)
SELECT source_id, CAST(cue_index AS BIGINT) AS cue_index, min(s0) AS start_ms, max(e0) AS end_ms, any_value(text) AS text FROM z GROUP BY source_id, cue_index""")
def recognised_cues(spark, sf_dir):
    """Streams to cues: each different image read once, its text fanned out, the safe policy."""
    frames, images = drawn_frames(spark, sf_dir)
    texts = recognised(spread(keyed(images), "_key"), Settings("glyphs"), ["_key"])
    rows = dedupe.fan_out(keyed(frames), texts.withColumn("_read", F.lit(True)), ["_key"], "left")
    read = F.when(F.col("_read").isNull(), F.raise_error(F.lit("inputs and texts differ in length")).cast("boolean")).otherwise(F.lit(True))
    rows = rows.where(read)
    return timeline.cues(timeline.text_segments(rows), "safe", ["source_id"], ["top", "left", "right", "window_id"], "first_ordinal")


_RUNS = SQL_CORE["track_islands"]


@query(f"SELECT user_id, event_type, us, end_us, rows FROM ({_RUNS})")
def stateful_islands(spark, sf_dir):
    """Runs of equal events of each user by a streaming query, those open at the end of the input read from its state."""
    base = shared_dir(spark)
    schema = load(spark, sf_dir, "events").schema
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("us", us).select("user_id", "event_type", "event_id", "us", F.col("us").alias("end_us"))
    found = stream_islands(rows, ["user_id"], "event_type", "us", "end_us", 1 << 60, order=["us", "event_id"])
    name = uuid.uuid4().hex
    out, state = f"{base}/staged/stream-{name}", f"{base}/staged/state-{name}"
    sink = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    sink.awaitTermination()
    closed = spark.read.schema(found.schema).parquet(out)
    return closed.unionByName(open_islands(spark, state, ["user_id"], "event_type", "us", "end_us"))
