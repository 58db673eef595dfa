"""Packetised bitmap-subtitle streams as DataFrames.

``packets`` reads files to rows of packets, ``display_sets`` folds the packets
of each stream, in order, to decoded windows, and ``frames`` and
``window_frames`` derive timed images. The fold is the one step with state:
objects and windows live until an epoch starts, palettes for the whole stream.
"""

from __future__ import annotations

import glob
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from struct import unpack_from

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import least_duration, pts_to_ms
from ..operators.timeline import fold_islands, next_start_end, repair_zero_duration, repaired_end
from ..raster.kernels import blend, compose, data_digest, decode_many, decode_runs, drawn_greys, palette_tables, pixel_hash, trimmed_many
from ..session import spread, stage

# Packet header and segment types.
MAGIC = b"PG"
HEADER = 13
PALETTE, OBJECT, COMPOSITION, WINDOWS, END = 0x14, 0x15, 0x16, 0x17, 0x80
# States of a composition; the last opens an epoch.
NORMAL, ACQUISITION, EPOCH = 0x00, 0x40, 0x80
#: Decoded displays a stream keeps for repeats.
KEPT_DISPLAYS = 4096
#: Display sets of a bucket of the scans over a stream.
SETS_PER_BUCKET = 4096
#: Where the data of a continued object begins.
CONTINUED_AT = 7

#: Display sets, and pixels of their objects, that are decoded together.
SETS_TOGETHER, PIXELS_TOGETHER = 4096, 1 << 22
#: Bytes of pixels by which a task remembers which images it gave out.
REMEMBERED_BYTES = 1 << 25

PACKETS = "source_id string, raw_index bigint, packet_no int, pts bigint, dts bigint, segment_type int, payload binary"
WINDOW = "struct<window_id:int,left:int,top:int,right:int,bottom:int,width:int,height:int,object_ids:array<int>,image_hash:binary,pixels:binary>"
SURFACE = "struct<left:int,top:int,width:int,height:int,image_hash:binary,pixels:binary>"
DISPLAY_SETS = f"source_id string, raw_index bigint, pts bigint, composition_state int, has_composition boolean, complete boolean, windows array<{WINDOW}>, surface {SURFACE}"

_ARROW_WINDOW = pa.struct([*[(n, pa.int32()) for n in ("window_id", "left", "top", "right", "bottom", "width", "height")], ("object_ids", pa.list_(pa.int32())), ("image_hash", pa.binary()), ("pixels", pa.binary())])
_ARROW_SURFACE = pa.struct([*[(n, pa.int32()) for n in ("left", "top", "width", "height")], ("image_hash", pa.binary()), ("pixels", pa.binary())])
ARROW_SETS = pa.schema([("source_id", pa.string()), ("raw_index", pa.int64()), ("pts", pa.int64()), ("composition_state", pa.int32()), ("has_composition", pa.bool_()), ("complete", pa.bool_()), ("windows", pa.list_(_ARROW_WINDOW)), ("surface", _ARROW_SURFACE)])

#: Times of the next complete set of a stream, and of the next one with images.
AHEAD = "next_pts bigint, next_image_pts bigint"
ARROW_AHEAD = pa.schema([*ARROW_SETS, ("next_pts", pa.int64()), ("next_image_pts", pa.int64())])


class SupFormatError(ValueError):
    """A stream that is not what its packets claim."""


def scan(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """raw_index, packet_no, pts, dts, type and payload of each packet.

    An end packet closes a display set; what follows the last one is a set of its
    own. Fewer bytes than a header at the end are ignored.
    """
    at, raw, number = 0, 0, 0
    while at + HEADER <= len(data):
        if data[at : at + 2] != MAGIC:
            raise SupFormatError(f"no packet signature at offset {at}")
        pts, dts, kind, size = unpack_from(">IIBH", data, at + 2)
        at += HEADER
        if at + size > len(data):
            raise SupFormatError(f"payload at offset {at} exceeds the stream")
        yield raw, number, pts, dts, kind, bytes(data[at : at + size])
        at += size
        raw, number = (raw + 1, 0) if kind == END else (raw, number + 1)


@dataclass(frozen=True)
class ObjectRef:
    object_id: int
    window_id: int
    x: int
    y: int
    crop: tuple[int, int, int, int] | None


@dataclass(frozen=True)
class Composition:
    width: int
    height: int
    number: int
    state: int
    palette_id: int
    refs: tuple[ObjectRef, ...]


def composition(payload: bytes) -> Composition | None:
    """Composition of a payload; null if it is too short. A cut list of references ends early."""
    if len(payload) < 11:
        return None
    width, height, _, number, state, _, palette_id, count = unpack_from(">HHBHBBBB", payload)
    refs, at = [], 11
    while len(refs) < count and at + 8 <= len(payload):
        object_id, window_id, flags, x, y = unpack_from(">HBBHH", payload, at)
        at += 8
        crop = None
        if flags & 0xC0:
            crop = (0, 0, 0, 0)
            if at + 8 <= len(payload):
                crop = unpack_from(">HHHH", payload, at)
                at += 8
        refs.append(ObjectRef(object_id, window_id, x, y, crop))
    return Composition(width, height, number, state, palette_id, tuple(refs))


@dataclass
class StoredObject:
    version: int
    width: int
    height: int
    expected: int
    data: bytes
    complete: bool
    digest: bytes = b""
    pixels: np.ndarray | None = None


@dataclass
class StreamDecoder:
    """State of one stream; ``display_set`` takes the packets of one set after the other."""

    continued_at: int = CONTINUED_AT
    palettes: dict[int, dict[int, tuple[int, int, int, int]]] = field(default_factory=dict)
    versions: dict[int, int] = field(default_factory=dict)
    objects: dict[int, StoredObject] = field(default_factory=dict)
    windows: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    _kept: OrderedDict = field(default_factory=OrderedDict)

    def palette(self, payload: bytes) -> None:
        if len(payload) < 2:
            return
        table = self.palettes.setdefault(payload[0], {})
        changed = {e[0]: tuple(e[1:]) for e in (payload[i : i + 5] for i in range(2, len(payload) - 4, 5))}
        if any(table.get(k) != v for k, v in changed.items()):
            table.update(changed)
            self.versions[payload[0]] = self.versions.get(payload[0], 0) + 1

    def object(self, payload: bytes) -> None:
        if len(payload) < 7:
            return
        object_id, version, flags = unpack_from(">HBB", payload)
        ends = bool(flags & 0x40)
        if not flags & 0x80:
            stored = self.objects.get(object_id)
            if stored is not None:
                data = stored.data + payload[self.continued_at :]
                self.objects[object_id] = StoredObject(version, stored.width, stored.height, stored.expected, data, stored.complete or ends and len(data) >= stored.expected)
            return
        if len(payload) < 11:
            return
        expected = max(0, int.from_bytes(payload[4:7], "big") - 4)
        width, height = unpack_from(">HH", payload, 7)
        fresh = StoredObject(version, width, height, expected, payload[11:], ends and len(payload) - 11 >= expected)
        old = self.objects.get(object_id)
        same = old is not None and old.complete and fresh.complete and (old.version, old.width, old.height, old.expected, old.data) == (version, width, height, expected, fresh.data)
        if not same:
            self.objects[object_id] = fresh

    def window(self, payload: bytes) -> None:
        for i in range(payload[0] if payload else 0):
            if 1 + 9 * (i + 1) > len(payload):
                break
            window_id, *box = unpack_from(">BHHHH", payload, 1 + 9 * i)
            self.windows[window_id] = tuple(box)

    def _drawable(self, ref: ObjectRef) -> StoredObject | None:
        stored = self.objects.get(ref.object_id)
        return stored if stored is not None and stored.complete and stored.width > 0 and stored.height > 0 else None

    def _layer(self, ref: ObjectRef) -> tuple[np.ndarray, int, int]:
        stored = self._drawable(ref)
        if stored.pixels is None:
            stored.pixels = decode_runs(stored.data, stored.width, stored.height)
        pixels = stored.pixels
        if ref.crop:
            x, y, w, h = ref.crop
            pixels = pixels[y : y + h if h else None, x : x + w if w else None]
        return pixels, ref.x, ref.y

    def signature(self, comp: Composition) -> tuple | None:
        """What a display's pixels depend on; null if something it needs is missing."""
        if not self.palettes.get(comp.palette_id):
            return None
        parts = []
        for ref in comp.refs:
            stored = self._drawable(ref)
            if stored is None:
                return None
            stored.digest = stored.digest or data_digest(stored.data)
            parts.append((ref, stored.width, stored.height, stored.digest))
        return comp.palette_id, self.versions.get(comp.palette_id, 0), tuple(parts)

    def decoded(self, comp: Composition) -> list[dict]:
        """Decoded windows of a composition in order of their ids."""
        if not comp.refs or not self.palettes.get(comp.palette_id):
            return []
        key = self.signature(comp)
        if key is not None and key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key]
        grey, alpha = palette_tables(self.palettes[comp.palette_id])
        out = []
        for window_id in sorted({r.window_id for r in comp.refs}):
            refs = [r for r in comp.refs if r.window_id == window_id]
            if any(self._drawable(r) is None for r in refs):
                continue
            drawn = blend([self._layer(r) for r in refs], grey, alpha)
            if drawn is None:
                continue
            pixels, (left, top, right, bottom) = drawn
            out.append({"window_id": window_id, "left": left, "top": top, "right": right, "bottom": bottom, "width": pixels.shape[1], "height": pixels.shape[0], "object_ids": [r.object_id for r in refs], "image_hash": pixel_hash(pixels), "pixels": pixels.tobytes()})
        if key is not None:
            self._kept[key] = out
            if len(self._kept) > KEPT_DISPLAYS:
                self._kept.popitem(last=False)
        return out

    def display_set(self, packets: Sequence[tuple[int, int, bytes]], surface: bool = False) -> dict:
        """Row of a display set from its (pts, type, payload).

        A set without composition, in an unknown state or without its end is
        incomplete; one without references is complete and blank.
        """
        comp, pts, ended = None, None, False
        for stamp, kind, payload in packets:
            if kind == COMPOSITION:
                found = composition(payload)
                if found is not None:
                    comp, pts = found, stamp
                    if comp.state == EPOCH:
                        self.objects.clear()
                        self.windows.clear()
            elif kind == PALETTE:
                self.palette(payload)
            elif kind == OBJECT:
                self.object(payload)
            elif kind == WINDOWS:
                self.window(payload)
            elif kind == END:
                ended = True
        row = {"pts": pts, "composition_state": comp.state if comp else None, "has_composition": comp is not None, "complete": False, "windows": [], "surface": None}
        if comp is None or comp.state not in (NORMAL, ACQUISITION, EPOCH) or not ended:
            return row
        if not comp.refs:
            return row | {"complete": True}
        windows = self.decoded(comp)
        row |= {"complete": bool(windows), "windows": windows}
        if surface and windows:
            _add_surface(row)
        return row


class BatchDecoder:
    """Decodes many display sets together; gives what ``StreamDecoder`` gives one by one.

    A set that opens an epoch and brings each of its objects whole, one to a
    window, depends on nothing before it but palettes. The bitmaps of such sets
    are decoded together, by size and palette. Every other set goes to the
    stream's decoder, after the set before it has, if that opened the epoch.
    ``pixels`` are those of ``all`` images, of the ``first`` of equal ones a
    task gives out, or of ``none``. With ``ahead`` a row has the times of the next
    complete set of its stream and of the next one with images, too.
    """

    def __init__(self, continued_at: int, surface: bool, pixels: str = "all", ahead: bool = False):
        if pixels not in ("all", "first", "none"):
            raise ValueError(f"unknown choice of pixels {pixels!r}")
        self.continued_at, self.surface, self.pixels, self.ahead = continued_at, surface, pixels, ahead
        self._open(None)
        self.given, self.given_bytes = set(), 0
        self.rows: list[dict] = []
        self._empty()

    def _open(self, source: str | None) -> None:
        self.source, self.stream, self.unread = source, StreamDecoder(self.continued_at), None
        self.applied, self.greys = {}, {}

    def _empty(self) -> None:
        self.plain: list[tuple[dict, list[tuple]]] = []
        self.bitmaps: dict[tuple, dict[bytes, int]] = {}  # by width, height and greys
        self.size = self.added = 0

    def full(self) -> bool:
        return self.added >= SETS_TOGETHER or self.size >= PIXELS_TOGETHER

    def add(self, source: str, raw_index: int, packets: Sequence[tuple[int, int, bytes]]) -> None:
        """The next set: streams one after the other, the sets of each in order."""
        if source != self.source:
            self._open(source)
        row = {"source_id": source, "raw_index": raw_index}
        self.rows.append(row)
        self.added += 1
        found = self._plain(packets)
        if found is not None:
            comp, objects = found
            self.unread = packets
            row |= {"pts": packets[0][0], "composition_state": comp.state, "has_composition": True, "complete": not comp.refs, "windows": [], "surface": None}
            table = self.stream.palettes.get(comp.palette_id)
            if not comp.refs or not table:
                return
            version = (comp.palette_id, self.stream.versions.get(comp.palette_id, 0))
            if version not in self.greys:
                self.greys[version] = drawn_greys(*palette_tables(table)).tobytes()
            greys, asked = self.greys[version], []
            for ref in sorted(comp.refs, key=lambda r: r.window_id):
                width, height, data = objects[ref.object_id]
                if width and height:
                    known = self.bitmaps.setdefault(group := (width, height, greys), {})
                    asked.append((ref, group, known.setdefault(data, len(known))))
                    self.size += width * height
            self.plain.append((row, asked))
            return
        if self.unread is not None:
            self.stream.display_set(self.unread)
            self.unread = None
        self.applied.clear()
        row |= self.stream.display_set(packets, self.surface)
        self.size += sum(len(w["pixels"]) for w in row["windows"])

    def _plain(self, packets: Sequence[tuple[int, int, bytes]]) -> tuple[Composition, dict] | None:
        """Composition and objects of a set that depends on nothing before it, with its palettes applied; else null."""
        if packets[0][1] != COMPOSITION or packets[-1][1] != END or len(packets[0][2]) < 11 or packets[0][2][7] != EPOCH:
            return None
        comp = composition(packets[0][2])
        windows = {r.window_id for r in comp.refs}
        if len(windows) < len(comp.refs) or any(r.crop for r in comp.refs):
            return None
        objects, palettes = {}, []
        for _, kind, payload in packets[1:-1]:
            if kind == OBJECT:
                if len(payload) < 11 or payload[3] & 0xC0 != 0xC0 or len(payload) - 7 < int.from_bytes(payload[4:7], "big"):
                    return None
                object_id, width, height = payload[0] << 8 | payload[1], payload[7] << 8 | payload[8], payload[9] << 8 | payload[10]
                if object_id in objects:
                    return None
                objects[object_id] = (width, height, payload[11:])
            elif kind == PALETTE:
                palettes.append(payload)
            elif kind != WINDOWS:
                return None
        if any(r.object_id not in objects for r in comp.refs):
            return None
        for payload in palettes:
            if payload and self.applied.get(payload[0]) != payload:
                self.stream.palette(payload)
                self.applied[payload[0]] = payload
        return comp, objects

    def done(self, last: bool = False) -> pa.RecordBatch:
        """Rows of the sets added since the last call; with ``ahead`` those that need not wait for more sets, or the ``last`` ones."""
        self._draw()
        self._empty()
        stop = len(self.rows)
        if self.ahead:
            source, pts, image, shown = None, None, None, 0
            for at in range(len(self.rows) - 1, -1, -1):
                row = self.rows[at]
                if row["source_id"] != source:
                    source, pts, image = row["source_id"], None, None
                row["next_pts"], row["next_image_pts"] = pts, image
                if row["complete"]:
                    pts = row["pts"]
                    if row["windows"]:
                        image, shown = pts, max(shown, at)
            stop = stop if last else shown
        out = self._table(self.rows[:stop])
        self.rows = self.rows[stop:]
        return out

    def _draw(self) -> None:
        """Windows and surfaces of the plain sets."""
        drawn = {}
        for group, known in self.bitmaps.items():
            width, height, greys = *group[:2], np.frombuffer(group[2], dtype=np.uint8)
            coded, step = list(known), max(1, PIXELS_TOGETHER // (width * height))
            drawn[group] = [(cut[1], cut[0].shape, pixel_hash(cut[0]), cut[0].tobytes()) if cut else None for i in range(0, len(coded), step) for cut in trimmed_many(greys[decode_many(coded[i : i + step], width, height)])]
        for row, asked in self.plain:
            shown = row["windows"]
            for ref, group, at in asked:
                found = drawn[group][at]
                if found is not None:
                    (left, top, right, bottom), (height, width), digest, pixels = found
                    shown.append({"window_id": ref.window_id, "left": ref.x + left, "top": ref.y + top, "right": ref.x + right, "bottom": ref.y + bottom, "width": width, "height": height, "object_ids": [ref.object_id], "image_hash": digest, "pixels": pixels})
            row["complete"] = bool(shown)
            if self.surface and shown:
                _add_surface(row)

    def _table(self, rows: list[dict]) -> pa.RecordBatch:
        windows = [w for row in rows for w in row["windows"]]
        surfaces = [row["surface"] for row in rows]
        offsets = pa.array(np.cumsum([0, *(len(row["windows"]) for row in rows)]), pa.int32())
        schema = ARROW_AHEAD if self.ahead else ARROW_SETS
        values = {f.name: pa.array([row[f.name] for row in rows], f.type) for f in schema if f.name not in ("windows", "surface")}
        values["windows"] = pa.ListArray.from_arrays(offsets, self._structs(windows, _ARROW_WINDOW))
        values["surface"] = self._structs(surfaces, _ARROW_SURFACE)
        return pa.RecordBatch.from_arrays([values[f.name] for f in schema], schema=schema)

    def _structs(self, images: list[dict | None], kind: pa.StructType) -> pa.StructArray:
        shown = [image for image in images if image is not None]
        fields = [pa.array([self._given(i, kind) for i in shown] if f.name == "pixels" else [i[f.name] for i in shown], f.type) for f in kind]
        found = pa.StructArray.from_arrays(fields, fields=list(kind))
        if len(shown) == len(images):
            return found
        places = iter(range(len(shown)))
        return found.take(pa.array([None if image is None else next(places) for image in images], pa.int64()))

    def _given(self, image: dict, kind: pa.StructType) -> bytes | None:
        if self.pixels == "all":
            return image["pixels"]
        key = (image["width"], image["height"], image["pixels"], kind is _ARROW_WINDOW)
        if self.pixels == "none" or key in self.given:
            return None
        if self.given_bytes > REMEMBERED_BYTES:
            self.given.clear()
            self.given_bytes = 0
        self.given.add(key)
        self.given_bytes += len(key[2])
        return key[2]


def _add_surface(row: dict) -> None:
    """The surface of a row's windows; without one, the row is not complete."""
    windows = row["windows"]
    if len(windows) == 1:
        row["surface"] = {n: windows[0][n] for n in ("left", "top", "width", "height", "image_hash", "pixels")}
        return
    whole = compose([(np.frombuffer(w["pixels"], dtype=np.uint8).reshape(w["height"], w["width"]), w["left"], w["top"]) for w in windows])
    row["complete"] = whole is not None
    if whole is not None:
        pixels, left, top = whole
        row["surface"] = {"left": left, "top": top, "width": pixels.shape[1], "height": pixels.shape[0], "image_hash": pixel_hash(pixels), "pixels": pixels.tobytes()}


@dataclass
class _File(InputPartition):
    path: str


class SupReader(DataSourceReader):
    """One partition per file; a stream has state and cannot be split."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxdisplaysets", options.get("maxDisplaySets", 0)))

    def partitions(self) -> list[_File]:
        paths = sorted(glob.glob(self.path.removeprefix("file://"), recursive=True))
        if not paths:
            raise FileNotFoundError(f"no stream at {self.path}")
        return [_File(p) for p in paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as stream:
            for packet in scan(stream.read()):
                if self.most and packet[0] >= self.most:
                    return
                yield (partition.path, *packet)


class SupDataSource(DataSource):
    """``spark.read.format("sup")``: packets of stream files on storage all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "sup"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> SupReader:
        return SupReader(self.options)


def packets(spark: SparkSession, path: str, max_display_sets: int | None = None) -> DataFrame:
    """Packets of stream files on any storage Spark reads, one task per file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source, content in zip(part["path"], part["content"]):
                rows = [(source, *p) for p in scan(content) if not max_display_sets or p[0] < max_display_sets]
                yield pd.DataFrame(rows, columns=["source_id", "raw_index", "packet_no", "pts", "dts", "segment_type", "payload"])

    return files.mapInPandas(run, PACKETS)


def display_sets(packet_rows: DataFrame, surface: bool = False, continued_at: int = CONTINUED_AT) -> DataFrame:
    """Display sets of every stream, decoded in packet order.

    Streams are spread over tasks and sorted; the packets of a stream pass
    through its task, which holds some sets (``BatchDecoder``) and the stream's
    state at a time.
    """
    ordered = spread(packet_rows.select("source_id", "raw_index", "packet_no", "pts", "segment_type", "payload"), "source_id").sortWithinPartitions("source_id", "raw_index", "packet_no")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, raw, decoder, held = None, None, BatchDecoder(continued_at, surface), []
        for part in parts:
            for s, r, _, pts, kind, payload in zip(*(c.to_pylist() for c in part.columns)):
                if s != source or r != raw:
                    if held:
                        decoder.add(source, raw, held)
                        held = []
                        if decoder.full():
                            yield decoder.done()
                    source, raw = s, r
                held.append((pts, kind, payload))
        if held:
            decoder.add(source, raw, held)
        yield decoder.done(last=True)

    return ordered.mapInArrow(run, DISPLAY_SETS)


def decoded_sets(set_rows: DataFrame, surface: bool = False, continued_at: int = CONTINUED_AT, pixels: str = "all", ahead: bool = False) -> DataFrame:
    """``display_sets`` of rows that hold the bytes of one display set each (source_id, raw_index, data).

    Each partition must hold whole streams one after the other, in order.
    ``pixels`` and ``ahead`` as in ``BatchDecoder``.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = BatchDecoder(continued_at, surface, pixels, ahead)
        for part in parts:
            for source, raw, data in zip(*(c.to_pylist() for c in part.columns)):
                decoder.add(source, raw, [(pts, kind, payload) for _, _, pts, _, kind, payload in scan(data)])
                if decoder.full():
                    yield decoder.done()
        yield decoder.done(last=True)

    return set_rows.select("source_id", "raw_index", "data").mapInArrow(run, f"{DISPLAY_SETS}, {AHEAD}" if ahead else DISPLAY_SETS)


def packets_of(set_rows: DataFrame) -> DataFrame:
    """Packets of rows that hold the bytes of one display set each (source_id, raw_index, data)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(source, raw, *packet[1:]) for source, raw, data in zip(part["source_id"], part["raw_index"], part["data"]) for packet in scan(data)]
            yield pd.DataFrame(rows, columns=["source_id", "raw_index", "packet_no", "pts", "dts", "segment_type", "payload"])

    return set_rows.select("source_id", "raw_index", "data").mapInPandas(run, PACKETS)


def unique_objects(packet_rows: DataFrame) -> DataFrame:
    """Distinct bitmaps that arrive in one piece: width, height, digest, data."""
    first = F.conv(F.hex(F.substring("payload", 4, 1)), 16, 10).cast("int")
    number = lambda at, size: F.conv(F.hex(F.substring("payload", at, size)), 16, 10).cast("int")
    whole = packet_rows.where((F.col("segment_type") == OBJECT) & (F.length("payload") >= 11)).where(first.bitwiseAND(F.lit(0xC0)) == 0xC0)
    data = F.expr("substring(payload, 12)")
    rows = whole.select(number(8, 2).alias("width"), number(10, 2).alias("height"), data.alias("data"), number(5, 3).alias("_size"))
    rows = rows.where(F.length("data") >= F.col("_size") - 4).withColumn("digest", F.sha2("data", 256))
    return rows.groupBy("width", "height", "digest").agg(F.first("data").alias("data"))


def _frames_of(shown: DataFrame, track: Sequence[str], max_items: int | None) -> DataFrame:
    """Frames of the images of complete sets (source_id, raw_index, pts, ordinal, box, image_hash, pixels), those of blank sets null.

    The images are staged once; all scans run over their numbers, and the first
    image of each frame is joined to it at the end.
    """
    images = stage(shown, "images")
    found = _numbers_of(images, track, max_items)
    values = [c for c in images.columns if c not in ("raw_index", "pts", "image_hash", *track)]
    return found.join(images.select(*values).withColumnRenamed("ordinal", "first_ordinal"), ["source_id", "first_ordinal"])


def _numbers_of(images: DataFrame, track: Sequence[str], max_items: int | None) -> DataFrame:
    """Frames without their images. A set ends with the next complete one, blank or not."""
    sets = images.select("source_id", "raw_index", "pts").distinct()
    timed = next_start_end(sets, ["source_id"], ["raw_index"], "pts", bucket=("raw_index", SETS_PER_BUCKET)).withColumnRenamed("pts", "start_pts")
    numbers = images.where("image_hash is not null").select("source_id", "raw_index", "ordinal", *track, "image_hash")
    rows = repair_zero_duration(stage(numbers.join(timed, ["source_id", "raw_index"]), "timed-images"), ["source_id"], ["ordinal"], first_n=max_items, bucket=ORDINALS)
    return _folded(rows, track)


def _folded(rows: DataFrame, track: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    found = fold_islands(rows, ["source_id", *track], ["ordinal"], "image_hash", "start_pts", "end_pts", first=["raw_index", *first], bucket=ORDINALS)
    start, end = pts_to_ms(F.col("start_pts")), pts_to_ms(F.col("end_pts"))
    return found.withColumn("start_ms", start).withColumn("end_ms", least_duration(start, end))


#: Buckets of the scans over images.
ORDINALS = ("ordinal", SETS_PER_BUCKET * 256)
WINDOW_TRACK = ["window_id", "left", "top", "right", "bottom"]


def _window_images(sets: DataFrame, *more: str) -> DataFrame:
    shown = sets.where("has_composition and complete").select("source_id", "raw_index", "pts", *more, F.explode_outer("windows").alias("w"))
    ordinal = F.col("raw_index") * 256 + F.coalesce("w.window_id", F.lit(0))
    return shown.select("source_id", "raw_index", "pts", *more, ordinal.alias("ordinal"), "w.*").drop("object_ids")


def window_numbers(set_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``window_frames`` of rows as in ``decoded_sets``, without pixels, and the different images: image_hash, width, height, pixels.

    The decoder, which passes over each stream in order, gives the times of the
    sets ahead and the first of equal images. Images of one shape and hash must
    be equal, else the job fails.
    """
    sets = decoded_sets(set_rows, pixels="first", ahead=True).where("size(windows) > 0")
    last = F.element_at("windows", -1)["window_id"]
    staged = stage(_window_images(sets.withColumn("last_window", last), "next_pts", "next_image_pts", "last_window"), "images")
    key = ["image_hash", "width", "height"]
    images = staged.where("pixels is not null").groupBy(*key).agg(F.min("pixels").alias("pixels"), F.max("pixels").alias("_other"))
    equal = F.when(F.col("pixels") == F.col("_other"), F.lit(True)).otherwise(F.raise_error(F.lit("different images have one hash")).cast("boolean"))
    # An image that is not the last of its set is followed by one of the same time.
    ahead = F.when(F.col("window_id") < F.col("last_window"), F.col("pts")).otherwise(F.col("next_image_pts"))
    end = repaired_end(F.col("pts"), F.coalesce("next_pts", "pts"), ahead)
    rows = staged.select("source_id", "raw_index", "ordinal", *WINDOW_TRACK, "image_hash", "width", "height", F.col("pts").alias("start_pts"), end.alias("end_pts"))
    return _folded(rows, WINDOW_TRACK, ["width", "height"]), images.where(equal).drop("_other")


def window_frames(sets: DataFrame, max_items: int | None = None) -> DataFrame:
    """One row per image a window shows for a while; its order is that of ``first_ordinal``.

    ``max_items`` counts candidates before equal neighbours are merged.
    """
    return _frames_of(_window_images(sets), WINDOW_TRACK, max_items)


def frames(sets: DataFrame, max_items: int | None = None) -> DataFrame:
    """One row per composed screen; ``sets`` must have surfaces."""
    shown = sets.where("has_composition and complete").select("source_id", "raw_index", "pts", F.col("raw_index").alias("ordinal"), "surface.*")
    return _frames_of(shown, [], max_items)
