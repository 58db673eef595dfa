"""Synthetic streams: the inverse of the reader, for fixtures and round trips."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from struct import pack

import numpy as np

from ..raster.kernels import encode_runs
from .sup import COMPOSITION, END, EPOCH, MAGIC, OBJECT, PALETTE, WINDOWS


def packet(kind: int, payload: bytes, pts: int, dts: int = 0) -> bytes:
    return MAGIC + pack(">IIBH", pts, dts, kind, len(payload)) + payload


def composition_payload(refs: Sequence[tuple], state: int = EPOCH, palette_id: int = 0, size: tuple[int, int] = (1920, 1080), number: int = 0) -> bytes:
    """Payload of references (object, window, x, y[, crop of four])."""
    out = pack(">HHBHBBBB", *size, 0x10, number, state, 0, palette_id, len(refs))
    for object_id, window_id, x, y, *crop in refs:
        out += pack(">HBBHH", object_id, window_id, 0x80 if crop else 0, x, y)
        out += pack(">HHHH", *crop[0]) if crop else b""
    return out


def palette_payload(entries: Mapping[int, tuple[int, int, int, int]], palette_id: int = 0, version: int = 0) -> bytes:
    return bytes([palette_id, version]) + b"".join(bytes([k, *v]) for k, v in entries.items())


def object_payload(object_id: int, pixels: np.ndarray, version: int = 0) -> bytes:
    height, width = pixels.shape
    return coded_payload(object_id, width, height, encode_runs(pixels), version)


def coded_payload(object_id: int, width: int, height: int, data: bytes, version: int = 0) -> bytes:
    """Payload of an object whose runs are coded already."""
    return pack(">HBB", object_id, version, 0xC0) + (len(data) + 4).to_bytes(3, "big") + pack(">HH", width, height) + data


def windows_payload(boxes: Mapping[int, tuple[int, int, int, int]]) -> bytes:
    return bytes([len(boxes)]) + b"".join(pack(">BHHHH", k, *v) for k, v in boxes.items())


def display_set(pts: int, images: Iterable[tuple[int, int, int, np.ndarray]], palette: Mapping[int, tuple[int, int, int, int]], state: int = EPOCH) -> bytes:
    """A whole set showing (window, x, y, indexed pixels); no images blank the screen."""
    coded = [(window, x, y, p.shape[1], p.shape[0], encode_runs(p)) for window, x, y, p in images]
    return coded_set(pts, coded, palette_payload(palette), state)


def coded_set(pts: int, images: Sequence[tuple[int, int, int, int, int, bytes]], palette: bytes, state: int = EPOCH) -> bytes:
    """A whole set of images whose runs are coded (window, x, y, width, height, data), with the payload of its palette."""
    refs = [(i, window, x, y) for i, (window, x, y, *_) in enumerate(images)]
    out = packet(COMPOSITION, composition_payload(refs, state), pts)
    if images:
        out += packet(WINDOWS, windows_payload({window: box for window, *box, _ in images}), pts)
        out += packet(PALETTE, palette, pts)
        out += b"".join(packet(OBJECT, coded_payload(i, w, h, data), pts) for i, (_, _, _, w, h, data) in enumerate(images))
    return out + packet(END, b"", pts)
