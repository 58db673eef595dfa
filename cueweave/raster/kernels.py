"""NumPy kernels for indexed bitmaps: run lengths, palettes, blending, trimming, hashing.

A raster is a uint8 array in which 255 is background. Kernels are called from
Arrow UDFs and the stream decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Mapping, Sequence

import numpy as np

BACKGROUND = 255
# Palette entries that are never drawn.
CLEAR_ENTRIES = (0, 30)
#: Bitmaps from which on reading them in step is worth it.
LEAST_IN_STEP = 16


def runs_of(data: bytes) -> tuple[list[int], list[int]]:
    """Lengths and colours of the coded runs; length -1 ends a line."""
    lengths, colours = [], []
    at, size = 0, len(data)
    while at < size:
        colour = data[at]
        at += 1
        length = 1
        if colour == 0:
            if at >= size:
                break
            flags = data[at]
            at += 1
            if flags == 0:
                lengths.append(-1)
                colours.append(0)
                continue
            length = flags & 0x3F
            if flags & 0x40:
                if at >= size:
                    break
                length = length << 8 | data[at]
                at += 1
            if flags & 0x80:
                if at >= size:
                    break
                colour = data[at]
                at += 1
        lengths.append(length)
        colours.append(colour)
    return lengths, colours


def decode_runs(data: bytes, width: int, height: int) -> np.ndarray:
    """Palette indices of a coded bitmap; short lines and a missing end are 0.

    A run longer than its line goes on in the next one.
    """
    if width <= 0 or height <= 0:
        return np.zeros((max(0, height), max(0, width)), dtype=np.uint8)
    out = np.zeros(width * height, dtype=np.uint8)
    lengths, colours = runs_of(bytes(data))
    line, x = 0, 0
    starts, ends, paints = [], [], []
    for length, colour in zip(lengths, colours):
        if line >= height:
            break
        if length < 0:
            line, x = line + 1, 0
            continue
        if not length:
            continue
        begin = line * width + x
        end = begin + length
        if colour:
            starts.append(begin)
            ends.append(min(end, len(out)))
            paints.append(colour)
        line, x = divmod(end, width)
        if x == 0:
            line, x = line - 1, width  # a full line is left by its own end mark
    for begin, end, colour in zip(starts, ends, paints):
        out[begin:end] = colour
    return out.reshape(height, width)


def encode_runs(pixels: np.ndarray) -> bytes:
    """Coded runs of palette indices, a line end after each line."""
    out = bytearray()
    for row in np.asarray(pixels, dtype=np.uint8):
        cuts = np.flatnonzero(np.diff(row)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(row)]):
            length, colour = int(end - begin), int(row[begin])
            while length:
                step = min(length, 0x3FFF)
                length -= step
                if colour and step == 1:
                    out.append(colour)
                    continue
                head = [step] if step < 0x40 else [0x40 | step >> 8, step & 0xFF]
                out += bytes([0, head[0] | (0x80 if colour else 0), *head[1:], *([colour] if colour else [])])
        out += b"\x00\x00"
    return bytes(out)


def encode_many(images: np.ndarray) -> list[bytes]:
    """``encode_runs`` of each of equally large images (number, height, width)."""
    count, height, width = images.shape
    if not 0 < width < 0x40 or not count or not height:
        return [encode_runs(pixels) for pixels in images]
    lines = np.ascontiguousarray(images, dtype=np.uint8).reshape(count * height, width)
    opens = np.ones(lines.shape, dtype=bool)
    opens[:, 1:] = lines[:, 1:] != lines[:, :-1]
    begin = np.flatnonzero(opens)
    length = np.diff(begin, append=lines.size)
    colour = lines.reshape(-1)[begin]
    blank, single = colour == 0, (colour > 0) & (length == 1)
    several = ~blank & ~single
    size = np.where(blank, 2, np.where(single, 1, 3)) + 2 * ((begin + length) % width == 0)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    out[at[single]] = colour[single]
    out[at[blank] + 1] = length[blank]
    out[at[several] + 1] = 0x80 | length[several]
    out[at[several] + 2] = colour[several]
    cuts = [*at[begin % (height * width) == 0].tolist(), len(out)]
    data = out.tobytes()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def decode_many(coded: Sequence[bytes], width: int, height: int) -> np.ndarray:
    """``decode_runs`` of each of many bitmaps of one size: (number, height, width).

    All bitmaps are read in step, one code of each at a time.
    """
    if width <= 0 or height <= 0 or len(coded) < LEAST_IN_STEP:
        return np.array([decode_runs(data, width, height) for data in coded], dtype=np.uint8).reshape(len(coded), max(0, height), max(0, width))
    size = width * height
    buffer = np.frombuffer(b"".join(coded) + b"\0\0\0\0", dtype=np.uint8)
    stop = np.cumsum([len(data) for data in coded])
    at = np.concatenate([[0], stop[:-1]])
    image, line, x = np.arange(len(coded)), np.zeros(len(coded), dtype=np.int64), np.zeros(len(coded), dtype=np.int64)
    begins, lengths, colours = [], [], []
    while True:
        going = np.flatnonzero((at < stop) & (line < height))
        if not len(going):
            break
        if len(going) < len(at):
            image, at, stop, line, x = image[going], at[going], stop[going], line[going], x[going]
        colour = buffer[at]
        coded_run = colour == 0
        flags = np.where(coded_run, buffer[at + 1], 0)
        at = at + 1 + coded_run
        long, painted = flags & 0x40 > 0, flags & 0x80 > 0
        length = np.where(coded_run, (flags & 0x3F).astype(np.int64), 1)
        length = np.where(long, length << 8 | buffer[np.minimum(at, len(buffer) - 1)], length)
        at += long
        colour = np.where(painted, buffer[np.minimum(at, len(buffer) - 1)], colour)
        at += painted
        whole = at <= stop  # a code cut off by the end is dropped
        ends_line = coded_run & (flags == 0)
        length = np.where(whole & ~ends_line, length, 0)
        begin = line * width + x
        inked = np.flatnonzero((length > 0) & (colour > 0))
        begins.append(image[inked] * size + begin[inked])
        lengths.append(np.clip(size - begin[inked], 0, length[inked]))
        colours.append(colour[inked])
        to_line, to_x = np.divmod(begin + length, width)
        full = to_x == 0  # a full line is left by its own end mark
        moved = length > 0
        line = np.where(moved, to_line - full, line + (ends_line & whole))
        x = np.where(moved, np.where(full, width, to_x), np.where(ends_line, 0, x))
    out = np.zeros(len(coded) * size, dtype=np.uint8)
    if begins:
        begin, length, colour = np.concatenate(begins), np.concatenate(lengths), np.concatenate(colours)
        ends = np.cumsum(length)
        out[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)] = np.repeat(colour, length)
    return out.reshape(len(coded), height, width)


def drawn_greys(grey: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Grey value of each palette entry drawn over background."""
    over = (alpha * grey + (255 - alpha) * np.uint16(BACKGROUND) + 254) // 255
    return np.where(alpha > 0, over, BACKGROUND).astype(np.uint8)


def trimmed_many(canvases: np.ndarray) -> list[tuple[np.ndarray, tuple[int, int, int, int]] | None]:
    """``trimmed`` of each of many canvases of one size, at place 0, 0."""
    inked = canvases != BACKGROUND
    rows, columns = inked.any(2), inked.any(1)
    y0, x0 = rows.argmax(1).tolist(), columns.argmax(1).tolist()
    y1, x1 = (rows.shape[1] - 1 - rows[:, ::-1].argmax(1)).tolist(), (columns.shape[1] - 1 - columns[:, ::-1].argmax(1)).tolist()
    return [(canvas[b : d + 1, a : c + 1], (a, b, c, d)) if any_ink else None for canvas, any_ink, a, b, c, d in zip(canvases, rows.any(1).tolist(), x0, y0, x1, y1)]


def palette_tables(palette: Mapping[int, Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Grey (inverted luminance) and alpha of 256 entries, from entry to (y, cr, cb, alpha)."""
    grey, alpha = np.full(256, BACKGROUND, dtype=np.uint16), np.zeros(256, dtype=np.uint16)
    for entry, (y, _, _, a) in palette.items():
        grey[entry & 0xFF], alpha[entry & 0xFF] = 255 - y, a
    alpha[list(CLEAR_ENTRIES)] = 0
    return grey, alpha


def trimmed(canvas: np.ndarray, left: int, top: int) -> tuple[np.ndarray, tuple[int, int, int, int]] | None:
    """Canvas cut to what is not background, with its inclusive box; null if nothing is."""
    ys, xs = np.nonzero(canvas != BACKGROUND)
    if not len(ys):
        return None
    y0, y1, x0, x1 = int(ys.min()), int(ys.max()), int(xs.min()), int(xs.max())
    return canvas[y0 : y1 + 1, x0 : x1 + 1].astype(np.uint8), (left + x0, top + y0, left + x1, top + y1)


def blend(layers: Iterable[tuple[np.ndarray, int, int]], grey: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int, int]] | None:
    """Indexed layers drawn over each other at their places, trimmed."""
    layers = [layer for layer in layers if layer[0].size]
    if not layers:
        return None
    left, top = min(x for _, x, _ in layers), min(y for _, _, y in layers)
    right, bottom = max(x + p.shape[1] for p, x, _ in layers), max(y + p.shape[0] for p, _, y in layers)
    canvas = np.full((bottom - top, right - left), BACKGROUND, dtype=np.uint16)
    for pixels, x, y in layers:
        under = canvas[y - top : y - top + pixels.shape[0], x - left : x - left + pixels.shape[1]]
        a = alpha[pixels]
        over = (a * grey[pixels] + (255 - a) * under + 254) // 255
        np.copyto(under, over, where=a > 0)
    return trimmed(canvas, left, top)


def compose(windows: Sequence[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, int, int] | None:
    """Decoded windows on one surface, later ones on top; null if all is background."""
    if not windows:
        return None
    left, top = min(x for _, x, _ in windows), min(y for _, _, y in windows)
    right, bottom = max(x + p.shape[1] for p, x, _ in windows), max(y + p.shape[0] for p, _, y in windows)
    surface = np.full((bottom - top, right - left), BACKGROUND, dtype=np.uint8)
    for pixels, x, y in windows:
        part = surface[y - top : y - top + pixels.shape[0], x - left : x - left + pixels.shape[1]]
        np.copyto(part, pixels, where=pixels != BACKGROUND)
    return None if (surface == BACKGROUND).all() else (surface, left, top)


def pixel_hash(pixels: np.ndarray) -> bytes:
    """Eight bytes that identify a raster: its shape and rows. As an unsigned number: big-endian."""
    shape = struct.pack(">II", *pixels.shape)
    return hashlib.blake2b(shape + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes(), digest_size=8).digest()


def data_digest(data: bytes) -> bytes:
    return hashlib.blake2b(bytes(data), digest_size=8).digest()


def png(pixels: np.ndarray, level: int = 6) -> bytes:
    """PNG file of a grey (2-D) or RGB (3-D) raster."""
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    height, width = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    rows = np.concatenate([np.zeros((height, 1), dtype=np.uint8), pixels.reshape(height, -1)], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Raster of a PNG written by ``png`` (no filters, eight bits)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, shape = 8, b"", None
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind = struct.unpack(">IIBB", part[:10])
            shape = (height, width) if kind == 0 else (height, width, 3)
        elif name == b"IDAT":
            body += part
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(shape[0], -1)
    if rows[:, 0].any():
        raise ValueError("filtered PNG rows are not read")
    return rows[:, 1:].reshape(shape).copy()


def bmp(pixels: np.ndarray) -> bytes:
    """BMP file of a grey raster."""
    height, width = pixels.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, :width] = pixels[::-1]
    palette = b"".join(bytes([v, v, v, 0]) for v in range(256))
    offset = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette + rows.tobytes()


def outlined(pixels: np.ndarray, boxes: Sequence[tuple[int, int, int, int, tuple[int, int, int]]]) -> np.ndarray:
    """RGB raster with the outlines of inclusive boxes in their colours."""
    out = np.repeat(pixels[:, :, None], 3, axis=2) if pixels.ndim == 2 else pixels.copy()
    for left, top, right, bottom, colour in boxes:
        out[[top, bottom], left : right + 1] = colour
        out[top : bottom + 1, [left, right]] = colour
    return out
