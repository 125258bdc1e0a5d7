"""PNG reading for content that Spark's image source cannot see (Parquet cells, archive members).

Also used for files, because one ``binaryFile`` scan then gives digest, header and pixels together, where the
image source would need a second read and a join of the two. Sizes come from the header bytes with plain
expressions, so only the images that pass the size test reach the decoder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.base import col
from ..schemas import DECODED

# Fixed values of the format: the signature, channels per colour type, and the first cell and step of each
# interlace pass as (x, y, dx, dy).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIGNATURE_HEX = SIGNATURE.hex().upper()
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
PIXELS_AT_ONCE = 1 << 16  # decoded pixels that a task holds before it hands them over, beyond one image
ROW_COST = 64  # pixels that a row's other fields count for


def is_png(content: Column | str) -> Column:
    return F.coalesce(F.hex(F.substring(col(content), 1, 8)) == SIGNATURE_HEX, F.lit(False))


def png_header(content: Column | str) -> Column:
    """struct<width,height,depth,color_type> from the header bytes alone; NULL when it is not a PNG."""
    c = col(content)

    def number(at: int, size: int) -> Column:
        return F.conv(F.hex(F.substring(c, at, size)), 16, 10).cast("bigint")

    return F.when(
        is_png(c) & (F.length(c) >= 26),
        F.struct(
            number(17, 4).alias("width"), number(21, 4).alias("height"), number(25, 1).alias("depth"), number(26, 1).alias("color_type")
        ),
    )


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        (crc,) = struct.unpack(">I", data[at + 8 + size : at + 12 + size])
        if kind[0] < 97 and crc != zlib.crc32(kind + body):
            raise ValueError("bad chunk checksum")
        yield kind, body
        at += 12 + size


def _unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo row filters. Cell (y, x) needs only left, upper and upper-left cells, so one diagonal of all rows
    is computed at a time."""
    h, n = raw.shape
    w = n // step
    cells = raw.reshape(h, w, step).astype(np.int32)
    if not kinds.any():
        return cells
    out = np.zeros((h + 1, w + 1, step), dtype=np.int32)
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        k = kinds[y][:, None]
        guess = np.select([k == 0, k == 1, k == 2, k == 3, k == 4], [0 * a, a, b, (a + b) >> 1, paeth])
        out[y + 1, x + 1] = (cells[y, x] + guess) & 255
    return out[1:, 1:]


def _samples(stream: bytes, w: int, h: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """Samples [h, w, channels] of one pass and the number of bytes it used."""
    row = (w * channels * depth + 7) // 8
    used = h * (row + 1)
    if len(stream) < used:
        raise ValueError("truncated image data")
    lines = np.frombuffer(stream[:used], dtype=np.uint8).reshape(h, row + 1)
    flat = _unfilter(lines[:, 1:], lines[:, 0], max(1, channels * depth // 8)).reshape(h, row)
    if depth == 8:
        return flat.reshape(h, w, channels), used
    if depth == 16:
        return flat[:, ::2].reshape(h, w, channels), used
    bits = np.unpackbits(flat.astype(np.uint8), axis=1)[:, : w * channels * depth]
    weights = 1 << np.arange(depth - 1, -1, -1)
    return (bits.reshape(h, w * channels, depth) @ weights).reshape(h, w, channels), used


def decode(data: bytes) -> tuple[int, int, np.ndarray, dict[str, str]]:
    """(width, height, packed pixels, text entries); raises on anything that is not a whole PNG."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    body, plte, trns, text, head = b"", b"", None, {}, None
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            plte = part
        elif kind == b"tRNS":
            trns = part
        elif kind == b"IDAT":
            body += part
        elif kind == b"tEXt" and b"\0" in part:
            key, value = part.split(b"\0", 1)
            text[key.decode("latin-1")] = value.decode("latin-1")
        elif kind == b"iTXt" and part.count(b"\0") >= 4:
            key, flags, _, rest = part.split(b"\0", 1)[0], part.split(b"\0", 1)[1][:2], None, part.split(b"\0", 1)[1][2:]
            value = rest.split(b"\0", 2)[2]
            text[key.decode("latin-1")] = (zlib.decompress(value) if flags[0] else value).decode("utf-8", "replace")
    width, height, depth, color, _, _, interlace = head
    channels = CHANNELS[color]
    # no more than the header implies: rows of samples with a filter byte each, at most one more row for each pass of a pixel's size
    opened = zlib.decompressobj()
    stream = opened.decompress(body, (-(-width * depth * channels // 8) + 1 + 8) * (height + 8) * 2)
    if interlace:
        grid = np.zeros((height, width, channels), dtype=np.int64)
        for x0, y0, dx, dy in PASSES:
            w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
            if w > 0 and h > 0:
                part, used = _samples(stream, w, h, depth, channels)
                grid[y0::dy, x0::dx], stream = part, stream[used:]
    else:
        grid = _samples(stream, width, height, depth, channels)[0].astype(np.int64)
    top = 255 if depth >= 8 else (1 << depth) - 1
    opaque = np.full((height, width), 255, dtype=np.int64)
    if color == 3:
        table = np.zeros((256, 4), dtype=np.int64)
        colors = np.frombuffer(plte, dtype=np.uint8).reshape(-1, 3)
        table[: len(colors), :3], table[:, 3] = colors, 255
        if trns is not None:
            table[: len(trns), 3] = np.frombuffer(trns, dtype=np.uint8)
        rgba = table[grid[..., 0]]
        r, g, b, a = (rgba[..., i] for i in range(4))
    elif color in (0, 4):
        r = g = b = grid[..., 0] * 255 // top
        a = grid[..., 1] if color == 4 else opaque
        if color == 0 and trns is not None and depth <= 8:
            a = np.where(grid[..., 0] == struct.unpack(">H", trns[:2])[0], 0, 255)
    else:
        r, g, b = grid[..., 0], grid[..., 1], grid[..., 2]
        a = grid[..., 3] if color == 6 else opaque
        if color == 2 and trns is not None and depth == 8:
            a = np.where((grid == np.array(struct.unpack(">HHH", trns[:6]))).all(axis=2), 0, 255)
    return width, height, (a << 24 | r << 16 | g << 8 | b).reshape(-1), text


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["width", "height", "pixels", "png_text"], dtype=object)
    return out.astype({"width": "Int32", "height": "Int32"})


@F.pandas_udf(DECODED)
def _decode_png(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Decoded image as a struct; all its fields are NULL for a corrupt or missing payload. Images are handed over in bounded parts
    of an Arrow batch, as their pixels take far more memory than their files."""
    for content in batches:
        rows, held = [], 0
        for data in content:
            try:
                rows.append(decode(data))
                held += len(rows[-1][2])
            except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
                rows.append((None, None, None, None))
            held += ROW_COST
            if held >= PIXELS_AT_ONCE:
                yield _frame(rows)
                rows, held = [], 0
        if rows:
            yield _frame(rows)


# Nondeterministic only for the planner: a call is never copied into several expressions and decoded twice.
_DECODE = _decode_png.asNondeterministic()


def decode_png(content: Column | str) -> Column:
    return _DECODE(col(content))
