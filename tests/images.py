"""PNG files and pixel helpers for the tests."""

import json
import zlib

import numpy as np

from pixelspark.checks.views import _write_png
from pixelspark.sources.png import PASSES


def packed(rgba):
    a = np.asarray(rgba, dtype=np.int64)
    return (a[..., 3] << 24 | a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]).reshape(-1)


def png(rgba, indexed=False, text="t"):
    a = np.asarray(rgba)
    return _write_png(a.shape[1], a.shape[0], packed(a), indexed, text)


def solid(width, height, color):
    return np.tile(np.array(color, dtype=np.uint8), (height, width, 1))


def save(path, rgba, meta=None, **kwargs):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(png(rgba, **kwargs))
    if meta is not None:
        path.with_suffix(".json").write_text(json.dumps(meta), encoding="utf-8")


def raw_png(width, height, depth, color_type, samples, chunks=b"", interlace=False):
    """PNG of any kind without row filters, from samples [h, w, channels]."""

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    def rows(cells):
        out = b""
        for row in cells:
            flat = row.reshape(-1)
            if depth == 16:
                body = flat.astype(">u2").tobytes()
            elif depth == 8:
                body = flat.astype(np.uint8).tobytes()
            else:
                bits = ((flat[:, None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1)
                body = np.packbits(bits).tobytes()
            out += b"\0" + body
        return out

    data = b""
    if interlace:
        for x0, y0, dx, dy in PASSES:
            part = samples[y0::dy, x0::dx]
            if part.size:
                data += rows(part)
    else:
        data = rows(samples)
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([depth, color_type, 0, 0, int(interlace)])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunks + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def chunk(kind, body):
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
