"""Expressions over whole images held in one row.

An image is ``pixels array<bigint>`` in raster order, each value ``a<<24 | r<<16 | g<<8 | b``: comparing the
numbers is comparing (a, r, g, b), which is the palette order. An image is bounded, so working inside the row
needs no shuffle and cannot be skewed by a large source or a popular colour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import col, let

OPAQUE = 1 << 24


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    return a.cast("bigint") * 16777216 + r.cast("bigint") * 65536 + g.cast("bigint") * 256 + b.cast("bigint")


def alpha(px: Column) -> Column:
    return F.shiftright(px, 24).cast("int")


def red(px: Column) -> Column:
    return F.shiftright(px, 16).bitwiseAND(255).cast("int")


def green(px: Column) -> Column:
    return F.shiftright(px, 8).bitwiseAND(255).cast("int")


def blue(px: Column) -> Column:
    return px.bitwiseAND(255).cast("int")


def clear_hidden(px: Column) -> Column:
    """A fully transparent pixel has no colour."""
    return F.when(px < OPAQUE, F.lit(0).cast("bigint")).otherwise(px)


def visible_pixels(pixels: Column | str) -> Column:
    return F.transform(col(pixels), clear_hidden)


def palette(pixels: Column | str) -> Column:
    """Distinct colours in palette order."""
    return F.sort_array(F.array_distinct(visible_pixels(pixels)))


def color_count(pixels: Column | str) -> Column:
    return F.size(F.array_distinct(visible_pixels(pixels)))


def palette_stats(colors: Column | str, max_colors: int) -> Column:
    """struct<unique_color_count, palette_size, lossy>; a lossy palette counts as full."""
    c = col(colors)
    return F.struct(
        c.cast("int").alias("unique_color_count"),
        F.least(c, F.lit(max_colors)).cast("int").alias("palette_size"),
        (c > max_colors).alias("lossy"),
    )


def index_map(pixels: Column | str, colors: Column | str) -> Column:
    """Position of every pixel in a palette that holds all of its colours."""
    return let(
        col(colors),
        lambda p: F.transform(col(pixels), lambda px: (F.array_position(p, clear_hidden(px)) - 1).cast("int")),
    )


def decode_indices(indices: Column | str, colors: Column | str) -> Column:
    """Indices back to pixels; an index outside the palette is an error."""
    bad = F.raise_error(F.lit("an index lies outside the palette")).cast("bigint")
    return let(
        col(colors),
        lambda p: F.transform(
            col(indices), lambda i: F.when((i >= 0) & (i < F.size(p)), F.get(p, i)).otherwise(bad)
        ),
    )


def remap_palette(indices: Column | str, colors: Column | str) -> Column:
    """struct<indices, palette> with the palette brought into palette order (equal colours keep their order)."""
    keyed = F.array_sort(F.transform(col(colors), lambda c, i: F.struct(c.alias("c"), i.alias("i"))))
    return let(
        keyed,
        lambda k: F.struct(
            let(
                F.transform(k, lambda e: e["i"]),
                lambda order: F.transform(col(indices), lambda i: (F.array_position(order, i) - 1).cast("int")),
            ).alias("indices"),
            F.transform(k, lambda e: e["c"]).alias("palette"),
        ),
    )


def rgb_distance(x: Column, y: Column) -> Column:
    dr, dg, db = red(x) - red(y), green(x) - green(y), blue(x) - blue(y)
    return dr * dr + dg * dg + db * db


DISTANCES = 1 << 22  # distances held at once while nearest entries are looked for


def _nearest_entries(pixels: np.ndarray, colors: np.ndarray) -> np.ndarray:
    """Index of the nearest colour for every pixel; see ``nearest_indices``."""
    shown = np.where(pixels < OPAQUE, 0, pixels)
    distinct, inverse = np.unique(shown, return_inverse=True)
    first = 1 if len(colors) and colors[0] == 0 else 0
    entries, found = colors[first:], np.zeros(len(distinct), np.int64)
    if not len(entries):
        return np.full(len(pixels), 0 if first else -1)
    step = max(1, DISTANCES // len(entries))
    channels = [(entries >> shift & 255).astype(np.int32) for shift in (16, 8, 0)]
    for at in range(0, len(distinct), step):
        some, far = distinct[at : at + step], 0
        for shift, channel in zip((16, 8, 0), channels):
            gap = (some >> shift & 255).astype(np.int32)[:, None] - channel
            far = far + gap * gap
        found[at : at + step] = far.argmin(axis=1) + first
    if first:
        found[distinct < OPAQUE] = 0
    return found[inverse]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _nearest_batch(pixels: pd.Series, colors: pd.Series) -> pd.Series:
    out = [None if p is None or c is None else _nearest_entries(np.asarray(p, np.int64), np.asarray(c, np.int64)).astype(np.int32) for p, c in zip(pixels, colors)]
    return pd.Series([None if x is None else np.where(x < 0, None, x) if (x < 0).any() else x for x in out], dtype=object)


def nearest_indices(pixels: Column | str, colors: Column | str) -> Column:
    """Nearest palette entry per pixel by squared RGB distance, the lowest index on a tie; NULL in an empty palette.

    A leading transparent entry takes exactly the transparent pixels. Distances are computed once per distinct colour of the image, not
    once per pixel, over whole Arrow batches: a search per pixel in a list of colours would take the square of their number.
    """
    return _nearest_batch(col(pixels), col(colors))


def has_transparency(pixels: Column | str) -> Column:
    return F.exists(col(pixels), lambda px: px < 255 * OPAQUE)


def opaque_mask(pixels: Column | str) -> Column:
    """Silhouette used by the metrics: alpha of at least one half."""
    return F.transform(col(pixels), lambda px: px >= 128 * OPAQUE)


def boundary(values: Column | str, width: Column | str, valid: Column | None = None) -> Column:
    """True on both sides of every change between 4-neighbours; with ``valid``, only between two valid cells."""
    w = col(width)

    def mark(v: Column) -> Column:
        n = F.size(v)

        def cell(x: Column, i: Column) -> Column:
            def differs(j: Column) -> Column:
                other = F.coalesce(F.get(v, j) != x, F.lit(False))
                if valid is None:
                    return other
                return other & F.coalesce(F.get(valid, i) & F.get(valid, j), F.lit(False))

            return (
                ((i >= w) & differs(i - w))
                | ((i + w < n) & differs(i + w))
                | ((i % w > 0) & differs(i - 1))
                | ((i % w < w - 1) & differs(i + 1))
            )

        return F.transform(v, cell)

    return let(col(values), mark)


def edge_counts(values: Column | str, width: Column | str, height: Column | str) -> Column:
    """struct<changes, pairs> over all horizontal and vertical neighbours."""
    w, h = col(width), col(height)

    def count(v: Column) -> Column:
        right = F.size(F.filter(F.transform(v, lambda x, i: (i % w < w - 1) & (F.get(v, i + 1) != x)), lambda b: b))
        down = F.size(F.filter(F.transform(v, lambda x, i: F.coalesce(F.get(v, i + w) != x, F.lit(False))), lambda b: b))
        return F.struct((right + down).alias("changes"), ((w - 1) * h + (h - 1) * w).alias("pairs"))

    return let(col(values), count)


def quality_score(values: Column, width: Column, height: Column, colors: Column, palette_size: Column, lossy: Column) -> Column:
    """0.35 palette fit + 0.35 edge density + 0.30 size fit, less 0.25 for a lossy image, within 0..1."""
    edges = edge_counts(values, width, height)
    return let(
        edges,
        lambda e: F.greatest(
            F.lit(0.0),
            F.least(
                F.lit(1.0),
                0.35 * F.least(F.lit(1.0), colors / F.greatest(F.lit(1), palette_size))
                + 0.35 * (e["changes"] / F.greatest(F.lit(1), e["pairs"]))
                + 0.30 * F.least(F.lit(1.0), F.greatest(width, height) / F.lit(128))
                - F.when(lossy, F.lit(0.25)).otherwise(F.lit(0.0)),
            ),
        ),
    )


def fit_to_shape(pixels: Column | str, width: Column, height: Column, out_width: Column, out_height: Column) -> Column:
    """Crop or zero-pad an image to another shape, anchored at the top left."""

    def place(src: Column) -> Column:
        def cell(i: Column) -> Column:
            x, y = i % out_width, F.floor(i / out_width).cast("int")
            return F.when((x < width) & (y < height), F.get(src, y * width + x)).otherwise(F.lit(0).cast("bigint"))

        return F.transform(F.sequence(F.lit(0), out_width * out_height - 1), cell)

    return let(col(pixels), place)


def crop(pixels: Column | str, width: Column, box: Column) -> Column:
    """The part of an image inside ``box`` (struct x0,y0,x1,y1; the ends are exclusive)."""
    rows = F.transform(
        F.sequence(box["y0"], box["y1"] - 1),
        lambda y: F.slice(col(pixels), y * width + box["x0"] + 1, box["x1"] - box["x0"]),
    )
    return F.flatten(rows)


def pixels_from_image_struct(image: Column) -> Column:
    """Pixels of Spark's image data source: rows of B,G,R[,A] bytes, or gray."""
    channels = image["nChannels"]

    def unpack(hexed: Column) -> Column:
        def byte(pos: Column) -> Column:
            return F.conv(F.substring(hexed, pos * 2 + 1, F.lit(2)), 16, 10).cast("bigint")

        def cell(i: Column) -> Column:
            at = i * channels
            gray = byte(at)
            return (
                F.when(channels == 4, pack(byte(at + 2), byte(at + 1), byte(at), byte(at + 3)))
                .when(channels == 3, pack(byte(at + 2), byte(at + 1), byte(at), F.lit(255)))
                .otherwise(pack(gray, gray, gray, F.lit(255)))
            )

        return F.transform(F.sequence(F.lit(0), image["width"] * image["height"] - 1), cell)

    return F.when(image["width"] > 0, let(F.hex(image["data"]), unpack))


def pad_palette(colors: Column | str, size: int) -> Column:
    """struct<palette, mask> with exactly ``size`` entries."""

    def pad(p: Column) -> Column:
        filled = F.slice(F.concat(p, F.array_repeat(F.lit(0).cast("bigint"), size)), 1, size)
        mask = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < F.size(p))
        return F.struct(filled.alias("palette"), mask.alias("mask"))

    return let(col(colors), pad)


def logits_to_color(r: Column, g: Column, b: Column, a: Column, valid: Column) -> Column:
    """Palette logits to a packed colour; unused or mostly transparent entries become fully transparent."""

    def channel(x: Column) -> Column:
        return F.bround(255 / (1 + F.exp(-x))).cast("int")

    shown = valid & (channel(a) >= 128)
    return F.when(shown, pack(channel(r), channel(g), channel(b), channel(a))).otherwise(F.lit(0).cast("bigint"))


def composite_over(below: Column, above: Column) -> Column:
    """Source-over of two packed pixels in 8-bit integer arithmetic (7 extra bits, rounded division by 255)."""
    sa, da = F.shiftright(above, 24), F.shiftright(below, 24)
    weight = sa * 255 + da * (255 - sa)

    def div255(x: Column) -> Column:
        return F.shiftright(F.shiftright(x, 8) + x, 8)

    def mix(w: Column) -> Column:
        up = F.expr("0L") if w is None else F.floor(sa * (255 * 255 * 128) / w).cast("bigint")

        def blend(k: Column) -> Column:
            def channel(shift: int) -> Column:
                s = F.shiftright(above, shift).bitwiseAND(255)
                d = F.shiftright(below, shift).bitwiseAND(255)
                return F.shiftright(div255(s * k + d * (255 * 128 - k) + 128 * 128), 7)

            return div255(w + 128) * 16777216 + channel(16) * 65536 + channel(8) * 256 + channel(0)

        return let(up, blend)

    return F.when(sa == 0, below).otherwise(let(weight, mix))


def composite_layers(layers: Column, width: int, height: int) -> Column:
    """Draw ``layers`` (array of struct<x,y,w,h,pixels> in order) on a transparent canvas.

    The canvas is kept as rows: a layer copies the rows it covers and passes the others on as they are.
    """

    def draw(canvas: Column, layer: Column) -> Column:
        x, y = layer["x"], layer["y"]
        w, h = F.least(layer["w"], F.lit(width) - x), F.least(layer["h"], F.lit(height) - y)

        def row(cells: Column, r: Column) -> Column:
            covered = F.zip_with(F.slice(cells, x + 1, w), F.slice(layer["pixels"], r * layer["w"] + 1, w), composite_over)
            return F.concat(F.slice(cells, F.lit(1), x), covered, F.slice(cells, x + w + 1, F.lit(width) - x - w))

        band = F.transform(F.slice(canvas, y + 1, h), row)
        return F.concat(F.slice(canvas, F.lit(1), y), band, F.slice(canvas, y + h + 1, F.lit(height) - y - h))

    empty = F.array_repeat(F.array_repeat(F.lit(0).cast("bigint"), width), height)
    return F.flatten(F.aggregate(layers, empty, draw))
