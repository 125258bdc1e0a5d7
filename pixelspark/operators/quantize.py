"""Palettes for images with too many colours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels as px

MIN_COLORS, MAX_COLORS = 8, 64


def check_max_colors(max_colors: int) -> None:
    if not MIN_COLORS <= max_colors <= MAX_COLORS:
        raise ValueError(f"the number of colours lies between {MIN_COLORS} and {MAX_COLORS}")


def _split(colors: np.ndarray, budget: int, max_colors: int) -> np.ndarray:
    """Means of the boxes of one image's distinct opaque colours, ascending; colours within the budget stay as they are."""
    if len(colors) <= budget:
        return np.sort(colors)
    channels = np.stack([colors >> 16 & 255, colors >> 8 & 255, colors & 255])
    box, boxes = np.zeros(len(colors), np.int64), 1
    while boxes < max_colors:
        names, of, n = np.unique(box, return_inverse=True, return_counts=True)
        by_box, starts = np.argsort(of, kind="stable"), np.cumsum(n) - n
        spread = np.maximum.reduceat(channels[:, by_box], starts, axis=1) - np.minimum.reduceat(channels[:, by_box], starts, axis=1)
        along = channels[spread.argmax(axis=0)[of], np.arange(len(of))]
        half = np.empty(len(of), bool)
        half[np.lexsort((colors, along, of))] = np.arange(len(of)) - np.repeat(starts, n) >= np.repeat((n + 1) // 2, n)
        allowed = np.zeros(len(names), bool)
        allowed[np.lexsort((names, -n))[: max(0, budget - boxes)]] = True
        box = box * 2 + (half & allowed[of])
        boxes *= 2
    _, of, n = np.unique(box, return_inverse=True, return_counts=True)
    r, g, b = ((2 * np.bincount(of, c).astype(np.int64) + n) // (2 * n) for c in channels)
    return np.unique(255 << 24 | r << 16 | g << 8 | b)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _split_batch(colors: pd.Series, budget: pd.Series, max_colors: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else _split(np.asarray(c, np.int64), int(k), int(m)) for c, k, m in zip(colors, budget, max_colors)], dtype=object)


def box_palette(pixels: Column | str, max_colors: int) -> Column:
    """Palette by splitting boxes of the distinct visible colours, one fixed round after the other.

    Every round cuts a box in two equal halves along its widest channel; the last round cuts only as many of the
    fullest boxes as the budget allows. A transparent entry is reserved when any pixel is transparent. The split stays in the row: it moves
    no colour and takes the memory of one Arrow batch.
    """
    check_max_colors(max_colors)
    clear = F.exists(pixels, lambda p: p < px.OPAQUE)
    opaque = F.array_distinct(
        F.transform(F.filter(pixels, lambda p: p >= px.OPAQUE), lambda p: p.bitwiseAND(px.OPAQUE - 1) + 255 * px.OPAQUE)
    )
    shown = _split_batch(opaque, F.lit(max_colors) - clear.cast("int"), F.lit(max_colors))
    zero = F.array(F.lit(0).cast("bigint"))
    return F.when(clear, F.concat(zero, shown)).otherwise(shown)


def box_palettes(df: DataFrame, key: str, max_colors: int) -> DataFrame:
    """(key, palette) of every image, see ``box_palette``."""
    return df.select(key, box_palette("pixels", max_colors).alias("palette"))


def encode_images(df: DataFrame, key: str, max_colors: int = 64) -> DataFrame:
    """Add ``indices``, ``palette``, ``unique_color_count``, ``palette_size`` and ``lossy`` to images.

    Images within the budget keep their exact colours; only the others visit the box split. Nothing is shuffled.
    ``df`` is read once for each of the two ways, so it should be stored if decoding it is expensive.
    """
    check_max_colors(max_colors)
    counted = df.withColumn("unique_color_count", px.color_count("pixels"))
    exact = counted.where(F.col("unique_color_count") <= max_colors).withColumn("palette", px.palette("pixels"))
    exact = exact.withColumn("indices", px.index_map("pixels", "palette")).withColumn("lossy", F.lit(False))
    rest = counted.where(F.col("unique_color_count") > max_colors)
    lossy = rest.withColumn("palette", box_palette("pixels", max_colors))
    lossy = lossy.withColumn("indices", px.nearest_indices("pixels", "palette")).withColumn("lossy", F.lit(True))
    return exact.unionByName(lossy).withColumn("palette_size", F.size("palette"))
