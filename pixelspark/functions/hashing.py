"""Content digests and the 64-bit average hash."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import col, let

# ITU-601 luma weights in 1/65536 and the resampler's fixed-point precision.
LUMA_R, LUMA_G, LUMA_B = 19595, 38470, 7471
FIXED_POINT_BITS = 22
HASH_SIDE = 8
PIXELS_AT_ONCE = 1 << 17  # of images of one size that are resampled together


def content_digest(content: Column | str) -> Column:
    return F.sha2(col(content), 256)


def crop_digest(width: Column | str, height: Column | str, pixels: Column | str) -> Column:
    """Digest of a cut-out that has no file of its own: equal exactly when size and pixels are equal."""
    parts = F.concat_ws(",", F.transform(col(pixels), lambda p: p.cast("string")))
    return F.sha2(F.concat_ws(":", col(width).cast("string"), col(height).cast("string"), parts), 256)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hash_to_bits(h: Column | str) -> Column:
    return F.lpad(F.bin(col(h)), 64, "0")


def bits_to_hash(bits: Column | str) -> Column:
    return F.aggregate(
        F.split(col(bits), ""), F.lit(0).cast("bigint"), lambda acc, c: F.shiftleft(acc, 1).bitwiseOR(c.cast("bigint"))
    )


def hash_from_values(values: Column | str) -> Column:
    """Bits ``value >= mean`` of 64 values, first value in the highest bit."""

    def pack(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + x)
        return let(
            total,
            lambda t: F.aggregate(
                v,
                F.lit(0).cast("bigint"),
                lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((F.size(v) * x >= t).cast("bigint")),
            ),
        )

    return let(col(values), pack)


def _axis_taps(n: int) -> list[tuple[int, list[int]]]:
    """Triangle-filter taps that resample ``n`` samples to 8: (first sample, fixed-point weights)."""
    scale = n / HASH_SIDE
    reach = max(1.0, scale)
    taps = []
    for out in range(HASH_SIDE):
        center = (out + 0.5) * scale
        lo = max(0, int(center - reach + 0.5))
        hi = min(n, int(center + reach + 0.5))
        raw = [max(0.0, 1.0 - abs((s - center + 0.5) / reach)) for s in range(lo, hi)]
        total = math.fsum(raw)
        taps.append((lo, [int(0.5 + w / total * (1 << FIXED_POINT_BITS)) for w in raw]))
    return taps


@cache
def _axis_matrix(n: int) -> np.ndarray:
    """8 x n: the taps of a side length as fixed-point weights."""
    out = np.zeros((HASH_SIDE, n))
    for row, (lo, weights) in zip(out, _axis_taps(n)):
        row[lo : lo + len(weights)] = weights
    return out


def _rounded(sums: np.ndarray) -> np.ndarray:
    """Fixed-point sums back to values; sums stay far below 2^53, so products of doubles are exact."""
    return (sums.astype(np.int64) + (1 << (FIXED_POINT_BITS - 1))) >> FIXED_POINT_BITS


def _average_hashes(pixels: np.ndarray) -> np.ndarray:
    """Hashes of images of one size, (image, y, x) packed colours: luma, both axes as a product each, bits not below the mean."""
    gray = ((pixels >> 16 & 255) * LUMA_R + (pixels >> 8 & 255) * LUMA_G + (pixels & 255) * LUMA_B + 0x8000) >> 16
    _, height, width = gray.shape
    rows = _rounded(gray.astype(float) @ _axis_matrix(width).T)
    small = _rounded(_axis_matrix(height) @ rows.astype(float)).reshape(len(gray), -1)
    bits = HASH_SIDE * HASH_SIDE * small >= small.sum(axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


@F.pandas_udf(T.LongType())
def _hash_batch(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    out = np.full(len(pixels), None, object)
    sizes: dict[tuple, list[int]] = {}
    for i, (p, w, h) in enumerate(zip(pixels, width, height)):
        if p is not None and w == w and h == h and w and h and len(p) == w * h:  # NULL sides come as NaN
            sizes.setdefault((int(h), int(w)), []).append(i)
    for (h, w), members in sizes.items():
        step = max(1, PIXELS_AT_ONCE // (h * w))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            out[some] = _average_hashes(np.stack([np.asarray(pixels.iloc[i], np.int64) for i in some]).reshape(-1, h, w)).tolist()
    return pd.Series(out, dtype=object)


def with_perceptual_hash(df: DataFrame, max_side: int = 128, out: str = "phash") -> DataFrame:
    """Add the average hash of ``pixels`` (luma, 8x8, bit = not below the mean).

    Raw colours are used: alpha and hidden RGB count. Images with a side above ``max_side`` get NULL, as do those without pixels. Images of
    one size in an Arrow batch are resampled together, by two small matrix products.
    """
    fits = (F.col("width") <= max_side) & (F.col("height") <= max_side)
    side = [F.when(fits, F.col(c)).cast("int") for c in ("width", "height")]
    return df.withColumn(out, _hash_batch(F.when(fits, F.col("pixels")), *side))
