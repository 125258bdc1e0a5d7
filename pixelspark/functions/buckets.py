"""Size classes and stage shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col

# The longest sides of the resolution classes.
BUCKET_SIZES = (32, 64, 128)


def bucket_size(width: Column | str, height: Column | str, sizes: Sequence[int] = BUCKET_SIZES, strict: bool = False) -> Column:
    """Smallest class holding the longest side; larger images give NULL, or an error when ``strict``."""
    w, h = col(width), col(height)
    longest = F.greatest(w, h)
    out = F.when(F.lit(False), F.lit(0))
    for size in sorted(sizes):
        out = out.when(longest <= size, F.lit(size))
    if strict:
        message = F.concat(F.lit("image larger than supported buckets: "), w.cast("string"), F.lit("x"), h.cast("string"))
        return out.otherwise(F.raise_error(message).cast("int"))
    return out


def aspect_bucket(width: Column | str, height: Column | str) -> Column:
    w, h = col(width), col(height)
    return F.when(3 * w >= 4 * h, "landscape").when(4 * w <= 3 * h, "portrait").otherwise("square")


def bucket_id(width: Column | str, height: Column | str, sizes: Sequence[int] = BUCKET_SIZES) -> Column:
    size = bucket_size(width, height, sizes)
    return F.when(size.isNotNull(), F.concat_ws(":", size.cast("string"), aspect_bucket(width, height)))


def stage_shape(width: Column | str, height: Column | str, stage: Column | int, downsample: int = 4) -> Column:
    """struct<w,h> of an image in a stage: only ever scaled down, then padded up to whole tokens."""
    w, h = col(width), col(height)
    most = stage if isinstance(stage, Column) else F.lit(stage)
    scale = F.least(F.lit(1.0), most.cast("double") / F.greatest(w, h))

    def side(n: Column) -> Column:
        scaled = F.greatest(F.lit(1), F.bround(n * scale).cast("int"))
        tokens = F.ceil(scaled / downsample).cast("int")
        return F.least(most, F.greatest(F.lit(1), tokens) * downsample)

    return F.struct(side(w).alias("w"), side(h).alias("h"))


def image_rejection_raw(width: Column | str, height: Column | str, colors: Column | str, max_size: int, max_pixel_art_colors: int) -> Column:
    """First reason to refuse a raw image, or NULL. A NULL width means that the decoder refused it.

    The size comes first, so a size known from the header alone decides without decoding.
    """
    w, h = col(width), col(height)
    return (
        F.when(w.isNull(), "corrupt")
        .when((w <= 0) | (h <= 0) | (w > max_size) | (h > max_size), "oversized")
        .when(col(colors) > max_pixel_art_colors, "non_pixel_art")
    )


def candidate_rejection(
    width: Column | str, height: Column | str, colors: Column | str, max_size: int, max_colors: int, max_pixel_art_colors: int
) -> Column:
    """First reason to hold a curation candidate back, or NULL."""
    w, h, c = col(width), col(height), col(colors)
    return (
        F.when((w <= 0) | (h <= 0) | (w > max_size) | (h > max_size), "oversized_high_res")
        .when(c > max_pixel_art_colors, "non_pixel_art_smooth")
        .when(c > max_colors, "lossy_gt_64_colors")
    )
