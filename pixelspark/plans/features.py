"""Facts about an image that everything later needs, computed in the same pass that reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions.buckets import BUCKET_SIZES, aspect_bucket, bucket_id, bucket_size
from ..functions.hashing import hash_to_bits, with_perceptual_hash


def with_color_stats(images: DataFrame, max_colors: int = 64) -> DataFrame:
    """Add ``unique_color_count``, ``palette_size``, ``lossy`` and ``transparency`` (NULL without pixels)."""
    counted = images.withColumn("unique_color_count", F.when(F.col("pixels").isNotNull(), px.color_count("pixels")).cast("int"))
    colors = F.col("unique_color_count")
    return (
        counted.withColumn("palette_size", F.least(colors, F.lit(max_colors)).cast("int"))
        .withColumn("lossy", colors > max_colors)
        .withColumn("transparency", px.has_transparency("pixels"))
    )


def with_size_class(images: DataFrame, sizes=BUCKET_SIZES, strict: bool = False) -> DataFrame:
    return (
        images.withColumn("bucket_size", bucket_size("width", "height", sizes, strict))
        .withColumn("aspect_bucket", aspect_bucket("width", "height"))
        .withColumn("bucket", bucket_id("width", "height", sizes))
    )


def with_image_features(images: DataFrame, max_colors: int = 64, max_side: int = 128) -> DataFrame:
    """Colour statistics and the 64-bit hash of images with ``width``, ``height`` and ``pixels``: no shuffle."""
    return with_perceptual_hash(with_color_stats(images, max_colors), max_side)


def hash_text(rows: DataFrame, column: str = "phash") -> DataFrame:
    """The hash as 64 characters, as manifests store it."""
    return rows.withColumn(column, hash_to_bits(column))
