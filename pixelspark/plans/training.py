"""Manifest to padded training batches, and stage targets."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import asset_caption
from ..operators.batches import bucket_batches, collate, train_val_test_split
from ..operators.curate import training_filter
from ..operators.metrics import assign_codes
from ..operators.quantize import encode_images
from ..operators.reports import throughput_report
from ..operators.targets import with_regions, with_stage_grid
from ..session import cut_lineage
from ..sources.files import decode_files
from ..sources.manifest import fingerprint, path_exists, unencoded


def training_rows(
    manifest: DataFrame,
    key: str = "rel_path",
    max_bucket_size: int | None = None,
    include_lossy: bool = False,
    limit: int | None = None,
    validation_fraction: float = 0.2,
    test_fraction: float = 0.2,
    seed: int = 0,
) -> DataFrame:
    """Filtered manifest rows with ``split`` and ``conditioning`` (caption); the manifest alone decides."""
    kept = training_filter(manifest, max_bucket_size, include_lossy, limit, key)
    labelled = train_val_test_split(kept, key, validation_fraction, test_fraction, seed)
    return labelled.withColumn("conditioning", asset_caption("caption", "category"))


def training_batches(rows: DataFrame, encodings: DataFrame, key: str = "rel_path", batch_size: int = 8, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """Padded samples of single-bucket batches; ``encodings`` holds width, height, indices and palette per key.

    Batches are formed on the narrow manifest rows, so the pixels move once, in the join to their batch.
    """
    placed = bucket_batches(rows, key, batch_size, seed, drop_last)
    drop = [c for c in ("width", "height", "indices", "palette") if c in placed.columns]
    return collate(placed.drop(*drop).join(encodings.select(key, "width", "height", "indices", "palette"), key))


def stage_targets(images: DataFrame, stages=(32, 64, 128), downsample: int = 4, classes: int = 65, connected: bool = True) -> DataFrame:
    """One row per image and stage: regions, found once, resized to each stage's shape and kept within the class range."""
    staged = with_regions(images, connected).withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return with_stage_grid(staged, F.col("stage"), downsample, classes=classes)


def stage_codes(latents: DataFrame, codebook: DataFrame, vector: str = "vector") -> DataFrame:
    """Codes of supplied latent vectors; the network that makes them is not part of this package."""
    return assign_codes(latents, codebook, vector)


def refresh_encodings(spark: SparkSession, files: DataFrame, table: str, max_colors: int = 64, max_side: int = 128) -> DataFrame:
    """Encodings of ``files`` (path, modificationTime, length, content), kept in a table between runs.

    Only files whose fingerprint the table lacks are decoded; their encodings are appended.
    """
    key = fingerprint(F.col("path"), F.col("modificationTime"), F.col("length"), max_colors)
    keyed = files.withColumn("fingerprint", key)
    todo = unencoded(keyed, spark.read.parquet(table)) if path_exists(spark, table) else keyed
    images = decode_files(todo, max_side=max_side).where(F.col("pixels").isNotNull()).drop("content", "png_text")
    images = cut_lineage(images)
    encode_images(images, "fingerprint", max_colors).drop("pixels").write.mode("append").parquet(table)
    return spark.read.parquet(table).join(keyed.select("fingerprint"), "fingerprint", "left_semi")


def measure_throughput(samples: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Time one pass over padded samples and report samples per second and projected hours."""
    start = time.perf_counter()
    touched = F.sum(F.aggregate("indices", F.lit(0).cast("bigint"), lambda s, x: s + x))
    counts = cut_lineage(samples.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("count"), touched.alias("touched")))
    return throughput_report(counts, time.perf_counter() - start)
