"""Splits, single-bucket batches and padded batch rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import components, grids
from ..session import cut_lineage
from .shuffles import seeded_rank, seeded_split


def train_validation_split(df: DataFrame, key: str, validation_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    if not 0 < validation_fraction < 1:
        raise ValueError("the share for validation lies between 0 and 1")
    return seeded_split(df, [key], seed, [("validation", validation_fraction), ("train", None)])


def train_val_test_split(df: DataFrame, key: str, validation_fraction: float = 0.2, test_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    if validation_fraction <= 0 or test_fraction <= 0 or validation_fraction + test_fraction >= 1:
        raise ValueError("the shares for validation and test are above 0, and below 1 together")
    return seeded_split(df, [key], seed, [("test", test_fraction), ("validation", validation_fraction), ("train", None)])


def bucket_counts(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    return df.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def batch_counts(df: DataFrame, batch_size: int, drop_last: bool = False, bucket: str = "bucket") -> DataFrame:
    """(bucket, batches) without forming any batch."""
    full = F.floor(F.col("count") / batch_size) if drop_last else F.ceil(F.col("count") / batch_size)
    return bucket_counts(df, bucket).select("bucket", full.cast("bigint").alias("batches"))


def bucket_batches(df: DataFrame, key: str, batch_size: int, seed: int = 0, drop_last: bool = False, bucket: str = "bucket") -> DataFrame:
    """Add ``chunk`` (batch within its bucket), ``slot`` (place in the batch) and ``batch_id`` (place of the batch).

    Rows are shuffled inside their bucket, cut into batches and the batches shuffled. All of that happens on
    (key, bucket) alone, stored once; the rows themselves only move in the join that gives them their batch. The
    batches are listed by their first rows, so that list is as distributed as the rows are. ``key`` is unique.
    """
    placed = seeded_rank(df.select(key, bucket), [key], seed, [bucket], "_rank", "_total")
    placed = placed.withColumn("chunk", F.floor((F.col("_rank") - 1) / batch_size).cast("bigint"))
    placed = placed.withColumn("slot", ((F.col("_rank") - 1) % batch_size).cast("bigint"))
    if drop_last:
        placed = placed.where((F.col("chunk") + 1) * batch_size <= F.col("_total"))
    placed = cut_lineage(placed.drop("_rank", "_total"))
    order = seeded_rank(placed.where(F.col("slot") == 0).select(bucket, "chunk"), [bucket, "chunk"], seed + 1, out="batch_id")
    numbered = placed.join(order.withColumn("batch_id", F.col("batch_id") - 1), [bucket, "chunk"])
    return df.join(numbered.select(key, "chunk", "slot", "batch_id"), key)


def collate(batches: DataFrame, batch: str = "batch_id", slot: str = "slot") -> DataFrame:
    """Pad samples (width, height, indices, palette) to the largest of their batch and add their regions.

    One row per sample: padded ``indices`` (-1 outside), ``valid_mask``, ``palette``, ``palette_mask`` and
    ``structure``. The samples move once, to their batch, which is bounded by its size.
    """
    together = Window.partitionBy(batch)
    df = batches.withColumn("batch_width", F.max("width").over(together)).withColumn("batch_height", F.max("height").over(together))
    df = df.withColumn("batch_colors", F.max(F.size("palette")).over(together))
    w, h, bw, bh = F.col("width"), F.col("height"), F.col("batch_width"), F.col("batch_height")
    ones = F.transform("indices", lambda i: F.lit(True))
    extra = F.col("batch_colors") - F.size("palette")
    df = components.with_component_labels(df, components.region_input("indices", "palette"), out="_labels")
    regions = components.regions_from_labels("_labels")
    df = df.withColumn("structure", grids.pad_grid(regions, w, h, bw, bh, F.lit(0)))
    df = df.withColumn("valid_mask", grids.pad_grid(ones, w, h, bw, bh, F.lit(False)))
    df = df.withColumn("indices", grids.pad_grid("indices", w, h, bw, bh, F.lit(-1)))
    df = df.withColumn("palette_mask", F.concat(F.transform("palette", lambda c: F.lit(True)), F.array_repeat(F.lit(False), extra)))
    df = df.withColumn("palette", F.concat("palette", F.array_repeat(F.lit(0).cast("bigint"), extra)))
    return df.drop("_labels")


def batch_rows(collated: DataFrame, columns: list[str], batch: str = "batch_id", slot: str = "slot") -> DataFrame:
    """One row per batch with its samples in order; a batch is bounded by the batch size."""
    packed = F.array_sort(F.collect_list(F.struct(slot, *columns)))
    return collated.groupBy(batch, "batch_width", "batch_height").agg(packed.alias("samples"))
