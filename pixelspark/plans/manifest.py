"""Folder of images to manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.buckets import BUCKET_SIZES
from ..functions.hashing import content_digest
from ..operators.dedup import with_duplicate_of, with_near_duplicate_of
from ..operators.reports import histogram, manifest_report
from ..session import cut_lineage
from ..sources.files import decode_files, join_sidecars, read_sidecars, scan_png
from ..sources.manifest import conform, find_manifest, read_manifest, write_manifest
from .features import hash_text, with_image_features, with_size_class


def mark_duplicates(rows: DataFrame, hamming: int = 4) -> DataFrame:
    """Add ``duplicate_of`` and ``near_duplicate_of`` to rows with path, rel_path, sha256 and a numeric phash."""
    ordered = cut_lineage(rows.withColumn("_order", names.path_order("rel_path")))
    exact = with_duplicate_of(ordered, "sha256", "_order", "path")
    return with_near_duplicate_of(exact, "phash", "_order", "path", hamming).drop("_order")


def manifest_rows(images: DataFrame, hamming: int = 4, sizes=BUCKET_SIZES, strict: bool = False) -> DataFrame:
    """Manifest of readable images that carry their features, digest and metadata."""
    return conform(hash_text(mark_duplicates(with_size_class(images, sizes, strict), hamming)))


def build_manifest(
    spark: SparkSession,
    root: str,
    manifest_path: str | None = None,
    max_colors: int = 64,
    sizes=BUCKET_SIZES,
    hamming: int = 4,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(manifest, report) of all PNG files below ``root``.

    One scan yields digest, size, colours and hash. Files too large for any size class are counted as
    ``oversized``; with ``strict`` they are an error.
    """
    side = max(sizes)
    files = decode_files(scan_png(spark, root).withColumn("sha256", content_digest("content")), max_side=side)
    facts = with_image_features(files, max_colors, side)
    if strict:
        too_large = (F.col("width") > side) | (F.col("height") > side)
        message = F.concat(F.lit("image larger than supported buckets: "), F.col("path"))
        facts = facts.withColumn("width", F.when(too_large, F.raise_error(message).cast("int")).otherwise(F.col("width")))
    reason = F.when(F.col("width").isNull(), "corrupt").when((F.col("width") > side) | (F.col("height") > side), "oversized")
    facts = cut_lineage(join_sidecars(facts.drop("content", "pixels", "png_text").withColumn("reason", reason), read_sidecars(spark, root, strict=True)))
    rows = cut_lineage(manifest_rows(facts.where(F.col("reason").isNull()), hamming, sizes))
    if manifest_path:
        write_manifest(rows, manifest_path)
    report = manifest_report(rows).unionByName(histogram(facts, "rejected", F.col("reason")))
    return rows, report


def open_dataset(spark: SparkSession, root: str, manifest: str | None = None) -> DataFrame:
    """Rows to work on: the manifest when there is one, else a listing of the PNG files with their sidecars."""
    found = manifest or find_manifest(spark, root)
    if found:
        rows = read_manifest(spark, found, root)
    else:
        listing = scan_png(spark, root).select("path", "rel_path", "modificationTime", "length")
        rows = join_sidecars(listing, read_sidecars(spark, root))
    if rows.isEmpty():
        raise ValueError(f"{root} has no PNG files")
    return rows
