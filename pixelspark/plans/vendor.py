"""One vendor folder or archive to a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.buckets import image_rejection_raw
from ..functions.hashing import content_digest
from ..operators.reports import distribution_report, histogram, totals
from ..session import cut_lineage
from ..sources.files import decode_files, expand_archives, scan_files
from ..sources.manifest import path_exists, write_manifest
from .features import with_image_features
from .manifest import manifest_rows


def pack_rows(
    files: DataFrame, tagged: Column, source: str, source_url: str, license_text: str, max_size: int = 128, max_colors: int = 64, max_pixel_art_colors: int = 256
) -> DataFrame:
    """Files of a pack (rel_path, content) as classified images; only the accepted keep their pixels."""
    files = files.where(~names.is_hidden("rel_path")).withColumn("sha256", content_digest("content"))
    is_image = names.suffix("rel_path") == ".png"
    payload = files.withColumn("content", F.when(is_image, F.col("content")))
    facts = with_image_features(decode_files(payload, max_side=max_size), max_colors, max_size)
    reason = F.when(~is_image, "unsupported_format").otherwise(
        image_rejection_raw("width", "height", "unique_color_count", max_size, max_pixel_art_colors)
    )
    return (
        facts.withColumn("reason", reason)
        .withColumn("tags", names.pack_tags(tagged))
        .withColumn("source", F.lit(source))
        .withColumn("source_url", F.lit(source_url))
        .withColumn("license", F.lit(license_text))
        .withColumn("provenance", F.col("rel_path"))
        .withColumn("pixels", F.when(F.col("reason").isNull(), F.col("pixels")))
        .drop("content")
    )


def pack_report(rows: DataFrame) -> DataFrame:
    """Report (section, key, count) of classified pack images."""
    counts = totals(
        rows,
        "total",
        total_scanned=F.count(F.lit(1)),
        total_accepted=F.count_if(F.col("reason").isNull()),
        total_rejected=F.count_if(F.col("reason").isNotNull()),
    )
    report = counts.unionByName(histogram(rows, "rejection_reasons", F.col("reason")))
    return report.unionByName(distribution_report(rows.where(F.col("reason").isNull())).drop("position"))


def prepare_vendor_pack(
    spark: SparkSession,
    source_path: str,
    output: str,
    source: str,
    source_url: str,
    license_text: str,
    max_size: int = 128,
    max_colors: int = 64,
    max_pixel_art_colors: int = 256,
    hamming: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(manifest, report) of a pack; the accepted images are stored in ``<output>/assets`` with their pixels."""
    if path_exists(spark, output):
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(output)
        if not listing.select("path").isEmpty():
            raise ValueError(f"the output folder must be empty, {output} is not")
    if source_path.lower().endswith(".zip"):
        archive = spark.read.format("binaryFile").load(source_path).select(F.col("path").alias("rel_path"), "content")
        files = expand_archives(archive).select(F.col("member").alias("rel_path"), "content")
        tagged = F.col("rel_path")
    else:
        files = scan_files(spark, source_path).select("rel_path", "content")
        tagged = F.concat_ws("/", F.lit(source_path.rstrip("/").rsplit("/", 1)[-1]), F.col("rel_path"))
    facts = pack_rows(files, tagged, source, source_url, license_text, max_size, max_colors, max_pixel_art_colors)
    folder = output.rstrip("/")
    facts.write.mode("overwrite").parquet(f"{folder}/assets")
    stored = spark.read.parquet(f"{folder}/assets").drop("pixels", "png_text")
    accepted = stored.where(F.col("reason").isNull())
    described = accepted.withColumn(
        "metadata",
        F.create_map(
            *[x for k in ("source", "source_url", "license", "provenance") for x in (F.lit(k), F.col(k))],
            *[x for k in ("width", "height", "transparency", "unique_color_count", "lossy") for x in (F.lit(k), F.col(k).cast("string"))],
            F.lit("palette_size_used"),
            F.col("palette_size").cast("string"),
        ),
    ).withColumn("path", F.concat(F.lit(f"{folder}/"), F.col("rel_path")))
    manifest = cut_lineage(manifest_rows(described, hamming))
    write_manifest(manifest, f"{folder}/manifest.jsonl")
    return manifest, pack_report(stored)
