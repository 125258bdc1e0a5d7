"""Provisional curation: a folder of candidates to an accepted pool and a holdout with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import components, names
from ..functions import pixels as px
from ..functions.buckets import candidate_rejection
from ..functions.hashing import content_digest, crop_digest
from ..operators.dedup import greedy_dedup
from ..operators.reports import histogram, totals
from ..session import cut_lineage
from ..sources.files import decode_files, join_sidecars, read_sidecars, scan_files
from ..sources.manifest import conform, write_accepted_and_held, write_report
from ..schemas import BOX, HOLDOUT
from .features import hash_text, with_image_features, with_size_class

SPLITS = "_splits"


def sheet_pieces(images: DataFrame, max_size: int = 128, searched: Column | None = None) -> DataFrame:
    """Add ``boxes`` (array, empty unless the image is ``searched`` and a sheet of at least two pieces)."""
    mask = components.sheet_mask("pixels")
    mask = mask if searched is None else F.when(searched, mask)
    labelled = components.with_component_labels(images, mask, out="_labels", diagonal=True)
    return labelled.withColumn("boxes", components.sheet_boxes("_labels", "width", max_size)).drop("_labels")


def piece_path(rel_path: Column, index: Column, box: Column) -> Column:
    name = F.format_string(
        "%04d_%d_%d_%dx%d.png", index.cast("int"), box["x0"], box["y0"], box["x1"] - box["x0"], box["y1"] - box["y0"]
    )
    return F.concat_ws("/", F.lit(SPLITS), names.path_stem(rel_path), name)


def split_sheets(images: DataFrame, max_size: int = 128) -> DataFrame:
    """Replace every sheet by its pieces, in one pass over the images.

    Adds ``piece`` (number within the sheet, NULL for a whole image), ``parent`` and ``box``. Only images above
    the size limit, and small enough to have been decoded, are searched. Pieces are cut before the rows multiply,
    so a sheet's pixels are never copied along.
    """
    large = (F.col("width") > max_size) | (F.col("height") > max_size)
    boxed = sheet_pieces(images, max_size, large & F.col("pixels").isNotNull())
    cut = F.transform(
        "boxes", lambda b, i: F.struct(i.alias("piece"), b.alias("box"), px.crop("pixels", F.col("width"), b).alias("pixels"))
    )
    whole = F.array(F.struct(F.lit(None).cast("int").alias("piece"), F.lit(None).cast(BOX).alias("box"), F.col("pixels").alias("pixels")))
    parts = F.explode(F.when(F.size("boxes") > 0, cut).otherwise(whole))
    rest = [c for c in images.columns if c != "pixels"]
    rows = boxed.select(*rest, parts.alias("_p")).select(*rest, "_p.piece", "_p.box", "_p.pixels")
    is_piece = F.col("piece").isNotNull()

    def of_piece(name: str, value: Column) -> Column:
        return F.when(is_piece, value).otherwise(F.col(name)).alias(name)

    placed = rows.withColumn("parent", F.when(is_piece, F.col("rel_path"))).select(
        *[c for c in rows.columns if c not in ("rel_path", "width", "height")],
        "parent",
        of_piece("rel_path", piece_path(F.col("parent"), F.col("piece"), F.col("box"))),
        of_piece("width", F.col("box.x1") - F.col("box.x0")),
        of_piece("height", F.col("box.y1") - F.col("box.y0")),
    )
    return placed.withColumn("sha256", of_piece("sha256", crop_digest("width", "height", "pixels")))


def classify_candidates(
    candidates: DataFrame, max_size: int, max_colors: int, max_pixel_art_colors: int, hamming: int, key: str = "rel_path", order: str = "_order"
) -> DataFrame:
    """Add ``status``, ``reason`` and the duplicate columns to candidates with features; ``reason`` may be preset."""
    ladder = candidate_rejection("width", "height", "unique_color_count", max_size, max_colors, max_pixel_art_colors)
    judged = cut_lineage(candidates.withColumn("reason", F.coalesce("reason", ladder)))
    passed = greedy_dedup(judged.where(F.col("reason").isNull()), "sha256", "phash", order, key, hamming)
    passed = passed.withColumn("reason", F.when(F.col("status") != "accepted", F.col("status")))
    none = F.lit(None).cast("string")
    refused = judged.where(F.col("reason").isNotNull()).select(
        "*", F.lit("rejected").alias("status"), none.alias("duplicate_of"), none.alias("near_duplicate_of")
    )
    return passed.unionByName(refused)


def candidates_from_files(files: DataFrame, sidecars: DataFrame, max_size: int = 128, max_colors: int = 64) -> DataFrame:
    """Candidates of a table of files (path, rel_path, suffix, content): decoded, sheets cut, with features."""
    files = files.where(F.col("suffix") != ".json").withColumn("sha256", content_digest("content"))
    payload = files.withColumn("content", F.when(F.col("suffix") == ".png", F.col("content")))
    scanned = decode_files(payload, max_side=max_size, max_area=components.MAX_SHEET_AREA).drop("content", "png_text")
    facts = with_image_features(split_sheets(scanned, max_size), max_colors, max_size)
    # metadata joins last, when only the pieces of sheets still carry pixels
    facts = facts.withColumn("pixels", F.when(F.col("piece").isNotNull(), F.col("pixels")))
    facts = join_sidecars(facts, sidecars, F.coalesce("parent", "rel_path"))
    first = F.when(F.col("suffix") != ".png", "unsupported_format").when(F.col("width").isNull(), "corrupt")
    order = F.struct(names.path_order(F.coalesce("parent", "rel_path")).alias("p"), F.coalesce("piece", F.lit(-1)).alias("i"))
    return facts.withColumn("reason", first).withColumn("_order", order)


def _with_stamp(rows: DataFrame) -> DataFrame:
    split = F.when(
        F.col("piece").isNotNull(),
        F.create_map(F.lit("split_from"), F.col("parent"), F.lit("split_box"), F.to_json("box")),
    ).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    inherited = F.map_filter("metadata", lambda k, _: ~k.isin("split_from", "split_box") | F.col("piece").isNull())
    source_path = F.when(F.col("piece").isNull(), F.col("path"))
    zero = F.lit(0)
    stamped = names.curation_stamp(
        F.map_concat(inherited, split),
        F.coalesce("reason", F.lit("accepted")),
        source_path,
        F.coalesce("unique_color_count", zero),
        F.coalesce("palette_size", zero),
    )
    return rows.withColumn("metadata", stamped).withColumn("source_path", source_path)


def curation_counts(rows: DataFrame) -> DataFrame:
    """Report (section, key, count) of a curation run."""
    def when_reason(*reasons: str) -> Column:
        return F.count_if(F.coalesce(F.col("reason").isin(*reasons), F.lit(False)))

    parents = F.count_distinct("parent")
    children = F.count("piece")
    counts = totals(
        rows,
        "curation",
        scanned=F.count(F.lit(1)) - children + parents,
        accepted=F.count_if(F.col("status") == "accepted"),
        holdout=F.count_if(F.col("status") != "accepted"),
        sprite_sheets_split=parents,
        split_children=children,
        duplicates=when_reason("duplicate"),
        near_duplicates=when_reason("near_duplicate"),
        non_pixel_art_smooth=when_reason("non_pixel_art_smooth"),
        oversized_high_res=when_reason("oversized_high_res"),
        lossy_gt_64_colors=when_reason("lossy_gt_64_colors"),
        corrupt_unsupported=when_reason("corrupt", "unsupported_format"),
    )
    return counts.unionByName(histogram(rows, "rejection_reasons", F.col("reason")))


def curate_folder(
    spark: SparkSession,
    root: str,
    output: str,
    max_size: int = 128,
    max_colors: int = 64,
    max_pixel_art_colors: int = 256,
    hamming: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of a curation run, written below ``output``.

    Writes ``training_pool`` and ``holdout`` (by reason) with the pieces cut from sheets, the holdout and accepted
    manifests' rows being the same tables, and ``report``. Input files are only read.
    """
    candidates = candidates_from_files(scan_files(spark, root), read_sidecars(spark, root), max_size, max_colors)
    manifest = cut_lineage(curated_rows(candidates, max_size, max_colors, max_pixel_art_colors, hamming))
    folder = output.rstrip("/")
    write_accepted_and_held(manifest, f"{folder}/training_pool", f"{folder}/holdout")
    report = cut_lineage(curation_counts(manifest))
    write_report(report, f"{folder}/report")
    return manifest, report


def curated_rows(candidates: DataFrame, max_size: int = 128, max_colors: int = 64, max_pixel_art_colors: int = 256, hamming: int = 4) -> DataFrame:
    """Classified candidates as manifest and holdout rows; pieces of sheets keep their pixels."""
    classified = classify_candidates(candidates, max_size, max_colors, max_pixel_art_colors, hamming)
    rows = _with_stamp(with_size_class(classified))
    pool = F.concat(F.lit("training_pool/"), names.safe_output_path("rel_path"))
    rows = rows.withColumn("source_rel_path", F.col("rel_path")).withColumn("rel_path", pool)
    kept = hash_text(rows.withColumn("piece_pixels", F.col("pixels")))
    return conform(kept, HOLDOUT + ", status string, piece int, parent string, piece_pixels array<bigint>")
