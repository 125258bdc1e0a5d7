"""Path, name, tag and caption expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, text

# Words a vendor pack repeats in every file name, and folders that carry no meaning.
PACK_NOISE_WORDS = ("tile", "kenney")
PLAIN_FOLDERS = ("png", "images")

# Limits above which an output path is shortened.
MAX_PATH = 180
MAX_PART = 80


def path_order(rel_path: Column | str) -> Column:
    """Sort key of a path: its components, compared one by one."""
    return F.split(col(rel_path), "/")


def file_name(rel_path: Column | str) -> Column:
    return F.element_at(F.split(col(rel_path), "/"), -1)


def stem(rel_path: Column | str) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(rel_path), r"(?<=.)\.[^.]+$", "")


def path_stem(rel_path: Column | str) -> Column:
    """Whole path without its last suffix; the key that pairs an asset with its sidecar."""
    return F.regexp_replace(col(rel_path), r"(?<=[^/])\.[^./]+$", "")


def suffix(rel_path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(rel_path), r"(?<=.)(\.[^.]+)$", 1))


def is_hidden(rel_path: Column | str) -> Column:
    return F.coalesce(col(rel_path).rlike(r"(^|/)\."), F.lit(False))


def slug(s: Column | str) -> Column:
    joined = F.lower(F.regexp_replace(col(s), r"[^\p{L}\p{N}]", "_"))
    return F.coalesce(text(F.regexp_replace(joined, "^_+|_+$", "")), F.lit("source"))


def _words(s: Column, separators: str) -> Column:
    words = F.split(F.lower(F.translate(s, separators, "_" * len(separators))), "_")
    return F.filter(words, lambda w: (w != "") & ~w.rlike(r"^\p{Nd}+$"))


def source_tags(tags: Column | str, rel_path: Column | str) -> Column:
    """Tags of the source together with the words of the file name."""
    own = F.coalesce(col(tags), F.array().cast("array<string>"))
    return F.array_sort(F.array_union(own, _words(stem(rel_path), "-")))


def pack_tags(rel_path: Column | str) -> Column:
    """Words of the file name and of its folders, without the pack's noise words."""
    parts = F.split(col(rel_path), "/")
    folders = F.filter(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~F.lower(p).isin(*PLAIN_FOLDERS)
    )
    words = F.flatten(F.transform(F.concat(folders, F.array(stem(rel_path))), lambda p: _words(p, "- ")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*PACK_NOISE_WORDS))))


def safe_output_path(rel_path: Column | str) -> Column:
    """The path itself, or a short digest-named one where a file system could refuse it."""
    rel = col(rel_path)
    too_long = (F.length(rel) > MAX_PATH) | F.exists(F.split(rel, "/"), lambda p: F.length(p) > MAX_PART)
    short = F.concat(
        F.lit("_long_paths/"),
        F.substring(slug(stem(rel)), 1, 48),
        F.lit("_"),
        F.substring(F.sha2(rel, 256), 1, 24),
        F.coalesce(text(suffix(rel)), F.lit(".bin")),
    )
    return F.when(too_long, short).otherwise(rel)


def asset_caption(caption: Column | str, category: Column | str, fallback: Column | str = "pixel art") -> Column:
    """Caption for conditioning: own caption, else category, else the fallback; the category is added if missing."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    category = text(category)
    base = F.coalesce(text(caption), category, fallback)
    return F.when(category.isNotNull() & ~base.contains(category), F.trim(F.concat_ws(" ", base, category))).otherwise(base)


def row_caption(text_col: Column, prompt: Column, caption: Column) -> Column:
    return F.coalesce(text(text_col), text(prompt), text(caption))


def provenance(source: Column, rel_path: Column | str) -> Column:
    """Provenance fields of an asset taken from ``source`` (a catalogue struct)."""
    rel = col(rel_path)
    return F.struct(
        source["name"].alias("source"),
        F.coalesce(text(source["source_url"]), text(source["url"]), text(source["path"])).alias("source_url"),
        source["license"].alias("license"),
        source["author"].alias("author"),
        source["category"].alias("category"),
        source_tags(source["tags"], rel).alias("tags"),
        rel.alias("provenance"),
        F.concat_ws("/", slug(source["name"]), rel).alias("corpus_rel_path"),
    )


def curation_stamp(metadata: Column, status: Column, source_path: Column, colors: Column, palette_size: Column) -> Column:
    """Sidecar metadata (a string map) with the outcome of curation added."""
    stamped = ("curation_status", "unique_color_count", "palette_size_used")
    kept = F.map_filter(metadata, lambda k, _: ~k.isin(*stamped) & ~((k == "source_path") & source_path.isNotNull()))
    added = F.create_map(
        F.lit("curation_status"),
        status,
        F.lit("unique_color_count"),
        colors.cast("string"),
        F.lit("palette_size_used"),
        palette_size.cast("string"),
    )
    with_path = F.when(
        source_path.isNotNull(), F.create_map(F.lit("source_path"), source_path)
    ).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_concat(kept, added, with_path)
