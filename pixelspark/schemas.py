"""Declared schemas; nothing in this package infers one from data."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE = (
    "name string, path string, url string, hf_repo string, license string, source_url string, author string, "
    "category string, tags array<string>, enabled boolean, blocked_reason string, file_name string, "
    "allow_patterns array<string>, ignore_patterns array<string>, extract_archives boolean, "
    "extract_parquet boolean, extract_grid boolean"
)

CATALOGUE = f"sources array<struct<{', '.join(':'.join(f.strip().split(' ', 1)) for f in SOURCE.split(', '))}>>"

SIDECAR = (
    "caption string, category string, source string, source_url string, license string, author string, "
    "tags array<string>, provenance string"
)

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"

DECODED = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("pixels", T.ArrayType(T.LongType())),
        T.StructField("png_text", T.MapType(T.StringType(), T.StringType())),
    ]
)

MANIFEST = (
    "path string, rel_path string, source_rel_path string, width int, height int, bucket_size int, "
    "aspect_bucket string, bucket string, sha256 string, phash string, duplicate_of string, "
    "near_duplicate_of string, source string, source_url string, license string, metadata map<string,string>, "
    "tags array<string>, category string, lossy boolean, unique_color_count int, palette_size int"
)

HOLDOUT = MANIFEST + ", reason string, source_path string"
