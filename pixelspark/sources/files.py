"""File scans: assets, sidecars and archives through the ``binaryFile`` source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.pixels import pixels_from_image_struct
from ..schemas import SIDECAR
from .png import decode_png, png_header


MEMBER_COLUMNS = ["archive", "member", "content"]
MEMBER_BATCH_BYTES = 16 << 20


def relative_path(spark: SparkSession, path: Column, root: str) -> Column:
    """Path below ``root``, which the file system makes absolute first; scheme and host are left out on both sides. A root
    that is a file itself, or a pattern, leaves the path from the pattern's fixed folder on, or the file's name."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    bare = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath()
    fixed = bare.rstrip("/")
    while any(c in fixed for c in "*?[{"):
        fixed = fixed.rsplit("/", 1)[0]
    plain = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    below = F.substring(plain, len(fixed) + 2, 1 << 30)
    return F.when(plain == fixed, F.element_at(F.split(plain, "/"), -1)).otherwise(below)


def underscored(spark: SparkSession, root: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Folders and files below ``root`` whose names start with "_", which Spark's listings pass over: the folders as paths to read beside
    ``root``, the files as (path, modification time in milliseconds, length).

    The file system answers one pattern per depth; only what matches reaches Python.
    """
    start = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(spark._jsc.hadoopConfiguration())
    at, folders, found = root.rstrip("/"), [], []
    while True:
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_*")) or []:
            path = status.getPath().toString()
            if status.isDirectory():
                folders.append(re.sub(r"([\\*?\[\]{}])", r"\\\1", path))
            else:
                found.append((path, status.getModificationTime(), status.getLen()))
        at += "/*"
        if not len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at)) or []):
            return folders, found


def _read_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the content of each path, one at a time; NULL where it cannot be read."""
    from pyarrow import fs

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            try:
                files, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", row.column(0)[0].as_py()))
                with files.open_input_stream(path) as opened:
                    content = opened.read()
            except (OSError, pa.ArrowException):
                content = None
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], names=[*row.schema.names, "content"])


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, rel_path, suffix, modificationTime, length, content) of all files but hidden ones, whose name or a folder's starts with ".".

    Columns that are not used are not read: a listing without ``content`` opens no file. Folders that start with "_" are read beside
    the others. Files that do are opened by the executors on their own, in a store that Arrow can reach (local, HDFS, object stores); where
    that fails the row stays, with NULL content.
    """
    folders, found = underscored(spark, root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load([root, *folders])
    found = [f for f in found if glob is None or fnmatchcase(f[0].rsplit("/", 1)[-1], glob)]
    if found:
        listed = spark.createDataFrame(found, "path string, millis bigint, length bigint")
        listed = listed.select("path", F.timestamp_millis("millis").alias("modificationTime"), "length")
        read = listed.repartition(max(1, len(found) // 64)).mapInArrow(_read_paths, "path string, modificationTime timestamp, length bigint, content binary")
        files = files.unionByName(read)
    files = files.withColumn("rel_path", relative_path(spark, F.col("path"), root))
    files = files.where(~names.is_hidden("rel_path")).withColumn("suffix", names.suffix("rel_path"))
    return files.select("path", "rel_path", "suffix", "modificationTime", "length", "content")


def scan_png(spark: SparkSession, root: str) -> DataFrame:
    return scan_files(spark, root, "*.png")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, width, height, pixels) through Spark's own image decoder; corrupt files have NULL pixels.

    For uses that need pixels only. It drops the alpha of gray images; ``decode_files`` keeps it.
    """
    images = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load([root, *underscored(spark, root)[0]])
    path = F.col("image.origin")
    out = images.select(path.alias("path"), relative_path(spark, path, root).alias("rel_path"), F.col("image").alias("_image"))
    pixels = pixels_from_image_struct(F.col("_image"))
    ok = F.col("_image.width") > 0
    return out.where(~names.is_hidden("rel_path")).select(
        "path", "rel_path", F.when(ok, F.col("_image.width")).alias("width"), F.when(ok, F.col("_image.height")).alias("height"), pixels.alias("pixels")
    )


def decode_files(files: DataFrame, max_side: int | None = None, max_area: int | None = None) -> DataFrame:
    """Add ``width``, ``height``, ``pixels`` and ``png_text`` to files with ``content``.

    Width and height come from the header, so images beyond the limits are measured but never decoded. Corrupt
    files have NULL in all four.
    """
    headed = files.withColumn("_head", png_header("content"))
    decode = F.col("_head").isNotNull()
    if max_side is not None:
        small = (F.col("_head.width") <= max_side) & (F.col("_head.height") <= max_side)
        if max_area is not None:
            small = small | (F.col("_head.width") * F.col("_head.height") <= max_area)
        decode = decode & small
    decoded = headed.withColumn("_wanted", decode)
    decoded = decoded.withColumn("_image", decode_png(F.when(F.col("_wanted"), F.col("content"))))
    skipped = F.col("_head").isNotNull() & ~F.col("_wanted")

    def side(name: str) -> Column:
        return F.when(skipped, F.col(f"_head.{name}").cast("int")).otherwise(F.col(f"_image.{name}")).alias(name)

    keep = [c for c in files.columns if c not in ("width", "height", "pixels", "png_text")]
    return decoded.select(*keep, side("width"), side("height"), F.col("_image.pixels").alias("pixels"), F.col("_image.png_text").alias("png_text"))


def parse_sidecar(content: Column, strict: bool = False) -> Column:
    """Sidecar JSON as a struct; malformed text gives NULL, or an error when ``strict``."""
    text = F.decode(content, "UTF-8") if not strict else content.cast("string")
    return F.from_json(text, SIDECAR, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def read_sidecars(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """(stem, sidecar, extra): sidecars by the path stem they share with their asset; ``extra`` is the whole
    object as a string map."""
    files = scan_files(spark, root, "*.json")
    content = F.col("content").cast("string")
    return files.select(
        names.path_stem("rel_path").alias("stem"),
        parse_sidecar(F.col("content"), strict).alias("sidecar"),
        F.from_json(content, "map<string,string>").alias("extra"),
    )


def join_sidecars(assets: DataFrame, sidecars: DataFrame, path: Column | str = "rel_path") -> DataFrame:
    """Add the sidecar fields and ``metadata`` (string map, empty without a sidecar) to assets.

    The sidecar is the one beside ``path``. Join before pixels are attached or after they are dropped.
    """
    fields = ("caption", "category", "source", "source_url", "license", "author", "tags", "provenance")
    joined = assets.withColumn("stem", names.path_stem(path)).join(sidecars, "stem", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return joined.select(*assets.columns, *[F.col(f"sidecar.{f}").alias(f) for f in fields], F.coalesce("extra", empty).alias("metadata"))


def is_unsafe_member(member: Column) -> Column:
    """Whether an archive member would be written outside its folder."""
    parts = F.split(member, "/")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("d"), F.lit(False).alias("out")),
        lambda s, p: F.struct(
            F.when(p == "..", s["d"] - 1).when((p == "") | (p == "."), s["d"]).otherwise(s["d"] + 1).alias("d"),
            (s["out"] | ((p == "..") & (s["d"] == 0))).alias("out"),
        ),
    )
    return member.startswith("/") | depth["out"]


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, content in zip(batch["archive"], batch["content"]):
            rows, size = [], 0
            with zipfile.ZipFile(io.BytesIO(content)) as opened:
                for info in opened.infolist():
                    if info.is_dir():
                        continue
                    rows.append((archive, info.filename, opened.read(info)))
                    size += info.file_size
                    if size > MEMBER_BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=MEMBER_COLUMNS)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=MEMBER_COLUMNS)


def expand_archives(archives: DataFrame, archive: str = "rel_path", content: str = "content") -> DataFrame:
    """(archive, member, content) of zip files held in a column; a member outside its folder is an error."""
    named = archives.select(F.col(archive).alias("archive"), F.col(content).alias("content"))
    members = named.mapInPandas(_members, "archive string, member string, content binary")
    bad = F.raise_error(F.concat(F.lit("unsafe zip path: "), F.col("member")))
    checked = F.when(is_unsafe_member(F.col("member")), bad.cast("string")).otherwise(F.col("member"))
    return members.select("archive", checked.alias("member"), "content")
