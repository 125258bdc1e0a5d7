"""Images stored inside Parquet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import let, text
from .files import underscored
from .png import decode_png, is_png

# Columns that may hold an image, and columns that may hold its caption, in order of preference.
IMAGE_COLUMNS = ("preview", "image", "img", "prompt", "text", "caption")
CAPTION_COLUMNS = ("text", "prompt", "caption")
GRID_COLUMN = "grid"


def read_parquet_tree(spark: SparkSession, root: str, grid: bool = False) -> DataFrame:
    """Rows of all Parquet files below ``root`` with only the columns that can matter.

    Folders that start with "_" are read, too. Files may have different columns: those a file lacks are NULL in its rows. One name with two types is an error.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True)
    df = reader.parquet(root, *underscored(spark, root)[0])
    wanted = [c for c in IMAGE_COLUMNS if c in df.columns] + ([GRID_COLUMN] if grid and GRID_COLUMN in df.columns else [])
    return df.select(*wanted) if wanted else df


def image_payload(df: DataFrame) -> Column:
    """First value of a row that is a PNG: a binary column or the ``bytes`` of a struct."""
    found = []
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.BinaryType):
            value = F.col(field.name)
        elif isinstance(kind, T.StructType) and "bytes" in kind.names and isinstance(kind["bytes"].dataType, T.BinaryType):
            value = F.col(field.name)["bytes"]
        else:
            continue
        found.append(F.when(is_png(value), value))
    return F.coalesce(*found, F.lit(None).cast("binary")) if found else F.lit(None).cast("binary")


def caption(df: DataFrame) -> Column:
    present = [text(c) for c in CAPTION_COLUMNS if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def grid_pixels(grid: Column, colors: Column) -> Column:
    """struct<width,height,pixels> of a square grid of palette numbers, NULL when its length is no square; a number that the
    palette lacks is an error."""
    unknown = F.raise_error(F.lit("a grid has a number that its palette lacks")).cast("bigint")
    side = F.floor(F.sqrt(F.size(grid).cast("double"))).cast("int")

    def build(n: Column) -> Column:
        return F.when(
            (F.size(grid) > 0) & (n * n == F.size(grid)),
            F.struct(n.alias("width"), n.alias("height"), F.transform(grid, lambda i: F.coalesce(F.get(colors, i), unknown)).alias("pixels")),
        )

    return let(side, build)


def palette_row(palette: DataFrame) -> DataFrame:
    """A palette table (idx, r, g, b[, a]) as one row of colours by ``idx``, NULL where the table has a gap. An ``idx`` given
    twice or below zero is an error."""
    a = F.col("a") if "a" in palette.columns else F.lit(255)
    packed = a.cast("bigint") * 16777216 + F.col("r").cast("bigint") * 65536 + F.col("g").cast("bigint") * 256 + F.col("b").cast("bigint")
    entries = palette.agg(F.collect_list(F.struct("idx", packed.alias("c"))).alias("e"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    numbers = F.transform("e", lambda x: x["idx"])
    bad = (F.size(F.array_distinct(numbers)) < F.size(numbers)) | (F.col("low") < 0)
    colors = F.transform(F.sequence(F.lit(0), F.col("high")), lambda i: F.get(F.transform("e", lambda x: x["c"]), (F.array_position(numbers, i) - 1).cast("int")))
    error = F.raise_error(F.lit("a palette gives a number twice or below zero")).cast("array<bigint>")
    return entries.select(F.when(bad, error).otherwise(F.coalesce(colors, F.array().cast("array<bigint>"))).alias("_colors"))


def extract_images(df: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """Add ``width``, ``height``, ``pixels``, ``payload`` and ``caption`` to rows that hold an image.

    The payload column comes first; with a shared ``palette`` a square grid is used where there is none.
    """
    out = df.withColumn("payload", image_payload(df)).withColumn("_caption", caption(df))
    out = out.withColumn("_image", decode_png("payload"))
    picture = F.struct(F.col("_image.width").alias("width"), F.col("_image.height").alias("height"), F.col("_image.pixels").alias("pixels"))
    picture = F.when(F.col("payload").isNotNull(), picture)
    if palette is not None and GRID_COLUMN in df.columns:
        out = out.join(F.broadcast(palette_row(palette)), F.lit(True))
        picture = F.coalesce(picture, grid_pixels(F.col(GRID_COLUMN), F.col("_colors")))
    out = out.withColumn("_picture", picture).where(F.col("_picture").isNotNull())
    keep = [c for c in df.columns if c not in (*IMAGE_COLUMNS, GRID_COLUMN)]
    return out.select(*keep, "payload", F.col("_caption").alias("caption"), "_picture.width", "_picture.height", "_picture.pixels")


def require_images(images: DataFrame, where: str) -> DataFrame:
    if images.isEmpty():
        raise ValueError(f"no row of {where} holds an image")
    return images
