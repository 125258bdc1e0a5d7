"""Image-shaped views of the given tables, and the same views as SQL text.

The given tables hold no images, so their rows are mapped onto the shapes of the operators with arithmetic that
any SQL engine repeats: documents become assets with sizes, licences and digests, embeddings of 64 values become
64-pixel images in several shapes. The work of every check therefore grows with the tables.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

# Fixed values of the views.
LICENSES = ("CC0-1.0", "Creative  Commons CC0", "CC_BY 4.0", "CC-BY-NC", " mit ", "", "All Rights Reserved", "cc-by-sa-4.0")
SUFFIXES = (".png", ".PNG", ".jpg", ".json", ".png", ".txt", ".png")
WIDTHS = (8, 16, 4, 32, 2)
PALETTE = (
    0,
    128 << 24 | 200 << 16 | 30 << 8 | 30,
    255 << 24,
    255 << 24 | 20 << 16 | 160 << 8 | 60,
    255 << 24 | 40 << 16 | 40 << 8 | 200,
    255 << 24 | 230 << 16 | 220 << 8 | 40,
    255 << 24 | 240 << 16 | 140 << 8 | 20,
    255 << 24 | 255 << 16 | 255 << 8 | 255,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "embeddings" else df


def pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def sql_pick(values: tuple, by: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[({by}) % {len(values)} + 1]"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as assets: asset_id, rel_path, content, sha256, category, license, width, height, colours."""
    d = table(spark, sf_dir, "documents")
    rel = F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".png"))
    colors = (1 + F.col("n_chars") % 300).cast("int")
    return d.select(
        F.col("doc_id").alias("asset_id"),
        rel.alias("rel_path"),
        F.col("source"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("sha256"),
        F.col("lang").alias("category"),
        pick(LICENSES, F.col("doc_id")).alias("license"),
        (1 + F.col("doc_id") * 7 % 140).cast("int").alias("width"),
        (1 + F.col("n_chars") % 140).cast("int").alias("height"),
        colors.alias("unique_color_count"),
        (colors > 64).alias("lossy"),
        F.least(colors, F.lit(64)).alias("palette_size"),
    )


ASSET = f"""asset AS (
  SELECT doc_id AS asset_id, source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.png' AS rel_path, source,
         text AS content, sha256(text) AS sha256, lang AS category, {sql_pick(LICENSES, "doc_id")} AS license,
         1 + doc_id * 7 % 140 AS width, 1 + n_chars % 140 AS height, 1 + n_chars % 300 AS unique_color_count,
         1 + n_chars % 300 > 64 AS lossy, least(1 + n_chars % 300, 64) AS palette_size
  FROM documents)"""


def sql_license(expr: str) -> str:
    return f"trim(regexp_replace(replace(lower({expr}), '_', '-'), '\\s+', ' ', 'g'))"


def sql_allowed(expr: str) -> str:
    """The licence rule written out in SQL."""
    n = sql_license(expr)
    named = (
        "'cc0','creative commons cc0','cc0-1.0','cc0 1.0','public domain','pdm','cc-by','cc by','cc-by-3.0','cc-by-4.0',"
        "'oga-by','oga-by-3.0','mit','apache-2.0','bsd-2-clause','bsd-3-clause','mixed permissive'"
    )
    return (
        f"({n} <> '' AND NOT regexp_matches({n}, 'nc|nd|noncommercial|no derivatives|all rights reserved|unknown')"
        f" AND ({n} IN ({named}) OR {n} LIKE 'cc-by %' OR {n} LIKE 'cc by %'))"
    )


SQL_BUCKET_SIZE = "CASE WHEN greatest(width, height) <= 32 THEN 32 WHEN greatest(width, height) <= 64 THEN 64 WHEN greatest(width, height) <= 128 THEN 128 END"
SQL_ASPECT = "CASE WHEN width * 3 >= height * 4 THEN 'landscape' WHEN width * 4 <= height * 3 THEN 'portrait' ELSE 'square' END"
SQL_BUCKET = f"CAST({SQL_BUCKET_SIZE} AS VARCHAR) || ':' || {SQL_ASPECT}"


def sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as indexed images: image_id, label, width, height, indices, palette, pixels."""
    e = table(spark, sf_dir, "embeddings")
    index = F.transform("embedding", lambda v: F.least(F.lit(7), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.25) * 16).cast("int"))))
    width = pick(WIDTHS, F.col("vec_id"))
    out = e.select(
        F.col("vec_id").alias("image_id"),
        "label",
        width.cast("int").alias("width"),
        (F.lit(64) / width).cast("int").alias("height"),
        index.alias("indices"),
    )
    colors = F.array(*[F.lit(c).cast("bigint") for c in PALETTE])
    return out.withColumn("palette", colors).withColumn("pixels", F.transform("indices", lambda i: F.get(colors, i)))


PALETTE_SQL = "[" + ", ".join(f"CAST({c} AS BIGINT)" for c in PALETTE) + "]"
SPRITE = f"""sprite AS (
  SELECT vec_id AS image_id, label, {sql_pick(WIDTHS, "vec_id")} AS width, 64 // {sql_pick(WIDTHS, "vec_id")} AS height,
         list_transform(embedding, lambda e: CAST(least(7, greatest(0, floor((CAST(e AS DOUBLE) + 0.25) * 16))) AS BIGINT)) AS indices
  FROM embeddings)"""
CELL = SPRITE + f""",
cell AS (
  SELECT image_id, label, width, height, pos, pos % width AS x, pos // width AS y, indices[pos + 1] AS idx,
         ({PALETTE_SQL})[indices[pos + 1] + 1] AS px
  FROM (SELECT *, unnest(range(64)) AS pos FROM sprite))"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as true-colour images of up to 64 colours, transparent where the sprite is."""
    s = table(spark, sf_dir, "embeddings")
    base = sprites(spark, sf_dir).select("image_id", "label", "width", "height", "indices")

    def channel(v: Column) -> Column:
        return F.floor((v.cast("double") + 1) * 127).cast("bigint")

    e = F.col("embedding")
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.lit(255 << 24).cast("bigint")
        + channel(F.get(e, i)) * 65536
        + channel(F.get(e, (i + 1) % 64)) * 256
        + channel(F.get(e, (i + 2) % 64)),
    )
    colored = s.select(F.col("vec_id").alias("image_id"), packed.alias("_rgb"))
    joined = base.join(colored, "image_id")
    pixels = F.zip_with("_rgb", "indices", lambda c, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(c))
    return joined.withColumn("pixels", pixels).drop("_rgb", "indices")


PHOTO = SPRITE + """,
photo AS (
  SELECT s.image_id, s.label, s.width, s.height, pos,
         CASE WHEN s.indices[pos + 1] = 0 THEN 0 ELSE CAST(4278190080 AS BIGINT)
           + CAST(floor((CAST(e.embedding[pos + 1] AS DOUBLE) + 1) * 127) AS BIGINT) * 65536
           + CAST(floor((CAST(e.embedding[(pos + 1) % 64 + 1] AS DOUBLE) + 1) * 127) AS BIGINT) * 256
           + CAST(floor((CAST(e.embedding[(pos + 2) % 64 + 1] AS DOUBLE) + 1) * 127) AS BIGINT) END AS px
  FROM (SELECT *, unnest(range(64)) AS pos FROM sprite) s JOIN embeddings e ON e.vec_id = s.image_id)"""


def sprite_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.hashing import hash_from_values

    return sprites(spark, sf_dir).select("image_id", hash_from_values(F.transform("indices", lambda i: i.cast("bigint"))).alias("phash"))


SPRITE_HASH = SPRITE + """,
sprite_hash AS (
  SELECT image_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(indices, lambda v: CASE WHEN 64 * v >= list_sum(indices) THEN CAST(1 AS BIGINT) ELSE 0 END)),
         lambda acc, b: xor((acc & 4611686018427387903) << 1, b) + (CASE WHEN (acc & 4611686018427387904) <> 0 THEN -9223372036854775807 - 1 ELSE 0 END)) AS phash
  FROM sprite)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hashes per image at distances 0, 3, 6 and 9 from it; ``digest`` repeats so that copies exist."""
    h = sprite_hashes(spark, sf_dir)
    flips = F.array(*[F.struct(F.lit(v).alias("v"), F.lit((1 << (3 * v)) - 1).cast("bigint").alias("m")) for v in range(4)])
    out = h.select("image_id", F.col("phash").alias("base"), F.explode(flips).alias("f"))
    variant = F.col("image_id") * 4 + F.col("f.v")
    return out.select(variant.alias("variant_id"), variant.alias("ord"), F.col("base").bitwiseXOR(F.col("f.m")).alias("phash"))


VARIANT = SPRITE_HASH + """,
variant AS (
  SELECT image_id * 4 + v AS variant_id, image_id * 4 + v AS ord, xor(phash, (CAST(1 AS BIGINT) << (3 * v)) - 1) AS phash
  FROM sprite_hash, (SELECT unnest([0, 1, 2, 3]) AS v))"""


def sprite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image n as prediction of image n + 1, whose shape differs."""
    s = sprites(spark, sf_dir)
    names = ("pixels", "indices", "width", "height")
    pred = s.select(F.col("image_id").alias("pair_id"), "label", *[F.col(n).alias(f"pred_{n}") for n in names])
    target = s.select((F.col("image_id") - 1).alias("pair_id"), *[F.col(n).alias(f"target_{n}") for n in names])
    return pred.join(target, "pair_id")


PAIR = CELL + """,
pair AS (
  SELECT p.image_id AS pair_id, p.label, p.width, p.height, p.pos, p.x, p.y, p.idx AS pred_idx, p.px AS pred_px,
         coalesce(t.px, 0) AS target_px, t.idx AS target_idx
  FROM cell p LEFT JOIN cell t ON t.image_id = p.image_id + 1 AND t.x = p.x AND t.y = p.y
  WHERE p.image_id + 1 IN (SELECT image_id FROM sprite))"""


def _write_png(width: int, height: int, pixels: np.ndarray, indexed: bool, text: str) -> bytes:
    """PNG of an image for the decoder's checks, with a different row filter on every row."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    px = np.asarray(pixels, dtype=np.int64).reshape(height, width)
    extra = b""
    if indexed:
        colors = np.unique(px)
        cells = np.searchsorted(colors, px)[..., None]
        rgb = np.stack([colors >> 16 & 255, colors >> 8 & 255, colors & 255], axis=1).astype(np.uint8)
        extra = chunk(b"PLTE", rgb.tobytes()) + chunk(b"tRNS", (colors >> 24).astype(np.uint8).tobytes())
    else:
        cells = np.stack([px >> 16 & 255, px >> 8 & 255, px & 255, px >> 24 & 255], axis=2)
    padded = np.pad(cells, ((1, 0), (1, 0), (0, 0)))
    left, up, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    guess = left + up - corner
    dl, du, dc = abs(guess - left), abs(guess - up), abs(guess - corner)
    paeth = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, up, corner))
    filtered = np.stack([cells, cells - left, cells - up, cells - (left + up) // 2, cells - paeth]) & 255
    kinds = np.arange(height) % 5
    rows = filtered[kinds, np.arange(height)].reshape(height, -1)
    raw = np.concatenate([kinds[:, None], rows], axis=1).astype(np.uint8).tobytes()
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 3 if indexed else 6, 0, 0, 0])
    note = chunk(b"tEXt", b"caption\0" + text.encode("latin-1"))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + note + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def png_bytes(width: pd.Series, height: pd.Series, pixels: pd.Series, indexed: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_write_png(int(w), int(h), p, bool(i), t) for w, h, p, i, t in zip(width, height, pixels, indexed, text)])


def png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprites as PNG content: every third one indexed, every eleventh one broken off."""
    s = sprites(spark, sf_dir)
    caption = F.concat(F.lit("sprite "), F.col("image_id").cast("string"))
    content = png_bytes("width", "height", "pixels", F.col("image_id") % 3 == 0, caption)
    made = s.select("image_id", "label", content.alias("_c"))
    return made.select("image_id", "label", F.when(F.col("image_id") % 11 == 5, F.substring("_c", 1, 60)).otherwise(F.col("_c")).alias("content"))
