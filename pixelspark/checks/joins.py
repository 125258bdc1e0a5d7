"""Checks of duplicates, lookups, resizing joins and composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grids, names
from ..functions import pixels as px
from ..operators import compose, dedup, embed, metrics, quantize, targets
from ..operators.reports import quality_summary
from ..session import cut_lineage, scratch_path
from ..sources import files
from . import views as v
from .registry import check
from .scalars import DUP, P23, dup_assets, scored_sprites


def joined(values, separator=","):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator)


@check("j1_exact_duplicates", f"WITH {DUP} SELECT asset_id, duplicate_of FROM dup")
def _(spark, sf):
    return dup_assets(spark, sf).select("asset_id", "duplicate_of")


J2 = f"""{v.VARIANT},
near AS (SELECT a.variant_id, min(struct_pack(d := bit_count(xor(a.phash, b.phash)), o := b.ord)).o AS match
  FROM variant a JOIN variant b ON b.ord < a.ord AND bit_count(xor(a.phash, b.phash)) <= 4 GROUP BY a.variant_id)"""


@check("j2_near_duplicates", f"WITH {J2} SELECT variant_id, CAST(match AS VARCHAR) AS near_duplicate_of FROM variant LEFT JOIN near USING (variant_id)")
def _(spark, sf):
    rows = v.variants(spark, sf).withColumn("key", F.col("variant_id").cast("string"))
    return dedup.with_near_duplicate_of(rows, "phash", "ord", "key").select("variant_id", "near_duplicate_of")


@check(
    "j3_greedy_near_duplicates",
    f"""WITH RECURSIVE {v.VARIANT},
    numbered AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM variant),
    pass(n, kept, taken) AS (
      SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false
      UNION ALL
      SELECT r.n, CASE WHEN free THEN list_append(kept, phash) ELSE kept END, free FROM (
        SELECT r.n, r.phash, p.kept, len(list_filter(p.kept, lambda k: bit_count(xor(k, r.phash)) <= 4)) = 0 AS free
        FROM pass p JOIN numbered r ON r.n = p.n + 1) r)
    SELECT variant_id, CASE WHEN taken THEN 'accepted' ELSE 'near_duplicate' END AS status FROM pass JOIN numbered USING (n)""",
)
def _(spark, sf):
    rows = v.variants(spark, sf).withColumn("key", F.col("variant_id").cast("string"))
    return dedup.greedy_dedup(rows, "key", "phash", "ord", "key").select("variant_id", "status")


@check(
    "j4_duplicate_report",
    f"""WITH {P23}, row AS (SELECT *, sha256(array_to_string(indices, ',')) AS digest FROM sprite JOIN scored USING (image_id)),
    h AS (SELECT image_id, list_sum(indices) AS total, indices FROM sprite),
    bits AS (SELECT image_id, array_to_string(list_transform(indices, lambda q: CASE WHEN 64 * q >= total THEN 1 ELSE 0 END), '') AS b FROM h),
    pair AS (SELECT DISTINCT a.image_id FROM bits a JOIN bits b ON b.image_id < a.image_id AND hamming(a.b, b.b) <= 4),
    copy AS (SELECT image_id FROM (SELECT image_id, row_number() OVER (PARTITION BY digest ORDER BY image_id) AS n FROM row) WHERE n > 1)
    SELECT count(*) AS count, (SELECT count(*) FROM copy) AS duplicate_count, (SELECT count(*) FROM pair) AS near_duplicate_count,
      round(avg(quality), 6) AS mean_quality, round(min(quality), 6) AS min_quality, round(max(quality), 6) AS max_quality FROM row""",
)
def _(spark, sf):
    rows = v.sprites(spark, sf).select("image_id", F.sha2(joined("indices"), 256).alias("digest")).join(v.sprite_hashes(spark, sf), "image_id")
    rows = cut_lineage(rows.join(scored_sprites(spark, sf), "image_id").withColumn("key", F.col("image_id").cast("string")))
    rows = dedup.with_duplicate_of(rows, "digest", "image_id", "key")
    rows = dedup.with_near_duplicate_of(rows, "phash", "image_id", "key")
    out = quality_summary(rows)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("quality") else F.col(c) for c in out.columns])


@check(
    "j5_sidecar_join",
    f"""WITH {v.ASSET} SELECT asset_id, CASE WHEN asset_id % 5 = 0 OR asset_id % 7 = 0 THEN NULL ELSE license END AS license,
      CASE WHEN asset_id % 5 = 0 OR asset_id % 7 = 0 THEN NULL ELSE category END AS category, CAST(CASE WHEN asset_id % 5 = 0 OR asset_id % 7 = 0 THEN 0 ELSE 2 END AS BIGINT) AS fields FROM asset""",
)
def _(spark, sf):
    a = v.assets(spark, sf).select("asset_id", "rel_path", "license", "category")
    text = F.when(F.col("asset_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("license", "category")))
    side = a.where(F.col("asset_id") % 5 != 0).select(
        names.path_stem("rel_path").alias("stem"),
        files.parse_sidecar(F.encode(text, "UTF-8")).alias("sidecar"),
        F.from_json(text, "map<string,string>").alias("extra"),
    )
    out = files.join_sidecars(a.select("asset_id", "rel_path"), side)
    return out.select("asset_id", "license", "category", F.size("metadata").alias("fields"))


@check("j6_palette_lookup", f"WITH {v.CELL} SELECT image_id, string_agg(CAST(px AS VARCHAR), ',' ORDER BY pos) AS pixels FROM cell GROUP BY image_id")
def _(spark, sf):
    return v.sprites(spark, sf).select("image_id", joined(px.decode_indices("indices", "palette")).alias("pixels"))


J7 = f"""{v.PHOTO},
entry AS (SELECT unnest(range(8)) AS i, unnest({v.PALETTE_SQL}) AS c),
best AS (SELECT image_id, pos, CASE WHEN px = 0 THEN 0 ELSE (
  SELECT min(struct_pack(d := pow(((px >> 16) & 255) - ((c >> 16) & 255), 2) + pow(((px >> 8) & 255) - ((c >> 8) & 255), 2) + pow((px & 255) - (c & 255), 2), i := i)).i
  FROM entry WHERE i > 0) END AS i FROM photo)"""


@check("j7_nearest_palette_color", f"WITH {J7} SELECT image_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY pos) AS indices FROM best GROUP BY image_id")
def _(spark, sf):
    colors = F.array(*[F.lit(c).cast("bigint") for c in v.PALETTE])
    return v.photos(spark, sf).select("image_id", joined(px.nearest_indices("pixels", colors)).alias("indices"))


# 128 codes drawn from the whole table: the smallest by the md5 of their id
J8 = """book AS (SELECT vec_id AS code, embedding AS w FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT 128),
dist AS (SELECT e.vec_id, b.code, list_sum(list_transform(list_zip(e.embedding, b.w), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) AS d FROM embeddings e, book b),
code AS (SELECT vec_id, min(struct_pack(d := round(d, 9), code := code)).code AS code FROM dist GROUP BY vec_id)"""


def coded(spark, sf):
    e = v.table(spark, sf, "embeddings").select("vec_id", "embedding")
    book = e.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(128).select(F.col("vec_id").alias("code"), F.col("embedding").alias("vector"))
    return metrics.assign_codes(e, book, "embedding").select("vec_id", "code")


@check("j8_nearest_code", f"WITH {J8} SELECT vec_id, code FROM code")
def _(spark, sf):
    return coded(spark, sf)


J9 = f"""{v.PAIR},
pc AS (SELECT DISTINCT pair_id, pred_px AS p FROM pair), tc AS (SELECT DISTINCT pair_id, target_px AS t FROM pair),
near AS (SELECT pair_id, p, min(sqrt(pow(((p >> 16) & 255) - ((t >> 16) & 255), 2) + pow(((p >> 8) & 255) - ((t >> 8) & 255), 2)
  + pow((p & 255) - (t & 255), 2) + pow((p >> 24) - (t >> 24), 2))) AS d FROM pc JOIN tc USING (pair_id) GROUP BY ALL),
fidelity AS (SELECT pair_id, greatest(0.0, least(1.0, 1.0 - avg(d) / 510.0)) AS palette_fidelity, avg(d) AS d FROM near GROUP BY pair_id)"""


@check("j9_nearest_target_color", f"WITH {J9} SELECT pair_id, round(palette_fidelity, 6) AS palette_fidelity FROM fidelity")
def _(spark, sf):
    return fitted_pairs(spark, sf).select("pair_id", F.round(metrics.palette_fidelity("pred_pixels", "target_pixels"), 6).alias("palette_fidelity"))


def fitted_pairs(spark, sf):
    p = v.sprite_pairs(spark, sf)
    fit = px.fit_to_shape("target_pixels", F.col("target_width"), F.col("target_height"), F.col("pred_width"), F.col("pred_height"))
    return p.withColumn("target_pixels", fit)


@check(
    "j10_pixel_pairs",
    f"WITH {v.PAIR} SELECT pair_id, CAST(count(*) FILTER (pred_px = target_px) AS BIGINT) AS same, string_agg(CAST(target_px AS VARCHAR), ',' ORDER BY pos) AS target FROM pair GROUP BY pair_id",
)
def _(spark, sf):
    same = metrics.count_true(F.zip_with("pred_pixels", "target_pixels", lambda a, b: a == b))
    return fitted_pairs(spark, sf).select("pair_id", same.alias("same"), joined("target_pixels").alias("target"))


@check(
    "j11_embedding_cache",
    """WITH known AS (SELECT DISTINCT text FROM conversations WHERE conv_id % 3 = 0)
    SELECT conv_id, turn, CASE WHEN text IN (SELECT text FROM known) THEN 'old' ELSE 'new' END AS origin FROM conversations""",
)
def _(spark, sf):
    requests = v.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    old = requests.where(F.col("conv_id") % 3 == 0).select("text").distinct()
    stale = F.lit("tiny:0").alias("version")
    cache = old.select("text", F.lit("tiny:64").alias("version"), embed.text_embedding("text").alias("embedding"))
    cache = cache.unionByName(requests.select("text").distinct().select("text", stale, F.array().cast("array<double>").alias("embedding")))
    path = scratch_path(spark, "embeddings")
    cache.write.parquet(path)
    fresh = embed.encode_missing(requests, spark.read.parquet(path), "tiny:64").withColumn("origin", F.lit("new"))
    full = spark.read.parquet(path).withColumn("origin", F.lit("old")).unionByName(fresh)
    got = embed.with_cached_embeddings(requests, full, "tiny:64")
    known = full.where(F.col("version") == "tiny:64").select("text", "origin")
    return got.where(F.size("embedding") == 64).join(known, "text").select("conv_id", "turn", "origin")


def scene_assets(spark, sf):
    s = v.sprites(spark, sf)
    return s.select(F.col("image_id"), F.lpad(F.col("image_id").cast("string"), 8, "0").alias("rel_path"), "width", "height", "pixels", v.pick(v.LICENSES, F.col("label")).alias("license"))


_HEX = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def _sql_draws(scene: str, pool: str) -> str:
    """CTEs d0..d5 that draw six distinct positions per scene."""
    out = [f"d0 AS (SELECT scene_id, {pool} AS pool, [{_HEX.format(f'concat(7, chr(58), {scene}, chr(58), 0)')} % {pool}] AS taken FROM scenes)"]
    for j in range(1, 6):
        pick = f"{_HEX.format(f'concat(7, chr(58), {scene}, chr(58), {j})')} % (pool - {j})"
        stepped = f"list_reduce(list_prepend({pick}, list_sort(taken)), lambda p, t: CASE WHEN p >= t THEN p + 1 ELSE p END)"
        out.append(f"d{j} AS (SELECT scene_id, pool, list_append(taken, {stepped}) AS taken FROM d{j - 1})")
    return ",\n".join(out)


SCENES = f"""{v.CELL},
usable AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat('7:', lpad(CAST(image_id AS VARCHAR), 8, '0'))), image_id) - 1 AS position
  FROM (SELECT image_id FROM cell GROUP BY image_id HAVING bool_or((px >> 24) < 255))),
scenes AS (SELECT vec_id AS scene_id FROM embeddings),
{_sql_draws("scene_id", "(SELECT count(*) FROM usable)")},
drawn AS (SELECT scene_id, unnest(range(6)) AS layer, unnest(taken) AS position FROM d5)"""


@check("t5_distinct_draws", f"WITH {SCENES} SELECT scene_id, CAST(layer AS BIGINT) AS layer, position, image_id FROM drawn JOIN usable USING (position)")
def _(spark, sf):
    from ..operators.shuffles import seeded_rank

    a = scene_assets(spark, sf).where(px.has_transparency("pixels")).select("image_id", "rel_path")
    placed = cut_lineage(seeded_rank(a, ["rel_path"], 7, out="position").withColumn("position", F.col("position") - 1))
    scenes = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"))
    draws = compose.layer_draws(scenes, placed.count(), 7)
    return draws.join(placed, "position").select("scene_id", "layer", "position", "image_id")


def composed(spark, sf):
    scenes = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"))
    return compose.compose_scenes(scene_assets(spark, sf), scenes, 7)


_OVER = """CASE WHEN s >> 24 = 0 THEN b ELSE
  ((((w + 128) >> 8) + w + 128) >> 8) * 16777216
  + (((((((s >> 16) & 255) * k + ((b >> 16) & 255) * (32640 - k) + 16384) >> 8) + ((s >> 16) & 255) * k + ((b >> 16) & 255) * (32640 - k) + 16384) >> 8) >> 7) * 65536
  + (((((((s >> 8) & 255) * k + ((b >> 8) & 255) * (32640 - k) + 16384) >> 8) + ((s >> 8) & 255) * k + ((b >> 8) & 255) * (32640 - k) + 16384) >> 8) >> 7) * 256
  + ((((((s & 255) * k + (b & 255) * (32640 - k) + 16384) >> 8) + (s & 255) * k + (b & 255) * (32640 - k) + 16384) >> 8) >> 7) END"""


def _sql_layers() -> str:
    """One CTE per layer: the pixels drawn so far, with the next layer's pixels put over them."""
    out = ["m0 AS (SELECT scene_id, CAST(0 AS BIGINT) AS cx, CAST(0 AS BIGINT) AS cy, CAST(0 AS BIGINT) AS b FROM scenes WHERE false)"]
    for j in range(6):
        mixed = f"""SELECT scene_id, cx, cy, b, s, (s >> 24) * 255 + (b >> 24) * (255 - (s >> 24)) AS w FROM (
            SELECT coalesce(m.scene_id, t.scene_id) AS scene_id, coalesce(m.cx, t.cx) AS cx, coalesce(m.cy, t.cy) AS cy, coalesce(m.b, 0) AS b, coalesce(t.px, 0) AS s
            FROM m{j} m FULL JOIN (SELECT * FROM placed WHERE layer = {j}) t ON m.scene_id = t.scene_id AND m.cx = t.cx AND m.cy = t.cy)"""
        out.append(
            f"m{j + 1} AS (SELECT scene_id, cx, cy, CAST({_OVER} AS BIGINT) AS b FROM (SELECT *, CASE WHEN w > 0 THEN ((s >> 24) * 8323200) // w ELSE 0 END AS k FROM ({mixed})))"
        )
    return ",\n".join(out)


@check(
    "j12_scene_composition",
    f"""WITH {SCENES},
    placed AS (SELECT scene_id, layer, px, x + {_HEX.format("concat(8, chr(58), scene_id, chr(58), layer)")} % greatest(1, 129 - width) AS cx,
      y + {_HEX.format("concat(9, chr(58), scene_id, chr(58), layer)")} % greatest(1, 129 - height) AS cy FROM drawn JOIN usable USING (position) JOIN cell USING (image_id)),
    {_sql_layers()}
    SELECT scene_id, CAST(sum((b % 1000003) * (cy * 128 + cx + 1)) AS BIGINT) AS checksum, CAST(count(*) FILTER (b <> 0) AS BIGINT) AS painted FROM m6 GROUP BY scene_id""",
)
def _(spark, sf):
    # a row per cell is compiled code, where lambdas over a canvas are interpreted; cells are summed before they move
    cells = composed(spark, sf).select("scene_id", F.posexplode("pixels").alias("i", "c"))
    return cells.groupBy("scene_id").agg(F.sum(F.expr("c % 1000003 * (i + 1)")).alias("checksum"), F.count_if(F.col("c") != 0).cast("int").alias("painted"))


@check(
    "j13_parent_licenses",
    f"""WITH {SCENES}, l AS (SELECT scene_id, list_sort(list_distinct(list({v.sql_pick(v.LICENSES, 'label')}))) AS ls, string_agg(lpad(CAST(image_id AS VARCHAR), 8, '0'), ',' ORDER BY layer) AS parents
      FROM drawn JOIN usable USING (position) JOIN sprite USING (image_id) GROUP BY scene_id)
    SELECT scene_id, CASE WHEN len(ls) = 1 THEN ls[1] ELSE 'mixed permissive' END AS license, array_to_string(ls, '|') AS parent_licenses, parents FROM l""",
)
def _(spark, sf):
    return composed(spark, sf).select("scene_id", "license", F.array_join("parent_licenses", "|").alias("parent_licenses"), F.array_join("parents", ",").alias("parents"))


@check(
    "j14_pair_alignment",
    """SELECT round(avg(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2]))), 6) AS alignment
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, sf):
    e = v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("left"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("left").alias("right"))
    return metrics.mean_alignment(e.join(other, "vec_id"), "left", "right").select(F.round("alignment", 6).alias("alignment"))


_SHAPE = "(3 + image_id % 9)", "(2 + image_id % 7)"
_RESIZED = """out AS (SELECT image_id, width, height, ow, oh, unnest(range(ow * oh)) AS pos FROM (SELECT image_id, width, height, 3 + image_id % 9 AS ow, 2 + image_id % 7 AS oh FROM sprite)),
src AS (SELECT image_id, pos, ow, oh, least(width - 1, CAST(floor(CAST(pos % ow AS FLOAT) * (CAST(width AS FLOAT) / CAST(ow AS FLOAT))) AS BIGINT)) AS x,
  least(height - 1, CAST(floor(CAST(pos // ow AS FLOAT) * (CAST(height AS FLOAT) / CAST(oh AS FLOAT))) AS BIGINT)) AS y FROM out)"""


def _shapes():
    return (3 + F.col("image_id") % 9).cast("int"), (2 + F.col("image_id") % 7).cast("int")


@check(
    "j15_nearest_resize",
    f"WITH {v.CELL}, {_RESIZED} SELECT image_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY src.pos) AS grid FROM src JOIN cell USING (image_id, x, y) GROUP BY image_id",
)
def _(spark, sf):
    ow, oh = _shapes()
    s = v.sprites(spark, sf).withColumn("ow", ow).withColumn("oh", oh)
    grid = grids.resize_nearest("indices", F.col("width"), F.col("height"), F.col("ow"), F.col("oh"))
    return s.select("image_id", joined(grid).alias("grid"))


@check(
    "j16_condition_resize",
    f"""WITH {v.CELL}, {_RESIZED} SELECT image_id, string_agg(CAST(CASE WHEN idx > 1 THEN idx ELSE 129 END AS VARCHAR), ',' ORDER BY src.pos) AS grid
    FROM src JOIN cell USING (image_id, x, y) GROUP BY image_id""",
)
def _(spark, sf):
    ow, oh = _shapes()
    s = v.sprites(spark, sf).withColumn("ow", ow).withColumn("oh", oh).withColumn("valid", F.transform("indices", lambda i: i > 1))
    grid = grids.resize_condition(F.col("indices"), F.col("valid"), F.col("width"), F.col("height"), F.col("ow"), F.col("oh"), 129)
    return s.select("image_id", joined(grid).alias("grid"))


@check(
    "j17_any_pooling",
    f"""WITH {v.CELL}, out AS (SELECT image_id, width, height, ow, oh, unnest(range(ow * oh)) AS o FROM (SELECT image_id, width, height, 3 + image_id % 9 AS ow, 2 + image_id % 7 AS oh FROM sprite)),
    area AS (SELECT image_id, o, floor((o % ow) * width / ow) AS x0, ceil((o % ow + 1) * width / ow) AS x1, floor((o // ow) * height / oh) AS y0, ceil((o // ow + 1) * height / oh) AS y1 FROM out)
    SELECT image_id, string_agg(CASE WHEN hit THEN '1' ELSE '0' END, '' ORDER BY o) AS mask FROM (
      SELECT a.image_id, o, bool_or(idx > 5) AS hit FROM area a JOIN cell c ON c.image_id = a.image_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL) GROUP BY image_id""",
)
def _(spark, sf):
    ow, oh = _shapes()
    s = v.sprites(spark, sf).withColumn("ow", ow).withColumn("oh", oh).withColumn("mask", F.transform("indices", lambda i: i > 5))
    pooled = targets.token_mask("mask", F.col("width"), F.col("height"), F.col("ow"), F.col("oh"))
    return s.select("image_id", joined(F.transform(pooled, lambda b: b.cast("int")), "").alias("mask"))


@check("a4_box_palette")
def _(spark, sf):
    return quantize.box_palettes(v.photos(spark, sf), "image_id", 16).select("image_id", F.size("palette").alias("colors"), joined("palette").alias("palette"))


@check("a4_lossy_encoding")
def _(spark, sf):
    e = quantize.encode_images(v.photos(spark, sf), "image_id", 8)
    return e.select("image_id", "unique_color_count", "palette_size", "lossy", joined("indices").alias("indices"))
