"""Checks of seeded samples, splits, batches, masks, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import pixels as px
from ..operators import batches, curate, shuffles, targets
from ..plans.curation import piece_path
from ..plans.features import with_size_class
from ..session import cut_lineage
from . import views as v
from .aggregates import A14_SPARSE, _sql_edges, sheets
from .joins import joined
from .registry import check
from .scalars import dup_assets


@check("w1_first_seen", f"WITH {v.ASSET} SELECT asset_id, first_value(rel_path) OVER (PARTITION BY sha256 ORDER BY string_split(rel_path, '/')) AS first_path FROM asset")
def _(spark, sf):
    return dup_assets(spark, sf).select("asset_id", F.coalesce("duplicate_of", "rel_path").alias("first_path"))


_GROUP = f"category || '|' || coalesce({v.SQL_BUCKET}, 'None')"


def grouped(spark, sf):
    rows = with_size_class(v.assets(spark, sf))
    return rows.select("asset_id", "rel_path", "bucket", curate.group_key(F.col("category"), F.col("bucket")).alias("group"))


@check(
    "w2_balanced_sample",
    f"""WITH {v.ASSET}, g AS (SELECT asset_id, rel_path, {_GROUP} AS g FROM asset),
    s AS (SELECT asset_id, row_number() OVER (PARTITION BY g ORDER BY md5('5:' || rel_path), rel_path) AS n FROM g) SELECT asset_id FROM s WHERE n <= 12""",
)
def _(spark, sf):
    return shuffles.seeded_take(grouped(spark, sf), ["rel_path"], 5, F.lit(12), ["group"]).select("asset_id")


@check(
    "t2_sample_to_target",
    f"""WITH {v.ASSET}, g AS (SELECT asset_id, rel_path, {_GROUP} AS g FROM asset),
    s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('5:' || rel_path), rel_path) AS n FROM g),
    t AS (SELECT *, row_number() OVER (ORDER BY md5('6:' || rel_path), rel_path) AS k FROM s WHERE n <= 12) SELECT asset_id FROM t WHERE k <= 150""",
)
def _(spark, sf):
    return curate.balanced_sample(grouped(spark, sf), 150, 12, 5).select("asset_id")


@check(
    "w3_boundary_marks",
    f"""WITH {v.CELL}, edge AS ({_sql_edges({'e': 'idx'}, 'image_id', 'cell')}) SELECT image_id, string_agg(CASE WHEN e THEN '1' ELSE '0' END, '' ORDER BY pos) AS edges FROM edge GROUP BY image_id""",
)
def _(spark, sf):
    marks = F.transform(px.boundary("indices", "width"), lambda b: b.cast("int"))
    return v.sprites(spark, sf).select("image_id", joined(marks, "").alias("edges"))


@check(
    "w4_train_validation_split",
    f"""WITH {v.ASSET}, r AS (SELECT asset_id, row_number() OVER (ORDER BY md5('3:' || rel_path), rel_path) - 1 AS i, count(*) OVER () AS n FROM asset)
    SELECT asset_id, CASE WHEN i < greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def _(spark, sf):
    return batches.train_validation_split(v.assets(spark, sf).select("asset_id", "rel_path"), "rel_path", 0.15, 3).select("asset_id", "split")


W5 = """r AS (SELECT asset_id, rel_path, row_number() OVER (ORDER BY md5('3:' || rel_path), rel_path) - 1 AS i, count(*) OVER () AS n FROM asset),
c AS (SELECT *, greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS t, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS val FROM r),
s AS (SELECT asset_id, rel_path, CASE WHEN i < t THEN 'test' WHEN i < t + val THEN 'validation' ELSE 'train' END AS split FROM c)"""


@check("w5_train_val_test_split", f"WITH {v.ASSET}, {W5} SELECT asset_id, split FROM s")
def _(spark, sf):
    return batches.train_val_test_split(v.assets(spark, sf).select("asset_id", "rel_path"), "rel_path", 0.1, 0.2, 3).select("asset_id", "split")


def sql_batches(size: int, drop_last: bool, source: str = "b", key: str = "rel_path", seed: int = 2) -> str:
    keep = f"WHERE n >= (chunk + 1) * {size}" if drop_last else ""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('{seed}:' || {key}), {key}) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM {source}),
    k AS (SELECT *, i // {size} AS chunk, i % {size} AS slot FROM r),
    o AS (SELECT bucket, chunk, row_number() OVER (ORDER BY md5('{seed + 1}:' || bucket || ':' || chunk), bucket, chunk) - 1 AS batch_id FROM (SELECT DISTINCT bucket, chunk FROM k {keep})),
    batched AS (SELECT * FROM k JOIN o USING (bucket, chunk))"""


_BUCKETED = f"{v.ASSET}, b AS (SELECT asset_id, rel_path, {v.SQL_BUCKET} AS bucket FROM asset WHERE {v.SQL_BUCKET} IS NOT NULL)"


@check("w6_bucket_batches", f"WITH {_BUCKETED}, {sql_batches(8, True)} SELECT asset_id, bucket, chunk, slot, batch_id FROM batched")
def _(spark, sf):
    rows = grouped(spark, sf).where("bucket is not null")
    return batches.bucket_batches(rows, "rel_path", 8, 2, drop_last=True).select("asset_id", "bucket", "chunk", "slot", "batch_id")


@check(
    "w7_batch_counts",
    f"WITH {_BUCKETED} SELECT bucket, CAST(ceil(count(*) / 8) AS BIGINT) AS batches, CAST(floor(count(*) / 8) AS BIGINT) AS whole FROM b GROUP BY bucket",
)
def _(spark, sf):
    rows = grouped(spark, sf).where("bucket is not null")
    whole = batches.batch_counts(rows, 8, drop_last=True).withColumnRenamed("batches", "whole")
    return batches.batch_counts(rows, 8).join(whole, "bucket")


def sprite_batches(spark, sf):
    s = v.sprites(spark, sf).withColumn("palette", px.palette("pixels")).withColumn("bucket", (F.col("label") % 3).cast("string"))
    s = s.withColumn("indices", px.index_map("pixels", "palette")).withColumn("key", F.col("image_id").cast("string"))
    placed = batches.bucket_batches(s.select("image_id", "key", "bucket"), "key", 6, 2)
    return placed.join(s.select("image_id", "width", "height", "indices", "palette"), "image_id")


@check(
    "w8_padded_batches",
    f"""WITH {v.CELL}, b AS (SELECT image_id, CAST(image_id AS VARCHAR) AS rel_path, CAST(label % 3 AS VARCHAR) AS bucket FROM sprite), {sql_batches(6, False)},
    used AS (SELECT image_id, px, row_number() OVER (PARTITION BY image_id ORDER BY px) - 1 AS i FROM (SELECT DISTINCT image_id, px FROM cell)),
    frame AS (SELECT batch_id, max(width) AS bw, max(height) AS bh, max(k) AS colors FROM batched JOIN sprite USING (image_id) JOIN (SELECT image_id, count(*) AS k FROM used GROUP BY image_id) USING (image_id) GROUP BY batch_id),
    grid AS (SELECT image_id, batch_id, slot, bw, bh, colors, o, o % bw AS x, o // bw AS y FROM (SELECT *, unnest(range(bw * bh)) AS o FROM batched JOIN frame USING (batch_id)))
    SELECT g.image_id, batch_id, slot, CAST(any_value(bw) AS BIGINT) AS batch_width, CAST(any_value(bh) AS BIGINT) AS batch_height, any_value(colors) AS colors,
      string_agg(CAST(coalesce(u.i, -1) AS VARCHAR), ',' ORDER BY o) AS indices, count(u.i) AS valid
    FROM grid g LEFT JOIN cell c ON c.image_id = g.image_id AND c.x = g.x AND c.y = g.y LEFT JOIN used u ON u.image_id = c.image_id AND u.px = c.px GROUP BY g.image_id, batch_id, slot""",
)
def _(spark, sf):
    c = batches.collate(sprite_batches(spark, sf))
    valid = F.size(F.filter("valid_mask", lambda b: b))
    return c.select("image_id", "batch_id", "slot", "batch_width", "batch_height", F.size("palette").alias("colors"), joined("indices").alias("indices"), valid.alias("valid"))


@check(
    "w8_batch_rows",
    f"""WITH {v.SPRITE}, b AS (SELECT image_id, CAST(image_id AS VARCHAR) AS rel_path, CAST(label % 3 AS VARCHAR) AS bucket FROM sprite), {sql_batches(6, False)}
    SELECT batch_id, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY slot) AS images FROM batched GROUP BY batch_id""",
)
def _(spark, sf):
    rows = batches.batch_rows(batches.collate(sprite_batches(spark, sf)), ["image_id", "indices", "valid_mask"])
    return rows.select("batch_id", joined(F.transform("samples", lambda s: s["image_id"])).alias("images"))


_UNIT = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


W9 = f"""WITH {v.CELL}, t AS (SELECT image_id, pos, idx AS token, pos % 5 <> 2 AS valid FROM cell),
    r AS (SELECT *, count(*) FILTER (valid) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id, valid ORDER BY md5(concat('12:', image_id, ':', pos)), pos) AS rn,
      0.1::DOUBLE + {_UNIT.format("concat('11:', image_id)")} * (1.0::DOUBLE - 0.1::DOUBLE) AS ratio FROM t),
    c AS (SELECT *, valid AND rn <= greatest(1, round_even(n * ratio, 0)) AS chosen FROM r)
    SELECT image_id, pos, CAST(CASE WHEN chosen THEN 128 ELSE token END AS BIGINT) AS masked, CAST(CASE WHEN chosen THEN token ELSE -100 END AS BIGINT) AS label FROM c"""


@check("w9_masked_tokens", W9)
def _(spark, sf):
    cells = v.sprites(spark, sf).select("image_id", F.posexplode("indices").alias("pos", "token")).withColumn("valid", F.col("pos") % 5 != 2)
    return targets.masked_cells(cells, 128, 11).select("image_id", "pos", "masked", "label")


@check("w9_masked_grids", W9)
def _(spark, sf):
    s = v.sprites(spark, sf).withColumn("valid", F.transform("indices", lambda t, i: i % 5 != 2))
    grid = targets.masked_grid("indices", "valid", F.col("image_id"), 128, 11)
    cells = s.select("image_id", grid.alias("g")).select("image_id", F.posexplode(F.arrays_zip("g.masked", "g.label")).alias("pos", "c"))
    return cells.select("image_id", "pos", "c.masked", "c.label")


@check(
    "w10_token_noise",
    f"""WITH {v.CELL} SELECT image_id, pos, CAST(CASE WHEN pos % 5 <> 2 AND {_UNIT.format("concat('4:', image_id, ':', pos)")} < 0.3
      THEN CAST('0x' || substr(md5(concat('5:', image_id, ':', pos)), 1, 8) AS BIGINT) % 128 ELSE idx END AS BIGINT) AS token FROM cell""",
)
def _(spark, sf):
    cells = v.sprites(spark, sf).select("image_id", F.posexplode("indices").alias("pos", "idx"))
    noisy = targets.noisy_token(F.col("idx"), F.col("pos") % 5 != 2, 128, 0.3, 4, F.col("image_id"), F.col("pos"))
    return cells.select("image_id", "pos", noisy.alias("token"))


@check(
    "w11_mixed_condition",
    f"""WITH r AS (SELECT vec_id AS image_id, {_UNIT.format("concat('9:', vec_id)")} AS roll FROM embeddings)
    SELECT image_id, CASE WHEN image_id % 4 <> 0 AND roll < 0.4 THEN 'sampled' WHEN roll < 0.7 THEN 'corrupt' ELSE 'true' END AS condition FROM r""",
)
def _(spark, sf):
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"))
    sampled = F.when(F.col("image_id") % 4 != 0, "sampled")
    return e.select("image_id", targets.mixed_condition(sampled, F.lit("corrupt"), F.lit("true"), 0.4, 0.3, 9, F.col("image_id")).alias("condition"))


@check("t1_path_order", f"WITH {v.ASSET} SELECT asset_id, row_number() OVER (ORDER BY string_split(rel_path, '/')) AS place FROM asset")
def _(spark, sf):
    rows = v.assets(spark, sf).select("asset_id", "rel_path")
    return shuffles.ordered_rank(rows, names.path_order("rel_path"), "place").select("asset_id", "place")


@check("t3_first_rows", f"WITH {v.ASSET} SELECT asset_id FROM asset WHERE NOT lossy ORDER BY string_split(rel_path, '/') LIMIT 100")
def _(spark, sf):
    return curate.training_filter(with_size_class(v.assets(spark, sf)), limit=100).select("asset_id")


@check(
    "t4_piece_names",
    f"""WITH RECURSIVE {A14_SPARSE} SELECT '_splits/a/' || image_id || '/' || lpad(CAST(piece AS VARCHAR), 4, '0') || '_' || x0 || '_' || y0 || '_' || (x1 - x0) || 'x' || (y1 - y0) || '.png' AS path
    FROM piece WHERE n >= 2""",
)
def _(spark, sf):
    s = sheets(spark, sf).select("image_id", F.posexplode("boxes").alias("piece", "box"))
    rel = F.concat(F.lit("a/"), F.col("image_id").cast("string"), F.lit(".png"))
    return s.select(piece_path(rel, F.col("piece"), F.col("box")).alias("path"))


@check(
    "u1_union_of_sources",
    """SELECT 'documents/' || source || '/' || doc_id AS rel_path FROM documents UNION ALL SELECT 'part/' || lower(p_type) || '/' || p_partkey FROM part
    UNION ALL SELECT 'pages/' || page_id FROM pages""",
)
def _(spark, sf):
    parts = {
        "documents": v.table(spark, sf, "documents").selectExpr("concat(source, '/', doc_id) AS rel"),
        "part": v.table(spark, sf, "part").selectExpr("concat(lower(p_type), '/', p_partkey) AS rel"),
        "pages": v.table(spark, sf, "pages").selectExpr("cast(page_id as string) AS rel"),
    }
    tables = [df.select(F.concat_ws("/", names.slug(F.lit(name)), "rel").alias("rel_path")) for name, df in parts.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@check(
    "u2_assets_with_scenes",
    f"WITH {v.ASSET} SELECT rel_path, license, category FROM asset UNION ALL SELECT 'procedural_scenes/scene_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.png', 'mixed permissive', 'scene' FROM embeddings",
)
def _(spark, sf):
    scenes = v.table(spark, sf, "embeddings").select(
        F.concat(F.lit("procedural_scenes/scene_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".png")).alias("rel_path"),
        F.lit("mixed permissive").alias("license"),
        F.lit("scene").alias("category"),
    )
    return v.assets(spark, sf).select("rel_path", "license", "category", "width").unionByName(scenes, allowMissingColumns=True).drop("width")


@check(
    "u3_distinct_values",
    f"""WITH {v.CELL} SELECT 'color' AS kind, CAST(px AS VARCHAR) AS value FROM (SELECT DISTINCT px FROM cell)
    UNION ALL SELECT DISTINCT 'license', {v.sql_pick(v.LICENSES, 'doc_id')} FROM documents UNION ALL SELECT DISTINCT 'tag', unnest([lang, source]) FROM documents""",
)
def _(spark, sf):
    colors = v.sprites(spark, sf).select(F.explode(F.array_distinct("pixels")).alias("value")).distinct().select(F.col("value").cast("string").alias("value"))
    a = v.assets(spark, sf)
    licenses = a.select(F.col("license").alias("value")).distinct()
    tags = a.select(F.explode(F.array_distinct(F.array("category", "source"))).alias("value")).distinct()
    kinds = {"color": colors, "license": licenses, "tag": tags}
    out = [df.select(F.lit(kind).alias("kind"), "value") for kind, df in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@check(
    "u4_sheet_children",
    f"""WITH RECURSIVE {A14_SPARSE}, child AS (SELECT p.image_id, p.piece, c.pos, c.px FROM piece p JOIN cell c ON c.image_id = p.image_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 WHERE n >= 2)
    SELECT image_id, piece, string_agg(CAST(px AS VARCHAR), ',' ORDER BY pos) AS pixels FROM child GROUP BY ALL
    UNION ALL SELECT image_id, NULL, string_agg(CAST(px AS VARCHAR), ',' ORDER BY pos) FROM cell WHERE image_id NOT IN (SELECT image_id FROM child) GROUP BY image_id""",
)
def _(spark, sf):
    s = sheets(spark, sf)
    kids = s.where(F.size("boxes") > 0).select("image_id", "pixels", "width", F.posexplode("boxes").alias("piece", "box"))
    kids = kids.select("image_id", "piece", joined(px.crop("pixels", F.col("width"), F.col("box"))).alias("pixels"))
    whole = s.where(F.size("boxes") == 0).select("image_id", F.lit(None).cast("int").alias("piece"), joined("pixels").alias("pixels"))
    return kids.unionByName(whole)


@check(
    "u5_split_disjointness",
    f"""WITH {v.ASSET}, {W5}, p AS (SELECT rel_path, count(DISTINCT split) AS n FROM s GROUP BY rel_path)
    SELECT count(*) AS rows, count(*) FILTER (n > 1) AS shared, (SELECT count(*) FROM asset) - count(*) AS missing FROM p""",
)
def _(spark, sf):
    rows = v.assets(spark, sf).select("rel_path")
    labelled = cut_lineage(batches.train_val_test_split(rows, "rel_path", 0.1, 0.2, 3))
    parts = {name: labelled.where(F.col("split") == name).select("rel_path") for name in ("train", "validation", "test")}
    shared = parts["train"].intersect(parts["validation"]).union(parts["train"].intersect(parts["test"])).union(parts["validation"].intersect(parts["test"]))
    missing = rows.exceptAll(labelled.select("rel_path"))
    one = F.lit(1)
    counts = labelled.select(one.alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    counts = counts.unionByName(shared.select(F.lit(0).alias("a"), one.alias("b"), F.lit(0).alias("c")))
    counts = counts.unionByName(missing.select(F.lit(0).alias("a"), F.lit(0).alias("b"), one.alias("c")))
    return counts.agg(F.sum("a").alias("rows"), F.sum("b").alias("shared"), F.sum("c").alias("missing"))


