"""Checks of reports, palettes, regions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import components, names
from ..functions import pixels as px
from ..operators import curate, embed, metrics, reports, targets
from ..plans.features import with_color_stats, with_size_class
from . import views as v
from .joins import J8, J9, coded, fitted_pairs, joined
from .registry import check
from .scalars import DUP, P23, SQL_ELIGIBLE, dup_assets, scored_sprites


@check(
    "a1_palette_stats",
    f"""WITH {v.PHOTO} SELECT image_id, CAST(n AS BIGINT) AS unique_color_count, CAST(least(n, 32) AS BIGINT) AS palette_size, n > 32 AS lossy
    FROM (SELECT image_id, count(DISTINCT px) AS n FROM photo GROUP BY image_id)""",
)
def _(spark, sf):
    s = with_color_stats(v.photos(spark, sf), 32)
    return s.select("image_id", "unique_color_count", "palette_size", "lossy")


@check(
    "a2_palette_extraction",
    f"WITH {v.CELL} SELECT image_id, string_agg(CAST(px AS VARCHAR), ',' ORDER BY px) AS palette FROM (SELECT DISTINCT image_id, px FROM cell) GROUP BY image_id",
)
def _(spark, sf):
    return v.sprites(spark, sf).select("image_id", joined(px.palette("pixels")).alias("palette"))


@check(
    "a2_palette_reordering",
    f"""WITH {v.SPRITE}, cell AS (SELECT image_id, pos, 7 - indices[pos + 1] AS idx FROM (SELECT *, unnest(range(64)) AS pos FROM sprite))
    SELECT image_id, string_agg(CAST(7 - idx AS VARCHAR), ',' ORDER BY pos) AS indices FROM cell GROUP BY image_id""",
)
def _(spark, sf):
    s = v.sprites(spark, sf).withColumn("palette", F.reverse("palette")).withColumn("indices", F.transform("indices", lambda i: 7 - i))
    return s.select("image_id", joined(px.remap_palette("indices", "palette")["indices"]).alias("indices"))


@check(
    "a3_index_map",
    f"""WITH {v.PHOTO}, used AS (SELECT image_id, px, row_number() OVER (PARTITION BY image_id ORDER BY px) - 1 AS i FROM (SELECT DISTINCT image_id, px FROM photo))
    SELECT image_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY pos) AS indices FROM photo JOIN used USING (image_id, px) GROUP BY image_id""",
)
def _(spark, sf):
    s = v.photos(spark, sf).withColumn("palette", px.palette("pixels"))
    return s.select("image_id", joined(px.index_map("pixels", "palette")).alias("indices"))


_TAGS = "list_sort(list_distinct(['doc', category, source]))"
A5 = f"""{DUP}, report AS (
  SELECT 'total' AS section, 'count' AS key, count(*) AS count FROM dup UNION ALL SELECT 'total', 'lossy', count(*) FROM dup WHERE lossy
  UNION ALL SELECT 'total', 'lossless', count(*) FROM dup WHERE NOT lossy UNION ALL SELECT 'total', 'duplicates', count(*) FROM dup WHERE duplicate_of IS NOT NULL
  UNION ALL SELECT 'total', 'near_duplicates', count(*) FROM dup WHERE near_duplicate_of IS NOT NULL
  UNION ALL SELECT 'bucket', {v.SQL_BUCKET}, count(*) FROM dup WHERE {v.SQL_BUCKET} IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'license', license, count(*) FROM dup WHERE license <> '' GROUP BY ALL
  UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest({_TAGS}) AS tag FROM dup) GROUP BY ALL)"""


def tagged(spark, sf):
    return dup_assets(spark, sf).withColumn("tags", F.array_sort(F.array(F.lit("doc"), F.col("category"), F.col("source"))))


@check("a5_manifest_report", f"WITH {A5} SELECT * FROM report")
def _(spark, sf):
    return reports.manifest_report(tagged(spark, sf))


_REASON = "CASE WHEN width > 128 OR height > 128 THEN 'oversized' WHEN unique_color_count > 256 THEN 'non_pixel_art' END"


@check(
    "a6_rejection_report",
    f"""WITH {v.ASSET}, r AS (SELECT source, coalesce({_REASON}, 'accepted') AS reason FROM asset)
    SELECT source, reason, count(*) AS count FROM r GROUP BY ROLLUP (source, reason) UNION ALL SELECT NULL, reason, count(*) FROM r GROUP BY reason""",
)
def _(spark, sf):
    return reports.rejection_report(v.assets(spark, sf).withColumn("reason", F.expr(_REASON)))


@check(
    "a7_distribution_report",
    f"""WITH {v.CELL}, img AS (SELECT image_id, any_value(width) AS w, any_value(height) AS h, count(DISTINCT px) AS n, bool_or((px >> 24) < 255) AS t FROM cell GROUP BY image_id)
    SELECT 'size' AS section, w || 'x' || h AS key, CAST(0 AS BIGINT) AS position, count(*) AS count FROM img GROUP BY ALL
    UNION ALL SELECT 'palette_size', CAST(n AS VARCHAR), n, count(*) FROM img GROUP BY ALL UNION ALL SELECT 'transparency', CAST(t AS VARCHAR), 0, count(*) FROM img GROUP BY ALL""",
)
def _(spark, sf):
    return reports.distribution_report(with_color_stats(v.sprites(spark, sf)))


@check(
    "a8_readiness",
    f"WITH {DUP} SELECT count(*) AS selected, CASE WHEN count(*) >= 50 THEN 'ready' ELSE 'below_min_count' END AS status FROM dup WHERE {SQL_ELIGIBLE}",
)
def _(spark, sf):
    return reports.readiness(dup_assets(spark, sf).where(curate.is_eligible()), 50)


_GROUP = f"category || '|' || coalesce({v.SQL_BUCKET}, 'None')"


@check(
    "a9_curation_report",
    f"""WITH {DUP}, e AS (SELECT *, {_GROUP} AS g FROM dup WHERE {SQL_ELIGIBLE}), c AS (SELECT greatest(1, (60 + count(DISTINCT g) - 1) // count(DISTINCT g)) AS cap FROM e),
    s AS (SELECT * FROM (SELECT g, row_number() OVER (PARTITION BY g ORDER BY md5('0:' || rel_path), rel_path) AS n FROM e), c WHERE n <= cap)
    SELECT 'curation' AS section, 'eligible' AS key, count(*) AS count FROM e UNION ALL SELECT 'curation', 'dropped_lossy', count(*) FROM dup WHERE lossy
    UNION ALL SELECT 'curation', 'dropped_duplicates', count(*) FROM dup WHERE duplicate_of IS NOT NULL
    UNION ALL SELECT 'curation', 'dropped_near_duplicates', count(*) FROM dup WHERE near_duplicate_of IS NOT NULL
    UNION ALL SELECT 'curation', 'per_group_cap', CAST(cap AS BIGINT) FROM c UNION ALL SELECT 'curation', 'selected', least(60, count(*)) FROM s
    UNION ALL SELECT 'group', g, count(*) FROM e GROUP BY g""",
)
def _(spark, sf):
    rows = dup_assets(spark, sf)
    group = curate.group_key(F.col("category"), F.col("bucket"))
    eligible = rows.where(curate.is_eligible()).withColumn("group", group)
    cap = curate.sample_cap(eligible, 60, None)
    chosen = curate.balanced_sample(eligible, 60, cap)
    return reports.curation_report(rows, curate.is_eligible(), group, chosen, cap)


@check(
    "a10_split_report",
    f"""WITH {v.ASSET}, r AS (SELECT lossy, row_number() OVER (ORDER BY md5('0:' || rel_path), rel_path) - 1 AS i, count(*) OVER () AS n FROM asset),
    s AS (SELECT lossy, CASE WHEN i < greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'test' WHEN i < greatest(1, round_even(n * 0.2::DOUBLE, 0)) + greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM r)
    SELECT split, count(*) AS count, count(*) FILTER (lossy) AS lossy, count(*) FILTER (NOT lossy) AS lossless FROM s GROUP BY split""",
)
def _(spark, sf):
    from ..operators.batches import train_val_test_split

    rows = v.assets(spark, sf).select("rel_path", "lossy")
    return reports.split_report(train_val_test_split(rows, "rel_path", 0.1, 0.2))


@check(
    "a11_quality_summary",
    f"""WITH {P23} SELECT count(*) AS count, count(*) FILTER (image_id % 3 = 0) AS duplicate_count, count(*) FILTER (image_id % 5 = 0) AS near_duplicate_count,
    round(avg(quality), 6) AS mean_quality, round(min(quality), 6) AS min_quality, round(max(quality), 6) AS max_quality FROM scored""",
)
def _(spark, sf):
    rows = scored_sprites(spark, sf).withColumn("duplicate_of", F.when(F.col("image_id") % 3 == 0, "a"))
    out = reports.quality_summary(rows.withColumn("near_duplicate_of", F.when(F.col("image_id") % 5 == 0, "a")))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("quality") else F.col(c) for c in out.columns])


def _sql_reach(condition: str, diagonal: bool, cells: str = "cell") -> str:
    """Recursive CTE ``comp``: first raster position of the component of every cell with ``condition``."""
    near = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1" if diagonal else "abs(a.x - b.x) + abs(a.y - b.y) = 1"
    return f"""node AS (SELECT * FROM {cells} WHERE {condition}),
    link AS (SELECT a.image_id, a.pos AS f, b.pos AS t FROM node a JOIN node b ON a.image_id = b.image_id AND a.key = b.key AND {near} AND a.pos <> b.pos),
    reach(image_id, src, pos) AS (SELECT image_id, pos, pos FROM node UNION SELECT r.image_id, r.src, l.t FROM reach r JOIN link l ON l.image_id = r.image_id AND l.f = r.pos),
    comp AS (SELECT image_id, pos, min(src) AS root FROM reach GROUP BY ALL)"""


_KEYED = v.CELL + ", keyed AS (SELECT *, idx AS key FROM cell)"


@check(
    "a12_connected_regions",
    f"""WITH RECURSIVE {_KEYED}, {_sql_reach('idx <> 0', False, 'keyed')},
    num AS (SELECT image_id, pos, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS region FROM comp)
    SELECT image_id, string_agg(CAST(CASE WHEN coalesce(region, 0) > 20 THEN 0 ELSE coalesce(region, 0) END AS VARCHAR), ',' ORDER BY cell.pos) AS regions
    FROM cell LEFT JOIN num USING (image_id, pos) GROUP BY image_id""",
)
def _(spark, sf):
    return targets.with_regions(v.sprites(spark, sf), max_regions=20).select("image_id", joined("structure").alias("regions"))


@check(
    "a13_value_regions",
    f"""WITH {v.CELL}, first AS (SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY min(pos)) AS r FROM cell WHERE idx <> 0 GROUP BY image_id, idx)
    SELECT image_id, string_agg(CAST(CASE WHEN r <= 4 THEN r ELSE 0 END AS VARCHAR), ',' ORDER BY pos) AS regions FROM cell LEFT JOIN first USING (image_id, idx) GROUP BY image_id""",
)
def _(spark, sf):
    return targets.with_regions(v.sprites(spark, sf), connected=False, max_regions=4).select("image_id", joined("structure").alias("regions"))


_SHEET = v.CELL + """, mixed AS (SELECT image_id, bool_or(idx = 0) AND bool_or(idx <> 0) AS m, min(px) FILTER (pos = 0) AS back FROM cell GROUP BY image_id),
keyed AS (SELECT cell.*, CASE WHEN m THEN px >= 16777216 ELSE px <> back END AS fg, 1 AS key FROM cell JOIN mixed USING (image_id))"""
A14 = f"""{_SHEET}, {_sql_reach('fg', True, 'keyed')},
box AS (SELECT image_id, root, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM comp JOIN cell USING (image_id, pos) GROUP BY ALL
  HAVING count(*) >= 4 AND max(x) + 1 - min(x) <= 6 AND max(y) + 1 - min(y) <= 6),
piece AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y0, x0, x1, y1) - 1 AS piece, count(*) OVER (PARTITION BY image_id) AS n FROM box)"""


def sheets(spark, sf):
    """Sprites with fewer colours shown, so that they fall apart into pieces."""
    from ..plans.curation import sheet_pieces

    s = v.sprites(spark, sf).withColumn("pixels", F.transform("indices", lambda i: F.get(F.col("palette"), F.when(i < 5, 0).otherwise(i))))
    return sheet_pieces(s, 6)


_SPARSE = v.SPRITE + f""",
cell AS (
  SELECT image_id, label, width, height, pos, pos % width AS x, pos // width AS y, CASE WHEN indices[pos + 1] < 5 THEN 0 ELSE indices[pos + 1] END AS idx,
         ({v.PALETTE_SQL})[CASE WHEN indices[pos + 1] < 5 THEN 0 ELSE indices[pos + 1] END + 1] AS px
  FROM (SELECT *, unnest(range(64)) AS pos FROM sprite))"""
A14_SPARSE = A14.replace(v.CELL, _SPARSE)


@check("a14_sheet_boxes", f"WITH RECURSIVE {A14_SPARSE} SELECT image_id, piece, x0, y0, x1, y1 FROM piece WHERE n >= 2")
def _(spark, sf):
    s = sheets(spark, sf).select("image_id", F.posexplode("boxes").alias("piece", "b"))
    return s.select("image_id", "piece", "b.x0", "b.y0", "b.x1", "b.y1")


@check("a15_sheet_mask", f"WITH {_SHEET} SELECT image_id, string_agg(CASE WHEN fg THEN '1' ELSE '0' END, '' ORDER BY pos) AS mask FROM keyed GROUP BY image_id")
def _(spark, sf):
    mask = F.transform(components.sheet_mask("pixels"), lambda m: (m == 1).cast("int"))
    return v.sprites(spark, sf).select("image_id", joined(mask, "").alias("mask"))


@check(
    "a16_component_sizes",
    f"""WITH RECURSIVE {_KEYED.replace("idx AS key", "1 AS key")}, {_sql_reach('(px >> 24) >= 128 AND idx >= 4', False, 'keyed')},
    size AS (SELECT image_id, root, count(*) AS n FROM comp GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, root) AS k FROM size)
    SELECT image_id, count(root) AS components, max(CASE WHEN k = 1 THEN root END) AS largest, max(CASE WHEN k = 1 THEN n END) AS cells
    FROM sprite LEFT JOIN ranked USING (image_id) GROUP BY image_id""",
)
def _(spark, sf):
    shown = F.transform("indices", lambda i: F.when(i >= 4, 1).otherwise(-1))
    s = components.with_component_labels(v.sprites(spark, sf), shown)
    big = components.largest_component("labels")
    return s.select("image_id", components.component_count("labels").alias("components"), big["label"].alias("largest"), big["n"].alias("cells"))


@check("a17_palette_fidelity", f"WITH {J9} SELECT round(avg(palette_fidelity), 6) AS palette_fidelity FROM fidelity")
def _(spark, sf):
    return metrics.pair_metrics(v.sprite_pairs(spark, sf), "pair_id").agg(F.round(F.avg("palette_fidelity"), 6).alias("palette_fidelity"))


_MASKS = "mask AS (SELECT *, (pred_px >> 24) >= 128 AS p, (target_px >> 24) >= 128 AS t FROM pair)"


@check(
    "a18_transparency_iou",
    f"WITH {v.PAIR}, {_MASKS} SELECT pair_id, CASE WHEN count(*) FILTER (p OR t) = 0 THEN 1.0 ELSE round(count(*) FILTER (p AND t) / count(*) FILTER (p OR t), 6) END AS iou FROM mask GROUP BY pair_id",
)
def _(spark, sf):
    f = fitted_pairs(spark, sf)
    return f.select("pair_id", F.round(metrics.mask_iou(px.opaque_mask("pred_pixels"), px.opaque_mask("target_pixels")), 6).alias("iou"))


def _sql_edges(columns: dict[str, str], key: str, source: str, valid: str = "true") -> str:
    """Boundary flags of several cell values: both sides of every change."""
    parts = []
    for name, value in columns.items():
        tests = []
        for line, along in (("y", "x"), ("x", "y")):
            for side in ("lag", "lead"):
                over = f"OVER (PARTITION BY {key}, {line} ORDER BY {along})"
                tests.append(f"coalesce(({value}) <> {side}({value}) {over} AND ({valid}) AND {side}({valid}) {over}, false)")
        parts.append("(" + " OR ".join(tests) + f") AS {name}")
    return f"SELECT *, {', '.join(parts)} FROM {source}"


_F1 = "CASE WHEN 2 * count(*) FILTER (pe AND te) + count(*) FILTER (pe <> te) = 0 THEN 1.0 ELSE 2 * count(*) FILTER (pe AND te) / (2 * count(*) FILTER (pe AND te) + count(*) FILTER (pe <> te)) END"


@check(
    "a19_boundary_f1",
    f"WITH {v.PAIR}, {_MASKS}, edge AS ({_sql_edges({'pe': 'p', 'te': 't'}, 'pair_id', 'mask')}) SELECT pair_id, round({_F1}, 6) AS boundary_f1 FROM edge GROUP BY pair_id",
)
def _(spark, sf):
    f = fitted_pairs(spark, sf)
    edges = [px.boundary(px.opaque_mask(c), "pred_width") for c in ("pred_pixels", "target_pixels")]
    return f.select("pair_id", F.round(metrics.mask_f1(*edges), 6).alias("boundary_f1"))


def _sql_pair_components() -> str:
    both = f"""{v.PAIR}, {_MASKS},
    keyed AS (SELECT pair_id * 2 AS image_id, pos, x, y, p AS fg, 1 AS key FROM mask UNION ALL SELECT pair_id * 2 + 1, pos, x, y, t, 1 FROM mask)"""
    return f"""{both}, {_sql_reach('fg', False, 'keyed')},
    size AS (SELECT image_id, root, count(*) AS n FROM comp GROUP BY ALL),
    best AS (SELECT image_id, min(struct_pack(n := -n, r := root)).r AS root, count(*) AS components FROM size GROUP BY image_id),
    big AS (SELECT k.image_id, k.pos, c.root = b.root AS hit FROM keyed k LEFT JOIN comp c USING (image_id, pos) LEFT JOIN best b ON b.image_id = k.image_id),
    score AS (SELECT m.pair_id, any_value(coalesce(bp.components, 0)) AS pc, any_value(coalesce(bt.components, 0)) AS tc,
      count(*) FILTER (coalesce(p.hit, false) AND coalesce(t.hit, false)) AS both_n, count(*) FILTER (coalesce(p.hit, false) OR coalesce(t.hit, false)) AS any_n
      FROM mask m JOIN big p ON p.image_id = m.pair_id * 2 AND p.pos = m.pos JOIN big t ON t.image_id = m.pair_id * 2 + 1 AND t.pos = m.pos
      LEFT JOIN best bp ON bp.image_id = m.pair_id * 2 LEFT JOIN best bt ON bt.image_id = m.pair_id * 2 + 1 GROUP BY m.pair_id)"""


PAIR_COMPONENTS = _sql_pair_components()
LARGEST_IOU = "CASE WHEN any_n = 0 THEN 1.0 ELSE both_n / any_n END"


@check(
    "a20_component_agreement",
    f"WITH RECURSIVE {PAIR_COMPONENTS} SELECT pair_id, CAST(abs(pc - tc) AS DOUBLE) AS error, round(1.0 - abs(pc - tc) / greatest(pc, tc, 1), 6) AS consistency FROM score",
)
def _(spark, sf):
    m = metrics.pair_metrics(v.sprite_pairs(spark, sf), "pair_id")
    return m.select("pair_id", F.col("component_count_error").alias("error"), F.round("connected_component_consistency", 6).alias("consistency"))


@check("a21_largest_component_iou", f"WITH RECURSIVE {PAIR_COMPONENTS} SELECT pair_id, round({LARGEST_IOU}, 6) AS iou FROM score")
def _(spark, sf):
    return metrics.pair_metrics(v.sprite_pairs(spark, sf), "pair_id").select("pair_id", F.round("largest_component_iou", 6).alias("iou"))


@check("a22_grid_alignment", f"WITH {v.CELL} SELECT image_id, round((avg(CASE WHEN (px >> 24) IN (0, 255) THEN 1 ELSE 0 END) + 1) / 2, 6) AS alignment FROM cell GROUP BY image_id")
def _(spark, sf):
    return v.sprites(spark, sf).select("image_id", F.round(metrics.grid_alignment("pixels"), 6).alias("alignment"))


CORPUS_METRICS = f"""{PAIR_COMPONENTS}, colors AS (SELECT * FROM ({"WITH " + J9 + " SELECT pair_id, palette_fidelity FROM fidelity"})),
iou AS (SELECT pair_id, CASE WHEN count(*) FILTER (p OR t) = 0 THEN 1.0 ELSE count(*) FILTER (p AND t) / count(*) FILTER (p OR t) END AS iou FROM mask GROUP BY pair_id),
edge AS ({_sql_edges({'pe': 'p', 'te': 't'}, 'pair_id', 'mask')}),
f1 AS (SELECT pair_id, {_F1} AS f1 FROM edge GROUP BY pair_id),
hard AS (SELECT pair_id, (avg(CASE WHEN (pred_px >> 24) IN (0, 255) THEN 1 ELSE 0 END) + 1) / 2 AS alignment FROM pair GROUP BY pair_id)"""
CORPUS_AVERAGES = f"""round(avg(palette_fidelity), 6) AS palette_fidelity, round(avg(iou), 6) AS transparency_iou, round(avg(f1), 6) AS boundary_f1,
round(avg(CAST(abs(pc - tc) AS DOUBLE)), 6) AS component_count_error, round(avg({LARGEST_IOU}), 6) AS largest_component_iou,
round(avg(1.0 - abs(pc - tc) / greatest(pc, tc, 1)), 6) AS connected_component_consistency, round(avg(alignment), 6) AS grid_pixel_alignment"""


@check(
    "a23_corpus_metrics",
    f"WITH RECURSIVE {CORPUS_METRICS} SELECT {CORPUS_AVERAGES} FROM score JOIN colors USING (pair_id) JOIN iou USING (pair_id) JOIN f1 USING (pair_id) JOIN hard USING (pair_id)",
)
def _(spark, sf):
    out = metrics.corpus_metrics(metrics.pair_metrics(v.sprite_pairs(spark, sf), "pair_id"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_TOKENS = v.CELL + """, tok AS (SELECT c.image_id, c.label, c.width, c.pos, c.x, c.y, c.idx AS pred, d.idx AS target, c.pos % 7 <> 3 AS valid
  FROM cell c JOIN (SELECT image_id - 1 AS image_id, pos, idx FROM cell) d USING (image_id, pos))"""


def token_grids(spark, sf):
    """Predicted and true token grids of one shape with a validity mask."""
    s = v.sprites(spark, sf)
    target = s.select((F.col("image_id") - 1).alias("image_id"), F.col("indices").alias("target"))
    valid = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 7 != 3)
    return s.select("image_id", "label", "width", F.col("indices").alias("pred")).join(target, "image_id").withColumn("valid", valid)


def token_cells(spark, sf):
    z = token_grids(spark, sf).select("image_id", "label", "width", F.posexplode(F.arrays_zip("pred", "target", "valid")).alias("pos", "c"))
    return z.select("image_id", "label", "width", "pos", "c.pred", "c.target", "c.valid")


@check(
    "a24_token_metrics",
    f"""WITH {_TOKENS} SELECT round(avg(CASE WHEN pred = target THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN (pred = 0) = (target = 0) THEN 1 ELSE 0 END), 6) AS silhouette_accuracy,
    round(avg(CASE WHEN target <> 0 THEN 1 ELSE 0 END), 6) AS foreground_ratio, round(avg(CASE WHEN pred <> 0 THEN 1 ELSE 0 END), 6) AS predicted_foreground_ratio FROM tok WHERE valid""",
)
def _(spark, sf):
    out = metrics.token_metrics(token_cells(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@check(
    "a25_code_usage",
    f"""WITH {J8}, n AS (SELECT code, count(*) AS n FROM code GROUP BY code), p AS (SELECT n / sum(n) OVER () AS p FROM n)
    SELECT count(*) AS codes_used, 128 - count(*) AS dead_codes, round(exp(-sum(p * ln(p))), 6) AS perplexity FROM p""",
)
def _(spark, sf):
    return metrics.code_usage(coded(spark, sf), 128).withColumn("perplexity", F.round("perplexity", 6))


@check(
    "a26_token_boundary_f1",
    f"""WITH {_TOKENS}, edge AS ({_sql_edges({'pe': 'pred', 'te': 'target'}, 'image_id', 'tok', 'valid')}) SELECT CAST(width AS BIGINT) AS width, round({_F1}, 6) AS boundary_f1 FROM edge GROUP BY width""",
)
def _(spark, sf):
    return metrics.token_boundary_f1(token_grids(spark, sf), "width").withColumn("boundary_f1", F.round("boundary_f1", 6))


@check("a27_token_error", f"WITH {_TOKENS} SELECT CAST(label AS BIGINT) AS label, round(avg(CASE WHEN pred <> target THEN 1 ELSE 0 END) FILTER (valid), 6) AS token_error FROM tok GROUP BY label")
def _(spark, sf):
    return metrics.token_error(token_cells(spark, sf), "label").withColumn("token_error", F.round("token_error", 6))


@check(
    "a28_step_metrics",
    f"""WITH {_TOKENS}, step AS (SELECT *, CAST(label % 4 AS BIGINT) AS step, CASE WHEN valid THEN pred ELSE -1 END AS p FROM tok),
    nb AS (SELECT *, lead(p) OVER r AS pr, lead(target) OVER r AS tr, lead(valid) OVER r AS vr, lead(p) OVER d AS pd, lead(target) OVER d AS td, lead(valid) OVER d AS vd FROM step
      WINDOW r AS (PARTITION BY image_id, y ORDER BY x), d AS (PARTITION BY image_id, x ORDER BY y))
    SELECT step, round(count(*) FILTER (valid AND p = target) / count(*) FILTER (valid), 6) AS index_accuracy,
      round((count(*) FILTER (valid AND vr AND (p <> pr) = (target <> tr)) + count(*) FILTER (valid AND vd AND (p <> pd) = (target <> td))) / (count(*) FILTER (valid AND vr) + count(*) FILTER (valid AND vd)), 6) AS edge_detail,
      round(count(*) FILTER (NOT valid OR p < 6) / count(*), 6) AS palette_consistency,
      round(count(*) FILTER (valid AND (p = 0) = (target = 0)) / count(*) FILTER (valid), 6) AS transparency FROM nb GROUP BY step""",
)
def _(spark, sf):
    g = token_grids(spark, sf).withColumn("step", F.col("label") % 4).withColumn("palette_size", F.lit(6))
    out = metrics.step_metrics(g, "step")
    return out.select("step", *[F.round(c, 6).alias(c) for c in out.columns if c != "step"])


@check(
    "a29_weighted_mean",
    "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / greatest(sum(l_discount), 1), 4) AS mean FROM lineitem GROUP BY l_returnflag",
)
def _(spark, sf):
    li = v.table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(targets.weighted_mean("l_extendedprice", "l_discount"), 4).alias("mean"))


@check(
    "a30_region_weights",
    f"""WITH {_TOKENS}, fg AS (SELECT *, target <> 0 AND valid AS f FROM tok), edge AS ({_sql_edges({'e': 'f'}, 'image_id', 'fg')})
    SELECT image_id, string_agg(CAST(CASE WHEN valid THEN 1.0 + CASE WHEN f THEN 2.0 ELSE 0 END + CASE WHEN e THEN 0.5 ELSE 0 END ELSE 0 END * 2 AS INTEGER)::VARCHAR, ',' ORDER BY pos) AS weights FROM edge GROUP BY image_id""",
)
def _(spark, sf):
    w = targets.region_weights(F.col("target"), F.col("valid"), F.col("width"), 2.0, 0.5)
    return token_grids(spark, sf).select("image_id", joined(F.transform(w, lambda x: (x * 2).cast("int"))).alias("weights"))


@check("a31_region_count", f"WITH {_TOKENS} SELECT image_id, CAST(least(max(CASE WHEN valid THEN target ELSE 0 END), 5) AS BIGINT) AS regions FROM tok GROUP BY image_id")
def _(spark, sf):
    return token_grids(spark, sf).select("image_id", targets.region_count("target", F.col("valid"), 5).alias("regions"))


@check(
    "a32_throughput_report",
    f"""WITH {v.ASSET} SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(2.5 AS DOUBLE) AS seconds, round(sum(n) / 2.5, 6) AS samples_per_second, round(500000 / (sum(n) / 2.5) / 3600, 9) AS epoch_hours_500k,
    round(1000000 / (sum(n) / 2.5) / 3600, 9) AS epoch_hours_1m, string_agg(b || '=' || n, ',' ORDER BY b) AS buckets
    FROM (SELECT {v.SQL_BUCKET} AS b, count(*) AS n FROM asset WHERE {v.SQL_BUCKET} IS NOT NULL GROUP BY 1)""",
)
def _(spark, sf):
    from ..operators.batches import bucket_counts

    counts = bucket_counts(with_size_class(v.assets(spark, sf)).where("bucket is not null"))
    r = reports.throughput_report(counts, 2.5)
    text = F.array_join(F.transform(F.map_entries("buckets"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return r.select(
        "samples", "seconds", F.round("samples_per_second", 6).alias("samples_per_second"), F.round("epoch_hours_500k", 9).alias("epoch_hours_500k"),
        F.round("epoch_hours_1m", 9).alias("epoch_hours_1m"), text.alias("buckets"),
    )


@check(
    "a33_prompt_coverage",
    """SELECT c AS category, count(*) FILTER (contains(lower(text), c)) AS prompts, bool_or(contains(lower(text), c)) AS covered
    FROM (SELECT text, unnest(['sprite', 'icon', 'tile', 'object', 'building', 'scene', 'isometric', 'transparent']) AS c FROM (SELECT text FROM documents UNION ALL SELECT p_name || ' icon ' || p_type FROM part)) GROUP BY c""",
)
def _(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.lower("text").alias("prompt"))
    parts = v.table(spark, sf, "part").selectExpr("lower(concat(p_name, ' icon ', p_type)) AS prompt")
    return embed.prompt_coverage(docs.unionByName(parts))
