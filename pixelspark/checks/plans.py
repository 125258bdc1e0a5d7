"""Checks of the composed runs: corpus, curation, manifest, pack, training view, evaluation and stage targets."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import names
from ..functions import pixels as px
from ..operators import curate
from ..plans.corpus import prepare_corpus
from ..plans.curation import candidates_from_files, classify_candidates, curated_rows, curation_counts
from ..plans.evaluation import evaluate_pairs, evaluation_report
from ..plans.features import with_image_features, with_size_class
from ..plans.manifest import manifest_rows
from ..plans.training import stage_targets, training_batches, training_rows
from ..plans.vendor import pack_report, pack_rows
from ..session import cut_lineage, scratch_path
from ..sources.files import decode_files
from . import views as v
from .aggregates import CORPUS_AVERAGES, CORPUS_METRICS, _KEYED, _sql_reach
from .joins import joined
from .registry import check
from .scalars import DUP, P13, P19, SQL_ELIGIBLE, dup_assets, sql_projection, sql_stage
from .windows import W5, sql_batches

# The licences of the three example sources.
SOURCES = (("Pack Zero", "CC0-1.0"), ("Pack One", "mit"), ("Pack Two", "CC-BY-NC"))


def corpus_run(spark, sf, **options):
    """A corpus from three Parquet sources that hold the sprites as PNG images, one of them not permitted."""
    root = scratch_path(spark, "corpus")
    stored = v.png_files(spark, sf).select("label", F.struct(F.col("content").alias("bytes")).alias("image"), F.lit("a sprite").alias("caption"))
    sources = []
    for i, (name, license_) in enumerate(SOURCES):
        stored.where(F.col("label") % 3 == i).select("image", "caption").write.parquet(f"{root}/in/{i}")
        sources.append({"name": name, "path": f"{root}/in/{i}", "license": license_, "category": f"c{i}", "extract_parquet": True})
    spark.createDataFrame([(json.dumps({"sources": sources}),)], "value string").coalesce(1).write.text(f"{root}/config")
    return prepare_corpus(spark, f"{root}/config", f"{root}/out", **options)


_RAW = f"""SELECT label % 3 AS part, image_id % 11 = 5 AS broken FROM sprite"""


@check(
    "q1_corpus_sources",
    f"""WITH {v.SPRITE}, raw AS ({_RAW}), n AS (SELECT part, count(*) AS scanned, count(*) FILTER (NOT broken) AS accepted, count(*) FILTER (broken) AS rejected FROM raw GROUP BY part),
    names(part, source) AS (VALUES (0, 'Pack Zero'), (1, 'Pack One'), (2, 'Pack Two'))
    SELECT source, scanned, accepted, rejected, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS count FROM n JOIN names USING (part) WHERE part < 2
    UNION ALL SELECT source, 0, 0, 0, 'corrupt', rejected FROM n JOIN names USING (part) WHERE part < 2 AND rejected > 0
    UNION ALL SELECT 'Pack Two', 0, 0, 0, 'license_not_allowed', 1""",
)
def _(spark, sf):
    return corpus_run(spark, sf, target_count=v.table(spark, sf, "embeddings").count(), min_count=10)["sources"].drop("blocked_reason")


@check("q1_corpus_with_scenes")
def _(spark, sf):
    n = v.table(spark, sf, "embeddings").count()
    out = corpus_run(spark, sf, target_count=n, min_count=10, scenes=max(2, n // 10))
    return out["manifest"].select("rel_path", "bucket", "license", "category", "unique_color_count")


def candidate_assets(spark, sf):
    """documents as candidates whose hashes are equal for copies and near for texts of nearly the same length."""
    a = v.assets(spark, sf)
    start = F.md5(F.floor(F.length("content") / 8).cast("string"))
    high = F.conv(F.substring(start, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(start, 9, 8), 16, 10).cast("bigint")
    h = F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.length("content").cast("bigint") % 8)
    return a.select("asset_id", "rel_path", "sha256", "width", "height", (F.col("unique_color_count") % 100).alias("unique_color_count"), h.alias("phash")).withColumn(
        "reason", F.lit(None).cast("string")
    )


@check(
    "q2_candidate_classes",
    f"""WITH RECURSIVE {v.ASSET}, cand AS (SELECT asset_id, rel_path, sha256, width, height, unique_color_count % 100 AS colors,
      substr(md5(CAST(CAST(floor(length(content) / 8) AS BIGINT) AS VARCHAR)), 1, 16) AS start, length(content) % 8 AS tail FROM asset),
    bits AS (SELECT *, CASE WHEN width > 128 OR height > 128 THEN 'oversized_high_res' WHEN colors > 64 THEN 'lossy_gt_64_colors' END AS reason FROM cand),
    ok AS (SELECT *, row_number() OVER (ORDER BY string_split(rel_path, '/')) AS n FROM bits WHERE reason IS NULL),
    pass(n, kept, taken, copy) AS (
      SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(s VARCHAR, t BIGINT, d VARCHAR)[]), false, false
      UNION ALL
      SELECT n, CASE WHEN free THEN list_append(kept, me) ELSE kept END, free, copy FROM (
        SELECT r.n, p.kept, struct_pack(s := r.start, t := CAST(r.tail AS BIGINT), d := r.sha256) AS me, len(list_filter(p.kept, lambda k: k.d = r.sha256)) > 0 AS copy,
          len(list_filter(p.kept, lambda k: k.s = r.start AND bit_count(xor(k.t, CAST(r.tail AS BIGINT))) <= 4)) = 0 AS free
        FROM pass p JOIN ok r ON r.n = p.n + 1))
    SELECT asset_id, CASE WHEN taken THEN NULL WHEN copy THEN 'duplicate' ELSE 'near_duplicate' END AS reason FROM pass JOIN ok USING (n)
    UNION ALL SELECT asset_id, reason FROM bits WHERE reason IS NOT NULL""",
)
def _(spark, sf):
    rows = candidate_assets(spark, sf).withColumn("_order", names.path_order("rel_path"))
    return classify_candidates(rows, 128, 64, 256, 4).select("asset_id", "reason")


def image_files(spark, sf):
    """Sprites and documents as a table of files: PNG images, broken ones and other formats."""
    pngs = v.png_files(spark, sf).select(F.concat(F.lit("img/"), F.lpad(F.col("image_id").cast("string"), 8, "0"), F.lit(".png")).alias("rel_path"), "content")
    notes = v.table(spark, sf, "documents").select(F.concat(F.lit("txt/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.encode("text", "UTF-8").alias("content"))
    return pngs.unionByName(notes).withColumn("suffix", names.suffix("rel_path")).withColumn("path", F.concat(F.lit("/in/"), F.col("rel_path")))


@check("q2_curated_files")
def _(spark, sf):
    files = image_files(spark, sf)
    sidecars = spark.createDataFrame([], "stem string, sidecar struct<caption:string,category:string,source:string,source_url:string,license:string,author:string,tags:array<string>,provenance:string>, extra map<string,string>")
    rows = cut_lineage(curated_rows(candidates_from_files(files, sidecars, max_size=16), max_size=16))
    return curation_counts(rows)


Q3 = P13.replace(")\nSELECT image_id, string_agg(CASE WHEN 64 * l >= total", "),\nhashed AS (SELECT image_id, string_agg(CASE WHEN 64 * l >= total") + ")"


@check(
    "q3_manifest",
    f"""WITH {Q3}, ok AS (SELECT h.*, s.width, s.height, lpad(CAST(h.image_id AS VARCHAR), 8, '0') AS path FROM hashed h JOIN sprite s USING (image_id) WHERE h.image_id % 11 <> 5),
    color AS (SELECT image_id, count(DISTINCT px) AS n FROM cell GROUP BY image_id),
    same AS (SELECT a.image_id, min(b.path) AS p FROM ok a JOIN ok b ON b.image_id < a.image_id AND a.phash = b.phash GROUP BY a.image_id),
    near AS (SELECT a.image_id, min(struct_pack(d := hamming(a.phash, b.phash), p := b.path)).p AS p FROM ok a JOIN ok b ON b.image_id < a.image_id AND hamming(a.phash, b.phash) <= 4 GROUP BY a.image_id)
    SELECT path AS rel_path, {v.SQL_BUCKET} AS bucket, phash, coalesce(same.p, near.p) AS near_duplicate_of, CAST(n AS BIGINT) AS unique_color_count
    FROM ok JOIN color USING (image_id) LEFT JOIN same USING (image_id) LEFT JOIN near USING (image_id)""",
)
def _(spark, sf):
    rel = F.lpad(F.col("image_id").cast("string"), 8, "0")
    files = v.png_files(spark, sf).select(rel.alias("rel_path"), rel.alias("path"), "content", F.sha2("content", 256).alias("sha256"))
    facts = with_image_features(decode_files(files, max_side=128)).where(F.col("width").isNotNull()).drop("content", "pixels", "png_text")
    return manifest_rows(facts).select("rel_path", "bucket", "phash", "near_duplicate_of", "unique_color_count")


@check(
    "q4_vendor_pack",
    f"""WITH {v.CELL}, img AS (SELECT image_id, any_value(width) AS w, any_value(height) AS h, count(DISTINCT px) AS n, bool_or((px >> 24) < 255) AS t FROM cell GROUP BY image_id),
    kind AS (SELECT *, CASE WHEN w > 16 OR h > 16 THEN 'oversized' WHEN image_id % 11 = 5 THEN 'corrupt' END AS reason FROM img),
    ok AS (SELECT * FROM kind WHERE reason IS NULL), docs AS (SELECT count(*) AS n FROM documents)
    SELECT 'total' AS section, 'total_scanned' AS key, CAST(count(*) + (SELECT n FROM docs) AS BIGINT) AS count FROM img UNION ALL SELECT 'total', 'total_accepted', count(*) FROM ok
    UNION ALL SELECT 'total', 'total_rejected', CAST(count(*) + (SELECT n FROM docs) AS BIGINT) FROM kind WHERE reason IS NOT NULL
    UNION ALL SELECT 'rejection_reasons', reason, count(*) FROM kind WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'rejection_reasons', 'unsupported_format', n FROM docs
    UNION ALL SELECT 'size', w || 'x' || h, count(*) FROM ok GROUP BY ALL UNION ALL SELECT 'palette_size', CAST(n AS VARCHAR), count(*) FROM ok GROUP BY ALL
    UNION ALL SELECT 'transparency', CAST(t AS VARCHAR), count(*) FROM ok GROUP BY ALL""",
)
def _(spark, sf):
    files = image_files(spark, sf).select("rel_path", "content")
    return pack_report(cut_lineage(pack_rows(files, F.col("rel_path"), "Pack", "local", "CC0", max_size=16).drop("pixels", "png_text")))


@check(
    "q5_training_rows",
    f"""WITH {v.ASSET.replace("FROM documents", "FROM documents WHERE 1 + n_chars % 300 <= 64 AND greatest(1 + doc_id * 7 % 140, 1 + n_chars % 140) <= 64")}, {W5}
    SELECT s.rel_path, split, category AS conditioning FROM s JOIN asset USING (rel_path)""",
)
def _(spark, sf):
    rows = with_size_class(v.assets(spark, sf)).withColumn("caption", F.lit(None).cast("string"))
    return training_rows(rows, max_bucket_size=64, validation_fraction=0.1, test_fraction=0.2, seed=3).select("rel_path", "split", "conditioning")


@check(
    "q5_training_batches",
    f"""WITH RECURSIVE {_KEYED}, {_sql_reach('idx <> 0', False, 'keyed')},
    region AS (SELECT image_id, pos, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS region FROM comp),
    asset AS (SELECT image_id AS asset_id, image_id, 's/' || lpad(CAST(image_id AS VARCHAR), 8, '0') AS rel_path, {v.SQL_BUCKET} AS bucket, width, height FROM sprite),
    {W5.replace("'3:'", "'0:'").replace("n * 0.1::DOUBLE", "n * 0.2::DOUBLE")},
    b AS (SELECT asset.* FROM asset JOIN s USING (rel_path) WHERE split = 'train'), {sql_batches(8, False, seed=0).replace("r AS (", "rk AS (", 1).replace("FROM r)", "FROM rk)", 1)},
    frame AS (SELECT batch_id, max(width) AS bw, max(height) AS bh FROM batched GROUP BY batch_id),
    grid AS (SELECT image_id, rel_path, batch_id, slot, bw, bh, o, o % bw AS x, o // bw AS y FROM (SELECT *, unnest(range(bw * bh)) AS o FROM batched JOIN frame USING (batch_id)))
    SELECT g.rel_path, batch_id, slot, CAST(any_value(bw) AS BIGINT) AS batch_width, CAST(any_value(bh) AS BIGINT) AS batch_height, 'sprite ' || any_value(sp.label) AS conditioning,
      string_agg(CAST(CASE WHEN coalesce(region, 0) > 64 THEN 0 ELSE coalesce(region, 0) END AS VARCHAR), ',' ORDER BY o) AS structure
    FROM grid g JOIN sprite sp USING (image_id) LEFT JOIN cell c ON c.image_id = g.image_id AND c.x = g.x AND c.y = g.y LEFT JOIN region n ON n.image_id = c.image_id AND n.pos = c.pos
    GROUP BY g.rel_path, batch_id, slot""",
)
def _(spark, sf):
    s = v.sprites(spark, sf).withColumn("rel_path", F.concat(F.lit("s/"), F.lpad(F.col("image_id").cast("string"), 8, "0")))
    s = with_size_class(s.withColumn("lossy", F.lit(False)).withColumn("caption", F.lit("sprite")).withColumn("category", F.col("label").cast("string")))
    encoded = s.withColumn("palette", px.palette("pixels")).withColumn("indices", px.index_map("pixels", "palette"))
    rows = training_rows(s.drop("indices", "palette", "pixels"))
    train = rows.where(F.col("split") == "train")
    out = training_batches(train, encoded, batch_size=8)
    return out.select("rel_path", "batch_id", "slot", "batch_width", "batch_height", "conditioning", joined("structure").alias("structure"))


@check(
    "q6_evaluation",
    f"WITH RECURSIVE {CORPUS_METRICS} SELECT {CORPUS_AVERAGES}, CAST(1.5 AS DOUBLE) AS inference_latency_ms FROM score JOIN colors USING (pair_id) JOIN iou USING (pair_id) JOIN f1 USING (pair_id) JOIN hard USING (pair_id)",
)
def _(spark, sf):
    pairs = v.sprite_pairs(spark, sf).withColumn("prompt", F.lit("red potion icon"))
    splits = pairs.select(F.lit("test").alias("split"), F.lit(False).alias("lossy"))
    out = evaluation_report(pairs, splits, latency_ms=1.5)[0].drop("text_image_alignment")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_PROMPTS = ("red potion icon", "stone house", "grass tile")
_TEXT = P19.split("texts AS (")[0]


@check(
    "q6_prompt_alignment",
    f"""{_TEXT} {v.CELL}, {sql_projection(3, 64, False).strip().replace("proj", "iproj")},
    prompt AS (SELECT i - 1 AS k, unnest(string_split(p, ' ')) AS w FROM (SELECT unnest([1, 2, 3]) AS i, unnest({list(_PROMPTS)}) AS p)),
    hit AS (SELECT k, r, count(*) AS n FROM prompt JOIN word USING (w) JOIN feature USING (f) GROUP BY ALL),
    tv AS (SELECT k, c, sum(n * w) AS e FROM hit JOIN proj USING (r) GROUP BY ALL), tu AS (SELECT k, c, e / sqrt(sum(e * e) OVER (PARTITION BY k)) AS e FROM tv),
    chan AS (SELECT image_id, unnest([(px >> 16) & 255, (px >> 8) & 255, px & 255]) AS ch FROM cell),
    stat AS (SELECT image_id, 1 AS r, avg(ch) AS s FROM chan GROUP BY 1 UNION ALL SELECT image_id, 2, stddev_pop(ch) FROM chan GROUP BY 1
             UNION ALL SELECT image_id, 3, avg(px >> 24) FROM cell GROUP BY 1),
    iv AS (SELECT image_id, c, sum(s * w) AS e FROM stat JOIN iproj USING (r) GROUP BY ALL), iu AS (SELECT image_id, c, e / sqrt(sum(e * e) OVER (PARTITION BY image_id)) AS e FROM iv)
    SELECT image_id AS pair_id, round(sum(iu.e * tu.e), 6) AS alignment FROM iu JOIN tu ON tu.k = image_id % 3 AND tu.c = iu.c
    WHERE image_id + 1 IN (SELECT image_id FROM sprite) GROUP BY image_id""",
)
def _(spark, sf):
    pairs = v.sprite_pairs(spark, sf).withColumn("prompt", v.pick(_PROMPTS, F.col("pair_id")))
    return evaluate_pairs(pairs).select("pair_id", F.round("text_image_alignment", 6).alias("alignment"))


@check(
    "q7_stage_targets",
    f"""WITH RECURSIVE {_KEYED}, {_sql_reach('idx <> 0', False, 'keyed')},
    num AS (SELECT image_id, pos, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS region FROM comp),
    full_grid AS (SELECT c.image_id, c.x, c.y, coalesce(region, 0) AS region FROM cell c LEFT JOIN num USING (image_id, pos)),
    shape AS (SELECT image_id, width, height, st AS stage, {sql_stage('width', 'st')} AS ow, {sql_stage('height', 'st')} AS oh FROM sprite, (SELECT unnest([8, 16, 64]) AS st)),
    out AS (SELECT *, unnest(range(ow * oh)) AS o FROM shape),
    src AS (SELECT image_id, stage, ow, oh, o, least(width - 1, CAST(floor(CAST(o % ow AS FLOAT) * (CAST(width AS FLOAT) / CAST(ow AS FLOAT))) AS BIGINT)) AS x,
      least(height - 1, CAST(floor(CAST(o // ow AS FLOAT) * (CAST(height AS FLOAT) / CAST(oh AS FLOAT))) AS BIGINT)) AS y FROM out)
    SELECT image_id, CAST(stage AS BIGINT) AS stage, any_value(ow) AS stage_width, any_value(oh) AS stage_height, string_agg(CAST(least(region, 32) AS VARCHAR), ',' ORDER BY o) AS targets
    FROM src JOIN full_grid USING (image_id, x, y) GROUP BY image_id, stage""",
)
def _(spark, sf):
    t = stage_targets(v.sprites(spark, sf), (8, 16, 64), classes=33)
    return t.select("image_id", "stage", "stage_width", "stage_height", joined("stage_structure").alias("targets"))


FLAGSHIP_SQL = f"""WITH {DUP}, e AS (SELECT rel_path, category, {v.SQL_BUCKET} AS bucket, category || '|' || coalesce({v.SQL_BUCKET}, 'None') AS g FROM dup WHERE {SQL_ELIGIBLE}),
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('0:' || rel_path), rel_path) AS n FROM e)
SELECT category, bucket, count(*) AS usable, count(*) FILTER (n <= 5) AS selected FROM s GROUP BY ALL"""


@check("usable_assets_by_group", FLAGSHIP_SQL)
def usable_assets(spark, sf):
    """Usable, permitted, non-duplicate assets per category and bucket, with at most five per group selected."""
    rows = dup_assets(spark, sf).where(curate.is_eligible())
    rows = rows.withColumn("group", curate.group_key(F.col("category"), F.col("bucket"))).select("rel_path", "category", "bucket", "group")
    rows = cut_lineage(rows)
    chosen = curate.balanced_sample(rows, 1_000_000_000, 5).select("category", "bucket")
    usable = rows.groupBy("category", "bucket").agg(F.count(F.lit(1)).alias("usable"))
    selected = chosen.groupBy("category", "bucket").agg(F.count(F.lit(1)).alias("selected"))
    same = usable["category"].eqNullSafe(selected["category"]) & usable["bucket"].eqNullSafe(selected["bucket"])
    return usable.join(selected, same).select(usable["category"], usable["bucket"], "usable", "selected")
