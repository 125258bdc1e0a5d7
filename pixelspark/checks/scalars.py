"""Checks of projections, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import buckets, hashing, licenses, names
from ..functions import pixels as px
from ..operators import curate, embed, targets
from ..plans.features import with_size_class
from ..sources.catalogue import gate_report
from . import views as v
from .registry import check


@check("p1_bucket_size", f"WITH {v.ASSET} SELECT asset_id, CAST({v.SQL_BUCKET_SIZE} AS BIGINT) AS bucket_size FROM asset")
def _(spark, sf):
    return v.assets(spark, sf).select("asset_id", buckets.bucket_size("width", "height").alias("bucket_size"))


@check("p2_aspect_bucket", f"WITH {v.ASSET} SELECT asset_id, {v.SQL_ASPECT} AS aspect_bucket FROM asset")
def _(spark, sf):
    return v.assets(spark, sf).select("asset_id", buckets.aspect_bucket("width", "height").alias("aspect_bucket"))


@check("p3_bucket_id", f"WITH {v.ASSET} SELECT asset_id, {v.SQL_BUCKET} AS bucket FROM asset")
def _(spark, sf):
    return v.assets(spark, sf).select("asset_id", buckets.bucket_id("width", "height").alias("bucket"))


@check("p4_license_normal_form", f"WITH {v.ASSET} SELECT asset_id, {v.sql_license('license')} AS license FROM asset")
def _(spark, sf):
    return v.assets(spark, sf).select("asset_id", licenses.normalize_license("license").alias("license"))


@check("p5_license_allowed", f"WITH {v.ASSET} SELECT asset_id, {v.sql_allowed('license')} AS allowed FROM asset")
def _(spark, sf):
    return v.assets(spark, sf).select("asset_id", licenses.is_allowed_license("license").alias("allowed"))


@check(
    "p6_slug",
    r"""SELECT doc_id, coalesce(nullif(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}]', '_', 'g')), '^_+|_+$', '', 'g'), ''), 'source') AS slug
    FROM documents""",
)
def _(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", names.slug("text").alias("slug"))


def _part_path(p):
    return F.concat(
        F.lit("Pack-A/png/"), F.col("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit("_tile_"), F.col("p_partkey").cast("string"), F.lit(".png")
    )


PART_STEM = "replace(p_name, ' ', '-') || '_tile_' || CAST(p_partkey AS VARCHAR)"


def _sql_words(expr: str, extra: str = "") -> str:
    return f"list_filter(string_split(lower(translate({expr}, '- ', '__')), '_'), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+'){extra})"


@check(
    "p7_source_tags",
    f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(['pixel', p_brand], {_sql_words(PART_STEM)}))), ',') AS tags FROM part""",
)
def _(spark, sf):
    p = v.table(spark, sf, "part")
    tags = names.source_tags(F.array(F.lit("pixel"), F.col("p_brand")), _part_path(p))
    return p.select("p_partkey", F.array_join(tags, ",").alias("tags"))


@check(
    "p8_pack_tags",
    f"""SELECT p_partkey, array_to_string(list_sort(list_distinct({_sql_words("'Pack-A_' || p_type || '_' || " + PART_STEM, " AND w NOT IN ('tile', 'kenney')")})), ',') AS tags
    FROM part""",
)
def _(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(names.pack_tags(_part_path(p)), ",").alias("tags"))


@check(
    "p9_provenance",
    f"""WITH {v.ASSET} SELECT asset_id, source, CASE WHEN asset_id % 3 = 0 THEN 'https://example.org/' || source ELSE '/data/' || source END AS source_url,
      license, category, rel_path AS provenance, source || '/' || rel_path AS corpus_rel_path FROM asset""",
)
def _(spark, sf):
    a = v.assets(spark, sf)
    null = F.lit(None).cast("string")
    source = F.struct(
        F.col("source").alias("name"),
        F.when(F.col("asset_id") % 3 == 0, F.concat(F.lit("https://example.org/"), F.col("source"))).alias("source_url"),
        null.alias("url"),
        F.concat(F.lit("/data/"), F.col("source")).alias("path"),
        F.col("license"),
        null.alias("author"),
        F.col("category"),
        F.array().cast("array<string>").alias("tags"),
    )
    p = a.select("asset_id", names.provenance(source, "rel_path").alias("p"))
    return p.select("asset_id", "p.source", "p.source_url", "p.license", "p.category", "p.provenance", "p.corpus_rel_path")


@check(
    "p10_safe_output_path",
    r"""WITH t AS (SELECT doc_id, source || '/' || repeat('Ab-9', CAST(n_chars % 60 AS INTEGER)) || '/' || CAST(doc_id AS VARCHAR) || '.PNG' AS rel FROM documents)
    SELECT doc_id, CASE WHEN length(rel) > 180 OR len(list_filter(string_split(rel, '/'), lambda p: length(p) > 80)) > 0
      THEN '_long_paths/' || CAST(doc_id AS VARCHAR) || '_' || substr(sha256(rel), 1, 24) || '.png' ELSE rel END AS path FROM t""",
)
def _(spark, sf):
    rel = F.expr("concat(source, '/', repeat('Ab-9', cast(n_chars % 60 as int)), '/', cast(doc_id as string), '.PNG')")
    return v.table(spark, sf, "documents").select("doc_id", names.safe_output_path(rel).alias("path"))


@check(
    "p11_curation_stamp",
    f"""WITH {v.ASSET} SELECT asset_id, CASE WHEN lossy THEN 'lossy_gt_64_colors' ELSE 'accepted' END AS curation_status,
      CASE WHEN asset_id % 2 = 0 THEN rel_path ELSE 'old' END AS source_path, CAST(unique_color_count AS VARCHAR) AS colors,
      CAST(palette_size AS VARCHAR) AS used, license FROM asset""",
)
def _(spark, sf):
    a = v.assets(spark, sf)
    meta = F.create_map(F.lit("license"), F.col("license"), F.lit("source_path"), F.lit("old"), F.lit("curation_status"), F.lit("stale"))
    status = F.when(F.col("lossy"), "lossy_gt_64_colors").otherwise("accepted")
    path = F.when(F.col("asset_id") % 2 == 0, F.col("rel_path"))
    m = a.select("asset_id", names.curation_stamp(meta, status, path, F.col("unique_color_count"), F.col("palette_size")).alias("m"))
    pairs = {"curation_status": "curation_status", "source_path": "source_path", "unique_color_count": "colors", "palette_size_used": "used", "license": "license"}
    return m.select("asset_id", *[F.col("m")[k].alias(n) for k, n in pairs.items()])


@check("p12_content_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", hashing.content_digest(F.encode("text", "UTF-8")).alias("sha256"))


P13 = v.CELL + """,
gray AS (SELECT image_id, width, height, x, y, (((px >> 16) & 255) * 19595 + ((px >> 8) & 255) * 38470 + (px & 255) * 7471 + 32768) >> 16 AS l FROM cell),
side AS (SELECT DISTINCT unnest([width, height]) AS n FROM sprite),
axis AS (SELECT n, o, greatest(1.0, n / 8.0) AS reach, (o + 0.5) * (n / 8.0) AS center FROM side, (SELECT unnest(range(8)) AS o)),
span AS (SELECT *, greatest(0, trunc(center - reach + 0.5))::BIGINT AS lo, least(n, trunc(center + reach + 0.5))::BIGINT AS hi FROM axis),
raw AS (SELECT n, o, s, greatest(0.0, 1.0 - abs((s - center + 0.5) / reach)) AS w FROM (SELECT *, unnest(range(lo, hi)) AS s FROM span)),
tap AS (SELECT n, o, s, trunc(0.5 + w / sum(w) OVER (PARTITION BY n, o) * 4194304)::BIGINT AS k FROM raw),
horizontal AS (SELECT image_id, height, y, o AS x, ((2097152 + sum(l * k)) // 4194304)::BIGINT AS l FROM gray JOIN tap ON n = width AND s = x GROUP BY ALL),
small AS (SELECT image_id, o * 8 + x AS i, ((2097152 + sum(l * k)) // 4194304)::BIGINT AS l FROM horizontal JOIN tap ON n = height AND s = y GROUP BY ALL)
SELECT image_id, string_agg(CASE WHEN 64 * l >= total THEN '1' ELSE '0' END, '' ORDER BY i) AS phash
FROM (SELECT *, sum(l) OVER (PARTITION BY image_id) AS total FROM small) GROUP BY image_id"""


@check("p13_perceptual_hash", "WITH " + P13)
def _(spark, sf):
    hashed = hashing.with_perceptual_hash(v.sprites(spark, sf))
    return hashed.select("image_id", hashing.hash_to_bits("phash").alias("phash"))


@check(
    "p14_hash_codec",
    f"""WITH {v.SPRITE_HASH} SELECT a.image_id, a.phash AS hash, CAST(bit_count(xor(a.phash, b.phash)) AS BIGINT) AS distance
    FROM sprite_hash a JOIN sprite_hash b ON b.image_id = a.image_id + 1""",
)
def _(spark, sf):
    h = v.sprite_hashes(spark, sf).withColumn("phash", hashing.bits_to_hash(hashing.hash_to_bits("phash")))
    nxt = h.select((F.col("image_id") - 1).alias("image_id"), F.col("phash").alias("other"))
    return h.join(nxt, "image_id").select("image_id", F.col("phash").alias("hash"), hashing.hamming("phash", "other").alias("distance"))


@check("p15_has_transparency", f"WITH {v.CELL} SELECT image_id, bool_or((px >> 24) < 255) AS transparent FROM cell GROUP BY image_id")
def _(spark, sf):
    return v.sprites(spark, sf).select("image_id", px.has_transparency("pixels").alias("transparent"))


_CAPTION = "CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN NULL ELSE p_name END"
_CATEGORY = "CASE WHEN p_partkey % 6 = 1 THEN NULL WHEN p_partkey % 6 = 2 THEN 'ring' ELSE lower(p_type) END"


def _sql_caption(fallback: str) -> str:
    base = f"coalesce(nullif({_CAPTION}, ''), nullif({_CATEGORY}, ''), {fallback})"
    return f"CASE WHEN {_CATEGORY} <> '' AND NOT contains({base}, {_CATEGORY}) THEN trim({base} || ' ' || {_CATEGORY}) ELSE {base} END"


@check("p16_caption", f"SELECT p_partkey, {_sql_caption(chr(39) + 'pixel art' + chr(39))} AS caption FROM part")
def _(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select("p_partkey", names.asset_caption(F.expr(_CAPTION), F.expr(_CATEGORY)).alias("caption"))


@check("p17_caption_from_path", f"SELECT p_partkey, {_sql_caption(PART_STEM)} AS caption FROM part")
def _(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select("p_partkey", names.asset_caption(F.expr(_CAPTION), F.expr(_CATEGORY), names.stem(_part_path(p))).alias("caption"))


def sql_stage(side: str, stage: int | str) -> str:
    scaled = f"greatest(1, round_even({side} * least(1.0, CAST({stage} AS DOUBLE) / greatest(width, height)), 0))"
    return f"CAST(least({stage}, greatest(1, ceil({scaled} / 4)) * 4) AS BIGINT)"


@check(
    "p18_stage_shape",
    f"WITH {v.ASSET} SELECT asset_id, {', '.join(f'{sql_stage(s, n)} AS {s[0]}{n}' for n in (32, 64, 128) for s in ('width', 'height'))} FROM asset",
)
def _(spark, sf):
    a = v.assets(spark, sf)
    out = [buckets.stage_shape("width", "height", n)[s[0]].alias(f"{s[0]}{n}") for n in (32, 64, 128) for s in ("width", "height")]
    return a.select("asset_id", *out)


def sql_projection(rows: int, dim: int, unit_rows: bool) -> str:
    return f"""
proj0 AS (SELECT r, c, sin(r * c * 0.37::DOUBLE) + cos(r * c * 0.11::DOUBLE) AS w FROM (SELECT unnest(range(1, {rows + 1})) AS r), (SELECT unnest(range(1, {dim + 1})) AS c)),
proj1 AS (SELECT r, c, w / sqrt(sum(w * w) OVER (PARTITION BY c)) AS w FROM proj0),
proj AS (SELECT r, c, {'w / sqrt(sum(w * w) OVER (PARTITION BY r))' if unit_rows else 'w'} AS w FROM proj1)"""


_WORDS_SQL = ", ".join(
    f"('{w}', '{f}')" for w, fs in {**{f: (f,) for f in embed.FEATURES}, **embed.WORD_FEATURES}.items() for f in fs
)
_FEATURES_SQL = ", ".join(f"({i + 1}, '{f}')" for i, f in enumerate(embed.FEATURES))
P19 = f"""WITH word(w, f) AS (VALUES {_WORDS_SQL}), feature(r, f) AS (VALUES {_FEATURES_SQL}),
{sql_projection(len(embed.FEATURES), 64, True)},
texts AS (SELECT p_partkey AS k, p_name || '_' || p_type || ' Stone' || (CASE WHEN p_partkey % 3 = 0 THEN ' sword' ELSE '' END) AS t FROM part
          UNION ALL SELECT -1 - doc_id, text FROM documents),
hit AS (SELECT k, r, count(*) AS n FROM (SELECT k, unnest(regexp_split_to_array(replace(lower(t), '_', ' '), '\\s+')) AS w FROM texts) JOIN word USING (w) JOIN feature USING (f) GROUP BY ALL),
counted AS (SELECT * FROM hit UNION ALL SELECT k, r, 1 FROM texts, feature WHERE f = 'object' AND k NOT IN (SELECT k FROM hit)),
vec AS (SELECT k, c, sum(n * w) AS e FROM counted JOIN proj USING (r) GROUP BY ALL),
unit AS (SELECT k, c, e / sqrt(sum(e * e) OVER (PARTITION BY k)) AS e FROM vec)
SELECT k, round(sum(e * c), 6) AS ramp, round(max(CASE WHEN c = 1 THEN e END), 6) AS first FROM unit GROUP BY k"""


def _ramp(vector: str):
    weighted = F.transform(vector, lambda x, i: x * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 6).alias("ramp"), F.round(F.get(F.col(vector), F.lit(0)), 6).alias("first")


@check("p19_text_embedding", P19)
def _(spark, sf):
    part = v.table(spark, sf, "part").selectExpr(
        "p_partkey AS k", "concat(p_name, '_', p_type, ' Stone', CASE WHEN p_partkey % 3 = 0 THEN ' sword' ELSE '' END) AS t"
    )
    docs = v.table(spark, sf, "documents").selectExpr("-1 - doc_id AS k", "text AS t")
    encoded = part.unionByName(docs).select("k", embed.text_embedding("t").alias("e"))
    return encoded.select("k", *_ramp("e"))


@check(
    "p20_image_embedding",
    f"""WITH {v.CELL}, {sql_projection(3, 64, False).strip()},
chan AS (SELECT image_id, unnest([(px >> 16) & 255, (px >> 8) & 255, px & 255]) AS c FROM cell),
stat AS (SELECT image_id, 1 AS r, avg(c) AS s FROM chan GROUP BY 1 UNION ALL SELECT image_id, 2, stddev_pop(c) FROM chan GROUP BY 1
         UNION ALL SELECT image_id, 3, avg(px >> 24) FROM cell GROUP BY 1),
vec AS (SELECT image_id, c, sum(s * w) AS e FROM stat JOIN proj USING (r) GROUP BY ALL),
unit AS (SELECT image_id, c, e / sqrt(sum(e * e) OVER (PARTITION BY image_id)) AS e FROM vec)
SELECT image_id, round(sum(e * c), 6) AS ramp, round(max(CASE WHEN c = 1 THEN e END), 6) AS first FROM unit GROUP BY image_id""",
)
def _(spark, sf):
    return v.sprites(spark, sf).select("image_id", embed.image_embedding("pixels").alias("e")).select("image_id", *_ramp("e"))


@check(
    "p21_palette_from_logits",
    f"""WITH {v.SPRITE}, entry AS (SELECT vec_id AS image_id, i, i < 1 + vec_id % 16 AS ok,
      [CAST(round_even(255 / (1 + exp(-20 * CAST(embedding[4 * i + k] AS DOUBLE))), 0) AS BIGINT) FOR k IN [1, 2, 3, 4]] AS c
      FROM (SELECT *, unnest(range(16)) AS i FROM embeddings))
    SELECT image_id, string_agg(CAST(CASE WHEN ok AND c[4] >= 128 THEN c[4] * 16777216 + c[1] * 65536 + c[2] * 256 + c[3] ELSE 0 END AS VARCHAR), ',' ORDER BY i) AS palette
    FROM entry GROUP BY image_id""",
)
def _(spark, sf):
    e = v.table(spark, sf, "embeddings")

    def entry(i):
        c = [F.get(F.col("embedding"), i * 4 + k).cast("double") * 20 for k in range(4)]
        return px.logits_to_color(*c, i < 1 + F.col("vec_id") % 16)

    colors = F.transform(F.sequence(F.lit(0), F.lit(15)), entry)
    return e.select(F.col("vec_id").alias("image_id"), F.array_join(F.transform(colors, lambda c: c.cast("string")), ",").alias("palette"))


@check(
    "p22_padded_palette",
    f"""WITH {v.CELL}, used AS (SELECT image_id, px, row_number() OVER (PARTITION BY image_id ORDER BY px) - 1 AS i FROM (SELECT DISTINCT image_id, px FROM cell)),
    slot AS (SELECT image_id, i FROM sprite, (SELECT unnest(range(6)) AS i))
    SELECT image_id, string_agg(CAST(coalesce(px, 0) AS VARCHAR), ',' ORDER BY i) AS palette, CAST(count(px) AS BIGINT) AS used
    FROM slot LEFT JOIN used USING (image_id, i) GROUP BY image_id""",
)
def _(spark, sf):
    p = v.sprites(spark, sf).select("image_id", px.pad_palette(px.palette("pixels"), 6).alias("p"))
    used = F.size(F.filter("p.mask", lambda m: m))
    return p.select("image_id", F.array_join(F.transform("p.palette", lambda c: c.cast("string")), ",").alias("palette"), used.alias("used"))


P23 = v.CELL + """,
edge AS (SELECT image_id, count(*) FILTER (idx <> r) + count(*) FILTER (idx <> d) AS changes, count(r) + count(d) AS pairs FROM (
  SELECT *, lead(idx) OVER (PARTITION BY image_id, y ORDER BY x) AS r, lead(idx) OVER (PARTITION BY image_id, x ORDER BY y) AS d FROM cell) GROUP BY image_id),
color AS (SELECT image_id, any_value(width) AS width, any_value(height) AS height, count(DISTINCT px) AS n, image_id % 4 = 0 AS lossy FROM cell GROUP BY image_id),
scored AS (SELECT image_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE * least(1.0::DOUBLE, n / 8) + 0.35::DOUBLE * (changes / greatest(1, pairs))
  + 0.30::DOUBLE * least(1.0::DOUBLE, greatest(width, height) / 128) - CASE WHEN lossy THEN 0.25::DOUBLE ELSE 0 END)) AS quality FROM edge JOIN color USING (image_id))"""


def scored_sprites(spark, sf):
    s = v.sprites(spark, sf).withColumn("colors", px.color_count("pixels"))
    score = px.quality_score(F.col("indices"), F.col("width"), F.col("height"), F.col("colors"), F.lit(8), F.col("image_id") % 4 == 0)
    return s.select("image_id", score.alias("quality"))


@check("p23_quality_score", f"WITH {P23} SELECT image_id, round(quality, 6) AS quality FROM scored")
def _(spark, sf):
    return scored_sprites(spark, sf).select("image_id", F.round("quality", 6).alias("quality"))


@check(
    "p24_one_hot",
    f"""WITH {v.CELL} SELECT image_id, pos, array_to_string([CASE WHEN c = least(4, greatest(0, idx - 1)) AND x > 0 THEN 1 ELSE 0 END FOR c IN range(5)], '') AS hot FROM cell""",
)
def _(spark, sf):
    cells = v.sprites(spark, sf).select("image_id", "width", F.posexplode("indices").alias("pos", "idx"))
    hot = targets.one_hot(F.col("idx") - 1, F.col("pos") % F.col("width") > 0, 5)
    return cells.select("image_id", "pos", F.array_join(F.transform(hot, lambda x: x.cast("string")), "").alias("hot"))


@check("p25_clamp", f"WITH {v.CELL} SELECT image_id, pos, CAST(greatest(0, least(4, idx - 2)) AS BIGINT) AS class FROM cell")
def _(spark, sf):
    cells = v.sprites(spark, sf).select("image_id", F.posexplode("indices").alias("pos", "idx"))
    return cells.select("image_id", "pos", targets.clamp(F.col("idx") - 2, 0, 4).alias("class"))


_GATE = f"""sources AS (SELECT DISTINCT source AS name, CAST(substr(source, 4) AS BIGINT) AS n FROM documents),
gated AS (SELECT name, n, CASE WHEN n % 5 = 3 THEN 'disabled' WHEN NOT {v.sql_allowed(v.sql_pick(v.LICENSES, "n"))} THEN 'license_not_allowed' END AS gate FROM sources)"""


def source_rows(spark, sf):
    """The sources of the documents as a catalogue."""
    s = v.table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    n = F.substring("name", 4, 10).cast("bigint")
    return s.select(
        "name", v.pick(v.LICENSES, n).alias("license"), (n % 5 != 3).alias("enabled"), F.concat(F.lit("blocked "), F.col("name")).alias("blocked_reason"), n.alias("position")
    )


@check(
    "f1_license_gate",
    f"""WITH {_GATE} SELECT name AS source, CAST(0 AS BIGINT) AS scanned, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS rejected, gate AS reason,
    CAST(1 AS BIGINT) AS count, CASE WHEN gate = 'disabled' THEN 'blocked ' || name END AS blocked_reason FROM gated WHERE gate IS NOT NULL""",
)
def _(spark, sf):
    from ..sources.catalogue import gate_sources

    return gate_report(gate_sources(source_rows(spark, sf)))


@check(
    "f2_raw_rejection",
    f"""WITH {v.ASSET} SELECT asset_id, CASE WHEN asset_id % 13 = 0 THEN 'corrupt' WHEN width > 128 OR height > 128 THEN 'oversized'
    WHEN unique_color_count > 256 THEN 'non_pixel_art' END AS reason FROM asset""",
)
def _(spark, sf):
    a = v.assets(spark, sf)
    width = F.when(F.col("asset_id") % 13 != 0, F.col("width"))
    return a.select("asset_id", buckets.image_rejection_raw(width, "height", "unique_color_count", 128, 256).alias("reason"))


@check(
    "f3_candidate_rejection",
    f"""WITH {v.ASSET} SELECT asset_id, CASE WHEN width > 128 OR height > 128 THEN 'oversized_high_res' WHEN unique_color_count > 256 THEN 'non_pixel_art_smooth'
    WHEN unique_color_count > 64 THEN 'lossy_gt_64_colors' END AS reason FROM asset""",
)
def _(spark, sf):
    a = v.assets(spark, sf)
    return a.select("asset_id", buckets.candidate_rejection("width", "height", "unique_color_count", 128, 64, 256).alias("reason"))


DUP = f"""{v.ASSET},
dup AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sha256 ORDER BY string_split(rel_path, '/')) > 1
        THEN first_value(rel_path) OVER (PARTITION BY sha256 ORDER BY string_split(rel_path, '/')) END AS duplicate_of,
        CASE WHEN asset_id % 9 = 4 THEN 'x' END AS near_duplicate_of FROM asset)"""
SQL_ELIGIBLE = f"(NOT lossy AND duplicate_of IS NULL AND near_duplicate_of IS NULL AND {v.sql_allowed('license')})"


def dup_assets(spark, sf):
    from ..operators.dedup import with_duplicate_of

    a = with_size_class(v.assets(spark, sf)).drop("content").withColumn("_order", names.path_order("rel_path"))
    marked = with_duplicate_of(a, "sha256", "_order", "rel_path").drop("_order")
    return marked.withColumn("near_duplicate_of", F.when(F.col("asset_id") % 9 == 4, "x"))


@check("f4_curation_eligible", f"WITH {DUP} SELECT asset_id FROM dup WHERE {SQL_ELIGIBLE}")
def _(spark, sf):
    return dup_assets(spark, sf).where(curate.is_eligible()).select("asset_id")


@check(
    "f5_training_filter",
    f"WITH {v.ASSET} SELECT asset_id FROM asset WHERE {v.SQL_BUCKET_SIZE} <= 64 AND NOT lossy",
)
def _(spark, sf):
    return curate.training_filter(with_size_class(v.assets(spark, sf)), 64).select("asset_id")


@check(
    "f6_size_filters",
    f"""WITH {v.ASSET} SELECT 'exact' AS kind, asset_id FROM asset WHERE {v.SQL_BUCKET_SIZE} = 32
    UNION ALL SELECT 'most', asset_id FROM asset WHERE {v.SQL_BUCKET_SIZE} <= 64""",
)
def _(spark, sf):
    rows = with_size_class(v.assets(spark, sf))
    exact = curate.exact_size_filter(rows, 32).select(F.lit("exact").alias("kind"), "asset_id")
    return exact.unionByName(curate.max_size_filter(rows, 64).select(F.lit("most").alias("kind"), "asset_id"))


@check(
    "f7_decode_in_range",
    f"WITH {v.CELL} SELECT image_id, CAST(sum(px * (pos + 1) % 1000003) AS BIGINT) AS checksum FROM cell GROUP BY image_id",
)
def _(spark, sf):
    s = v.sprites(spark, sf).select("image_id", px.decode_indices("indices", "palette").alias("p"))
    return s.select("image_id", F.aggregate(F.transform("p", lambda c, i: c * (i + 1) % 1000003), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("checksum"))
