"""Checks of sources, sinks, incremental ingestion and plug-in encoders.

Inputs are files and tables that Spark first writes from the given tables, below the shared scratch folder.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions import pixels as px
from ..functions.buckets import candidate_rejection
from ..operators import compose, embed, reports
from ..plans.features import with_size_class
from ..plans.manifest import open_dataset
from ..sources import catalogue, embedded, files, manifest
from ..sources.png import decode_png, png_header
from ..session import cut_lineage, scratch_path
from ..streaming import ingest
from . import views as v
from .aggregates import A5, tagged
from .joins import joined
from .registry import check
from .scalars import _GATE, source_rows


@check(
    "s1_source_catalogue",
    f"WITH {_GATE} SELECT name, gate, CASE WHEN gate = 'disabled' THEN 'blocked ' || name END AS blocked_reason, {v.sql_pick(v.LICENSES, 'n')} AS license FROM gated",
)
def _(spark, sf):
    rows = source_rows(spark, sf)
    folded = rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("position", "name", "license", "enabled", "blocked_reason"))).alias("sources"))).alias("value"))
    path = scratch_path(spark, "catalogue")
    folded.write.text(path)
    gated = catalogue.gate_sources(catalogue.read_catalogue(spark, path))
    return gated.select("name", "gate", F.when(F.col("gate") == "disabled", F.col("blocked_reason")).alias("blocked_reason"), "license")


# folder, name and ending of the files that the texts of a table are dealt to, by doc_id modulo their number
PLACES = [
    ("plain", "a", ".png"),
    ("plain/_deep", "b", ".txt"),
    ("_splits", "c", ".png"),
    ("_splits/_again", "d", ".json"),
    (".cache", "e", ".png"),
    ("_splits/.cache", "f", ".txt"),
    ("plain", "_g", ".png"),
    ("_splits", "_h", ".txt"),
    ("plain/x[1]/_y{2}", "i", ".png"),
    ("plain", ".j", ".png"),
]
HIDDEN = (4, 5, 9)


def file_tree(spark, sf) -> str:
    """documents as real files, one line a doc_id, in visible, hidden and underscored folders."""
    root = scratch_path(spark, "tree")
    d = v.table(spark, sf, "documents").select("doc_id")
    d.select(F.col("doc_id").cast("string").alias("value"), (F.col("doc_id") % len(PLACES)).alias("place")).repartition("place").write.partitionBy("place").text(f"{root}-parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (folder, name, ending) in enumerate(PLACES):
        fs.mkdirs(path(f"{root}/{folder}"))
        for part in fs.globStatus(path(f"{root}-parts/place={i}/part-*")):  # Spark cannot name the files it writes
            fs.rename(part.getPath(), path(f"{root}/{folder}/{name}{ending}"))
    return root


def _lines(found):
    lines = found.select("suffix", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    return lines.where("line <> ''").select("suffix", F.col("line").cast("bigint").alias("doc_id"))


def _places(condition: str) -> str:
    return f"SELECT doc_id FROM documents WHERE doc_id % {len(PLACES)} IN ({condition})"


@check("s2_visible_png", _places(", ".join(str(i) for i, p in enumerate(PLACES) if p[2] == ".png" and i not in HIDDEN)))
def _(spark, sf):
    return _lines(files.scan_png(spark, file_tree(spark, sf))).select("doc_id")


@check(
    "s3_all_files",
    "SELECT doc_id, CASE WHEN doc_id % {n} IN ({odd}) THEN 'unsupported_format' END AS reason FROM documents WHERE doc_id % {n} IN ({shown})".format(
        n=len(PLACES),
        odd=", ".join(str(i) for i, p in enumerate(PLACES) if p[2] != ".png"),
        shown=", ".join(str(i) for i, p in enumerate(PLACES) if p[2] != ".json" and i not in HIDDEN),
    ),
)
def _(spark, sf):
    rows = _lines(files.scan_files(spark, file_tree(spark, sf))).where(F.col("suffix") != ".json")
    return rows.select("doc_id", F.when(F.col("suffix") != ".png", "unsupported_format").alias("reason"))


@check(
    "s4_decode_png",
    f"""WITH {v.CELL} SELECT image_id, CASE WHEN image_id % 11 <> 5 THEN CAST(any_value(width) AS BIGINT) END AS width, CASE WHEN image_id % 11 <> 5 THEN CAST(any_value(height) AS BIGINT) END AS height,
    CASE WHEN image_id % 11 <> 5 THEN string_agg(CAST(px AS VARCHAR), ',' ORDER BY pos) END AS pixels FROM cell GROUP BY image_id""",
)
def _(spark, sf):
    d = v.png_files(spark, sf).withColumn("d", decode_png("content"))
    return d.select("image_id", "d.width", "d.height", joined("d.pixels").alias("pixels"))


@check("s5_image_struct_pixels", f"WITH {v.CELL} SELECT image_id, string_agg(CAST(px AS VARCHAR), ',' ORDER BY pos) AS pixels FROM cell GROUP BY image_id")
def _(spark, sf):
    s = v.sprites(spark, sf)
    data = F.unhex(F.array_join(F.transform("pixels", lambda p: F.concat(*[F.lpad(F.hex(F.shiftright(p, n).bitwiseAND(255)), 2, "0") for n in (0, 8, 16, 24)])), ""))
    image = F.struct("width", "height", F.lit(4).alias("nChannels"), data.alias("data"))
    return s.select("image_id", image.alias("image")).select("image_id", joined(px.pixels_from_image_struct(F.col("image"))).alias("pixels"))


@check("s6_sidecars", f"WITH {v.ASSET} SELECT asset_id, CASE WHEN asset_id % 7 <> 0 THEN license END AS license, CASE WHEN asset_id % 7 <> 0 THEN content END AS caption FROM asset")
def _(spark, sf):
    a = v.assets(spark, sf)
    text = F.when(F.col("asset_id") % 7 == 0, F.lit('{"caption": ')).otherwise(F.to_json(F.struct("license", F.col("content").alias("caption"))))
    s = a.select("asset_id", files.parse_sidecar(F.encode(text, "UTF-8")).alias("s"))
    return s.select("asset_id", "s.license", "s.caption")


@check(
    "s7_parquet_images",
    f"""WITH {v.CELL} SELECT image_id, coalesce(nullif(CASE WHEN image_id % 4 = 1 THEN '' ELSE 'text ' || image_id END, ''), CASE WHEN image_id % 8 = 1 THEN 'prompt' END, 'caption') AS caption,
    string_agg(CAST(px AS VARCHAR), ',' ORDER BY pos) AS pixels FROM cell WHERE image_id % 5 <> 0 AND image_id % 11 <> 5 GROUP BY image_id""",
)
def _(spark, sf):
    f = v.png_files(spark, sf).where(F.col("image_id") % 11 != 5)
    i = F.col("image_id")
    stored = f.select(
        i,
        F.when(i % 2 == 0, F.lit("no image").cast("binary")).alias("preview"),
        F.struct(F.when(i % 5 != 0, F.col("content")).alias("bytes"), F.lit("x.png").alias("path")).alias("image"),
        F.when(i % 8 == 1, "prompt").alias("prompt"),
        F.when(i % 4 == 1, "").otherwise(F.concat(F.lit("text "), i.cast("string"))).alias("text"),
        F.lit("caption").alias("caption"),
    )
    path = scratch_path(spark, "parquet-images")
    stored.write.parquet(path)
    tree = spark.read.parquet(path)
    images = embedded.extract_images(tree)
    return images.select("image_id", "caption", joined("pixels").alias("pixels"))


@check(
    "s8_grid_images",
    f"WITH {v.CELL} SELECT image_id, CAST(8 AS BIGINT) AS side, string_agg(CAST(px AS VARCHAR), ',' ORDER BY pos) AS pixels FROM cell WHERE image_id % 3 <> 0 GROUP BY image_id",
)
def _(spark, sf):
    s = v.sprites(spark, sf)
    rows = s.select("image_id", F.when(F.col("image_id") % 3 == 0, F.slice("indices", 1, 63)).otherwise(F.col("indices")).alias("grid"))
    colors = s.select(F.posexplode("palette").alias("idx", "c")).distinct()
    colors = colors.select("idx", px.red(F.col("c")).alias("r"), px.green(F.col("c")).alias("g"), px.blue(F.col("c")).alias("b"), px.alpha(F.col("c")).alias("a"))
    images = embedded.extract_images(rows, colors)
    return images.select("image_id", F.col("width").alias("side"), joined("pixels").alias("pixels"))


@check(
    "s9_row_caption",
    "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END, ''), CASE WHEN doc_id % 2 = 0 THEN source END, lang) AS caption FROM documents",
)
def _(spark, sf):
    d = v.table(spark, sf, "documents")
    i = F.col("doc_id")
    text, prompt = F.when(i % 3 == 0, "").otherwise(F.col("text")), F.when(i % 2 == 0, F.col("source"))
    return d.select("doc_id", names.row_caption(text, prompt, F.col("lang")).alias("caption"))


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for i, text in zip(rows["doc_id"], rows["text"]):
            archive.writestr(f"pack/{i}.txt", text)
    return pd.DataFrame({"archive": [f"{key[0]}.zip"], "content": [buffer.getvalue()]})


@check("s10_archive_members", "SELECT CAST(doc_id // 40 AS VARCHAR) || '.zip' AS archive, 'pack/' || doc_id || '.txt' AS member, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    blocks = v.table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 40).alias("block"))
    archives = blocks.groupBy("block").applyInPandas(_pack, "archive string, content binary")
    return files.expand_archives(archives, "archive").select("archive", "member", F.sha2("content", 256).alias("sha256"))


def manifest_source(spark, sf):
    a = with_size_class(v.assets(spark, sf)).drop("content")
    meta = F.map_from_arrays(F.array(F.lit("category"), F.lit("license")), F.array("category", "license"))
    return manifest.conform(a.withColumn("path", F.concat(F.lit("/old/"), F.col("rel_path"))).withColumn("metadata", meta))


_MANIFEST = f"SELECT rel_path, CAST(width AS BIGINT) AS width, {v.SQL_BUCKET} AS bucket, license, lossy, category FROM asset"


@check("s11_manifest_write", f"WITH {v.ASSET} {_MANIFEST}")
def _(spark, sf):
    path = scratch_path(spark, "manifest") + "/manifest.jsonl"
    manifest.write_manifest(manifest_source(spark, sf), path)
    return manifest.read_manifest(spark, path, "/new").select("rel_path", "width", "bucket", "license", "lossy", F.col("metadata")["category"].alias("category"))


@check("s12_manifest_rebase", f"WITH {v.ASSET} SELECT CASE WHEN asset_id % 6 = 0 THEN '/old/' || rel_path ELSE '/new/' || rel_path END AS path, sha256 FROM asset")
def _(spark, sf):
    rows = manifest_source(spark, sf)
    rows = rows.withColumn("rel_path", F.when(F.substring("rel_path", -12, 8).cast("int") % 6 != 0, F.col("rel_path")))
    path = scratch_path(spark, "manifest") + "/manifest.parquet"
    manifest.write_manifest(rows, path, by_bucket=True)
    return manifest.read_manifest(spark, path, "/new").select("path", "sha256")


@check("s13_manifest_preferred", f"WITH {v.ASSET} SELECT rel_path, category AS category FROM asset WHERE NOT lossy")
def _(spark, sf):
    root = scratch_path(spark, "dataset")
    rows = manifest_source(spark, sf)
    manifest.write_manifest(rows, f"{root}/manifest.jsonl")
    manifest.write_manifest(rows.where(~F.col("lossy")), f"{root}/manifest.parquet")
    return open_dataset(spark, root).select("rel_path", F.col("metadata")["category"].alias("category"))


@check(
    "s14_accepted_and_held",
    f"""WITH {v.ASSET}, r AS (SELECT asset_id, CASE WHEN width > 128 OR height > 128 THEN 'oversized_high_res' WHEN unique_color_count > 256 THEN 'non_pixel_art_smooth'
    WHEN unique_color_count > 64 THEN 'lossy_gt_64_colors' END AS reason FROM asset) SELECT asset_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM r""",
)
def _(spark, sf):
    reason = candidate_rejection("width", "height", "unique_color_count", 128, 64, 256)
    rows = v.assets(spark, sf).select("asset_id", reason.alias("reason"))
    rows = rows.withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
    root = scratch_path(spark, "sinks")
    manifest.write_accepted_and_held(rows, f"{root}/pool", f"{root}/holdout")
    held = spark.read.schema("asset_id bigint, status string, reason string").parquet(f"{root}/holdout")
    return spark.read.parquet(f"{root}/pool").select("asset_id", "status", "reason").unionByName(held.select("asset_id", "status", "reason"))


@check("s15_report_sink", f"WITH {A5} SELECT * FROM report")
def _(spark, sf):
    path = scratch_path(spark, "report")
    manifest.write_report(reports.manifest_report(tagged(spark, sf)), path)
    return spark.read.schema("section string, key string, count bigint").json(path)


@check("s15_report_document", f"WITH {A5} SELECT * FROM report")
def _(spark, sf):
    path = scratch_path(spark, "document")
    manifest.write_report_document(reports.report_json(cut_lineage(reports.manifest_report(tagged(spark, sf)))), path)
    parsed = spark.read.text(path).select(F.from_json("value", "map<string,map<string,bigint>>").alias("m"))
    sections = parsed.select(F.explode("m").alias("section", "counts"))
    return sections.select("section", F.explode("counts").alias("key", "count"))


@check("s16_metric_log", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(spark, sf):
    path = scratch_path(spark, "log")
    e = v.table(spark, sf, "events").select("event_type", "value", "event_id")
    for part in range(2):
        manifest.append_log(e.where(F.col("event_id") % 2 == part), path)
    log = spark.read.schema("event_id bigint, event_type string, value double").json(path)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@check("s17_encoding_cache", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR n_chars % 2 = 0")
def _(spark, sf):
    d = v.table(spark, sf, "documents")
    modified = F.lit("2024-01-01").cast("timestamp")
    now = d.select("doc_id", manifest.fingerprint(F.col("doc_id").cast("string"), modified, F.col("n_chars"), 64).alias("fingerprint"))
    before = F.col("n_chars") + F.when(F.col("n_chars") % 2 == 0, 1).otherwise(0)
    old = d.where(F.col("doc_id") % 3 == 0).select(manifest.fingerprint(F.col("doc_id").cast("string"), modified, before, 64).alias("fingerprint"))
    path = scratch_path(spark, "encodings")
    old.write.parquet(path)
    return manifest.unencoded(now, spark.read.parquet(path)).select("doc_id")


@check("s18_header_size", f"WITH {v.SPRITE} SELECT image_id, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(8 AS BIGINT) AS depth, CAST(CASE WHEN image_id % 3 = 0 THEN 3 ELSE 6 END AS BIGINT) AS color_type FROM sprite")
def _(spark, sf):
    return v.png_files(spark, sf).select("image_id", png_header("content").alias("h")).select("image_id", "h.width", "h.height", "h.depth", "h.color_type")


@check("s19_png_text", f"WITH {v.SPRITE} SELECT image_id, CASE WHEN image_id % 11 <> 5 THEN 'sprite ' || image_id END AS caption FROM sprite")
def _(spark, sf):
    d = v.png_files(spark, sf).withColumn("d", decode_png("content"))
    return d.select("image_id", F.col("d.png_text")["caption"].alias("caption"))


@check("r1_resumed_ingest", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    root = scratch_path(spark, "ingest")
    e = v.table(spark, sf, "events").select("event_id", "event_type", F.sha2(F.col("event_id").cast("string"), 256).alias("digest"))
    schema = "event_id bigint, event_type string, digest string"
    for part in range(2):
        # the second delivery repeats a part of the first, and comes by a stream of its own
        e.where(F.col("event_id") % 3 >= part).write.mode("append").parquet(f"{root}/in")
        ingest.ingest_unseen(ingest.stream_parquet(spark, f"{root}/in", schema), f"{root}/out", f"{root}/state{part}", "digest", "event_id")
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type")


@check(
    "r2_completion",
    """SELECT source, count(*) AS expected, count(*) FILTER (doc_id % 50 <> 7) AS landed, count(*) FILTER (doc_id % 50 = 7) = 0 AS complete FROM documents GROUP BY source""",
)
def _(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", "source")
    return ingest.completion(d, d.where(F.col("doc_id") % 50 != 7), "source")


@check("r3_dedup_against_history", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, sf):
    root = scratch_path(spark, "history")
    d = v.table(spark, sf, "documents").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    schema = "doc_id bigint, text string, digest string"
    half = d.agg(F.avg("doc_id").alias("m"))
    marked = d.join(F.broadcast(half), F.lit(True))
    for n, part in enumerate((marked.where("doc_id <= m"), marked.where("doc_id > m"))):
        part.drop("m").write.mode("append").parquet(f"{root}/in")
        ingest.ingest_unseen(ingest.stream_parquet(spark, f"{root}/in", schema), f"{root}/out", f"{root}/state{n}", "digest", "doc_id")
    return spark.read.parquet(f"{root}/out").select("text", "doc_id")


@check("r4_scene_reuse", "SELECT count(*) AS created, count(*) FILTER (vec_id % 3 <> 0) AS new, count(*) FILTER (vec_id % 3 = 0) AS reused FROM embeddings")
def _(spark, sf):
    scenes = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"))
    existing = scenes.where(F.col("scene_id") % 3 == 0)
    return compose.composition_report(scenes, existing, compose.missing_scenes(scenes, existing))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _length_encoder(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [float(len(t)), 1.0])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _mean_encoder(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda p: [float((p >> 24).mean())])


@check("x1_text_encoder_plugin", "SELECT DISTINCT text, CAST(length(text) AS DOUBLE) AS first FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    requests = v.table(spark, sf, "conversations").select("text")
    cache = requests.limit(0).select("text", F.lit("v").alias("version"))
    return embed.encode_missing(requests, cache, "v", encoder=_length_encoder).select("text", F.get("embedding", F.lit(0)).alias("first"))


@check("x2_image_encoder_plugin", f"WITH {v.CELL} SELECT image_id, round(avg(px >> 24), 6) AS alpha FROM cell GROUP BY image_id")
def _(spark, sf):
    e = embed.encode_images(v.sprites(spark, sf).select("image_id", "pixels"), encoder=_mean_encoder)
    return e.select("image_id", F.round(F.get("embedding", F.lit(0)), 6).alias("alpha"))


@check("x3_python_readers", "SELECT count(*) AS members, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents")
def _(spark, sf):
    blocks = v.table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 40).alias("block"))
    members = files.expand_archives(blocks.groupBy("block").applyInPandas(_pack, "archive string, content binary"), "archive")
    return members.agg(F.count(F.lit(1)).alias("members"), F.sum(F.length("content")).alias("bytes"))
