"""Licensed sources to a balanced, deduplicated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.buckets import image_rejection_raw
from ..functions.hashing import content_digest, crop_digest
from ..operators import reports
from ..operators.compose import CANVAS, TOO_FEW, compose_scenes, missing_scenes
from ..operators.curate import balanced_sample, group_key, is_eligible, sample_cap
from ..operators.shuffles import shuffled
from ..session import cut_lineage
from ..sources import embedded
from ..sources.catalogue import gate_report, gate_sources, open_sources, read_catalogue
from ..sources.files import decode_files, expand_archives, relative_path, scan_files, scan_png
from ..sources.manifest import path_exists, write_manifest, write_report
from .features import with_image_features
from .manifest import manifest_rows

ASSET_COLUMNS = ("source_name", "rel_path", "sha256", "width", "height", "pixels", "caption")


def _files_of(spark: SparkSession, source: Row, done: DataFrame | None = None) -> DataFrame:
    """(rel_path, content) of a source's PNG files that are not done, looking into archives where the source says so."""
    path = source["path"]
    if path.lower().endswith((".zip", ".png")):
        one = spark.read.format("binaryFile").load(path).select(names.file_name("path").alias("rel_path"), "content")
        found = one if path.lower().endswith(".png") else expand_archives(one).select(F.col("member").alias("rel_path"), "content")
    elif source["extract_archives"]:
        archives = scan_files(spark, path, "*.zip").select("rel_path", "content")
        if archives.select("rel_path").isEmpty():
            found = scan_png(spark, path).select("rel_path", "content")
        else:
            members = expand_archives(archives)
            found = members.select(F.concat_ws("/", names.stem("archive"), F.col("member")).alias("rel_path"), "content")
    else:
        found = scan_png(spark, path).select("rel_path", "content")
    found = found.where(F.col("rel_path").endswith(".png") & ~names.is_hidden("rel_path"))
    return found if done is None else found.join(done, "rel_path", "left_anti")


def source_images(spark: SparkSession, source: Row, max_size: int, done: DataFrame | None = None) -> DataFrame:
    """The images of one source as ``ASSET_COLUMNS``; images above ``max_size`` stay undecoded.

    Images whose ``rel_path`` is in ``done`` are left out before anything is decoded.
    """
    if source["path"] is None:
        raise ValueError(f"source {source['name']!r} has no path; download it to a folder first")
    label = F.lit(source["name"]).alias("source_name")
    if source["extract_parquet"]:
        tree = embedded.read_parquet_tree(spark, source["path"], bool(source["extract_grid"]))
        row = F.concat(F.lpad(F.col("_metadata.row_index").cast("string"), 8, "0"), F.lit(".png"))
        tree = tree.withColumn("rel_path", F.concat_ws("/", names.path_stem(relative_path(spark, F.col("_metadata.file_path"), source["path"])), row))
        if done is not None:
            tree = tree.join(done, "rel_path", "left_anti")
        palette = None
        if source["extract_grid"] and path_exists(spark, f"{source['path']}/palette.json"):
            palette = spark.read.schema("idx int, r int, g int, b int, a int").json(f"{source['path']}/palette.json")
            palette = palette.withColumn("a", F.coalesce("a", F.lit(255)))
        images = embedded.extract_images(tree, palette)
        if done is None:
            images = embedded.require_images(images, source["path"])
        digest = F.coalesce(content_digest("payload"), crop_digest("width", "height", "pixels"))
        return images.select(label, "rel_path", digest.alias("sha256"), "width", "height", "pixels", "caption")
    files = decode_files(_files_of(spark, source, done).withColumn("sha256", content_digest("content")), max_side=max_size)
    return files.select(label, "rel_path", "sha256", "width", "height", "pixels", F.lit(None).cast("string").alias("caption"))


def land_sources(
    spark: SparkSession, gated: DataFrame, table: str, max_size: int = 128, max_colors: int = 64, max_pixel_art_colors: int = 256
) -> DataFrame:
    """Scan, validate and store the open sources; returns the stored table.

    Every scanned image is one row with its features and a ``reason`` (NULL when accepted, and only then with
    pixels). Images already accepted in the table are neither validated nor written again.
    """
    done, run = None, 1
    if path_exists(spark, table):
        run = 1 + (spark.read.parquet(table).agg(F.max("run")).first()[0] or 0)
        done = spark.read.parquet(table).where(F.col("reason").isNull()).select("source_name", "rel_path")

    def landed(name: str) -> DataFrame | None:
        return None if done is None else done.where(F.col("source_name") == name).select("rel_path")

    parts = [source_images(spark, s, max_size, landed(s["name"])) for s in open_sources(gated)]
    if parts:
        images = parts[0]
        for part in parts[1:]:
            images = images.unionByName(part)
        facts = with_image_features(images, max_colors, max_size)
        reason = image_rejection_raw("width", "height", "unique_color_count", max_size, max_pixel_art_colors)
        facts = facts.withColumn("reason", reason)
        facts = facts.withColumn("pixels", F.when(F.col("reason").isNull(), F.col("pixels")))
        facts.withColumn("run", F.lit(run)).write.mode("append").parquet(table)
    if not path_exists(spark, table):
        return with_image_features(
            spark.createDataFrame([], "source_name string, rel_path string, sha256 string, width int, height int, pixels array<bigint>, caption string")
        ).withColumn("reason", F.lit(None).cast("string"))
    # a rejected image is scanned again by every run: only its latest verdict counts, and none once it is accepted
    stored = spark.read.parquet(table)
    keys = ["source_name", "rel_path"]
    accepted, rejected = stored.where(F.col("reason").isNull()), stored.where(F.col("reason").isNotNull())
    latest = rejected.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stored.columns if c not in keys]), "run").alias("r"))
    latest = latest.select(*keys, "r.*").join(shuffled(accepted.select(*keys)), keys, "left_anti")
    return accepted.unionByName(latest.select(*stored.columns)).drop("run")


def with_source_metadata(landed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Accepted images with provenance fields; Spark broadcasts the catalogue if it finds it small enough."""
    sources = catalogue.select(F.col("name").alias("source_name"), F.struct(*catalogue.columns).alias("_source"))
    joined = landed.join(sources, "source_name")
    described = joined.withColumn("_p", names.provenance(F.col("_source"), "rel_path"))
    fields = ("source", "source_url", "license", "author", "category", "tags", "provenance", "corpus_rel_path")
    out = described.select(*landed.columns, *[F.col(f"_p.{f}").alias(f) for f in fields])
    return out.withColumn("rel_path", F.col("corpus_rel_path"))


def with_metadata_map(rows: DataFrame) -> DataFrame:
    scalar = ("source", "source_url", "license", "author", "category", "provenance", "caption")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in scalar])
    return rows.withColumn("metadata", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def scene_rows(scenes: DataFrame, max_colors: int) -> DataFrame:
    """Composed scenes as corpus rows with features."""
    named = scenes.withColumn("rel_path", F.concat(F.lit("procedural_scenes/scene_"), F.lpad(F.col("scene_id").cast("string"), 6, "0"), F.lit(".png")))
    named = named.withColumn("provenance", F.to_json("parents")).withColumn("sha256", crop_digest("width", "height", "pixels"))
    facts = with_image_features(named, max_colors, CANVAS)
    null = F.lit(None).cast("string")
    return facts.withColumn("caption", null).withColumn("author", null)


def source_report(landed: DataFrame, gated: DataFrame) -> DataFrame:
    """(source, scanned, accepted, rejected, reason, count, blocked_reason); NULL reason for the totals of a source."""
    per = landed.groupBy(F.col("source_name").alias("source"), "reason").agg(F.count(F.lit(1)).alias("count"))
    whole = per.groupBy("source").agg(
        F.sum("count").alias("scanned"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("count"))), F.lit(0)).alias("accepted")
    ).withColumn("rejected", F.col("scanned") - F.col("accepted"))
    named = gated.where(F.col("gate").isNull()).select(F.col("name").alias("source"))
    zero = F.lit(0).cast("bigint")
    whole = named.join(whole, "source", "left").select(
        "source", *[F.coalesce(c, zero).alias(c) for c in ("scanned", "accepted", "rejected")],
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("string").alias("blocked_reason"),
    )
    reasons = per.where(F.col("reason").isNotNull()).select(
        "source", zero.alias("scanned"), zero.alias("accepted"), zero.alias("rejected"), "reason", "count", F.lit(None).cast("string").alias("blocked_reason")
    )
    return whole.unionByName(reasons).unionByName(gate_report(gated))


def _counts(spark: SparkSession, section: str, counts: dict[str, int]) -> DataFrame:
    """Numbers known to the driver as rows of a report."""
    return spark.createDataFrame([(section, k, v) for k, v in counts.items()], "section string, key string, count bigint")


def prepare_corpus(
    spark: SparkSession,
    config_path: str,
    output: str,
    target_count: int = 100_000,
    min_count: int = 50_000,
    max_size: int = 128,
    max_colors: int = 64,
    max_pixel_art_colors: int = 256,
    hamming: int = 4,
    per_bucket_cap: int | None = None,
    scenes: int = 0,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Build a corpus below ``output``; returns its tables: ``manifest``, ``sources``, ``report`` and ``status``.

    Stored tables: ``assets`` (every scanned image, pixels of the accepted), ``scenes``, ``manifest.raw.jsonl``,
    ``manifest.jsonl``, ``sources`` (counts, reasons and blocked sources) and ``report`` (raw and curated manifests, curation, totals,
    reasons, composition, thresholds and status). A second run takes up what is stored.
    """
    folder = output.rstrip("/")
    catalogue = read_catalogue(spark, config_path)
    gated = cut_lineage(gate_sources(catalogue))
    landed = land_sources(spark, gated, f"{folder}/assets", max_size, max_colors, max_pixel_art_colors)
    assets = with_source_metadata(landed.where(F.col("reason").isNull()), catalogue)

    wanted = ("rel_path", "sha256", "width", "height", "unique_color_count", "palette_size", "lossy", "phash",
              "source", "source_url", "license", "author", "category", "tags", "provenance", "caption")
    rows = assets.select(*wanted)
    sections, composed = [], 0
    if scenes:
        table = f"{folder}/scenes"
        requested = spark.range(scenes).withColumnRenamed("id", "scene_id")
        stored = spark.read.parquet(table) if path_exists(spark, table) else None
        reused = stored.count() if stored is not None else 0
        todo = missing_scenes(requested, stored) if stored is not None else requested
        todo = cut_lineage(todo)
        if not todo.isEmpty():
            scene_rows(compose_scenes(assets, todo, seed), max_colors).write.mode("append").parquet(table)
        made = spark.read.parquet(table)
        composed = made.count()
        rows = rows.unionByName(made.select(*wanted))
        sections.append(_counts(spark, "composition", {"created": composed, "reused": reused, "new": composed - reused}))
        if composed < scenes:
            sections.append(_counts(spark, "composition_reason", {TOO_FEW: scenes - composed}))

    base = with_metadata_map(rows).withColumn("path", F.concat(F.lit(f"{folder}/assets/"), F.col("rel_path")))
    raw = cut_lineage(manifest_rows(base, hamming))
    write_manifest(raw, f"{folder}/manifest.raw.jsonl")
    eligible = raw.where(is_eligible()).withColumn("group", group_key(F.col("category"), F.col("bucket")))
    cap = sample_cap(eligible, target_count, per_bucket_cap)
    chosen = cut_lineage(balanced_sample(eligible, target_count, cap, seed).orderBy("rel_path"))
    write_manifest(chosen.drop("group"), f"{folder}/manifest.jsonl")

    sources = source_report(landed, gated)
    status = reports.readiness(chosen, min_count)
    curation = reports.curation_report(raw, is_eligible(), group_key(F.col("category"), F.col("bucket")), chosen, cap)
    report = reports.manifest_report(raw).withColumn("section", F.concat(F.lit("manifest."), F.col("section"))).unionByName(curation)
    no_reason = F.col("reason").isNull()
    limits = {"target_count": target_count, "min_count": min_count, "max_size": max_size, "max_colors": max_colors}
    limits |= {"max_pixel_art_colors": max_pixel_art_colors, "hamming": hamming, "per_bucket_cap": cap}
    sections += [
        reports.manifest_report(chosen).withColumn("section", F.concat(F.lit("curated."), F.col("section"))),
        reports.totals(
            landed, "total", total_scanned=F.count(F.lit(1)), total_accepted=F.count_if(no_reason) + composed, total_rejected=F.count_if(~no_reason)
        ),
        reports.histogram(landed, "rejection_reasons", F.col("reason")),
        _counts(spark, "thresholds", limits),
        status.select(F.lit("status").alias("section"), F.col("status").alias("key"), F.col("selected").alias("count")),
    ]
    for section in sections:
        report = report.unionByName(section)
    report = cut_lineage(report)
    write_report(report, f"{folder}/report")
    sources.write.mode("overwrite").json(f"{folder}/sources")
    return {"manifest": chosen, "raw_manifest": raw, "sources": sources, "report": report, "status": status}
