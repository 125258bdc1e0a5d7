import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.plans.corpus import prepare_corpus
from pixelspark.plans.curation import curate_folder
from pixelspark.plans.manifest import build_manifest, open_dataset
from pixelspark.plans.vendor import prepare_vendor_pack
from pixelspark.sources.files import expand_archives

from images import packed, png, save, solid

META = {"source": "test", "license": "CC0-1.0", "tags": ["pixel-art"]}


def counts(report, section):
    return {r["key"]: r["count"] for r in report.where(F.col("section") == section).collect()}


def many_colors(width, height):
    n = np.arange(width * height)
    return np.stack([n % 256, n // 256, 0 * n, 0 * n + 255], axis=1).reshape(height, width, 4)


def tile(i):
    rng = np.random.default_rng(i)
    colors = np.array([(0, 0, 0, 0), (200, 40, 40, 255), (30, 160, 60, 255), (240, 240, 240, 255)])
    return colors[rng.integers(0, 4, (16, 16))]


@pytest.fixture
def candidates(tmp_path):
    root = tmp_path / "candidates"
    save(root / "ok.png", solid(8, 8, (255, 0, 0, 255)), META)
    (root / "dupe.png").write_bytes((root / "ok.png").read_bytes())
    (root / "dupe.json").write_text(json.dumps(META))
    sheet = solid(260, 16, (0, 0, 0, 0))
    for i in range(8):
        sheet[1 + i, 1 + i] = (0, 255, 0, 255)
        sheet[1 + i, 240 + 7 - i] = (0, 0, 255, 255)
    save(root / "sheet.png", sheet, META)
    save(root / "smooth.png", many_colors(17, 17), META)
    save(root / "lossy.png", many_colors(8, 9), META)
    save(root / "big.png", solid(129, 8, (1, 2, 3, 255)))
    (root / "bad.png").write_bytes(b"not a png")
    (root / "notes.txt").write_text("skip")
    save(root / ".hidden" / "x.png", solid(4, 4, (1, 1, 1, 255)))
    return root


def test_curation_golden_report(spark, candidates, tmp_path):
    before = {p: p.read_bytes() for p in candidates.rglob("*") if p.is_file()}
    rows, report = curate_folder(spark, str(candidates), str(tmp_path / "out"))
    assert {p: p.read_bytes() for p in candidates.rglob("*") if p.is_file()} == before
    got = counts(report, "curation")
    assert got["scanned"] == 8 and got["accepted"] == 3 and got["sprite_sheets_split"] == 1 and got["split_children"] == 2
    assert got["duplicates"] == 1 and got["near_duplicates"] == 0 and got["non_pixel_art_smooth"] == 1
    assert got["lossy_gt_64_colors"] == 1 and got["oversized_high_res"] == 1 and got["corrupt_unsupported"] == 2
    assert got["holdout"] == sum(counts(report, "rejection_reasons").values()) == 6
    by_path = {r["source_rel_path"]: r for r in rows.collect()}
    assert by_path["dupe.png"]["status"] == "accepted" and by_path["ok.png"]["reason"] == "duplicate"
    assert by_path["ok.png"]["duplicate_of"] == "dupe.png"
    kids = [r for p, r in by_path.items() if p.startswith("_splits/sheet/")]
    assert sorted(r["source_rel_path"] for r in kids) == ["_splits/sheet/0000_1_1_8x8.png", "_splits/sheet/0001_240_1_8x8.png"]
    for r in kids:
        assert r["metadata"]["split_from"] == "sheet.png" and r["license"] == "CC0-1.0" and len(r["piece_pixels"]) == 64
    accepted = [r for r in by_path.values() if r["status"] == "accepted"]
    assert all(r["metadata"]["curation_status"] == "accepted" and r["metadata"]["license"] == "CC0-1.0" for r in accepted)
    held = spark.read.parquet(str(tmp_path / "out" / "holdout"))
    assert held.where("reason = 'non_pixel_art_smooth'").first()["source_rel_path"] == "smooth.png"
    stored = spark.read.schema("section string, key string, count bigint").json(str(tmp_path / "out" / "report"))
    assert sorted(stored.collect()) == sorted(report.collect())


def test_vendor_pack_folder(spark, tmp_path):
    root = tmp_path / "tiny-town"
    for i in range(12):
        save(root / "png" / f"tile_{i:04d}.png", tile(i))
    (root / "LICENSE.md").write_text("text")
    manifest, report = prepare_vendor_pack(spark, str(root), str(tmp_path / "out"), "Vendor", "local", "Creative Commons CC0")
    assert counts(report, "total") == {"total_scanned": 13, "total_accepted": 12, "total_rejected": 1}
    assert counts(report, "rejection_reasons") == {"unsupported_format": 1} and counts(report, "size") == {"16x16": 12}
    assert counts(report, "transparency") == {"true": 12}
    row = manifest.where("rel_path = 'png/tile_0000.png'").first()
    assert row["tags"] == ["tiny", "town"] and row["metadata"]["license"] == "Creative Commons CC0" and not row["lossy"]
    with pytest.raises(ValueError, match="must be empty"):
        prepare_vendor_pack(spark, str(root), str(tmp_path / "out"), "Vendor", "local", "CC0")


def test_vendor_pack_rejections(spark, tmp_path):
    root = tmp_path / "raw"
    save(root / "ok.png", solid(8, 8, (255, 0, 0, 255)))
    save(root / "big.png", solid(129, 8, (255, 0, 0, 255)))
    save(root / "photo.png", many_colors(30, 10))
    (root / "bad.png").write_bytes(b"not a png")
    (root / "notes.txt").write_text("skip")
    _, report = prepare_vendor_pack(spark, str(root), str(tmp_path / "out"), "V", "local", "CC0")
    assert counts(report, "rejection_reasons") == {"corrupt": 1, "non_pixel_art": 1, "oversized": 1, "unsupported_format": 1}
    assert counts(report, "total")["total_accepted"] == 1


def test_vendor_pack_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("pack/tile_0000.png", png(tile(0)))
    manifest, report = prepare_vendor_pack(spark, str(tmp_path / "pack.zip"), str(tmp_path / "out"), "V", "local", "CC0")
    assert counts(report, "total")["total_accepted"] == 1
    assert manifest.first()["rel_path"] == "pack/tile_0000.png"


@pytest.mark.parametrize("member", ["../bad.png", "/abs.png", "a/../../b.png"])
def test_unsafe_archive_is_refused(spark, tmp_path, member):
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr(member, b"nope")
    with pytest.raises(Exception, match="unsafe zip path"):
        prepare_vendor_pack(spark, str(tmp_path / "pack.zip"), str(tmp_path / "out"), "V", "local", "CC0")


def test_inner_parent_steps_are_safe(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("a/../b.txt", b"fine")
    archives = spark.createDataFrame([("p", (tmp_path / "pack.zip").read_bytes())], "rel_path string, content binary")
    assert expand_archives(archives).first()["content"] == b"fine"


def corpus_config(tmp_path):
    folder = tmp_path / "town"
    for i in range(12):
        save(folder / f"tile_{i:04d}.png", tile(i))
    (folder / "bad.png").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "sample.zip", "w") as z:
        z.writestr("pack/tile_0100.png", png(tile(100)))
        z.writestr("pack/tile_0101.png", png(tile(101)))
    archives = tmp_path / "archives"
    archives.mkdir()
    with zipfile.ZipFile(archives / "inner.zip", "w") as z:
        z.writestr("deep/red-gem_07.png", png(tile(200)))
    config = tmp_path / "config.json"
    sources = [
        {"name": "Tiny Town", "path": str(folder), "license": "Creative Commons CC0", "source_url": "https://example.org/town", "category": "tile", "tags": ["tile"]},
        {"name": "Zip Pack", "path": str(tmp_path / "sample.zip"), "license": "CC0-1.0", "source_url": "local", "category": "object"},
        {"name": "Archives", "path": str(archives), "license": "MIT", "category": "gem", "extract_archives": True},
        {"name": "Closed", "path": str(folder), "license": "CC0", "enabled": False, "blocked_reason": "stalled"},
        {"name": "Bad", "path": str(folder), "license": "CC-BY-NC"},
    ]
    config.write_text(json.dumps({"sources": sources}))
    return str(config)


def test_corpus_end_to_end_and_resume(spark, tmp_path):
    config, out = corpus_config(tmp_path), str(tmp_path / "corpus")
    run = prepare_corpus(spark, config, out, target_count=50, min_count=1, scenes=3)
    assert run["status"].first()["status"] == "ready"
    totals = {r["source"]: (r["scanned"], r["accepted"], r["rejected"]) for r in run["sources"].where("reason is null").collect()}
    assert totals == {"Tiny Town": (13, 12, 1), "Zip Pack": (2, 2, 0), "Archives": (1, 1, 0)}
    reasons = {(r["source"], r["reason"], r["blocked_reason"]) for r in run["sources"].where("reason is not null").collect()}
    assert reasons == {("Tiny Town", "corrupt", None), ("Closed", "disabled", "stalled"), ("Bad", "license_not_allowed", None)}
    rows = {r["rel_path"]: r for r in run["manifest"].collect()}
    gem = rows["archives/inner/deep/red-gem_07.png"]
    assert gem["tags"] == ["gem", "red"] and gem["license"] == "MIT" and gem["metadata"]["provenance"] == "inner/deep/red-gem_07.png"
    assert all(not r["lossy"] and not r["duplicate_of"] and not r["near_duplicate_of"] for r in rows.values())
    scenes = [r for p, r in rows.items() if p.startswith("procedural_scenes/")]
    assert scenes and all(r["category"] == "scene" and (r["width"], r["height"]) == (128, 128) for r in scenes)
    assert counts(run["report"], "composition") == {"created": 3, "new": 3, "reused": 0}
    assert counts(run["report"], "manifest.total")["count"] == 18

    save(tmp_path / "town" / "tile_0012.png", tile(12))
    again = prepare_corpus(spark, config, out, target_count=50, min_count=1000, scenes=4)
    assert again["status"].first()["status"] == "below_min_count"
    assert counts(again["report"], "composition") == {"created": 4, "new": 1, "reused": 3}
    assert {r["source"]: r["accepted"] for r in again["sources"].where("reason is null").collect()} == {"Tiny Town": 13, "Zip Pack": 2, "Archives": 1}
    stored = spark.read.parquet(f"{out}/assets").where("reason is null")
    assert stored.count() == stored.select("source_name", "rel_path").distinct().count() == 16


def test_landed_keys_are_not_broadcast(spark, tmp_path):
    run = prepare_corpus(spark, corpus_config(tmp_path), str(tmp_path / "corpus"), target_count=50, min_count=1)
    plan = run["sources"]._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [source_name" in plan and "BroadcastHashJoin [source_name" not in plan


def test_corpus_without_any_permitted_source(spark, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"sources": [{"name": "Bad", "path": str(tmp_path), "license": "CC-BY-NC"}]}))
    run = prepare_corpus(spark, str(config), str(tmp_path / "out"), min_count=1)
    assert run["status"].first()["status"] == "below_min_count"
    assert [(r["reason"], r["count"]) for r in run["sources"].collect()] == [("license_not_allowed", 1)]
    assert counts(run["report"], "curation")["selected"] == 0


def test_manifest_and_dataset_reading(spark, tmp_path):
    root = tmp_path / "data"
    save(root / "sprite.png", tile(1), {"caption": "indexed", "tags": ["a", "b"], "license": "CC0"})
    save(root / "wide.png", solid(64, 20, (1, 2, 3, 255)))
    save(root / "huge.png", solid(200, 2, (1, 2, 3, 255)))
    rows, report = build_manifest(spark, str(root), str(root / "manifest.jsonl"))
    assert counts(report, "total")["count"] == 2 and counts(report, "rejected") == {"oversized": 1}
    assert counts(report, "bucket") == {"32:square": 1, "64:landscape": 1} and counts(report, "tag") == {"a": 1, "b": 1}
    (root / "sprite.json").unlink()
    (tmp_path / "data").rename(tmp_path / "moved")
    moved = open_dataset(spark, str(tmp_path / "moved"))
    sprite = moved.where("rel_path = 'sprite.png'").first()
    assert sprite["metadata"]["caption"] == "indexed" and sprite["path"] == f"{tmp_path}/moved/sprite.png"
    assert len(sprite["phash"]) == 64
    with pytest.raises(Exception, match="larger than supported"):
        build_manifest(spark, str(tmp_path / "moved"), strict=True)[0].count()
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no PNG"):
        open_dataset(spark, str(tmp_path / "empty"))


def test_parquet_source_with_grid(spark, tmp_path):
    src = tmp_path / "parquet"
    image = F.struct(F.lit(bytearray(png(tile(3)))).alias("bytes"))
    rows = spark.range(4).select(
        F.when(F.col("id") < 2, image).alias("image"),
        F.when(F.col("id") == 2, F.array(*[F.lit(i % 2) for i in range(9)])).when(F.col("id") == 3, F.array(F.lit(1), F.lit(0))).alias("grid"),
        F.lit("a gem").alias("prompt"),
    )
    rows.coalesce(1).write.parquet(str(src / "data"))
    spark.createDataFrame([(0, 9, 9, 9), (1, 250, 0, 0)], "idx int, r int, g int, b int").write.json(str(src / "palette.json"))
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"sources": [{"name": "P", "path": str(src), "license": "MIT", "category": "x", "extract_parquet": True, "extract_grid": True}]}))
    run = prepare_corpus(spark, str(config), str(tmp_path / "out"), min_count=1)
    total = run["sources"].where("reason is null").first()
    assert (total["scanned"], total["accepted"]) == (3, 3)
    stored = spark.read.parquet(str(tmp_path / "out" / "assets"))
    assert {(r["width"], r["caption"]) for r in stored.collect()} == {(16, "a gem"), (3, "a gem")}
    grid = stored.where("width = 3").first()
    assert grid["pixels"][:2] == [0xFF090909, 0xFFFA0000]
    # the two equal images are one after deduplication
    assert run["manifest"].count() == 2


def test_packed_helper_order():
    assert packed(np.array([[[1, 2, 3, 4]]])).tolist() == [0x04010203]


def test_encodings_are_kept_between_runs(spark, tmp_path):
    from pixelspark.plans.training import measure_throughput, refresh_encodings, training_batches, training_rows
    from pixelspark.sources.files import scan_png

    root, table = tmp_path / "data", str(tmp_path / "encodings")
    for i in range(10):
        save(root / f"t{i}.png", tile(i), {"caption": f"tile {i}", "category": "town"})
    save(root / "many.png", many_colors(10, 9))
    first = refresh_encodings(spark, scan_png(spark, str(root)), table)
    assert first.count() == 11 and first.where("lossy").count() == 1
    (root / "t0.png").unlink()
    save(root / "t10.png", tile(10))
    second = refresh_encodings(spark, scan_png(spark, str(root)), table)
    assert second.count() == 11 and spark.read.parquet(table).count() == 12
    assert refresh_encodings(spark, scan_png(spark, str(root)), table).count() == 11 and spark.read.parquet(table).count() == 12

    manifest, _ = build_manifest(spark, str(root))
    rows = training_rows(manifest.withColumn("caption", F.col("metadata")["caption"]).withColumn("category", F.col("metadata")["category"]))
    assert rows.count() == 10 and {r["split"] for r in rows.collect()} == {"train", "validation", "test"}
    samples = training_batches(rows, second.select("rel_path", "width", "height", "indices", "palette"), batch_size=4)
    report = measure_throughput(samples).first()
    assert report["samples"] == 10 and report["samples_per_second"] > 0 and report["buckets"] == {"32:square": 10}


def test_streaming_files_are_taken_once(spark, tmp_path):
    from pixelspark.functions.hashing import content_digest
    from pixelspark.streaming.ingest import ingest_unseen, stream_files

    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for i in (0, 1):
        save(root / f"a{i}.png", tile(i))
    save(root / "copy.png", tile(0))

    def run():
        prepare = lambda b: b.select("path", "length", content_digest("content").alias("digest"))
        ingest_unseen(stream_files(spark, str(root)), out, state, "digest", "path", prepare)
        return spark.read.parquet(out).count()

    assert run() == 2 and run() == 2
    save(root / "late.png", tile(1))
    save(root / "new.png", tile(5))
    assert run() == 3
