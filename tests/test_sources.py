"""Sources and streams lose and change nothing: odd names, equal names, mixed schemas, gaps, several streams, repaired files."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from images import png, save, solid
from pyspark.sql import functions as F

from pixelspark.plans.corpus import land_sources
from pixelspark.sources.catalogue import gate_sources, read_catalogue
from pixelspark.sources.embedded import extract_images, read_parquet_tree
from pixelspark.sources.files import scan_png
from pixelspark.streaming.ingest import first_of_each, ingest_unseen, stream_parquet


def gated(spark, tmp_path, **source):
    config = tmp_path / "sources.json"
    config.write_text(json.dumps({"sources": [{"name": "pack", "license": "cc0", "license_url": "https://example.org/l", "source_url": "https://example.org/s"} | source]}))
    return gate_sources(read_catalogue(spark, str(config)))


def picture(i):
    return solid(32, 32, [i, 2 * i, 255 - i, 255])


def test_names_with_pattern_letters(spark, tmp_path):
    root = tmp_path / "in"
    for name in ("a.png", "d[1].png", "e{2}.png", "f 3.png"):
        save(root / name, picture(len(name)))
    sources = gated(spark, tmp_path, path=str(root))
    assert land_sources(spark, sources, str(tmp_path / "out")).count() == 4
    save(root / "x[9]" / "y[8].png", picture(77))
    again = land_sources(spark, sources, str(tmp_path / "out"))
    assert sorted(r.rel_path for r in again.collect()) == ["a.png", "d[1].png", "e{2}.png", "f 3.png", "x[9]/y[8].png"]


def test_relative_roots(spark, tmp_path, monkeypatch):
    save(tmp_path / "data" / "work" / "data" / "x.png", picture(1))
    for root in (str(tmp_path / "data"), f"file://{tmp_path}/data/", os.path.relpath(tmp_path / "data")):
        assert [r.rel_path for r in scan_png(spark, root).select("rel_path").collect()] == ["work/data/x.png"]


def test_underscored_names(spark, tmp_path):
    from pixelspark.sources.files import scan_files

    root = tmp_path / "in"
    shown = ["a.png", "_b.png", "_splits/c.png", "_splits/_d/e.png", "f/_g/_h.png", "x[1]/_y{2}/z.png", "_s[3]/k.png"]
    for i, name in enumerate([*shown, ".h/_i.png", "_splits/.j.png", "_splits/.k/l.png", "_m/n.txt"]):
        save(root / name, picture(i))
    pngs = scan_png(spark, str(root)).collect()
    assert sorted(r.rel_path for r in pngs) == sorted(shown)
    assert all(bytes(r.content) == (root / r.rel_path).read_bytes() and r.length == len(r.content) for r in pngs)
    assert sorted(r.rel_path for r in scan_files(spark, str(root)).select("rel_path").collect()) == sorted([*shown, "_m/n.txt"])
    landed = land_sources(spark, gated(spark, tmp_path, path=str(root)), str(tmp_path / "out"))
    assert sorted((r.rel_path, r.reason) for r in landed.collect()) == sorted((n, None) for n in shown)
    write_images(root / "_packs" / "p.parquet", "image", [picture(9)])
    assert extract_images(read_parquet_tree(spark, str(root))).count() == 1


def test_split_pieces_are_read_back(spark, tmp_path):
    """Pieces that a curation stored below _splits are part of a manifest of the folder."""
    from pixelspark.plans.manifest import build_manifest

    for name in ("a.png", "_splits/b.png"):
        save(tmp_path / "pool" / name, picture(len(name)))
    assert sorted(r.rel_path for r in build_manifest(spark, str(tmp_path / "pool"))[0].select("rel_path").collect()) == ["_splits/b.png", "a.png"]


def write_images(path, column, pictures):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({column: pa.array([png(p) for p in pictures], pa.binary())}), path)


def test_equal_parquet_names(spark, tmp_path):
    root = tmp_path / "in"
    write_images(root / "train" / "0000.parquet", "image", [picture(i) for i in (1, 2, 3)])
    write_images(root / "test" / "0000.parquet", "image", [picture(i) for i in (3, 4, 5)])
    sources = gated(spark, tmp_path, path=str(root), extract_parquet=True)
    assert land_sources(spark, sources, str(tmp_path / "out")).select("rel_path").distinct().count() == 6
    write_images(root / "more" / "0000.parquet", "image", [picture(i) for i in (6, 7, 8)])
    landed = land_sources(spark, sources, str(tmp_path / "out"))
    assert landed.count() == landed.select("rel_path").distinct().count() == 9


def test_mixed_parquet_schemas(spark, tmp_path):
    write_images(tmp_path / "in" / "a.parquet", "image", [picture(i) for i in (1, 2, 3)])
    write_images(tmp_path / "in" / "b.parquet", "img", [picture(i) for i in (4, 5)])
    assert extract_images(read_parquet_tree(spark, str(tmp_path / "in"))).count() == 5


def grid(spark, numbers, entries):
    rows = spark.createDataFrame([(numbers,)], "grid array<int>")
    palette = spark.createDataFrame([(i, i % 256, 0, 0, 255) for i in entries], "idx int, r int, g int, b int, a int")
    return extract_images(rows, palette).first()


def test_palette_gaps(spark):
    red = lambda i: 255 << 24 | i << 16
    assert grid(spark, [0, 2, 2, 0], [0, 2]).pixels == [red(0), red(2), red(2), red(0)]
    assert grid(spark, [0, 300, 0, 300], [0, 300 - 1, 300]).pixels[1] == red(300 % 256)
    for numbers, entries in (([0, 1, 0, 0], [0, 2]), ([0, 0, 0, 5], [0, 2]), ([0, 0, 0, 0], [0, 0, 1]), ([0, 0, 0, 0], [-1, 0])):
        with pytest.raises(Exception, match="palette"):
            grid(spark, numbers, entries)


def test_two_streams_on_one_table(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(10).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    rows.where("id < 5").write.parquet(source)
    for checkpoint in ("one", "two", "one", "three"):
        ingest_unseen(stream_parquet(spark, source, "id bigint, digest string"), out, str(tmp_path / checkpoint), "digest", "id")
        if checkpoint == "one":
            rows.where("id >= 5").write.mode("append").parquet(source)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))


def landed_ids(spark, out):
    return sorted(r.id for r in spark.read.parquet(out).collect())


def test_batches_read_only_the_parts_they_hit(spark, tmp_path):
    from pixelspark.streaming.history import KeyHistory

    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    history = KeyHistory(spark, str(tmp_path / "h"), parts=64)
    history.append(rows.where("id < 2000"), "digest", "a", 0)
    history.append(rows.where("id >= 2000 and id < 2500"), "digest", "a", 1)
    few = rows.where("id in (3, 1999, 2600, 2601, 2602)")
    assert sorted(r.key for r in history.seen(few, "digest", "b", 0).collect()) == sorted(r.digest for r in rows.where("id in (3, 1999)").collect())
    own = rows.where("id in (3, 2100)")  # a batch does not know itself
    assert [r.key for r in history.seen(own, "digest", "a", 1).collect()] == [r.digest for r in rows.where("id = 3").collect()]
    new = rows.where("id >= 2500")
    suspects = history.suspects(new, "digest", "b", 0).collect()
    assert len(suspects) < 25  # of 500 unknown keys
    assert {r.part for r in history.suspects(few, "digest", "b", 0).collect()} <= {r.part for r in history._hashed(few, "digest").collect()}
    plan = history.seen(few, "digest", "b", 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan
    parts = {r.part for r in history.suspects(few, "digest", "b", 0).collect()}
    files = [f for f in (tmp_path / "h" / "64" / "keys").rglob("*.parquet")]
    hit = [f for f in files if int(f.parent.name.split("=")[1]) in parts]
    assert 0 < len(hit) <= 2 * len(parts) < len(files) / 4
    noted = spark.read.parquet(str(tmp_path / "h" / "64" / "keys")).where(F.col("part").isin(sorted(parts)))
    assert {r.f.split("/")[-1] for r in noted.select(F.input_file_name().alias("f")).distinct().collect()} <= {f.name for f in hit}


def test_a_table_from_before_the_history(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(30).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    rows.where("id < 20").write.parquet(f"{out}/stream=id-old/batch=0")
    rows.write.parquet(source)
    for checkpoint in ("one", "two"):
        ingest_unseen(stream_parquet(spark, source, "id bigint, digest string"), out, str(tmp_path / checkpoint), "digest", "id")
    assert landed_ids(spark, out) == list(range(30))


def test_a_repeated_batch_lands_once(spark, tmp_path):
    from pixelspark.streaming.ingest import _append_unseen

    out = str(tmp_path / "out")
    rows = spark.range(30).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    _append_unseen(spark, rows.where("id < 10"), out, "digest", "id", "s", 0)
    for _ in range(2):  # the second is the retry after a lost driver
        _append_unseen(spark, rows.where("id < 20"), out, "digest", "id", "s", 1)
    _append_unseen(spark, rows, out, "digest", "id", "t", 1)
    assert landed_ids(spark, out) == list(range(30))
    with pytest.raises(ValueError, match="Batch"):
        _append_unseen(spark, rows.withColumn("Batch", F.lit(1)), out, "digest", "id", "u", 0)


def test_first_of_each_takes_maps(spark):
    batch = spark.createDataFrame([("k", 2, {"a": "2"}), ("k", 1, {"a": "1"})], "key string, n int, m map<string,string>")
    assert [tuple(r) for r in first_of_each(batch, "key", "n").collect()] == [("k", 1, {"a": "1"})]


def test_repaired_files(spark, tmp_path):
    root = tmp_path / "in"
    save(root / "good.png", picture(1))
    (root / "bad.png").write_bytes(b"\x89PNG broken")
    sources = gated(spark, tmp_path, path=str(root))
    for _ in range(2):
        landed = land_sources(spark, sources, str(tmp_path / "out"))
        assert sorted((r.rel_path, r.reason is None) for r in landed.collect()) == [("bad.png", False), ("good.png", True)]
    save(root / "bad.png", picture(2))
    landed = land_sources(spark, sources, str(tmp_path / "out"))
    assert sorted((r.rel_path, r.reason) for r in landed.collect()) == [("bad.png", None), ("good.png", None)]


def test_capital_endings_of_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("a.png", png(picture(1)))
        z.writestr("b.PNG", png(picture(2)))
    landed = land_sources(spark, gated(spark, tmp_path, path=str(tmp_path / "pack.zip")), str(tmp_path / "out"))
    assert [r.rel_path for r in landed.collect()] == ["a.png"]


def test_stored_report(spark, tmp_path):
    from pixelspark.plans.corpus import prepare_corpus

    root, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(5):
        save(root / f"a{i}.png", picture(20 * i))
    (root / "bad.png").write_bytes(b"no")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"sources": [{"name": "pack", "path": str(root), "license": "cc0", "source_url": "local", "category": "x"}]}))
    prepare_corpus(spark, str(config), out, target_count=3, min_count=2, scenes=2)
    stored = {(r.section, r.key): r["count"] for r in spark.read.json(f"{out}/report").collect()}
    assert [stored["total", f"total_{k}"] for k in ("scanned", "accepted", "rejected")] == [6, 5, 1]
    assert stored["rejection_reasons", "corrupt"] == 1 and stored["thresholds", "hamming"] == 4 and stored["thresholds", "target_count"] == 3
    assert stored["composition", "created"] == stored["composition", "reused"] == 0
    assert [k for s, k in stored if s == "composition_reason"] and [k for s, k in stored if s == "status"]
    assert any(s.startswith("curated.") for s, _ in stored)
    (line,) = [r for r in spark.read.json(f"{out}/sources").collect() if r["scanned"]]
    assert (line["source"], line["accepted"], line["rejected"]) == ("pack", 5, 1)
