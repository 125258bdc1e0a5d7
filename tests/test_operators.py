import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.functions import buckets, grids, licenses, names
from pixelspark.functions import pixels as px
from pixelspark.operators import batches, compose, curate, embed, metrics, quantize, shuffles, targets
from pixelspark.sources.manifest import conform

from images import packed, solid


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def image_frame(spark, images):
    rows = [(i, a.shape[1], a.shape[0], packed(a).tolist()) for i, a in images.items()]
    return spark.createDataFrame(rows, "i int, width int, height int, pixels array<bigint>")


def test_licenses(spark):
    cases = {
        "CC0": True, " cc0-1.0 ": True, "Creative  Commons_CC0": False, "CC BY 4.0": True, "cc-by 3.0 unported": True, "cc-by-sa-4.0": False,
        "CC-BY-NC": False, "CC-BY-ND": False, "All Rights Reserved": False, "unknown": False, "": False, None: False, "licence": False,
        "MIT": True, "BSD_3-Clause": True, "mixed permissive": True, "OGA-BY-3.0": True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r["l"]: r["a"] for r in df.select("l", licenses.is_allowed_license("l").alias("a")).collect()} == cases


def test_names(spark):
    r = one(
        spark,
        names.slug(F.lit("Tiny Town! 2")).alias("a"), names.slug(F.lit("--")).alias("b"), names.stem(F.lit("a/b.c.png")).alias("c"),
        names.stem(F.lit("a/.png")).alias("d"), names.path_stem(F.lit("a.b/c.d.png")).alias("e"), names.suffix(F.lit("a/B.PNG")).alias("f"),
        names.is_hidden(F.lit("a/.b/c.png")).alias("g"), names.is_hidden(F.lit("a/b.png")).alias("h"),
        names.safe_output_path(F.lit("x/" + "y" * 81 + ".PNG")).alias("i"), names.safe_output_path(F.lit("x/y.png")).alias("j"),
        names.source_tags(F.array(F.lit("z")), F.lit("d/Red-Gem_07.png")).alias("k"),
        names.pack_tags(F.lit("Tiny-Town/PNG/tile_0001 big.png")).alias("l"),
    )
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == ("tiny_town__2", "source", "b.c", ".png", "a.b/c.d", ".png")
    assert r["g"] and not r["h"] and r["j"] == "x/y.png"
    assert r["i"].startswith("_long_paths/" + "y" * 48 + "_") and r["i"].endswith(".png") and len(r["i"]) == 12 + 48 + 1 + 24 + 4
    assert r["k"] == ["gem", "red", "z"] and r["l"] == ["big", "tiny", "town"]


def test_captions(spark):
    r = one(
        spark,
        names.asset_caption(F.lit("red gem"), F.lit("gem")).alias("a"), names.asset_caption(F.lit("red"), F.lit("gem")).alias("b"),
        names.asset_caption(F.lit(""), F.lit("gem")).alias("c"), names.asset_caption(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("d"),
    )
    assert tuple(r) == ("red gem", "red gem", "gem", "pixel art")


def test_bucket_and_stage_shapes(spark):
    df = spark.createDataFrame([(20, 20), (30, 20), (64, 20), (32, 64), (128, 80), (129, 1)], "w int, h int")
    assert [r[0] for r in df.select(buckets.bucket_id("w", "h")).collect()] == ["32:square", "32:landscape", "64:landscape", "64:portrait", "128:landscape", None]
    with pytest.raises(Exception, match="larger than supported"):
        df.select(buckets.bucket_size("w", "h", strict=True)).collect()
    shapes = [(80, 40, 32, (32, 16)), (40, 80, 64, (32, 64)), (48, 48, 128, (48, 48))]
    for w, h, stage, want in shapes:
        s = one(spark, buckets.stage_shape(F.lit(w), F.lit(h), stage).alias("s"))["s"]
        assert (s["w"], s["h"]) == want


def test_palette_cases(spark):
    six = np.array([[[0, 0, 0, 0], [255, 0, 0, 128], [0, 255, 0, 255]], [[0, 0, 255, 255], [255, 255, 0, 255], [255, 255, 255, 255]]])
    hidden = np.array([[[255, 0, 0, 0], [255, 0, 0, 255]]])
    nine = np.array([[[i * 20, 0, 255 - i * 20, 255] for i in range(9)]])
    checker = solid(128, 128, (0, 0, 0, 255))
    checker[..., 0] = np.indices((128, 128)).sum(axis=0) % 2 * 255
    images = {0: six, 1: hidden, 2: nine, 3: checker, 4: solid(1, 1, (0, 0, 0, 0))}
    enc = quantize.encode_images(image_frame(spark, images), "i", 8).withColumn("back", px.decode_indices("indices", "palette"))
    got = {r["i"]: r for r in enc.collect()}
    for i in (0, 3):
        assert got[i]["back"] == packed(images[i]).tolist() and not got[i]["lossy"]
    assert got[0]["palette"][0] == 0 and got[0]["palette"][1] >> 24 == 128
    assert got[1]["palette"] == [0, 0xFFFF0000] and got[1]["indices"] == [0, 1]
    assert got[2]["lossy"] and got[2]["unique_color_count"] == 9 and got[2]["palette_size"] <= 8 and got[2]["back"] != packed(nine).tolist()
    assert got[4]["palette"] == [0]
    for bad in (7, 65):
        with pytest.raises(ValueError, match="between 8 and 64"):
            quantize.encode_images(image_frame(spark, images), "i", bad)


def test_box_palettes_keep_the_contract(spark):
    rng = np.random.default_rng(1)
    images = {i: rng.integers(0, 256, (12, 11, 4)) for i in range(6)}
    for i, a in images.items():
        a[..., 3] = 255 if i % 2 else rng.choice([0, 200, 255], (12, 11))
    for budget in (8, 13, 64):
        enc = quantize.encode_images(image_frame(spark, images), "i", budget)
        again = {r["i"]: r["palette"] for r in enc.collect()}
        for r in enc.collect():
            assert r["palette"] == again[r["i"]] == sorted(r["palette"]) and len(r["palette"]) == len(set(r["palette"])) <= budget
            pixels, clear = packed(images[r["i"]]), r["i"] % 2 == 0
            assert (r["palette"][0] == 0) == clear and all(c >> 24 == 255 for c in r["palette"][clear:])
            colors = np.array(r["palette"])
            for p, index in zip(pixels, r["indices"]):
                if p >> 24 == 0:
                    assert index == 0
                    continue
                d = sum(((p >> s & 255) - (colors >> s & 255)) ** 2 for s in (0, 8, 16))[int(clear):]
                assert index == int(np.argmin(d)) + clear


def test_out_of_palette_index_is_an_error(spark):
    df = spark.createDataFrame([([0, 3], [0, 1])], "i array<int>, p array<bigint>")
    with pytest.raises(Exception, match="outside the palette"):
        df.select(px.decode_indices("i", "p")).collect()


def test_palette_reordering_keeps_the_image(spark):
    df = spark.createDataFrame([([0, 1, 2, 1], [0xFFFF0000, 0, 0xFF0000FF])], "i array<int>, p array<bigint>")
    r = df.select(px.remap_palette("i", "p").alias("r")).first()["r"]
    assert r["palette"] == [0, 0xFF0000FF, 0xFFFF0000] and r["indices"] == [2, 0, 1, 0]


def naive_over(b, s):
    """8-bit source-over for one pixel, from the definition."""
    sa, ba = s >> 24, b >> 24
    if sa == 0:
        return b
    w = sa * 255 + ba * (255 - sa)
    k = sa * 255 * 255 * 128 // w
    div = lambda v: ((v >> 8) + v) >> 8
    out = div(w + 128) << 24
    for shift in (16, 8, 0):
        out |= (div((s >> shift & 255) * k + (b >> shift & 255) * (255 * 128 - k) + (128 << 7)) >> 7) << shift
    return out


def test_composition_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    images = {i: rng.integers(0, 256, (int(rng.integers(3, 20)), int(rng.integers(3, 20)), 4)) for i in range(9)}
    for i in (7, 8):
        images[i][..., 3] = 255
    assets = image_frame(spark, images).withColumn("rel_path", F.format_string("a%02d", "i"))
    assets = assets.withColumn("license", F.when(F.col("i") < 4, "cc0").otherwise("mit"))
    scenes = spark.range(12).withColumnRenamed("id", "scene_id")
    rows = compose.compose_scenes(assets, scenes, seed=5, canvas=24).collect()
    again = compose.compose_scenes(assets, scenes, seed=5, canvas=24).collect()
    other = compose.compose_scenes(assets, scenes, seed=6, canvas=24).collect()
    assert sorted(rows) == sorted(again) and {tuple(r["parents"]) for r in rows} != {tuple(r["parents"]) for r in other}
    assert len(rows) == 12
    layers = compose.layer_draws(scenes, 7, 5).collect()
    assert all(0 <= r["position"] < 7 for r in layers)
    for r in rows:
        assert len(set(r["parents"])) == 6 and not {"a07", "a08"} & set(r["parents"]) and len(r["pixels"]) == 24 * 24
        licenses_ = {"cc0" if int(p[1:]) < 4 else "mit" for p in r["parents"]}
        assert r["license"] == (licenses_.pop() if len(licenses_) == 1 else "mixed permissive")
    layer = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(a.shape[1]).alias("w"), F.lit(a.shape[0]).alias("h"),
                               F.array(*[F.lit(int(p)).cast("bigint") for p in packed(a)]).alias("pixels")) for x, y, a in ((0, 2, images[0][:4, :4]), (2, 3, images[1][:5, :3]), (20, 22, images[2][:3, :3]))])
    got = one(spark, px.composite_layers(layer, 22, 24).alias("p"))["p"]
    want = np.zeros((24, 22), dtype=np.int64)
    for x, y, a in ((0, 2, images[0][:4, :4]), (2, 3, images[1][:5, :3]), (20, 22, images[2][:3, :3])):
        cells = packed(a).reshape(a.shape[:2])
        for dy in range(a.shape[0]):
            for dx in range(a.shape[1]):
                if y + dy < 24 and x + dx < 22:
                    want[y + dy, x + dx] = naive_over(int(want[y + dy, x + dx]), int(cells[dy, dx]))
    assert got == want.reshape(-1).tolist()


def test_drawn_layers_are_not_broadcast(spark):
    assets = image_frame(spark, {i: solid(4, 4, (1, 1, i, 0)) for i in range(9)})
    assets = assets.withColumn("rel_path", F.col("i").cast("string")).withColumn("license", F.lit("cc0"))
    plan = compose.compose_scenes(assets, spark.range(12).withColumnRenamed("id", "scene_id"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [position" in plan and "BroadcastHashJoin [position" not in plan


def test_too_few_transparent_assets_give_no_scene(spark):
    assets = image_frame(spark, {0: solid(4, 4, (1, 1, 1, 0)), 1: solid(4, 4, (1, 1, 1, 255))})
    assets = assets.withColumn("rel_path", F.col("i").cast("string")).withColumn("license", F.lit("cc0"))
    assert compose.compose_scenes(assets, spark.range(3).withColumnRenamed("id", "scene_id")).count() == 0


def test_two_assets_give_two_layers(spark):
    assets = image_frame(spark, {0: solid(4, 4, (1, 1, 1, 0)), 1: solid(4, 4, (1, 1, 1, 9))})
    assets = assets.withColumn("rel_path", F.col("i").cast("string")).withColumn("license", F.lit("cc0"))
    rows = compose.compose_scenes(assets, spark.range(3).withColumnRenamed("id", "scene_id")).collect()
    assert all(sorted(r["parents"]) == ["0", "1"] for r in rows) and len(rows) == 3


def hot_rows(spark, n=6000):
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select(F.format_string("k%06d", "id").alias("key"), group.alias("group"))


def test_seeded_rank_take_and_split_agree_with_one_sort(spark):
    import hashlib

    rows = hot_rows(spark)
    local = [(r["key"], r["group"]) for r in rows.collect()]

    def order(keys, seed):
        return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))

    ranked = {r["key"]: r["rank"] for r in shuffles.seeded_rank(rows, ["key"], 3, ["group"]).collect()}
    taken = {r["key"] for r in shuffles.seeded_take(rows, ["key"], 3, F.lit(37), ["group"]).collect()}
    for group in {g for _, g in local}:
        keys = order([k for k, g in local if g == group], 3)
        assert [ranked[k] for k in keys] == list(range(1, len(keys) + 1))
        assert {k for k in keys if k in taken} == set(keys[:37])
    split = {r["key"]: r["split"] for r in batches.train_val_test_split(rows, "key", 0.25, 0.1, 3).collect()}
    keys = order([k for k, _ in local], 3)
    assert [split[k] for k in keys] == ["test"] * 600 + ["validation"] * 1500 + ["train"] * 3900
    place = {r["key"]: r["rank"] for r in shuffles.ordered_rank(rows.repartition(7), F.col("key")).collect()}
    assert [place[k] for k in sorted(place)] == list(range(1, 6001))


def test_splits_are_exact_and_seeded(spark):
    rows = spark.range(12).select(F.col("id").cast("string").alias("key"))
    a, b, c = ({r["key"]: r["split"] for r in batches.train_validation_split(rows, "key", 0.25, s).collect()} for s in (123, 123, 456))
    assert a == b != c and list(a.values()).count("validation") == 3
    tiny = batches.train_validation_split(spark.range(1).select(F.col("id").cast("string").alias("key")), "key", 0.2)
    assert [r["split"] for r in tiny.collect()] == ["validation"]


def test_lookup_join_spreads_hot_keys_and_keeps_rows(spark):
    rows = hot_rows(spark)
    weights = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    out = shuffles.lookup_join(rows.unionByName(spark.createDataFrame([("x", None), ("y", "absent")], "key string, group string")), weights, ["group"], "n", ["key"])
    assert out.count() == 6002
    assert out.where("group = 'hot' and n = 2000").count() == 2000 and out.where("n is null").count() == 2


def test_lookup_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(shuffles, "HEAVY_KEYS", 2)
    rows = hot_rows(spark)
    weights = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    out = shuffles.lookup_join(rows, weights, ["group"], "n", ["key"])
    want = {r["group"]: r["n"] for r in weights.collect()}
    assert all(want[r["group"]] == r["n"] for r in out.collect()) and out.count() == 6000


def test_balanced_sample_caps(spark):
    rows = hot_rows(spark)
    assert curate.balanced_sample(rows, 100, 10, 1, "key").count() == 100
    assert curate.balanced_sample(rows, 10_000, 10, 1, "key").count() == 510
    cap = curate.sample_cap(rows, 100, None)
    assert cap == 2 and curate.sample_cap(rows, 100, 0) == 2
    a, b = (sorted(r["key"] for r in curate.balanced_sample(rows, 60, 2, s, "key").collect()) for s in (1, 2))
    assert a != b and len(a) == 60


def test_batches_hold_one_bucket(spark):
    rows = hot_rows(spark, 500).withColumnRenamed("group", "bucket")
    for drop_last in (False, True):
        out = batches.bucket_batches(rows, "key", 8, 7, drop_last).collect()
        want = sum(r["batches"] for r in batches.batch_counts(rows, 8, drop_last).collect())
        ids = {r["batch_id"] for r in out}
        assert ids == set(range(want))
        for i in ids:
            part = [r for r in out if r["batch_id"] == i]
            assert len({r["bucket"] for r in part}) == 1 and sorted(r["slot"] for r in part) == list(range(len(part)))
            assert len(part) == 8 or not drop_last
        assert drop_last or len(out) == 500


def test_collate_pads_to_the_batch(spark):
    images = {0: solid(2, 3, (255, 0, 0, 255)), 1: solid(4, 1, (0, 0, 0, 0))}
    enc = quantize.encode_images(image_frame(spark, images), "i").withColumn("batch_id", F.lit(0)).withColumn("slot", F.col("i"))
    a, b = batches.collate(enc).orderBy("slot").collect()
    assert (a["batch_width"], a["batch_height"]) == (4, 3)
    assert a["indices"] == [0, 0, -1, -1] * 3 and a["valid_mask"] == [True, True, False, False] * 3 and a["structure"] == [1, 1, 0, 0] * 3
    assert b["valid_mask"] == [True] * 4 + [False] * 8 and b["indices"][4:] == [-1] * 8 and b["structure"] == [0] * 12


@pytest.mark.parametrize("call", [
    lambda d: batches.train_validation_split(d, "key", 0.0),
    lambda d: batches.train_validation_split(d, "key", 1.0),
    lambda d: batches.train_val_test_split(d, "key", 0.5, 0.5),
    lambda d: batches.train_val_test_split(d, "key", 0.0, 0.5),
    lambda d: targets.masked_cells(d, 1, 0, 0.0, 1.0),
    lambda d: targets.masked_cells(d, 1, 0, 0.6, 0.5),
])
def test_parameter_guards(spark, call):
    with pytest.raises(ValueError):
        call(spark.range(1).select(F.col("id").cast("string").alias("key")))


def test_masking_golden(spark):
    cells = spark.createDataFrame([(0, p, p + 1, p not in (2, 5)) for p in range(6)] + [(1, 0, 9, False)], "image_id int, pos int, token int, valid boolean")
    out = {(r["image_id"], r["pos"]): (r["masked"], r["label"]) for r in targets.masked_cells(cells, 99, 0, 1.0, 1.0).collect()}
    assert all(out[0, p] == ((99, p + 1) if p not in (2, 5) else (p + 1, -100)) for p in range(6)) and out[1, 0] == (9, -100)
    few = targets.masked_cells(cells, 99, 0, 0.01, 0.01).where("label <> -100").count()
    assert few == 1


def test_noise_extremes(spark):
    df = spark.range(200).select(F.col("id"), F.lit(500).alias("t"), (F.col("id") % 2 == 0).alias("valid"))
    all_ = df.select("valid", targets.noisy_token(F.col("t"), F.col("valid"), 128, 1.0, 1, F.col("id")).alias("n")).collect()
    assert all((0 <= r["n"] < 128) if r["valid"] else r["n"] == 500 for r in all_)
    assert df.select(targets.noisy_token(F.col("t"), F.col("valid"), 128, 0.0, 1, F.col("id")).alias("n")).distinct().count() == 1


def test_resize_and_pooling_shapes(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], 3, 2)], "v array<int>, w int, h int")
    r = df.select(
        grids.resize_nearest("v", F.col("w"), F.col("h"), F.lit(6), F.lit(4)).alias("up"),
        grids.pool_any(F.transform("v", lambda x: x == 6), F.col("w"), F.col("h"), F.lit(2), F.lit(1)).alias("pool"),
        grids.pad_grid("v", F.col("w"), F.col("h"), F.lit(4), F.lit(3), F.lit(0)).alias("pad"),
    ).first()
    assert r["up"] == [1, 1, 2, 2, 3, 3] * 2 + [4, 4, 5, 5, 6, 6] * 2
    assert r["pool"] == [False, True] and r["pad"] == [1, 2, 3, 0, 4, 5, 6, 0, 0, 0, 0, 0]


def test_embeddings(spark):
    df = spark.createDataFrame([("red potion icon",), ("RED_potion icon",), ("stone house",), ("zzz",), ("object-less",)], "text string")
    e = {r["text"]: np.array(r["e"]) for r in df.select("text", embed.text_embedding("text").alias("e")).collect()}
    assert all(len(x) == 64 and abs(np.linalg.norm(x) - 1) < 1e-9 for x in e.values())
    assert np.allclose(e["red potion icon"], e["RED_potion icon"]) and not np.allclose(e["red potion icon"], e["stone house"])
    assert np.allclose(e["zzz"], e["object-less"])
    counts = df.select("text", embed.feature_counts("text").alias("c")).where("text = 'red potion icon'").first()["c"]
    want = {"red": 1, "object": 1, "transparent": 2, "round": 1, "fantasy": 1, "icon": 1, "edge": 1}
    assert {f: int(c) for f, c in zip(embed.FEATURES, counts) if c} == want
    one_image = image_frame(spark, {0: solid(2, 2, (10, 20, 30, 255))})
    stats = one_image.select(embed.image_statistics("pixels").alias("s")).first()["s"]
    assert np.allclose(stats, [20, np.std([10, 20, 30]), 255])


def test_prompt_set_covers_every_category(spark):
    prompts = spark.createDataFrame([(p,) for p in embed.EVALUATION_PROMPTS], "prompt string")
    assert all(r["covered"] for r in embed.prompt_coverage(prompts).collect())


@pytest.mark.parametrize("bytes_at_once", [32 << 20, 400])
def test_codebook_assignment(spark, monkeypatch, bytes_at_once):
    monkeypatch.setattr(metrics, "BOOK_BYTES", bytes_at_once)
    monkeypatch.setattr(metrics, "CODES", 3)
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.9]), (2, None), (3, [1.0])], "i int, v array<double>")
    book = spark.createDataFrame([(5, [1.0, 1.0]), (2, [1.0, -1.0]), (9, [0.0, 1.0])], "code int, vector array<double>")
    assert {r["i"]: r["code"] for r in metrics.assign_codes(vectors, book, "v").collect()} == {0: 2, 1: 9, 2: None, 3: None}
    assert {r["code"] for r in metrics.assign_codes(vectors, book.where("code < 0"), "v").collect()} == {None}
    rng = np.random.default_rng(4)
    codes = np.round(rng.normal(size=(60, 4)) * np.arange(1, 61)[:, None] / 9, 1)
    codes = np.concatenate([codes, codes[:20]])  # equal entries: the lowest code wins
    x = np.round(rng.normal(size=(200, 4)) * rng.uniform(0, 9, (200, 1)), 1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").repartition(3)
    entries = spark.createDataFrame([(f"c{99 - i:02d}", v.tolist()) for i, v in enumerate(codes)], "name string, entry array<double>")
    got = {r["i"]: r["code"] for r in metrics.assign_codes(frame, entries, "v", "name", "entry").collect()}
    for i, v in enumerate(x):
        distances = ((codes - v) ** 2).sum(axis=1)
        assert got[i] == min(f"c{99 - j:02d}" for j in np.flatnonzero(distances <= distances.min() + 1e-12))


def test_step_metrics_golden(spark):
    rows = [(s, [0, 1, 1, 0] if s else [0, 1, 1, 1], [0, 1, 1, 0], [True] * 4, 2, 2) for s in (0, 1, 2, 4)]
    df = spark.createDataFrame(rows, "step int, pred array<int>, target array<int>, valid array<boolean>, width int, palette_size int")
    out = {r["step"]: r for r in metrics.step_metrics(df, "step").collect()}
    assert out[0]["index_accuracy"] == 0.75 and out[0]["edge_detail"] == 0.5 and out[0]["palette_consistency"] == 1
    assert all(out[s]["index_accuracy"] == out[s]["edge_detail"] == out[s]["transparency"] == 1 for s in (1, 2, 4))


def test_conform_adds_missing_columns(spark):
    rows = conform(spark.createDataFrame([("a", 3)], "rel_path string, width bigint"))
    assert rows.schema["width"].dataType.simpleString() == "int" and rows.first()["phash"] is None


def test_nearest_entries_of_many_colors(spark):
    import time

    rng = np.random.default_rng(6)
    pixels = np.arange(128 * 128) * 977 % (1 << 24) | 255 << 24
    pixels[::50] &= (1 << 24) - 1
    colors = np.unique(rng.integers(0, 1 << 24, 16_384) | 255 << 24)
    colors = np.concatenate([[0], colors, colors[:3]])
    rows = [(0, pixels.tolist(), colors.tolist()), (1, pixels[:300].tolist(), colors[1:40].tolist()), (2, None, colors.tolist()), (3, [], [])]
    df = spark.createDataFrame(rows, "i int, p array<bigint>, c array<bigint>").cache()
    df.count()
    start = time.perf_counter()
    got = {r["i"]: r["n"] for r in df.select("i", px.nearest_indices("p", "c").alias("n")).collect()}
    assert time.perf_counter() - start < 20
    assert got[2] is None and got[3] == []

    def nearest(p, palette):
        if palette[0] == 0 and p < 1 << 24:
            return 0
        p, start = 0 if p < 1 << 24 else p, int(palette[0] == 0)
        return min(range(start, len(palette)), key=lambda i: (sum(((p >> s & 255) - (int(palette[i]) >> s & 255)) ** 2 for s in (16, 8, 0)), i))

    assert got[1] == [nearest(int(p), colors[1:40]) for p in pixels[:300]]
    for at in range(0, len(pixels), 1601):
        assert got[0][at] == nearest(int(pixels[at]), colors)
    df.unpersist()


@pytest.mark.parametrize("ranges,sorted_at_once", [(255, 1_000_000), (3, 5), (1, 1)])
def test_first_rows_by_path(spark, ranges, sorted_at_once):
    from pixelspark.operators.curate import first_rows

    rng = np.random.default_rng(7)
    paths = ["/".join(rng.choice(["a", "b", "a b", "A", "é", "a-b"], rng.integers(1, 5))) for _ in range(400)] + [None, "", "a", "a", "a"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, rel_path string").repartition(4)
    ordered = sorted((p or "").split("/") for p in paths)
    key = F.replace(F.col("rel_path"), F.lit("/"), F.lit("\x00"))
    for limit in (1, 2, 3, 57, 200, 404, 405, 900):
        got = shuffles.ordered_take(df, key, limit, ranges, sorted_at_once).collect()
        assert sorted((r["rel_path"] or "").split("/") for r in got) == ordered[:limit] and len({r["i"] for r in got}) == len(got)
    assert first_rows(df, None).count() == 405 and first_rows(df, 7).count() == 7 and first_rows(df.limit(0), 7).count() == 0
    plan = first_rows(df, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("Sorted", "") and "Scan ExistingRDD" in plan


def test_embedding_projects_only_what_a_text_has(spark):
    """Words between any white space or underscores, as a dense projection of all counts gives; no other word is made."""
    texts = ["red_potion icon", "Red RED\xa0red\tstone gray\n", "redder stones", "", "_grass__grass_", "water\x1cice fire", "no known word"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    matrix = embed.projection(len(embed.FEATURES), 64, unit_rows=True)
    for r in df.select("text", embed.feature_counts("text").alias("c"), embed.text_embedding("text").alias("e")).collect():
        words = re.split(r"[\t-\r \x85\xa0]+", r["text"].lower().replace("_", " "))
        hits = [f for w in words for f in embed.WORD_FEATURES.get(w, (w,) if w in embed.FEATURES else ())] or [embed.FALLBACK_FEATURE]
        assert r["c"] == [hits.count(f) for f in embed.FEATURES]
        dense = np.array(r["c"]) @ matrix
        assert np.allclose(r["e"], dense / np.linalg.norm(dense), atol=1e-12)
    assert "split(" not in df.select(embed.text_embedding("text"))._jdf.queryExecution().toString()


def boxes_of(colors, budget, most):
    """One list of colours per box, round after round."""
    boxes = {0: sorted(colors)}
    count = 1
    while count < most:
        fullest = sorted(boxes, key=lambda b: (-len(boxes[b]), b))[: max(0, budget - count)]
        out = {}
        for b, cs in boxes.items():
            spread = [max(c >> s & 255 for c in cs) - min(c >> s & 255 for c in cs) for s in (16, 8, 0)]
            shift = (16, 8, 0)[spread.index(max(spread))]
            cs = sorted(cs, key=lambda c: (c >> shift & 255, c))
            cut = (len(cs) + 1) // 2 if b in fullest else len(cs)
            out |= {2 * b + i: part for i, part in enumerate((cs[:cut], cs[cut:])) if part}
        boxes, count = out, 2 * count
    mean = lambda cs, s: (2 * sum(c >> s & 255 for c in cs) + len(cs)) // (2 * len(cs))
    return sorted({255 << 24 | mean(cs, 16) << 16 | mean(cs, 8) << 8 | mean(cs, 0) for cs in boxes.values()})


@pytest.mark.parametrize("budget", [8, 13, 16, 64])
def test_box_palettes_stay_in_the_row(spark, budget):
    rng = np.random.default_rng(budget)
    rows = [(i, [int(255 << 24 | c) for c in rng.integers(0, 1 << (24 if i % 2 else 9), n)] + [0] * (i % 3)) for i, n in enumerate([1, 8, 14, 40, 200, 700])]
    df = spark.createDataFrame(rows, "i int, pixels array<bigint>")
    got = quantize.box_palettes(df, "i", budget)
    assert not re.search("Exchange|Window|Sort", got._jdf.queryExecution().toString())
    assert not re.search("Exchange|Window|Join", quantize.encode_images(df, "i", budget)._jdf.queryExecution().toString())
    for r in got.collect():
        pixels = rows[r["i"]][1]
        clear = 0 in pixels
        colors = {p for p in pixels if p}
        want = sorted(colors) if len(colors) <= budget - clear else boxes_of(colors, budget - clear, budget)
        assert r["palette"] == [0] * clear + want


def test_scene_checksums_take_no_interpreted_pass(spark):
    """Cells are summed by compiled code, a row each."""
    from pixelspark.checks import QUERIES

    plan = QUERIES["j12_scene_composition"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "posexplode(" in plan.lower()
