import struct

import numpy as np
import pytest

from pixelspark.functions.hashing import _axis_taps, hash_to_bits, with_perceptual_hash
from pixelspark.sources.files import decode_files, read_images
from pixelspark.sources.png import decode, png_header

from images import chunk, packed, png, raw_png, save, solid

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("shape", [(1, 1), (7, 2), (3, 13), (16, 16), (40, 33)])
@pytest.mark.parametrize("indexed", [False, True])
def test_filters_round_trip(shape, indexed):
    colors = RNG.integers(0, 256, (9, 4))
    rgba = colors[RNG.integers(0, 9, shape)]
    width, height, pixels, text = decode(png(rgba, indexed, "hello"))
    assert (height, width) == shape and text == {"caption": "hello"}
    assert np.array_equal(pixels, packed(rgba))


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_gray_depths(depth, interlace):
    g = RNG.integers(0, 1 << depth, (9, 11, 1))
    _, _, pixels, _ = decode(raw_png(11, 9, depth, 0, g, interlace=interlace))
    want = (g[..., 0] >> 8 if depth == 16 else g[..., 0] * 255 // ((1 << depth) - 1)).reshape(-1)
    assert np.array_equal(pixels, 255 << 24 | want << 16 | want << 8 | want)


@pytest.mark.parametrize("interlace", [False, True])
def test_gray_alpha_keeps_its_alpha(interlace):
    ga = RNG.integers(0, 256, (5, 6, 2))
    _, _, pixels, _ = decode(raw_png(6, 5, 8, 4, ga, interlace=interlace))
    assert np.array_equal(pixels >> 24, ga[..., 1].reshape(-1)) and np.array_equal(pixels & 255, ga[..., 0].reshape(-1))


def test_rgb_with_transparent_colour():
    rgb = np.zeros((2, 2, 3), dtype=int)
    rgb[0, 0] = (1, 2, 3)
    _, _, pixels, _ = decode(raw_png(2, 2, 8, 2, rgb, chunk(b"tRNS", struct.pack(">HHH", 1, 2, 3))))
    assert (pixels >> 24).tolist() == [0, 255, 255, 255]


def test_packed_indices():
    plte = chunk(b"PLTE", bytes([10, 20, 30, 40, 50, 60, 70, 80, 90]))
    cells = np.array([[[0], [1], [2]], [[2], [1], [0]]])
    _, _, pixels, _ = decode(raw_png(3, 2, 2, 3, cells, plte))
    assert (pixels >> 16 & 255).tolist() == [10, 40, 70, 70, 40, 10]


@pytest.mark.parametrize("broken", [b"not a png", b"", png(solid(8, 8, (1, 2, 3, 255)))[:50], raw_png(4, 4, 8, 0, np.zeros((2, 4, 1), dtype=int))])
def test_broken_content_is_refused(broken):
    with pytest.raises(Exception):
        decode(broken)


def test_changed_content_fails_its_checksum():
    data = bytearray(png(solid(8, 8, (1, 2, 3, 255))))
    data[-20] ^= 1
    with pytest.raises(Exception):
        decode(bytes(data))


def test_decode_files_measures_but_skips_large_images(spark):
    big = png(solid(129, 8, (1, 2, 3, 255)))
    rows = [("big", big), ("ok", png(solid(3, 2, (1, 2, 3, 255)))), ("bad", b"no"), ("none", None)]
    df = spark.createDataFrame(rows, "name string, content binary")
    got = {r["name"]: r for r in decode_files(df, max_side=128).collect()}
    assert (got["big"]["width"], got["big"]["height"], got["big"]["pixels"]) == (129, 8, None)
    assert (got["ok"]["width"], got["ok"]["height"], len(got["ok"]["pixels"])) == (3, 2, 6)
    assert got["bad"]["width"] is None and got["none"]["width"] is None
    head = df.select(png_header("content").alias("h")).collect()
    assert head[0]["h"]["color_type"] == 6 and head[2]["h"] is None


def test_built_in_image_source_agrees(spark, tmp_path):
    rgba = RNG.integers(0, 256, (5, 7, 4))
    save(tmp_path / "a" / "x.png", rgba)
    save(tmp_path / ".hidden" / "y.png", rgba)
    (tmp_path / "bad.png").write_bytes(b"not a png")
    got = {r["rel_path"]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/x.png", "bad.png"}
    assert got["a/x.png"]["pixels"] == packed(rgba).tolist()
    assert got["bad.png"]["pixels"] is None and got["bad.png"]["width"] is None


def reference_hash(rgba):
    """The hash computed from the definition, one axis after the other."""
    r, g, b = (rgba[..., i].astype(np.int64) for i in range(3))
    gray = (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16

    def shrink(values, n):
        taps = _axis_taps(n)
        return np.stack([(sum(values[lo + j] * k for j, k in enumerate(ks)) + (1 << 21)) >> 22 for lo, ks in taps])

    small = shrink(shrink(gray.T, gray.shape[1]).T, gray.shape[0]).reshape(-1)
    return "".join("1" if 64 * v >= small.sum() else "0" for v in small)


def test_hash_of_many_shapes(spark):
    rows, want = [], {}
    for i, (h, w) in enumerate([(1, 1), (8, 8), (7, 9), (13, 3), (128, 128), (100, 17), (5, 64)]):
        rgba = RNG.integers(0, 256, (h, w, 4))
        rows.append((i, w, h, packed(rgba).tolist()))
        want[i] = reference_hash(rgba)
    rows.append((99, 200, 1, [0] * 200))
    want[99] = None
    df = spark.createDataFrame(rows, "i int, width int, height int, pixels array<bigint>")
    got = {r["i"]: r["b"] for r in with_perceptual_hash(df).select("i", hash_to_bits("phash").alias("b")).collect()}
    assert got == want


def test_taps_sum_to_one():
    for n in range(1, 129):
        for lo, ks in _axis_taps(n):
            assert lo >= 0 and lo + len(ks) <= n and abs(sum(ks) - (1 << 22)) <= len(ks)


def test_decoded_images_are_handed_over_in_parts(monkeypatch):
    """The parts of a batch are bounded by pixels, and joined they are the batch."""
    import pandas as pd

    from pixelspark.checks.views import _write_png
    from pixelspark.functions import hashing
    from pixelspark.sources import png

    files = [_write_png(8, 8, np.arange(64) + (255 << 24), bool(i % 2), f"sprite {i}") for i in range(40)]
    files[7], files[20] = None, files[20][:50]
    whole = list(png._decode_png.func(iter([pd.Series(files[:25]), pd.Series(files[25:])])))
    monkeypatch.setattr(png, "PIXELS_AT_ONCE", 500)
    parts = list(png._decode_png.func(iter([pd.Series(files[:25]), pd.Series(files[25:])])))
    assert len(whole) == 2 and max(map(len, parts)) <= 8
    a, b = pd.concat(whole, ignore_index=True), pd.concat(parts, ignore_index=True)
    assert len(a) == len(b) == 40 and a["width"].equals(b["width"]) and a["png_text"].equals(b["png_text"])
    assert all((x is None and y is None) or (x == y).all() for x, y in zip(a["pixels"], b["pixels"]))
    assert hashing.PIXELS_AT_ONCE <= 1 << 17
