import numpy as np
from pyspark.sql import functions as F

from pixelspark.functions import components
from pixelspark.operators.metrics import pair_metrics
from pixelspark.operators.targets import with_regions
from pixelspark.plans.curation import sheet_pieces

from images import packed, solid


def flood(grid, diagonal):
    """First raster position of every cell's component, -1 for background."""
    h, w = grid.shape
    out = np.full((h, w), -1)
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not (dy and dx))]
    for y in range(h):
        for x in range(w):
            if grid[y, x] < 0 or out[y, x] >= 0:
                continue
            todo = [(y, x)]
            out[y, x] = y * w + x
            while todo:
                cy, cx = todo.pop()
                for dy, dx in steps:
                    ny, nx = cy + dy, cx + dx
                    if 0 <= ny < h and 0 <= nx < w and out[ny, nx] < 0 and grid[ny, nx] == grid[y, x]:
                        out[ny, nx] = y * w + x
                        todo.append((ny, nx))
    return out


def random_grids(n=60):
    rng = np.random.default_rng(5)
    for i in range(n):
        h, w = rng.integers(1, 14, 2)
        yield i, rng.integers(-1, rng.integers(1, 4), (h, w))


def test_labels_match_flood_fill(spark):
    grids = dict(random_grids())
    spiral = np.full((21, 21), -1)
    y = x = 0
    dy, dx = 0, 1
    for _ in range(230):
        spiral[y, x] = 0
        ny, nx = y + 2 * dy, x + 2 * dx
        if not (0 <= ny < 21 and 0 <= nx < 21) or spiral[ny, nx] == 0:
            dy, dx = dx, -dy
        y, x = min(20, max(0, y + dy)), min(20, max(0, x + dx))
    grids[1000] = spiral
    rows = [(i, g.shape[1], g.reshape(-1).tolist()) for i, g in grids.items()]
    df = spark.createDataFrame(rows, "i int, width int, v array<int>").repartition(3)
    out = components.with_component_labels(df, "v", out="four")
    out = components.with_component_labels(out, "v", out="eight", diagonal=True)
    out = out.withColumn("n", components.component_count("four")).withColumn("big", components.largest_component("four"))
    for r in out.collect():
        four = flood(grids[r["i"]], False).reshape(-1)
        assert r["four"] == four.tolist()
        assert r["eight"] == flood(grids[r["i"]], True).reshape(-1).tolist()
        labels, sizes = np.unique(four[four >= 0], return_counts=True)
        assert r["n"] == len(labels)
        if len(labels):
            best = max(zip(sizes, -labels))
            assert (r["big"]["label"], r["big"]["n"]) == (-best[1], best[0])
        else:
            assert r["big"] is None


def test_region_golden_grid_and_recolouring(spark):
    colors = [0, 0xFFFF0000]
    other = [0, 0xFF00FF00]
    rows = [(p, 3, [1, 0, 1, 0, 0, 0, 1, 1, 0], c) for p, c in (("a", colors), ("b", other))]
    df = spark.createDataFrame(rows, "p string, width int, indices array<int>, palette array<bigint>")
    for r in with_regions(df, max_regions=7).collect():
        assert r["structure"] == [1, 0, 2, 0, 0, 0, 3, 3, 0]


def test_regions_beyond_the_cap_are_background(spark):
    n = 70
    df = spark.createDataFrame([(2 * n, [i % 2 for i in range(2 * n)], [0, 0xFF010203])], "width int, indices array<int>, palette array<bigint>")
    got = with_regions(df).first()["structure"]
    assert max(got) == 64 and got[2 * 64 + 1] == 0 and got[2 * 63 + 1] == 64


def test_sheet_boxes_match_brute_force(spark):
    rng = np.random.default_rng(9)
    images, want = [], {}
    for i in range(30):
        h, w = 12, 20
        mask = rng.random((h, w)) < (0.25 if i % 2 else 0.4)
        rgba = solid(w, h, (0, 0, 0, 0)) if i % 3 else solid(w, h, (9, 9, 9, 255))
        rgba[mask] = (200, 10, 10, 255)
        if i % 3 == 0:
            rgba[0, 0] = (9, 9, 9, 255)
            mask[0, 0] = False
        labels = flood(np.where(mask, 1, -1), True)
        boxes = []
        for label in np.unique(labels[labels >= 0]):
            ys, xs = np.nonzero(labels == label)
            box = (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
            if len(ys) >= 4 and box[2] - box[0] <= 8 and box[3] - box[1] <= 8:
                boxes.append(tuple(map(int, box)))
        boxes.sort(key=lambda b: (b[1], b[0]))
        want[i] = boxes if len(boxes) >= 2 else []
        images.append((i, w, h, packed(rgba).tolist()))
    df = spark.createDataFrame(images, "i int, width int, height int, pixels array<bigint>")
    for r in sheet_pieces(df, 8).collect():
        assert [tuple(b) for b in r["boxes"]] == want[r["i"]], r["i"]


def test_metrics_are_one_on_match_and_drop_on_mismatch(spark):
    a = solid(4, 4, (0, 0, 0, 0))
    a[1:3, 1:3] = (255, 0, 0, 255)
    b = solid(4, 4, (0, 0, 0, 0))
    b[0:2, 0:2] = (0, 0, 255, 255)
    b[3, 3] = (0, 0, 255, 128)
    rows = [(i, *x, *y) for i, (x, y) in enumerate([((packed(a).tolist(), 4, 4),) * 2, ((packed(b).tolist(), 4, 4), (packed(a).tolist(), 4, 4))])]
    names = "pair_id int, pred_pixels array<bigint>, pred_width int, pred_height int, target_pixels array<bigint>, target_width int, target_height int"
    same, other = pair_metrics(spark.createDataFrame(rows, names), "pair_id").orderBy("pair_id").collect()
    assert same["component_count_error"] == 0
    assert all(same[m] == 1 for m in same.asDict() if m not in ("pair_id", "component_count_error"))
    assert other["component_count_error"] == 1
    assert all(other[m] < 1 for m in other.asDict() if m not in ("pair_id", "component_count_error"))


def test_value_regions_number_by_first_appearance(spark):
    df = spark.createDataFrame([(4, [2, 0, 1, 2], [0, 0xFF000001, 0xFF000002])], "width int, indices array<int>, palette array<bigint>")
    assert with_regions(df, connected=False).select(F.col("structure")).first()[0] == [1, 0, 2, 1]


def test_many_components_take_linear_time(spark):
    """A noisy sheet of 1,000,000 cells, a third of them a component or a few each."""
    import time

    side = 1000
    noise = np.random.default_rng(5).integers(-1, 3, side * side)
    df = spark.createDataFrame([(noise.tolist(), side)], "v array<int>, width int")
    df = components.with_component_labels(df, "v", "width").cache()
    df.count()
    start = time.perf_counter()
    best = df.select(components.largest_component("labels").alias("b"), F.size(components.sheet_boxes("labels", "width", 64)).alias("n")).first()
    took = time.perf_counter() - start
    labels = np.array(df.first()["labels"])
    names, counts = np.unique(labels[labels >= 0], return_counts=True)
    assert (best["b"]["label"], best["b"]["n"]) == (names[counts.argmax()], counts.max()) and best["n"] > 1000
    assert took < 20
    df.unpersist()
