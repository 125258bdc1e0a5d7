"""Connected components inside single images.

Following a region to its end is the one step that column expressions cannot say for an image of any shape. It
stays inside the image, so it is an Arrow-batched UDF over whole batches of images: no shuffle, no driver loop,
nothing that outlives a task. Everything derived from the labels is a column expression again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import col, let, pinned

# Fixed value: regions beyond this number count as background.
MAX_REGIONS = 64
# A cut-out needs this many cells; a larger sheet is not searched.
MIN_PIECE_AREA = 4
MAX_SHEET_AREA = 1_000_000


def _merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of every node's component, for the edges a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(nxt := root[root], root):
            root = nxt
    return root


def _label_batch(values: pd.Series, widths: pd.Series, steps: tuple[tuple[int, int], ...]) -> pd.Series:
    values = values.map(lambda v: () if v is None else v)
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    flat = np.concatenate([np.asarray(v) for v in values]) if sizes.sum() else np.empty(0, dtype=np.int64)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = starts + np.repeat(sizes, sizes)
    width = np.repeat(widths.fillna(1).to_numpy(dtype=np.int64), sizes)
    at = np.arange(len(flat))
    x = (at - starts) % np.maximum(width, 1)
    heads, tails = [], []
    for dx, dy in steps:
        to = at + dy * width + dx
        ok = (flat >= 0) & (x + dx >= 0) & (x + dx < width) & (to < ends)
        ok[ok] = flat[to[ok]] == flat[ok]
        heads.append(at[ok])
        tails.append(to[ok])
    root = _merge(len(flat), np.concatenate(heads), np.concatenate(tails))
    labels = np.where(flat >= 0, root - starts, -1).astype(np.int32)
    return pd.Series(np.split(labels, np.cumsum(sizes)[:-1]), index=values.index)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _labels4(values: pd.Series, width: pd.Series) -> pd.Series:
    return _label_batch(values, width, ((1, 0), (0, 1)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _labels8(values: pd.Series, width: pd.Series) -> pd.Series:
    return _label_batch(values, width, ((1, 0), (0, 1), (1, 1), (-1, 1)))


# Declared nondeterministic so that the planner never copies a call into several expressions.
_LABELS4 = _labels4.asNondeterministic()
_LABELS8 = _labels8.asNondeterministic()


def with_component_labels(df: DataFrame, values: Column | str, width: Column | str = "width", out: str = "labels", diagonal: bool = False) -> DataFrame:
    """Add the label of every cell: raster position of its component's first cell; -1 where the value is negative.
    A NULL grid gives an empty one.

    Neighbours belong together when their values are equal. ``diagonal`` also joins corner neighbours.
    """
    given = df.withColumn("_values", pinned(col(values)))
    return given.withColumn(out, (_LABELS8 if diagonal else _LABELS4)("_values", col(width))).drop("_values")


def region_input(indices: Column | str, palette: Column | str, valid: Column | None = None) -> Column:
    """Palette indices with -1 for cells that are invalid or transparent."""

    def shown(p: Column) -> Column:
        def cell(v: Column, i: Column) -> Column:
            clear = F.coalesce(F.get(p, v) < (1 << 24), F.lit(False))
            ok = (v >= 0) & ~clear
            if valid is not None:
                ok = ok & F.get(valid, i)
            return F.when(ok, v).otherwise(F.lit(-1))

        return F.transform(col(indices), cell)

    return let(col(palette), shown)


def regions_from_labels(labels: Column | str, max_regions: int = MAX_REGIONS) -> Column:
    """Regions numbered from 1 in raster order of their first cell; later ones than ``max_regions`` are 0."""

    def number(lab: Column) -> Column:
        first = F.sort_array(F.array_distinct(F.filter(lab, lambda x: x >= 0)))
        return let(
            F.slice(first, 1, max_regions),
            lambda f: F.transform(lab, lambda x: F.array_position(f, x).cast("int")),
        )

    return let(col(labels), number)


def value_regions(shown: Column | str, max_regions: int = MAX_REGIONS) -> Column:
    """Regions by palette value instead of adjacency, numbered by first appearance in raster order."""

    def number(v: Column) -> Column:
        seen = F.slice(F.array_distinct(F.filter(v, lambda x: x >= 0)), 1, max_regions)
        return let(seen, lambda s: F.transform(v, lambda x: F.array_position(s, x).cast("int")))

    return let(col(shown), number)


def component_sizes(labels: Column | str) -> Column:
    """array<struct<label,at,n>> of an image's components in raster order.

    ``at`` is the 1-based start of the component in the list of foreground cells sorted by label.
    """

    def sizes(ordered: Column) -> Column:
        # a sorted label list holds each component as one stretch, which starts where the label changes
        changes = F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1) != x), F.struct(x.alias("label"), (i + 1).alias("at"))))
        return let(
            F.filter(changes, lambda e: e.isNotNull()),
            lambda s: F.transform(
                s,
                lambda e, i: F.struct(
                    e["label"].alias("label"),
                    e["at"].cast("int").alias("at"),
                    (F.coalesce(F.get(s, i + 1)["at"], F.size(ordered) + 1) - e["at"]).cast("int").alias("n"),
                ),
            ),
        )

    return let(F.sort_array(F.filter(col(labels), lambda x: x >= 0)), sizes)


def component_count(labels: Column | str) -> Column:
    return F.size(F.array_distinct(F.filter(col(labels), lambda x: x >= 0)))


def largest_component(labels: Column | str) -> Column:
    """struct<label,n> of the largest component, the earliest one on a tie; NULL without any."""
    best = F.array_max(F.transform(component_sizes(labels), lambda e: F.struct(e["n"].alias("n"), (-e["label"]).alias("k"))))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct((-b["k"]).alias("label"), b["n"].alias("n"))))


def sheet_mask(pixels: Column | str) -> Column:
    """Foreground of a sprite sheet (1) against its background (-1).

    With mixed transparency the visible pixels are foreground, otherwise every pixel unlike the first one.
    """
    px = col(pixels)
    clear = F.exists(px, lambda p: p < (1 << 24))
    shown = F.exists(px, lambda p: p >= (1 << 24))

    def mask(mixed: Column) -> Column:
        return let(
            F.get(px, F.lit(0)),
            lambda back: F.transform(px, lambda p: F.when(F.when(mixed, p >= (1 << 24)).otherwise(p != back), 1).otherwise(-1)),
        )

    return let(clear & shown, mask)


def sheet_boxes(labels: Column | str, width: Column | str, max_size: int) -> Column:
    """Boxes of a sheet's pieces ordered by (y, x); empty unless at least two qualify."""
    w = col(width)

    def boxes(lab: Column) -> Column:
        cells = F.sort_array(
            F.filter(
                F.transform(lab, lambda v, i: F.struct(v.alias("v"), (i % w).alias("x"), F.floor(i / w).cast("int").alias("y"))),
                lambda c: c["v"] >= 0,
            )
        )

        def measure(sorted_cells: Column) -> Column:
            return F.transform(
                component_sizes(lab),
                lambda e: let(
                    F.slice(sorted_cells, e["at"], e["n"]),
                    lambda p: F.struct(
                        F.array_min(F.transform(p, lambda c: c["y"])).alias("y0"),
                        F.array_min(F.transform(p, lambda c: c["x"])).alias("x0"),
                        (F.array_max(F.transform(p, lambda c: c["x"])) + 1).alias("x1"),
                        (F.array_max(F.transform(p, lambda c: c["y"])) + 1).alias("y1"),
                        e["n"].alias("area"),
                    ),
                ),
            )

        fits = F.filter(
            let(cells, measure),
            lambda b: (b["area"] >= MIN_PIECE_AREA) & (b["x1"] - b["x0"] <= max_size) & (b["y1"] - b["y0"] <= max_size),
        )
        ordered = F.transform(
            F.array_sort(fits),
            lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1")),
        )
        return let(ordered, lambda o: F.when(F.size(o) >= 2, o).otherwise(F.slice(o, 1, 0)))

    return let(col(labels), boxes)
