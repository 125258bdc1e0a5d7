"""Nearest and area resampling of cell grids held in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, let


def nearest_source(dst: Column, n_in: Column, n_out: Column) -> Column:
    """Source position of a nearest-neighbour resize, in single precision."""
    scale = (n_in.cast("double") / n_out).cast("float")
    return F.least(F.floor(dst.cast("float") * scale).cast("int"), n_in - 1)


def resize_nearest(values: Column | str, width: Column, height: Column, out_width: Column, out_height: Column) -> Column:
    def sample(v: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), out_height - 1), lambda y: nearest_source(y, height, out_height))
        cols = F.transform(F.sequence(F.lit(0), out_width - 1), lambda x: nearest_source(x, width, out_width))
        return let(cols, lambda cs: F.flatten(F.transform(rows, lambda y: F.transform(cs, lambda x: F.get(v, y * width + x)))))

    return let(col(values), sample)


def resize_condition(
    tokens: Column, valid: Column, width: Column, height: Column, out_width: Column, out_height: Column, pad_token: int
) -> Column:
    """Tokens in another shape, with the pad token wherever the source cell is not valid."""
    masked = F.zip_with(tokens, valid, lambda t, ok: F.when(ok, t).otherwise(F.lit(pad_token)))
    return resize_nearest(masked, width, height, out_width, out_height)


def pool_any(mask: Column | str, width: Column, height: Column, out_width: Column, out_height: Column) -> Column:
    """True where any source cell of an output cell's area is set."""

    def lo(i: Column, n_in: Column, n_out: Column) -> Column:
        return F.floor(i * n_in / n_out).cast("int")

    def hi(i: Column, n_in: Column, n_out: Column) -> Column:
        return F.ceil((i + 1) * n_in / n_out).cast("int")

    def pool(m: Column) -> Column:
        def cell(y: Column, x: Column) -> Column:
            x0, x1 = lo(x, width, out_width), hi(x, width, out_width)
            return F.exists(
                F.sequence(lo(y, height, out_height), hi(y, height, out_height) - 1),
                lambda sy: F.exists(F.slice(m, sy * width + x0 + 1, x1 - x0), lambda b: b),
            )

        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), out_height - 1),
                lambda y: F.transform(F.sequence(F.lit(0), out_width - 1), lambda x: cell(y, x)),
            )
        )

    return let(col(mask), pool)


def pad_grid(values: Column | str, width: Column, height: Column, out_width: Column, out_height: Column, fill: Column) -> Column:
    """Grid in a larger frame, anchored at the top left, ``fill`` elsewhere."""

    def place(v: Column) -> Column:
        row = lambda y: F.concat(F.slice(v, y * width + 1, width), F.array_repeat(fill, out_width - width))
        body = F.flatten(F.transform(F.sequence(F.lit(0), height - 1), row))
        return F.concat(body, F.array_repeat(fill, (out_height - height) * out_width))

    return let(col(values), place)
