"""Training targets: structure regions, stage grids, masking and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import components, grids
from ..functions.base import col, let, seeded_hex, seeded_int, seeded_unit
from ..functions.buckets import stage_shape
from ..functions.pixels import boundary

IGNORED_LABEL = -100  # fixed value


def with_regions(df: DataFrame, connected: bool = True, max_regions: int = 64, out: str = "structure") -> DataFrame:
    """Structure regions of images with ``indices``, ``palette`` and ``width``."""
    shown = components.region_input("indices", "palette")
    if not connected:
        return df.withColumn(out, components.value_regions(shown, max_regions))
    labelled = components.with_component_labels(df, shown, out="_labels")
    return labelled.withColumn(out, components.regions_from_labels("_labels", max_regions)).drop("_labels")


def with_stage_grid(df: DataFrame, stage: Column | int, downsample: int = 4, values: str = "structure", classes: int | None = None) -> DataFrame:
    """Add ``stage_width``, ``stage_height`` and ``stage_<values>``: the grid resized for a stage."""
    shape = stage_shape("width", "height", stage, downsample)
    sized = df.withColumn("_shape", shape)
    sized = sized.withColumn("stage_width", F.col("_shape.w")).withColumn("stage_height", F.col("_shape.h")).drop("_shape")
    resized = grids.resize_nearest(values, F.col("width"), F.col("height"), F.col("stage_width"), F.col("stage_height"))
    if classes is not None:
        resized = F.transform(resized, lambda v: clamp(v, 0, classes - 1))
    return sized.withColumn(f"stage_{values}", resized)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def one_hot(value: Column | str, valid: Column | str, classes: int) -> Column:
    """Class vector of a cell, all zero where it is not valid."""
    c = clamp(col(value), 0, classes - 1)
    return let(c, lambda k: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda t: ((t == k) & col(valid)).cast("int")))


def region_weights(targets: Column, valid: Column, width: Column, foreground_weight: float, boundary_weight: float) -> Column:
    """1 + foreground + boundary weight per cell, 0 where the cell is not valid."""
    foreground = F.zip_with(targets, valid, lambda t, ok: (t != 0) & ok)

    def weigh(fg: Column) -> Column:
        edges = boundary(fg, width)
        base = F.zip_with(fg, edges, lambda f, e: 1.0 + f.cast("double") * foreground_weight + e.cast("double") * boundary_weight)
        return F.zip_with(base, valid, lambda w, ok: F.when(ok, w).otherwise(F.lit(0.0)))

    return let(foreground, weigh)


def region_count(targets: Column | str, valid: Column, most: int = 64) -> Column:
    return F.least(F.array_max(F.zip_with(col(targets), valid, lambda t, ok: F.when(ok, t).otherwise(F.lit(0)))), F.lit(most))


def masked_cells(
    cells: DataFrame, mask_token: int, seed: int, min_ratio: float = 0.1, max_ratio: float = 1.0, image: str = "image_id", position: str = "pos"
) -> DataFrame:
    """Hide a seeded share of every image's valid cells (columns ``token``, ``valid``).

    The share is drawn once per image within the two ratios; ``max(1, round(valid * share))`` cells are hidden.
    Adds ``masked`` and ``label`` (the hidden token, otherwise -100). An image is bounded, so its window is too.
    """
    if not 0 < min_ratio <= max_ratio <= 1:
        raise ValueError("the least share of masked cells is above 0, the most is no less and at most 1")
    per_image = Window.partitionBy(image)
    ratio = F.lit(min_ratio) + seeded_unit(seed, F.col(image)) * F.lit(max_ratio - min_ratio)
    order = Window.partitionBy(image, "valid").orderBy(seeded_hex(seed + 1, F.col(image), F.col(position)), position)
    ranked = cells.withColumn("_n", F.count_if("valid").over(per_image)).withColumn("_rn", F.row_number().over(order))
    chosen = F.col("valid") & (F.col("_rn") <= F.greatest(F.lit(1), F.bround(F.col("_n") * ratio)))
    ranked = ranked.withColumn("_chosen", chosen)
    masked = F.when(F.col("_chosen"), F.lit(mask_token)).otherwise(F.col("token"))
    label = F.when(F.col("_chosen"), F.col("token")).otherwise(F.lit(IGNORED_LABEL))
    return ranked.select(*cells.columns, masked.alias("masked"), label.alias("label"))


def masked_grid(
    tokens: Column | str, valid: Column | str, image: Column, mask_token: int, seed: int, min_ratio: float = 0.1, max_ratio: float = 1.0
) -> Column:
    """struct<masked,label> of a whole grid, with the same draw as ``masked_cells`` but inside the row: no shuffle."""
    if not 0 < min_ratio <= max_ratio <= 1:
        raise ValueError("the least share of masked cells is above 0, the most is no less and at most 1")
    ratio = F.lit(min_ratio) + seeded_unit(seed, image) * F.lit(max_ratio - min_ratio)
    cells = F.zip_with(tokens, valid, lambda t, ok: F.struct(t.alias("t"), ok.alias("ok")))
    keyed = F.transform(
        cells, lambda c, i: F.struct((~c["ok"]).alias("last"), seeded_hex(seed + 1, image, i).alias("h"), i.alias("pos"), c["t"].alias("t"))
    )
    count = F.greatest(F.lit(1), F.bround(F.size(F.filter(valid, lambda ok: ok)) * ratio))

    def hide(k: Column) -> Column:
        drawn = F.transform(
            F.array_sort(keyed), lambda c, i: F.struct(c["pos"].alias("pos"), c["t"].alias("t"), (~c["last"] & (i < k)).alias("hidden"))
        )
        return let(
            F.array_sort(drawn),
            lambda d: F.struct(
                F.transform(d, lambda c: F.when(c["hidden"], F.lit(mask_token)).otherwise(c["t"])).alias("masked"),
                F.transform(d, lambda c: F.when(c["hidden"], c["t"]).otherwise(F.lit(IGNORED_LABEL))).alias("label"),
            ),
        )

    return let(count, hide)


def noisy_token(token: Column, valid: Column, vocab: int, probability: float, seed: int, *key: Column) -> Column:
    """The token, or with the given probability a random one; cells that are not valid stay as they are."""
    if probability <= 0:
        return token
    random = F.pmod(seeded_int(seed + 1, *key), F.lit(vocab)).cast("int")
    return F.when(valid & (seeded_unit(seed, *key) < probability), random).otherwise(token)


def mixed_condition(
    sampled: Column, corrupt: Column, true: Column, sampled_probability: float, corrupt_probability: float, seed: int, image: Column
) -> Column:
    """One of three conditions, drawn once per image; without a sampled one its share falls to the corrupted."""
    roll = seeded_unit(seed, image)
    return (
        F.when(sampled.isNotNull() & (roll < sampled_probability), sampled)
        .when(roll < sampled_probability + corrupt_probability, corrupt)
        .otherwise(true)
    )


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: sum(value * weight) / max(sum(weight), 1)."""
    return F.coalesce(F.sum(col(value) * col(weight)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(col(weight)), F.lit(0.0)), F.lit(1.0))


def token_mask(mask: Column | str, width: Column, height: Column, out_width: Column, out_height: Column) -> Column:
    return grids.pool_any(mask, width, height, out_width, out_height)
