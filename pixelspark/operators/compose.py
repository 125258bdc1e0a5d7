"""Scenes composed from transparent assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions.base import seeded_int
from ..session import cut_lineage
from .shuffles import seeded_rank, shuffled

# Canvas side, layers per scene and the metadata of a composed scene.
CANVAS = 128
LAYERS = 6
SCENE_SOURCE = "procedural_composition"
SCENE_URL = "local"
SCENE_CATEGORY = "scene"
SCENE_TAGS = ("scene", "procedural")
MIXED_LICENSE = "mixed permissive"
TOO_FEW = "fewer than two assets with transparency"


def draw_positions(scene: Column, pool: int, layers: int, seed: int) -> Column:
    """``layers`` distinct positions in 0 .. pool-1, in draw order, from the scene alone.

    Draw j picks among the ``pool - j`` positions left and steps over those taken before.
    """

    def draw(taken: Column, j: Column) -> Column:
        pick = F.pmod(seeded_int(seed, scene, j), F.lit(pool) - j)
        stepped = F.aggregate(F.sort_array(taken), pick, lambda p, t: F.when(p >= t, p + 1).otherwise(p))
        return F.concat(taken, F.array(stepped))

    return F.aggregate(F.sequence(F.lit(0), F.lit(layers - 1)), F.array().cast("array<bigint>"), draw)


def merge_licenses(licenses: Column) -> Column:
    """One distinct licence is kept, several become the mixed one."""
    distinct = F.array_sort(F.array_distinct(licenses))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise(F.lit(MIXED_LICENSE))


def layer_draws(scenes: DataFrame, pool: int, seed: int, scene: str = "scene_id", layers: int = LAYERS) -> DataFrame:
    """(scene, layer, position): the assets of every scene by their position in a seeded order."""
    drawn = scenes.select(scene, draw_positions(F.col(scene), pool, min(layers, pool), seed).alias("_drawn"))
    return drawn.select(scene, F.posexplode("_drawn").alias("layer", "position"))


def compose_scenes(
    assets: DataFrame, scenes: DataFrame, seed: int = 0, key: str = "rel_path", scene: str = "scene_id", canvas: int = CANVAS, layers: int = LAYERS
) -> DataFrame:
    """Compose one scene per row of ``scenes`` from images (key, width, height, pixels, license).

    Assets get a dense position in a seeded order, worked out on keys alone; each scene draws positions from its
    id. Only then are pixels looked up, by key, so no scene ever meets all assets and the pixels of assets that no
    scene drew are not shuffled while the drawn keys fit a broadcast. A stored ``transparency`` column is used if
    there is one. Fewer than two transparent assets give no scenes.
    """
    clear = F.col("transparency") if "transparency" in assets.columns else px.has_transparency("pixels")
    placed = cut_lineage(seeded_rank(assets.where(clear).select(key), [key], seed, out="position").withColumn("position", F.col("position") - 1))
    pool = placed.count()
    if pool < 2:
        placed, pool = placed.limit(0), 2
    wanted = layer_draws(scenes, pool, seed, scene, layers).join(shuffled(placed), "position")
    joined = assets.select(key, "width", "height", "pixels", "license").join(wanted, key)

    def offset(axis: int, side: str) -> Column:
        room = F.greatest(F.lit(1), F.lit(canvas + 1) - F.col(side))
        return F.pmod(seeded_int(seed + 1 + axis, F.col(scene), F.col("layer")), room).cast("int")

    layer = F.struct(
        "layer",
        offset(0, "width").alias("x"),
        offset(1, "height").alias("y"),
        F.col("width").alias("w"),
        F.col("height").alias("h"),
        "pixels",
        F.col(key).alias("parent"),
        F.coalesce("license", F.lit("")).alias("license"),
    )
    # A canvas is far larger than the layers shuffled for it, so the number of tasks is set here and not by bytes.
    tasks = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stacked = joined.repartition(tasks, scene).groupBy(scene).agg(F.array_sort(F.collect_list(layer)).alias("layers"))  # at most ``layers`` of them
    licenses = F.transform("layers", lambda e: e["license"])
    return stacked.select(
        scene,
        F.lit(canvas).alias("width"),
        F.lit(canvas).alias("height"),
        px.composite_layers(F.col("layers"), canvas, canvas).alias("pixels"),
        F.lit(SCENE_SOURCE).alias("source"),
        F.lit(SCENE_URL).alias("source_url"),
        merge_licenses(licenses).alias("license"),
        F.lit(SCENE_CATEGORY).alias("category"),
        F.array(*map(F.lit, SCENE_TAGS)).alias("tags"),
        F.transform("layers", lambda e: e["parent"]).alias("parents"),
        F.array_sort(F.array_distinct(licenses)).alias("parent_licenses"),
    )


def composition_report(requested: DataFrame, existing: DataFrame, composed: DataFrame, scene: str = "scene_id") -> DataFrame:
    """created = new + reused, where reused scenes were already there."""
    reused = requested.join(existing.select(scene).distinct(), scene, "left_semi").agg(F.count(F.lit(1)).alias("reused"))
    new = composed.agg(F.count(F.lit(1)).alias("new"))
    both = new.join(F.broadcast(reused), F.lit(True))  # one row each
    return both.select((F.col("new") + F.col("reused")).alias("created"), "new", "reused")


def missing_scenes(requested: DataFrame, existing: DataFrame, scene: str = "scene_id") -> DataFrame:
    return requested.join(existing.select(scene).distinct(), scene, "left_anti")
