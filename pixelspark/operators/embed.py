"""Small fixed text and image embeddings, and the table that keeps embeddings between runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions.base import col, let

# The vocabulary of the small encoder, in vector order.
FEATURES = (
    "red green blue yellow orange purple pink white black gray brown stone wood metal grass water fire ice light dark "
    "sprite icon tile object building scene isometric transparent opaque edge detail flat round small large fantasy nature"
).split()
# Words that stand for several features; any other word stands for itself.
WORD_FEATURES = {
    "potion": ("object", "transparent", "round", "fantasy"),
    "tree": ("object", "green", "brown", "nature"),
    "house": ("building", "stone", "wood"),
    "castle": ("building", "stone", "fantasy"),
    "grass": ("tile", "green", "nature"),
    "water": ("tile", "water", "blue"),
    "stone": ("stone", "gray", "tile"),
    "wood": ("wood", "brown"),
    "coin": ("object", "yellow", "metal", "round"),
    "sword": ("object", "metal", "edge"),
    "knight": ("sprite", "metal", "fantasy"),
    "sprite": ("sprite", "transparent", "detail"),
    "icon": ("icon", "transparent", "edge"),
    "tile": ("tile", "flat"),
    "object": ("object", "transparent"),
    "building": ("building", "opaque"),
    "scene": ("scene", "large"),
    "isometric": ("isometric", "building", "object"),
    "transparent": ("transparent",),
}
FALLBACK_FEATURE = "object"
DEFAULT_DIM = 64

# The prompts that an evaluation run covers.
EVALUATION_PROMPTS = (
    "red knight sprite transparent",
    "blue potion icon transparent",
    "grass tile",
    "small wooden object transparent",
    "stone house building",
    "tiny forest scene",
    "isometric stone building",
    "transparent sword icon",
)
# The kinds of content those prompts have to cover.
PROMPT_CATEGORIES = ("sprite", "icon", "tile", "object", "building", "scene", "isometric", "transparent")


def projection(rows: int, dim: int, unit_rows: bool) -> np.ndarray:
    """Fixed sin/cos projection with unit columns, and unit rows on request."""
    r, c = np.arange(1, rows + 1)[:, None], np.arange(1, dim + 1)[None]
    m = np.sin(r * c * 0.37) + np.cos(r * c * 0.11)
    m = m / np.maximum(np.linalg.norm(m, axis=0, keepdims=True), 1e-12)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if unit_rows else m


def _matrix(m: np.ndarray) -> Column:
    """A fixed matrix as one literal, one array per output dimension."""
    return F.expr("array(" + ",".join("array(" + ",".join(f"{x!r}D" for x in row) + ")" for row in m.T.tolist()) + ")")


def _project(vector: Column, m: np.ndarray) -> Column:
    return let(
        vector,
        lambda v: F.transform(_matrix(m), lambda w: F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)),
    )


def normalized(vector: Column) -> Column:
    def scale(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return let(F.greatest(norm, F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))

    return let(vector, scale)


def _feature_hits(text: Column | str) -> Column:
    """Positions of the vocabulary features that the words of a text stand for, one for each time.

    The words are found by one pattern, so other words are never made.
    """
    known = {**{f: (f,) for f in FEATURES}, **WORD_FEATURES}
    index = {f: i for i, f in enumerate(FEATURES)}
    by_start: dict[str, list[str]] = {}
    for w in known:
        by_start.setdefault(w[0], []).append(w[1:])
    word = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_start.items())
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(rf"(?U)(?:^|[\s_])({word})(?=[\s_]|$)"), F.lit(1))
    table = F.create_map(*[x for w, fs in known.items() for x in (F.lit(w), F.array(*[F.lit(index[f]) for f in fs]))])
    hits = F.flatten(F.transform(words, lambda w: F.element_at(table, w)))
    return let(hits, lambda h: F.when(F.size(h) == 0, F.array(F.lit(index[FALLBACK_FEATURE]))).otherwise(h))


def feature_counts(text: Column | str) -> Column:
    """Counts of the vocabulary features in a text; a text without any counts one ``object``."""
    return let(
        _feature_hits(text),
        lambda h: F.transform(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), lambda i: F.size(F.filter(h, lambda x: x == i)).cast("double")),
    )


def text_embedding(text: Column | str, dim: int = DEFAULT_DIM) -> Column:
    """Only features that a text has are projected; the others would add zeros."""
    matrix = _matrix(projection(len(FEATURES), dim, unit_rows=True))

    def counted(h: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(h)), lambda i: F.struct(i.alias("i"), F.size(F.filter(h, lambda x: x == i)).cast("double").alias("n")))

    def project(found: Column) -> Column:
        return F.transform(matrix, lambda w: F.aggregate(found, F.lit(0.0), lambda s, x: s + x["n"] * F.get(w, x["i"])))

    return normalized(let(let(_feature_hits(text), counted), project))


def image_statistics(pixels: Column | str) -> Column:
    """[mean of the colour channels, their population deviation, mean alpha]."""

    def stats(p: Column) -> Column:
        n = F.size(p)
        channels = F.flatten(F.transform(p, lambda c: F.array(px.red(c), px.green(c), px.blue(c))))
        total = F.aggregate(channels, F.lit(0).cast("bigint"), lambda s, x: s + x)
        squares = F.aggregate(channels, F.lit(0).cast("bigint"), lambda s, x: s + x * x)
        alpha = F.aggregate(p, F.lit(0).cast("bigint"), lambda s, c: s + px.alpha(c))
        return let(
            F.struct((total / (n * 3)).alias("m"), (squares / (n * 3)).alias("q"), (alpha / n).alias("a")),
            lambda s: F.array(s["m"], F.sqrt(F.greatest(F.lit(0.0), s["q"] - s["m"] * s["m"])), s["a"]),
        )

    return let(col(pixels), stats)


def image_embedding(pixels: Column | str, dim: int = DEFAULT_DIM) -> Column:
    return normalized(_project(image_statistics(pixels), projection(3, dim, unit_rows=False)))


def encode_missing(
    requests: DataFrame, cache: DataFrame, version: str, text: str = "text", encoder: Callable[[Column], Column] = text_embedding
) -> DataFrame:
    """(text, version, embedding) for the requested texts that the cache lacks in this version.

    ``encoder`` maps a text column to an array column; a pandas UDF plugs in the same way as the default.
    """
    known = cache.where(F.col("version") == version).select(text)
    missing = requests.select(text).where(F.col(text).isNotNull()).distinct().join(known, text, "left_anti")
    return missing.select(text, F.lit(version).alias("version"), encoder(F.col(text)).alias("embedding"))


def with_cached_embeddings(requests: DataFrame, cache: DataFrame, version: str, text: str = "text") -> DataFrame:
    """Requests with their embedding; a much-requested text is salted rather than sent to one task."""
    from .shuffles import lookup_join

    weights = requests.groupBy(text).agg(F.count(F.lit(1)).alias("_requests"))
    known = cache.where(F.col("version") == version).select(text, "embedding").join(weights, text)
    return lookup_join(requests, known, [text], "_requests", requests.columns).drop("_requests")


def encode_images(images: DataFrame, pixels: str = "pixels", encoder: Callable[[Column], Column] = image_embedding) -> DataFrame:
    """Add ``embedding``; the Arrow batch size bounds what a plugged-in pandas UDF sees at once."""
    return images.withColumn("embedding", encoder(F.col(pixels)))


def prompt_coverage(prompts: DataFrame, prompt: str = "prompt", categories: tuple[str, ...] = PROMPT_CATEGORIES) -> DataFrame:
    """(category, prompts, covered) of a prompt table."""
    hits = F.transform(F.array(*map(F.lit, categories)), lambda c: F.struct(c.alias("category"), F.col(prompt).contains(c).alias("hit")))
    exploded = prompts.select(F.explode(hits).alias("h")).select("h.*")
    return exploded.groupBy("category").agg(F.count_if("hit").alias("prompts"), F.bool_or("hit").alias("covered"))
