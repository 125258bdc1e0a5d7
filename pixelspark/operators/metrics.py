"""Quality metrics of predicted against target images, and of token grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import components
from ..functions import pixels as px
from ..functions.base import col, let, pinned
from ..session import stored


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda b: b))


def mask_iou(pred: Column, target: Column) -> Column:
    both = count_true(F.zip_with(pred, target, lambda p, t: p & t))
    any_ = count_true(F.zip_with(pred, target, lambda p, t: p | t))
    return let(any_, lambda n: F.when(n == 0, F.lit(1.0)).otherwise(both / n))


def mask_f1(pred: Column, target: Column) -> Column:
    """F1 of two masks; 1 when both are empty."""
    both = count_true(F.zip_with(pred, target, lambda p, t: p & t))
    one = count_true(F.zip_with(pred, target, lambda p, t: p != t))
    return let(F.struct(both.alias("b"), one.alias("o")), lambda s: F.when(s["b"] * 2 + s["o"] == 0, F.lit(1.0)).otherwise(2 * s["b"] / (2 * s["b"] + s["o"])))


def palette_fidelity(pred: Column | str, target: Column | str) -> Column:
    """1 - mean RGBA distance from each predicted colour to the nearest target colour / 510, within 0..1."""

    def nearest(c: Column, colors: Column) -> Column:
        def distance(t: Column) -> Column:
            da = px.alpha(c) - px.alpha(t)
            return px.rgb_distance(c, t) + da * da

        return F.sqrt(F.array_min(F.transform(colors, distance)))

    def score(p: Column, t: Column) -> Column:
        total = F.aggregate(F.transform(p, lambda c: nearest(c, t)), F.lit(0.0), lambda s, d: s + d)
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total / F.size(p) / 510.0))
        return F.when((F.size(p) == 0) | (F.size(t) == 0), F.lit(1.0)).otherwise(value)

    return let(F.array_distinct(col(pred)), lambda p: let(F.array_distinct(col(target)), lambda t: score(p, t)))


def grid_alignment(pred: Column | str) -> Column:
    """Mean of the share of hard alpha values and of the share of whole-number channels, which is 1 here."""
    hard = count_true(F.transform(col(pred), lambda p: (p < px.OPAQUE) | (p >= 255 * px.OPAQUE)))
    return (hard / F.size(col(pred)) + 1.0) / 2


def pair_metrics(pairs: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metrics per pair from ``pred_pixels, pred_width, pred_height, target_pixels, target_width, target_height``.

    The predicted shape wins: the target is cropped or padded to it. All of it stays inside the row, with the columns ``keep``.
    """
    w, h = F.col("pred_width"), F.col("pred_height")
    df = pairs.withColumn("_t", pinned(px.fit_to_shape("target_pixels", F.col("target_width"), F.col("target_height"), w, h)))
    df = df.withColumn("_pm", px.opaque_mask("pred_pixels")).withColumn("_tm", px.opaque_mask("_t"))

    def shown(mask: str) -> Column:
        return F.transform(mask, lambda b: F.when(b, 1).otherwise(-1))

    df = components.with_component_labels(df, shown("_pm"), "pred_width", "_pl")
    df = components.with_component_labels(df, shown("_tm"), "pred_width", "_tl")
    df = df.withColumn("_pc", components.component_count("_pl")).withColumn("_tc", components.component_count("_tl"))

    def largest(labels: str) -> Column:
        return let(components.largest_component(labels)["label"], lambda k: F.transform(labels, lambda x: F.coalesce(x == k, F.lit(False))))

    gap = F.abs(F.col("_pc") - F.col("_tc"))
    return df.select(
        key,
        palette_fidelity("pred_pixels", "_t").alias("palette_fidelity"),
        mask_iou(F.col("_pm"), F.col("_tm")).alias("transparency_iou"),
        mask_f1(px.boundary("_pm", w), px.boundary("_tm", w)).alias("boundary_f1"),
        gap.cast("double").alias("component_count_error"),
        mask_iou(largest("_pl"), largest("_tl")).alias("largest_component_iou"),
        (1.0 - gap / F.greatest("_pc", "_tc", F.lit(1))).alias("connected_component_consistency"),
        grid_alignment("pred_pixels").alias("grid_pixel_alignment"),
        *keep,
    )


METRICS = (
    "palette_fidelity",
    "transparency_iou",
    "boundary_f1",
    "component_count_error",
    "largest_component_iou",
    "connected_component_consistency",
    "grid_pixel_alignment",
)


def corpus_metrics(per_pair: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return per_pair.agg(*[F.avg(m).alias(m) for m in (*METRICS, *extra)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def mean_alignment(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Mean dot product of paired embeddings, 0 without pairs."""
    return pairs.agg(F.coalesce(F.avg(dot(F.col(left), F.col(right))), F.lit(0.0)).alias("alignment"))


BOOK_BYTES = 32 << 20  # of the codebook that is broadcast at once; a larger one takes a pass over the vectors for each such part
CODES = 1024  # codes compared in one matrix product


class Codebook:
    """Codes by the length of their vectors, for nearest-code questions about many vectors at once."""

    def __init__(self, codes: list, vectors: np.ndarray):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(norms, kind="stable")
        rank = np.empty(len(codes), np.int64)  # place among the sorted codes: decides ties
        rank[sorted(range(len(codes)), key=codes.__getitem__)] = np.arange(len(codes))
        self.codes = sorted(codes)
        self.vectors, self.norms, self.rank = vectors[order], norms[order], rank[order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance, place among the sorted codes) for each row of ``x``; the lowest code on a tie.

        Blocks of codes are visited from the lengths nearest to the vectors' own. A block is left out if no vector can be nearer to it
        than to what it has: vectors are at least as far apart as their lengths. Matrix products name the candidates, the
        differences themselves decide between them.
        """
        lengths = np.sqrt((x * x).sum(axis=1))
        best, place = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        blocks = [slice(at, min(len(self.norms), at + CODES)) for at in range(0, len(self.norms), CODES)]
        middle = np.median(lengths) if len(x) else 0.0
        for block in sorted(blocks, key=lambda b: max(self.norms[b][0] - middle, middle - self.norms[b][-1])):
            low, high = self.norms[block][0], self.norms[block][-1]
            gap = np.maximum(0.0, np.maximum(low - lengths, lengths - high))
            slack = 1e-9 * (lengths + high) ** 2 + 1e-300
            open_ = np.flatnonzero(gap * gap <= best + slack)
            if not len(open_):
                continue
            about = (lengths[open_] ** 2)[:, None] + self.norms[block] ** 2 - 2.0 * (x[open_] @ self.vectors[block].T)
            row, column = np.nonzero(about <= np.minimum(about.min(axis=1), best[open_])[:, None] + slack[open_][:, None])
            row, code = open_[row], column + block.start
            exact = ((x[row] - self.vectors[code]) ** 2).sum(axis=1)
            order = np.lexsort((self.rank[code], exact, row))
            row, first = np.unique(row[order], return_index=True)
            exact, rank = exact[order][first], self.rank[code][order][first]
            better = (exact < best[row]) | (exact == best[row]) & (rank < place[row])
            best[row[better]], place[row[better]] = exact[better], rank[better]
        return best, place


def assign_codes(vectors: DataFrame, codebook: DataFrame, vector: str, code: str = "code", code_vector: str = "vector") -> DataFrame:
    """Add ``code``, the nearest entry of the codebook, the lowest on a tie; NULL for a NULL vector, one of another size than the
    codebook's, or without a codebook.

    The codebook is broadcast in parts of bounded size; with more than one, the nearest so far is stored between the passes.
    """
    spark = vectors.sparkSession
    entries = codebook.select(F.col(code).alias("c"), F.col(code_vector).cast("array<double>").alias("v"))
    shape = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    parts = max(1, -(-shape["n"] * (shape["d"] or 0) * 8 // BOOK_BYTES))
    kind = codebook.schema[code].dataType
    best = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("code", kind)])
    out = vectors
    for part in range(parts):
        rows = entries.where(F.pmod(F.xxhash64("c"), F.lit(parts)) == part).collect()  # BOOK_BYTES or so
        book = spark.sparkContext.broadcast(Codebook([r.c for r in rows], np.array([r.v for r in rows], float).reshape(len(rows), shape["d"] or 0)))

        @F.pandas_udf(best)
        def nearest(x: pd.Series, held: pd.DataFrame) -> pd.DataFrame:
            at = np.array([i for i, v in enumerate(x) if v is not None and len(v) == book.value.vectors.shape[1]], np.int64)
            d, codes = held["d"].to_numpy(float, na_value=np.inf, copy=True), held["code"].tolist()
            if len(at) and len(book.value.codes):
                found, place = book.value.nearest(np.array([x[i] for i in at], float))
                for i, f, p in zip(at.tolist(), found.tolist(), place.tolist()):
                    mine = book.value.codes[p]
                    if f < d[i] or f == d[i] and (pd.isna(codes[i]) or mine < codes[i]):
                        d[i], codes[i] = f, mine
            return pd.DataFrame({"d": d, "code": pd.array([None if pd.isna(c) else c for c in codes], object)})

        held = F.struct(F.col("_best.d").alias("d"), F.col("_best.code").alias("code")) if part else F.struct(F.lit(None).cast("double").alias("d"), F.lit(None).cast(kind).alias("code"))
        out = out.withColumn("_best", nearest(F.col(vector).cast("array<double>"), held))
        if part < parts - 1:
            out = stored(out, "codes")
    return out.select(*vectors.columns, F.col("_best.code").alias("code"))


def code_usage(codes: DataFrame, codebook_size: int, code: str = "code") -> DataFrame:
    """Codes used and dead, and the perplexity of their use."""
    counts = codes.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    # entropy from sums alone: log(total) - sum(n log n) / total
    total = F.sum("n")
    entropy = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    return counts.agg(
        F.count(F.lit(1)).alias("codes_used"),
        (F.lit(codebook_size) - F.count(F.lit(1))).alias("dead_codes"),
        F.coalesce(F.exp(entropy), F.lit(1.0)).alias("perplexity"),
    )


def token_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, silhouette accuracy and foreground shares over valid cells (columns pred, target, valid)."""

    def share(c: Column) -> Column:
        return F.coalesce(F.avg(F.when(F.col("valid"), c.cast("int"))), F.lit(0.0))

    pred, target = F.col("pred"), F.col("target")
    return cells.agg(
        share(pred == target).alias("accuracy"),
        share((pred == 0) == (target == 0)).alias("silhouette_accuracy"),
        share(target != 0).alias("foreground_ratio"),
        share(pred != 0).alias("predicted_foreground_ratio"),
    )


def token_boundary_f1(grids: DataFrame, group: str) -> DataFrame:
    """Boundary F1 per group of token grids ``pred, target, valid, width``; edges lie between two valid cells."""
    edges = grids.select(
        group, px.boundary("pred", "width", F.col("valid")).alias("p"), px.boundary("target", "width", F.col("valid")).alias("t")
    )
    tp = F.sum(count_true(F.zip_with("p", "t", lambda a, b: a & b)))
    miss = F.sum(count_true(F.zip_with("p", "t", lambda a, b: a != b)))
    f1 = F.when(2 * tp + miss == 0, F.lit(1.0)).otherwise(2 * tp / (2 * tp + miss))
    return edges.groupBy(group).agg(f1.alias("boundary_f1"))


def token_error(cells: DataFrame, group: str) -> DataFrame:
    """Share of wrong tokens over valid cells per group."""
    wrong = F.avg(F.when(F.col("valid"), (F.col("pred") != F.col("target")).cast("int")))
    return cells.groupBy(group).agg(F.coalesce(wrong, F.lit(0.0)).alias("token_error"))


def step_metrics(grids: DataFrame, step: str) -> DataFrame:
    """Index accuracy, palette consistency, transparency agreement and edge detail per refinement step.

    Columns: ``pred, target, valid, width, palette_size``; predictions outside the valid area count as -1.
    """
    pred = F.zip_with("pred", "valid", lambda p, ok: F.when(ok, p).otherwise(F.lit(-1)))
    df = grids.withColumn("_p", pred)
    valid_n = count_true(F.col("valid"))
    both = F.zip_with("_p", "target", lambda p, t: F.struct(p.alias("p"), t.alias("t")))

    def hits(test) -> Column:
        return count_true(F.zip_with(both, "valid", lambda s, ok: ok & test(s)))

    def edges(shift: Column, inside) -> Column:
        """struct<hit,total> over the neighbours ``shift`` cells apart."""

        def at(name: str, i: Column) -> Column:
            return F.get(F.col(name), i)

        def cell(i: Column) -> Column:
            j = i + shift
            ok = inside(i, j) & F.coalesce(at("valid", i) & at("valid", j), F.lit(False))
            same = (at("_p", i) != at("_p", j)) == (at("target", i) != at("target", j))
            return F.when(ok & same, 2).when(ok, 1).otherwise(0)

        marks = F.transform(F.sequence(F.lit(0), F.size("valid") - 1), cell)
        return let(marks, lambda m: F.struct(F.size(F.filter(m, lambda x: x == 2)).alias("hit"), F.size(F.filter(m, lambda x: x > 0)).alias("total")))

    w = F.col("width")
    df = df.select(
        step,
        valid_n.alias("n"),
        F.size("valid").alias("cells"),
        hits(lambda s: s["p"] == s["t"]).alias("exact"),
        count_true(F.transform("_p", lambda p, i: (~F.get(F.col("valid"), i)) | ((p >= 0) & (p < F.col("palette_size"))))).alias("in_palette"),
        hits(lambda s: (s["p"] == 0) == (s["t"] == 0)).alias("clear"),
        edges(F.lit(1), lambda i, j: i % w < w - 1).alias("right"),
        edges(w, lambda i, j: j < F.size("valid")).alias("down"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.sum(a) / F.greatest(F.sum(b), F.lit(1))

    return df.groupBy(step).agg(
        ratio(F.col("exact"), F.col("n")).alias("index_accuracy"),
        ratio(F.col("right.hit") + F.col("down.hit"), F.col("right.total") + F.col("down.total")).alias("edge_detail"),
        ratio(F.col("in_palette"), F.col("cells")).alias("palette_consistency"),
        ratio(F.col("clear"), F.col("n")).alias("transparency"),
    )
