"""Evaluation report of a table of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.embed import image_embedding, text_embedding
from ..operators.metrics import corpus_metrics, dot, pair_metrics
from ..operators.reports import split_report


def evaluate_pairs(pairs: DataFrame, key: str = "pair_id", dim: int = 64, text_encoder=text_embedding, image_encoder=image_embedding) -> DataFrame:
    """Per-pair metrics with the alignment of ``prompt`` and predicted image."""
    aligned = pairs.withColumn("text_image_alignment", dot(text_encoder(F.col("prompt")), image_encoder(F.col("pred_pixels"))))
    return pair_metrics(aligned, key, keep=("text_image_alignment",))


def evaluation_report(pairs: DataFrame, splits: DataFrame, key: str = "pair_id", latency_ms: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(metrics, split counts): macro averages over the pairs, and rows per split."""
    metrics = corpus_metrics(evaluate_pairs(pairs, key), ("text_image_alignment",))
    metrics = metrics.withColumn("inference_latency_ms", F.lit(latency_ms))
    return metrics, split_report(splits)
