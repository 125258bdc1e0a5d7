"""Quality by compression: two zstandard dictionaries, built from good and from bad labelled text, compress each text.

Text like the good sample shrinks more with the good dictionary. The difference of the two sizes, as a share of their sum, is
turned into a score by a logistic curve fitted on labelled rows that built no dictionary; how far the text shrinks at all is a
second input, as endless repetition shrinks alike with either. Labels, ids and other columns are never inputs.

Only the sample for fitting is bounded (``SAMPLE_ROWS`` of each label, ``SAMPLE_BYTES`` in all, chosen by a hash of the id); every
row's whole text is scored, within its own task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import documents, map_texts

SAMPLE_ROWS = 1_500
SAMPLE_BYTES = 24 << 20
DICTIONARY_BYTES = 112_640
LEVEL = 3
FOLDS = 5  # rows whose crc32 of the id leaves no remainder are held out
CUT = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]


def held_out(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % FOLDS == 0


class _Sizes:
    """Inputs of the curve for a text."""

    def __init__(self, good: bytes, bad: bytes):
        self.press = [self._compressor(x) for x in (good, bad)]

    @staticmethod
    def _compressor(data: bytes):
        if not data:
            return zstandard.ZstdCompressor(level=LEVEL).compress
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known).compress

    def __call__(self, text: str) -> tuple[float, ...]:
        data = text.encode("utf-8", "replace")
        good, bad = (len(press(data)) for press in self.press)
        shrunk = (good + bad) / (2 * len(data) + 40)
        difference = (bad - good) / (good + bad + 40)
        return difference, abs(difference), shrunk, shrunk * shrunk


def _curve(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, intercept last; with one label only, its share alone."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def _dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained dictionary; of too little text, which cannot be trained on, the text itself."""
    data = [t.encode("utf-8", "replace") for t in texts]
    try:
        return zstandard.train_dictionary(size, data).as_bytes() if data else b""
    except zstandard.ZstdError:
        return b"\n".join(data)[:size]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Dictionaries and curve from a bounded sample of the labelled rows that are not held out.

    Rows without label, id or text are no sample. Of several labels of one id the lowest counts, of several texts the first in order, once.
    Half of the sample, by turns, builds the dictionaries; the other half fits the
    curve, weighted as the labels occur among all labelled rows. Without any labelled row every score is one half.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    shares = {r["label"]: r["n"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for good in (True, False):  # a top-n by hash of each label: bounded, and the same whatever the partitions
        part = known.where((F.col("label") > 0) == good).orderBy(*order).limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).dropna()
    # the sample has at most 2 * SAMPLE_ROWS ids and labels: bounded, so it may be broadcast
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = cut_lineage(found.withColumn("n", F.octet_length("text")).withColumn("order", order[0]))
    rows = found.select("doc_id", "n").orderBy("order", "doc_id").collect()  # one of each id
    total, keep = 0, []
    for r in rows:
        if total + r["n"] <= SAMPLE_BYTES:
            total += r["n"]
            keep.append(r["doc_id"])
    by_label: dict[bool, list[str]] = {True: [], False: []}
    wanted = texts.sparkSession.createDataFrame([(k,) for k in keep], f"doc_id {docs.schema[id_col].dataType.simpleString()}")
    for r in found.join(F.broadcast(wanted), "doc_id").orderBy("order", "doc_id").collect():
        by_label[r["label"] > 0].append(r["text"])
    good, bad = (_dictionary(by_label[k][::2]) for k in (True, False))
    rest = [(t, k) for k in (True, False) for t in by_label[k][1::2]]
    if not rest:
        return Model(good, bad, (0.0,) * 5, (0.0,) * 4, (1.0,) * 4)
    sizes = _Sizes(good, bad)
    x, y = np.array([sizes(t) for t, _ in rest]), np.array([float(k) for _, k in rest])
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _curve((x - center) / scale, y)
    if shares.get(1) and shares.get(0) and 0 < y.sum() < len(y):  # the sample holds both labels alike; the corpus may not
        w[-1] += np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, tuple(w), tuple(center), tuple(scale))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row. NULL counts as an empty text, which is scored like any other; a NULL id is
    not held out; repeated rows get equal scores; an empty table gives none."""

    def start():
        sizes = _Sizes(model.good, model.bad)
        w, center, scale = np.array(model.weights), np.array(model.center), np.array(model.scale)

        def work(ids: pa.Array, texts: list[str]) -> dict:
            x = (np.array([sizes(t) for t in texts]) - center) / scale
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            return {"doc_id": ids, "held_out": [held_out(k) for k in ids.to_pylist()], "score": p, "predicted": (p >= CUT).astype(np.int32)}

        return work

    docs = documents(df, id_col, text_col)
    return map_texts(docs, start, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
