"""Exact dedup by chunk recipes.

A text is cut where its own content says so: a rolling hash over the last 32 bytes picks the borders, so equal stretches are cut
alike wherever they stand. Each distinct chunk gets an identifier, and a text becomes the ordered list of its chunks'
identifiers. Lists are compared instead of texts.

Identifiers are verified: the bytes of all chunks are grouped with their identifiers, and if one identifier has two contents, the
next longer hash is taken, until each stands for one content. Content moves once for this, combined before it moves; from then
on only lists move. Groups are found by aggregation, so a group of any size burdens no task, and only narrow rows are joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .base import keep_rows, map_texts, row_key

WINDOW = 32
LEAST, MOST = 1024, 16_384  # bytes of a chunk
BORDER = 2_047  # a border falls on one in 2,048 places
HASHES = ("xxh64", "sha256")
LOWER = bytes(b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256))
SEEDS = np.array([(i * 0x9E3779B1 ^ i << 13) & 0xFFFFFFFF for i in range(1, 257)], np.uint32)


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(LOWER)


def borders(data: bytes) -> np.ndarray:
    """Places after which the content allows a cut: the hash of the 32 bytes before has low bits of zero."""
    if len(data) <= LEAST:
        return np.empty(0, np.int64)
    h = SEEDS[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # a hash of 2w bytes from two hashes of w bytes
        h[width:] = h[width:] + h[:-width] * np.uint32(pow(0x01000193, width, 1 << 32))
        width *= 2
    h ^= h >> np.uint32(15)
    return np.flatnonzero((h & np.uint32(BORDER)) == 0) + 1


def chunks(data: bytes) -> list[bytes]:
    """Chunks of LEAST to MOST bytes (the last may be shorter) that joined give the data; no data give no chunk."""
    out, start = [], 0
    for end in [*borders(data).tolist(), len(data)]:
        while end - start > MOST:
            out.append(data[start : start + MOST])
            start += MOST
        if end - start >= LEAST or end == len(data) and end > start:
            out.append(data[start:end])
            start = end
    return out


def identifier(chunk: bytes, kind: str) -> bytes:
    return xxhash.xxh64_digest(chunk) if kind == "xxh64" else hashlib.new(kind, chunk).digest()


def chunk_table(docs: DataFrame, kind: str) -> DataFrame:
    """(identifier, content) of all chunks of (doc_id, text)."""

    def start():
        def work(ids: pa.Array, texts: list[str]) -> dict:
            seen = {c: identifier(c, kind) for t in texts for c in chunks(normalised(t))}
            return {"identifier": list(seen.values()), "content": list(seen)}

        return work

    return map_texts(docs, start, "identifier binary, content binary")


def verified_hash(docs: DataFrame, kinds: tuple[str, ...] = HASHES) -> str:
    """The first hash of which no value stands for two different chunks."""
    for kind in kinds:
        contents = chunk_table(docs, kind).groupBy("identifier", "content").agg(F.count(F.lit(1)).alias("n"))
        twice = contents.groupBy("identifier").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
        if twice.isEmpty():
            return kind
    raise ValueError("chunks of different content share identifiers under every hash")


def recipes(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, row_id, row_hash, recipe, text_sha256): the recipe is the list of identifiers, one after another."""

    def start():
        def work(ids: pa.Array, texts: list[str]) -> dict:
            data = [normalised(t) for t in texts]
            return {
                "key": ids,
                "recipe": [b"".join([identifier(c, kind) for c in chunks(d)]) for d in data],
                "text_sha256": [hashlib.sha256(d).hexdigest() for d in data],
            }

        return work

    # the whole key travels as one column, so that it comes back beside the recipe
    keyed = docs.select(F.struct("doc_id", *row_key()).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    made = map_texts(keyed, start, f"key {keyed.schema['key'].dataType.simpleString()}, recipe binary, text_sha256 string")
    return made.select("key.*", "recipe", "text_sha256")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = HASHES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and the row's key (row_id, row_hash).

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty. Of equal texts the row with the largest
    doc_id stays (a NULL id is smaller than any other). Rows that share this doc_id are told apart by a hash of their text as
    written, the larger stays; of wholly repeated rows one stays. An empty table gives no groups.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = verified_hash(docs, kinds)
    folder = scratch_path(df.sparkSession, "recipes")  # narrow rows that are read twice
    recipes(docs, kind).withColumn("place", F.monotonically_increasing_id()).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    best = F.max(F.struct("doc_id", "row_id", "row_hash", "place"))
    groups = rows.groupBy(F.col("recipe").alias("of")).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # hot groups: both sides are plain shuffles, whose large partitions adaptive execution splits
    joined = rows.join(groups, F.col("recipe") == F.col("of"))
    kept = (F.col("place") == F.col("best.place")).alias("kept")
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept, "text_sha256", "row_id", "row_hash")


def drop_exact(docs: DataFrame, kinds: tuple[str, ...] = HASHES) -> DataFrame:
    """Rows of ``docs`` (columns doc_id, text and any others) with one of each group of equal texts, the one of ``exact_groups``.

    NULL and empty texts are equal to each other, so one of them stays. Of wholly repeated rows one stays; rows that differ in other columns
    only are repeated here, and any of them may stay. An empty table stays empty.
    """
    return keep_rows(docs, exact_groups(docs, kinds=kinds).where("kept").select("row_id", "row_hash"))
