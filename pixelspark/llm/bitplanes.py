"""Token-id files of shuffled planes.

Ids are cut into blocks of a fixed number; a block is transposed into bit planes (bit k of every id) or byte planes (byte k of
every id), and each plane is compressed with zstandard. High planes of small ids are all alike and vanish; neighbouring values
of one plane resemble each other.

A frame is the unit of reading: some whole documents, in blocks of their own. Layout, little-endian:

    magic "PLN1" | u8 kind (0 bits, 1 bytes) | u8 planes | u16 0 | u32 ids in a block | u64 ids
    u32 compressed size of each plane of each block (the chunk index) | the compressed planes in the same order

A frame is stored as one row of a Parquet table, beside its place: part (files of ascending document order), number of
ids of the part before it, ids and lengths of its documents. Spark's committed writes make the files safe against lost
and repeated tasks, on any file system Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import documents, slices
from .words import LibraryEncoder

HEAD = "<4sBBHIQ"
MAGIC = b"PLN1"
KINDS = ("bit", "byte")
BLOCK_IDS = 65_536
FRAME_IDS = 262_144


def _planes(ids: np.ndarray, kind: str, count: int) -> list[bytes]:
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [by_byte[k].tobytes() for k in range(count)]
    return [np.packbits((by_byte[k // 8] >> (k % 8)) & 1).tobytes() for k in range(count)]


def pack_frame(ids: np.ndarray, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3) -> bytes:
    """A frame of unsigned 32-bit ids; no ids give a frame without blocks."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    count = max(1, bits if kind == "bit" else -(-bits // 8))
    press = zstandard.ZstdCompressor(level=level).compress
    planes = [press(p) for at in range(0, len(ids), block_ids) for p in _planes(ids[at : at + block_ids], kind, count)]
    sizes = np.array([len(p) for p in planes], "<u4").tobytes()
    return b"".join([struct.pack(HEAD, MAGIC, KINDS.index(kind), count, 0, block_ids, len(ids)), sizes, *planes])


def unpack_frame(frame: bytes, blocks: range | None = None) -> np.ndarray:
    """Ids of a frame, or of some of its blocks, which the chunk index finds without reading the others."""
    magic, kind, count, _, block_ids, total = struct.unpack_from(HEAD, frame)
    if magic != MAGIC:
        raise ValueError("not a frame of planes")
    n_blocks = -(-total // block_ids)
    sizes = np.frombuffer(frame, "<u4", n_blocks * count, struct.calcsize(HEAD)).astype(np.int64)
    places = struct.calcsize(HEAD) + 4 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)])
    open_ = zstandard.ZstdDecompressor().decompress
    out = []
    for b in blocks if blocks is not None else range(n_blocks):
        n = min(block_ids, total - b * block_ids)
        by_byte = np.zeros((4, n), np.uint8)
        for k in range(count):
            plane = np.frombuffer(open_(frame[places[b * count + k] : places[b * count + k + 1]]), np.uint8)
            if KINDS[kind] == "byte":
                by_byte[k] = plane
            else:
                by_byte[k // 8] |= np.unpackbits(plane, count=n) << (k % 8)
        out.append(np.ascontiguousarray(by_byte.T).view("<u4").ravel())
    return np.concatenate(out) if out else np.empty(0, "<u4")


def write_token_files(
    df: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    space: str = "prefix",
    kind: str = "byte",
    frame_ids: int = FRAME_IDS,
    block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all documents, each closed by ``end_id``, in ascending order of doc_id.

    One shuffle, by ranges of doc_id; NULL ids come first, equal ids are ordered by text. NULL and empty texts are the end
    id alone. An empty table gives files without frames.
    """
    docs = documents(df, id_col, text_col)
    schema = (
        f"part int, frame int, ids_before bigint, n_ids bigint, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, "
        "lengths array<bigint>, frame_data binary"
    )
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder.of_worker(path, space)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        texts: list[np.ndarray] = []
        size = 0

        def frame() -> pa.RecordBatch:
            nonlocal number, before, size
            ids = np.concatenate(texts)
            row = [part, number, before, len(ids), list(keys), [len(t) for t in texts], pack_frame(ids, kind, block_ids)]
            number, before, size = number + 1, before + len(ids), 0
            keys.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for some in slices(batch):
                for key, ids in zip(some.column(0).to_pylist(), encoder.split(some.column(1), end_id)):
                    if keys and size + len(ids) > frame_ids:
                        yield frame()
                    keys.append(key)
                    texts.append(ids)
                    size += len(ids)
        if keys:
            yield frame()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files: start counts the ids of all documents before it.

    Rows that share an id each have a row, in the order in which they were written. Files without frames give none.
    """
    files = spark.read.parquet(folder)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # one row per part, and there are no more parts than the writing job had tasks: bounded, so it may be broadcast
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, lengths, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = unpack_frame(data)
                ends = np.cumsum(np.array(lengths, np.int64))
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [doc_ids, (starts + first).tolist(), lengths, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    placed = files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("ids_before")).alias("first"), "doc_ids", "lengths", "frame_data")
    return placed.mapInArrow(run, schema)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) as stored, end id included: a NULL or empty text has the end id alone. Repeated rows each have a row; files without
    frames give none."""
    files = spark.read.parquet(folder).select("doc_ids", "lengths", "frame_data")
    schema = f"doc_id {files.schema['doc_ids'].dataType.elementType.simpleString()}, ids array<bigint>"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lengths, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cuts = np.cumsum(lengths)[:-1]
                ids = [x.tolist() for x in np.split(unpack_frame(data), cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, arrow[0].type), pa.array(ids, arrow[1].type)], schema=arrow)

    return files.mapInArrow(run, schema)
