"""The keys of everything that has landed, in parts by key hash with a Bloom filter per part and batch.

A micro-batch asks the filters of the parts its keys fall into. Only keys that a filter knows are looked up, and only the files of their
parts are read: a batch of new keys reads a few bits per key of history and, but for false alarms, no key at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.manifest import path_exists

PARTS = 64  # each holds a part of all keys and is a file a batch; fixed for a history once it is there
BITS_PER_KEY = 12  # with PROBES bits set for a key, one in 300 unknown keys is looked up in vain
PROBES = 6
FILTER = "part int, stream string, batch bigint, bits binary"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers of each key, from the halves of its hash; ``size`` is a power of two."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)


def make_filter(hashes: np.ndarray) -> bytes:
    size = max(64, 1 << (BITS_PER_KEY * len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_places(hashes, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def in_filter(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(bits, np.uint8)
    places = _places(hashes, 8 * len(packed))
    return ((packed[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class KeyHistory:
    """Keys below ``folder``, by the number of parts: ``keys/part=N`` and ``filters``, appended by each batch. NULL keys are neither noted nor known."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.parts, self.folder = spark, parts, folder.rstrip("/")
        self.keys, self.filters = f"{self.folder}/{parts}/keys", f"{self.folder}/{parts}/filters"

    def _hashed(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, h, part), with the filter's hash and the part from independent hashes."""
        text = F.col(key).cast("string")
        part = F.pmod(F.xxhash64(F.lit(self.parts), text), F.lit(self.parts)).cast("int")
        return rows.where(F.col(key).isNotNull()).select(text.alias("key"), F.xxhash64(text).alias("h"), part.alias("part"))

    def exists(self) -> bool:
        if path_exists(self.spark, self.filters):
            return True
        if path_exists(self.spark, self.folder):
            raise ValueError(f"{self.folder} has another number of parts than {self.parts}")
        return False

    def append(self, rows: DataFrame, key: str, stream: str, batch: Column | int) -> None:
        """Note the keys of a batch. A batch noted twice is no other than one noted once."""
        placed = self._hashed(rows, key).withColumn("stream", F.lit(stream)).withColumn("batch", F.lit(batch).cast("bigint") if isinstance(batch, int) else batch)
        # one file a part; rows of one part lie together
        dealt = cut_lineage(placed.repartition("part").sortWithinPartitions("part", "stream", "batch"))
        dealt.select("key", "stream", "batch", "part").write.mode("append").partitionBy("part").parquet(self.keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []

            def out() -> pa.RecordBatch:
                columns = [pa.array([at[0]], pa.int32()), pa.array([at[1]]), pa.array([at[2]], pa.int64()), pa.array([make_filter(np.concatenate(held))], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["part", "stream", "batch", "bits"])

            for some in batches:
                names = list(zip(*(some.column(i).to_pylist() for i in range(3))))
                hashes = some.column(3).to_numpy()
                start = 0
                for i in range(1, len(names) + 1):
                    if i == len(names) or names[i] != names[start]:
                        if at is not None and at != names[start]:
                            yield out()
                            held = []
                        at = names[start]
                        held.append(hashes[start:i])
                        start = i
            if at is not None:
                yield out()

        made = dealt.select("part", "stream", "batch", "h").mapInArrow(run, FILTER)
        made.write.mode("append").parquet(self.filters)  # few rows, in order of their parts: file statistics tell where a part is

    def suspects(self, rows: DataFrame, key: str, stream: str, batch: int) -> DataFrame:
        """(key, part): keys of ``rows`` that the filters of other batches than this one know, by right or by false alarm."""
        asked = self._hashed(rows, key).distinct().groupBy("part").agg(F.collect_list(F.struct("key", "h")).alias("k"))
        asked = cut_lineage(asked)  # one row a part
        hit = [r.part for r in asked.select("part").collect()]  # at most ``parts`` numbers
        filters = self.spark.read.schema(FILTER).parquet(self.filters).where(F.col("part").isin(hit))
        filters = filters.where(~((F.col("stream") == stream) & (F.col("batch") == batch))).select("part", "bits")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in batches:
                for part, bits, keys, hashes in zip(*(some.column(i).to_pylist() for i in range(4))):
                    known = np.flatnonzero(in_filter(bits, np.array(hashes, np.int64))).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in known], pa.string()), pa.array([part] * len(known), pa.int32())], names=["key", "part"])

        joined = filters.join(asked, "part").select("part", "bits", F.col("k.key").alias("keys"), F.col("k.h").alias("hashes"))
        return joined.mapInArrow(run, "key string, part int").distinct()

    def seen(self, rows: DataFrame, key: str, stream: str, batch: int) -> DataFrame:
        """(key): keys of ``rows`` that another batch has noted. Reads the key files of the suspects' parts only."""
        suspects = cut_lineage(self.suspects(rows, key, stream, batch))
        parts = [r.part for r in suspects.select("part").distinct().collect()]  # at most ``parts`` numbers
        noted = self.spark.read.schema("key string, stream string, batch bigint, part int").parquet(self.keys).where(F.col("part").isin(parts))
        noted = noted.where(~((F.col("stream") == stream) & (F.col("batch") == batch)))
        return noted.join(suspects, ["key", "part"], "left_semi").select("key").distinct()
