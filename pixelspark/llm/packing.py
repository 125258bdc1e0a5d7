"""Packing by vector bins: sequences limited in tokens, segments and loss-bearing tokens at once.

A bin takes, again and again, the fitting item whose demands point most in the direction of the room that is left: the
largest dot product of demands and room, both as shares of the limits. So a bin with much token room and few segments left
takes long items, and items rich in loss go where loss is still allowed.

Each task packs its own rows from a pool of bounded size; bins never span tasks, so nothing is shuffled, no task depends on
another, and a lost task is repeated alone. Document text may be cut: whole sequences are cut off first, the rest is
placed, and room that no item fits is filled with the head of one. The last bin of a task becomes sequences of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import documents, slices
from .words import LibraryEncoder

POOL = 768  # items a task chooses among; when more arrive, bins are filled and given out
LEAST_CUT = 16  # tokens; smaller room is padded rather than filled with a cut
SEQUENCE_BITS = 40  # sequences numbered inside a task; the task's number stands above


class Pool:
    """Items with demand vectors, packed bin by bin by the dot-product rule."""

    def __init__(self, limits: list[float], cut: bool):
        self.limits = np.array(limits, float)
        self.cut = cut
        self.demands = np.empty((0, len(limits)))
        self.items: list = []

    def add(self, items: list, demands: np.ndarray) -> None:
        self.items += items
        self.demands = np.vstack([self.demands, demands])

    def fill(self) -> list:
        """One bin: indexes of the chosen items, in order of choice, and the room left."""
        shares = self.demands / self.limits
        room, open_, chosen = np.ones(len(self.limits)), np.ones(len(self.items), bool), []
        while True:
            fits = open_ & (shares <= room + 1e-12).all(axis=1)
            if not fits.any():
                return [chosen, np.rint(room * self.limits)]
            score = shares @ room
            score[~fits] = -1
            best = int(score.argmax())
            chosen.append(best)
            open_[best] = False
            room = room - shares[best]

    def drop(self, chosen: list[int]) -> list:
        """Take items out of the pool."""
        out, gone = [self.items[i] for i in chosen], set(chosen)
        self.items = [x for i, x in enumerate(self.items) if i not in gone]
        self.demands = np.delete(self.demands, chosen, axis=0)
        return out


def _loss(start: int, length: int) -> int:
    """Tokens of a piece that bear loss: all but a document's first, which nothing predicts."""
    return length - (start == 0)


class DocumentPacker:
    """Cuts and packs token ids of documents; rows are (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, first: int):
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.pool = Pool([tokens, segments, loss], cut=True)
        self.waiting: list = []
        self.next = first
        self.rows: list[tuple] = []

    def _emit(self, bin_: list) -> None:
        offset = 0
        for key, total, start, ids in bin_:
            self.rows.append((key, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def _demands(self, items: list) -> np.ndarray:
        return np.array([(len(ids) // 4, 1, _loss(start, len(ids) // 4)) for _, _, start, ids in items], float).reshape(-1, 3)

    def add(self, key, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        step = min(self.tokens, self.loss)
        while total - start >= step:
            self._emit([(key, total, start, ids[4 * start : 4 * (start + step)])])
            start += step
        if start < total:
            self.waiting.append((key, total, start, ids[4 * start :]))
        if len(self.waiting) >= POOL:
            self._pack(POOL // 2)

    def _pack(self, keep: int) -> None:
        """Fill bins until at most ``keep`` items wait."""
        self.pool.add(self.waiting, self._demands(self.waiting))
        self.waiting = []
        while len(self.pool.items) > keep:
            chosen, room = self.pool.fill()
            bin_ = self.pool.drop(chosen)
            gap = int(min(room[0], room[2]))
            if gap >= LEAST_CUT and room[1] >= 1 and self.pool.items:
                longest = int(self.pool.demands[:, 0].argmax())
                (key, total, start, ids), = self.pool.drop([longest])
                bin_.append((key, total, start, ids[: 4 * gap]))
                rest = [(key, total, start + gap, ids[4 * gap :])]
                self.pool.add(rest, self._demands(rest))
            if keep == 0 and not self.pool.items:
                self._last(bin_)
            else:
                self._emit(bin_)

    def _last(self, bin_: list) -> None:
        """Sequences of 1024, 512, ... tokens instead of one that needs padding."""
        left = sum(len(ids) // 4 for *_, ids in bin_)
        if self.tokens - left < LEAST_CUT:
            self._emit(bin_)
            return
        while bin_:
            room, out = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                key, total, start, ids = bin_.pop(0)
                n = min(room, len(ids) // 4)
                out.append((key, total, start, ids[: 4 * n]))
                if n < len(ids) // 4:
                    bin_.insert(0, (key, total, start + n, ids[4 * n :]))
                room -= n
            self._emit(out)

    def take(self, end: bool = False) -> list[tuple]:
        if end:
            self._pack(0)
        rows, self.rows = self.rows, []
        return rows


def pack_documents(
    df: DataFrame, path: str, end_id: int, tokens: int = 2048, segments: int = 256, loss: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are the tokenizers library's, with ``end_id`` after each document, so NULL and empty texts are pieces of one id.
    Every id lies in exactly one piece; a sequence holds at most ``tokens`` ids, ``segments`` pieces and ``loss``
    loss-bearing ids. Equal ids and repeated rows are packed like any others. An empty table gives no pieces.
    """
    docs = documents(df, id_col, text_col)
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint"
    )
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder.of_worker(path)
        packer = DocumentPacker(tokens, segments, loss, TaskContext.get().partitionId() << SEQUENCE_BITS)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for part in slices(batch):
                ids, ends = encoder.ids(part.column(1), end_id)
                packed = memoryview(ids.tobytes())
                for key, a, b in zip(part.column(0).to_pylist(), (4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist()):
                    packer.add(key, packed[a:b])
                yield out(packer.take())
        yield out(packer.take(end=True))

    return docs.mapInArrow(run, schema)


def pack_items(df: DataFrame, id_col: str, limits: dict[str, float]) -> DataFrame:
    """(id, sequence_id, position, fits): whole examples, never cut, placed under all limits at once.

    ``limits`` maps demand columns (tokens, segments, loss-bearing tokens, ...) to what a sequence may hold. NULL demands
    count as zero. An example over a limit gets a sequence of its own with ``fits`` false; repeated rows are separate
    examples; an empty table gives none.
    """
    names = list(limits)
    chosen = df.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"d{i}") for i, c in enumerate(names)])
    schema = f"id {chosen.schema['id'].dataType.simpleString()}, sequence_id bigint, position bigint, fits boolean"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    bounds = [float(limits[c]) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        pool = Pool(bounds, cut=False)

        def give(keep: int) -> Iterator[tuple]:
            nonlocal number
            while len(pool.items) > keep:
                for position, item in enumerate(pool.drop(pool.fill()[0])):
                    yield item, number, position, True
                number += 1

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            demands = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(bounds))])
            for at in range(0, len(ids), POOL):
                some, rows = demands[at : at + POOL], []
                fits = (some <= pool.limits).all(axis=1)
                for i in np.flatnonzero(~fits):
                    rows.append((ids[at + i], number, 0, False))
                    number += 1
                pool.add([ids[at + i] for i in np.flatnonzero(fits)], some[fits])
                yield out(rows + list(give(POOL // 2)))
        yield out(list(give(0)))

    return chosen.mapInArrow(run, schema)
