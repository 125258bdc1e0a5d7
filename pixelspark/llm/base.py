"""What the operators share: texts in bounded slices of Arrow batches, row keys, and keeping chosen rows.

Conventions of every operator here:

* It reads the id and text columns it is told, nothing else, so extra columns, whatever their names, never matter.
* A NULL text counts as empty (where a contract says "none": no words). A NULL id is an id like any other and stays NULL.
* Repeated rows each get their own result row.
* An empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from itertools import chain, count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 4 << 20  # text handled at once inside a task; bounds the memory of a Python worker, never the work


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with NULL texts as empty ones."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = [x or 0 for x in pa.compute.binary_length(column).to_pylist()]
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, start: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """Rows made from slices of (doc_id, text). ``start`` runs once per task and returns the function of a slice:
    it takes the ids and the texts and returns the columns of ``schema``."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(work(part.column(0), part.column(1).to_pylist()), schema=arrow)

    return df.mapInArrow(run, schema)


def free_worker() -> None:
    """Give back what tasks of other operators have kept in this Python worker, tokenizers and encoded words above all."""
    kept = getattr(sys.modules.get("_pixelspark_worker"), "kept", None)
    if kept:
        kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """Rows made from Arrow batches, cut into slices if there is a column ``text``: ``work`` returns the columns of ``schema``."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    cut = "text" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            for part in slices(batch, most=most) if cut else [batch]:
                yield pa.RecordBatch.from_pydict(work(part), schema=arrow)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in chain([name], (f"{name}_{i}" for i in count())) if n.lower() not in taken)


def row_key(doc_id="doc_id", text="text") -> list:
    """Two never-NULL numbers, independent hashes of id and text, that tell rows apart whatever the id's type. Rows that share both
    are taken as repetitions of one row."""
    return [
        F.xxhash64(F.lit(1), F.col(text), F.lit(2), F.col(doc_id)).alias("row_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("row_hash"),
    ]


def first_row() -> Column:
    """Orders rows by id, NULL ids last, and tells apart those that share one."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", "row_hash")


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose row key is in ``keys`` (row_id, row_hash); of repeated rows one stays.

    One shuffle by the id. The numbering of repetitions reuses that partitioning, and ids are spread evenly.
    """
    a, b = fresh(docs, "row_id"), fresh(docs, "row_hash")
    n = fresh(docs, "row_copy")
    key_id, key_hash = row_key()
    keyed = docs.withColumns({a: key_id, b: key_hash})
    wanted = keys.select(F.col("row_id").alias(a), F.col("row_hash").alias(b)).distinct()
    copy = F.expr(f"row_number() over (partition by `{a}`, `{b}` order by `{b}`)")
    return keyed.join(wanted, [a, b], "left_semi").withColumn(n, copy).where(F.col(n) == 1).select(*docs.columns)
