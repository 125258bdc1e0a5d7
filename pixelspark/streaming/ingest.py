"""Incremental ingestion with Structured Streaming.

A checkpointed stream remembers which inputs it has taken, so a restart resumes instead of repeating. What must
be known about *all* earlier data, the digests, is kept in a table and not in stream state: it has no horizon. See ``history``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import with_duplicate_of
from ..session import stored
from ..sources.manifest import path_exists
from .history import PARTS, KeyHistory


def new_only(batch: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those of the table ``landed``, which is scanned whole; see ``KeyHistory`` for a history of any size."""
    seen = landed.select(key).join(batch.select(key).distinct(), key, "left_semi").distinct()
    return batch.join(seen, key, "left_anti")


def first_of_each(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Earliest row per key inside one batch, with copies combined before the shuffle."""
    columns = [c for c in batch.columns if c != key]
    packed = batch.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("f"))
    return packed.select(*[key if c == key else F.col(f"f.{c}").alias(c) for c in batch.columns])


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a checkpoint: another one for every new checkpoint, the same after a restart."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]


def history_of(spark: SparkSession, table: str, parts: int = PARTS) -> KeyHistory:
    """The keys of a landing table, in a folder inside it that Spark's readers pass over."""
    return KeyHistory(spark, f"{table.rstrip('/')}/_history", parts)


def _append_unseen(spark: SparkSession, batch: DataFrame, table: str, key: str, order: str, stream: str, batch_id: int, parts: int = PARTS) -> None:
    if clash := {c for c in batch.columns if c.lower() in ("stream", "batch")}:
        raise ValueError(f"landed columns may not be called {', '.join(sorted(clash))}: the table's folders are")
    history, fresh = history_of(spark, table, parts), first_of_each(batch, key, order)
    if not history.exists() and path_exists(spark, table):  # a table from before there was a history
        landed = spark.read.parquet(table)
        history.append(landed, key, "earlier", 0)
    if history.exists():
        fresh = stored(fresh, "batch")  # asked twice
        known = history.seen(fresh, key, f"id-{stream}", batch_id).withColumnRenamed("key", "_key")
        fresh = fresh.join(known, F.col(key).cast("string") == F.col("_key"), "left_anti")
    # a repeated batch overwrites its own folder, so a retry after a lost driver adds nothing twice; other streams have others
    place = f"{table.rstrip('/')}/stream=id-{stream}/batch={batch_id}"
    fresh.write.mode("overwrite").parquet(place)
    history.append(spark.read.schema(fresh.schema).parquet(place), key, f"id-{stream}", batch_id)


def ingest_unseen(
    stream: DataFrame, table: str, checkpoint: str, key: str, order: str, prepare: Callable[[DataFrame], DataFrame] | None = None, parts: int = PARTS
):
    """Land every row whose ``key`` (a digest) was never seen before; runs over what is available and stops.

    Several streams, each with its checkpoint, may land in one table one after the other. Returns the finished
    query. ``prepare`` runs on each micro-batch first, for example to validate files. ``parts`` cuts the history of keys: more for
    longer histories, and always the same for one table.
    """
    spark = stream.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        _append_unseen(spark, prepare(batch) if prepare else batch, table, key, order, stream_id(spark, checkpoint), batch_id, parts)

    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_parquet(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_files(spark: SparkSession, root: str, glob: str = "*.png", files_per_batch: int = 100_000) -> DataFrame:
    """New files below ``root`` as (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(root)


def completion(expected: DataFrame, landed: DataFrame, group: str) -> DataFrame:
    """(group, expected, landed, complete): whether every group has all the rows it should have."""
    want = expected.groupBy(group).agg(F.count(F.lit(1)).alias("expected"))
    have = landed.groupBy(group).agg(F.count(F.lit(1)).alias("landed"))
    joined = want.join(have, group, "left").withColumn("landed", F.coalesce("landed", F.lit(0).cast("bigint")))
    return joined.withColumn("complete", F.col("landed") >= F.col("expected"))


__all__ = ["completion", "first_of_each", "ingest_unseen", "new_only", "stream_files", "stream_parquet", "with_duplicate_of"]
