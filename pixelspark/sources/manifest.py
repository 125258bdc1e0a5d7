"""Manifests, dual sinks, reports, logs and the encodings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import text
from ..schemas import MANIFEST

# Manifest names in order of preference.
MANIFEST_NAMES = ("manifest.parquet", "manifest.jsonl")


def conform(rows: DataFrame, schema: str = MANIFEST) -> DataFrame:
    """Rows in the declared schema; columns they lack become NULL."""
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schema).fields
    return rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def write_manifest(rows: DataFrame, path: str, by_bucket: bool = False) -> None:
    """Write as Parquet or, for a ``.jsonl`` name, as JSON lines with sorted keys."""
    if path.rstrip("/").endswith(".jsonl"):
        rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)
        return
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("bucket") if by_bucket else writer).parquet(path)


def read_manifest(spark: SparkSession, path: str, root: str | None = None, schema: str = MANIFEST) -> DataFrame:
    """Read a manifest and point ``path`` below ``root``, so that a moved corpus stays usable."""
    reader = spark.read.schema(schema)
    rows = reader.json(path) if path.rstrip("/").endswith(".jsonl") else reader.parquet(path)
    base = (root if root is not None else path.rstrip("/").rsplit("/", 1)[0]).rstrip("/")
    return rows.withColumn("path", rebased_path(F.col("rel_path"), F.col("path"), base))


def rebased_path(rel_path: Column, path: Column, root: str) -> Column:
    return F.coalesce(F.concat(F.lit(root + "/"), text(rel_path)), path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def find_manifest(spark: SparkSession, root: str) -> str | None:
    for name in MANIFEST_NAMES:
        candidate = f"{root.rstrip('/')}/{name}"
        if path_exists(spark, candidate):
            return candidate
    return None


def write_accepted_and_held(rows: DataFrame, accepted_path: str, holdout_path: str, status: str = "status") -> None:
    """One classified table to two sinks; held rows are foldered by reason. Inputs are only read."""
    rows.where(F.col(status) == "accepted").write.mode("overwrite").parquet(accepted_path)
    rows.where(F.col(status) != "accepted").write.mode("overwrite").partitionBy("reason").parquet(holdout_path)


def write_report(report: DataFrame, path: str) -> None:
    """A report (section, key, count) as JSON lines."""
    report.select("section", "key", "count").write.mode("overwrite").json(path)


def write_report_document(document: DataFrame, path: str) -> None:
    """A one-row table with a JSON ``value`` as a text file."""
    document.select("value").coalesce(1).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def fingerprint(path: Column, modified: Column, length: Column, max_colors: int) -> Column:
    """Key of a cached encoding: it changes with the file or with the palette budget."""
    parts = (path, F.unix_micros(modified).cast("string"), length.cast("string"), F.lit(str(max_colors)))
    return F.sha2(F.concat_ws(":", *parts), 256)


def unencoded(files: DataFrame, encodings: DataFrame, key: str = "fingerprint") -> DataFrame:
    return files.join(encodings.select(key), key, "left_anti")
