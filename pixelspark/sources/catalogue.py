"""The catalogue of licensed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.licenses import is_allowed_license
from ..schemas import CATALOGUE


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per source, in file order (``position``)."""
    raw = spark.read.schema(CATALOGUE).option("multiLine", True).json(path)
    return raw.select(F.posexplode("sources").alias("position", "s")).select("position", "s.*")


def gate_sources(catalogue: DataFrame) -> DataFrame:
    """Add ``gate``: NULL to scan the source, else ``disabled`` or ``license_not_allowed``."""
    enabled = F.coalesce("enabled", F.lit(True))
    return catalogue.withColumn("gate", F.when(~enabled, "disabled").when(~is_allowed_license("license"), "license_not_allowed"))


def gate_report(gated: DataFrame) -> DataFrame:
    """Report rows of the sources that are never scanned."""
    closed = gated.where(F.col("gate").isNotNull())
    zero = F.lit(0).cast("bigint")
    return closed.select(
        F.col("name").alias("source"),
        zero.alias("scanned"),
        zero.alias("accepted"),
        zero.alias("rejected"),
        F.col("gate").alias("reason"),
        F.lit(1).cast("bigint").alias("count"),
        F.when(F.col("gate") == "disabled", F.col("blocked_reason")).alias("blocked_reason"),
    )


def open_sources(gated: DataFrame) -> list:
    """Rows of the sources to scan. A catalogue is a configuration file, so its rows may be listed here."""
    return gated.where(F.col("gate").isNull()).orderBy("position").collect()
