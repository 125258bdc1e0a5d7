"""Reports as long tables ``(section, key, count)``; ``report_json`` folds one into a single JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import text

MAX_DOCUMENT_KEYS = 100_000


def _flag(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def present(name: str) -> Column:
    return text(F.col(name).cast("string")).isNotNull()


def totals(df: DataFrame, section: str, **counts: Column) -> DataFrame:
    """One row per named aggregate."""
    one = df.agg(*[c.cast("bigint").alias(n) for n, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("count")) for n in counts])
    return one.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.key", "p.count")


def histogram(df: DataFrame, section: str, key: Column) -> DataFrame:
    keyed = df.select(key.cast("string").alias("key")).where(F.col("key").isNotNull())
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).select(F.lit(section).alias("section"), "key", "count")


def manifest_report(rows: DataFrame) -> DataFrame:
    """Counts overall and by bucket, licence and tag, in one pass over the manifest.

    Every row is expanded to the few keys it counts under and the counts are combined before the shuffle.
    """
    def entry(section: str, key: Column | str) -> Column:
        return F.struct(F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).alias("key"))

    lossy = F.coalesce(F.col("lossy"), F.lit(False))
    entries = [
        entry("total", "count"),
        F.when(lossy, entry("total", "lossy")),
        F.when(~lossy, entry("total", "lossless")),
        F.when(present("duplicate_of"), entry("total", "duplicates")),
        F.when(present("near_duplicate_of"), entry("total", "near_duplicates")),
        F.when(F.col("bucket").isNotNull(), entry("bucket", F.col("bucket"))),
        F.when(present("license"), entry("license", F.col("license"))),
    ]
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: entry("tag", t))
    expanded = rows.select(F.explode(F.array_compact(F.concat(F.array(*entries), tags))).alias("e")).select("e.*")
    return expanded.groupBy("section", "key").agg(F.count(F.lit(1)).alias("count"))


def rejection_report(files: DataFrame, source: str = "source", reason: str = "reason") -> DataFrame:
    """(source, reason, count) per source, plus totals with source NULL; reason NULL counts everything scanned."""
    labelled = files.select(F.col(source).alias("source"), F.coalesce(F.col(reason), F.lit("accepted")).alias("reason"))
    return labelled.rollup("source", "reason").agg(F.count(F.lit(1)).alias("count")).unionByName(
        labelled.groupBy("reason").agg(F.count(F.lit(1)).alias("count")).select(F.lit(None).cast("string").alias("source"), "reason", "count")
    )


def distribution_report(rows: DataFrame) -> DataFrame:
    """Sizes, palette sizes and transparency of accepted images; ``position`` orders numeric keys by value."""
    keys = F.array(
        F.struct(F.lit("size").alias("section"), F.concat_ws("x", "width", "height").alias("key"), F.lit(0).alias("position")),
        F.struct(F.lit("palette_size").alias("section"), F.col("palette_size").cast("string").alias("key"), F.col("palette_size").cast("int").alias("position")),
        F.struct(F.lit("transparency").alias("section"), F.col("transparency").cast("string").alias("key"), F.lit(0).alias("position")),
    )
    expanded = rows.select(F.explode(keys).alias("e")).select("e.*")
    return expanded.groupBy("section", "key", "position").agg(F.count(F.lit(1)).alias("count"))


def readiness(rows: DataFrame, min_count: int) -> DataFrame:
    selected = rows.agg(F.count(F.lit(1)).alias("selected"))
    status = F.when(F.col("selected") >= min_count, "ready").otherwise("below_min_count")
    return selected.select("selected", status.alias("status"))


def curation_report(rows: DataFrame, eligible: Column, group: Column, selected: DataFrame, cap: int) -> DataFrame:
    """Counts of a curation run; the dropped counts overlap and cover all rows."""
    one = totals(
        rows,
        "curation",
        eligible=F.count_if(eligible),
        dropped_lossy=_flag(F.col("lossy")),
        dropped_duplicates=_flag(present("duplicate_of")),
        dropped_near_duplicates=_flag(present("near_duplicate_of")),
        per_group_cap=F.max(F.lit(cap)),
    )
    chosen = totals(selected, "curation", selected=F.count(F.lit(1)))
    return one.unionByName(chosen).unionByName(histogram(rows.where(eligible), "group", group))


def split_report(rows: DataFrame, split: str = "split") -> DataFrame:
    lossy = F.count_if("lossy")
    return rows.groupBy(F.col(split).alias("split")).agg(
        F.count(F.lit(1)).alias("count"), lossy.alias("lossy"), (F.count(F.lit(1)) - lossy).alias("lossless")
    )


def quality_summary(rows: DataFrame, score: str = "quality") -> DataFrame:
    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        _flag(present("duplicate_of")).alias("duplicate_count"),
        _flag(present("near_duplicate_of")).alias("near_duplicate_count"),
        or_zero(F.avg(score)).alias("mean_quality"),
        or_zero(F.min(score)).alias("min_quality"),
        or_zero(F.max(score)).alias("max_quality"),
    )


def throughput_report(counts: DataFrame, seconds: float) -> DataFrame:
    """Samples per second and projected hours for two corpus sizes, from per-bucket counts (bucket, count)."""
    total = F.sum("count")
    per_second = total / F.lit(max(seconds, 1e-9))
    return counts.agg(
        total.alias("samples"),
        F.lit(seconds).alias("seconds"),
        per_second.alias("samples_per_second"),
        (F.lit(500_000) / per_second / 3600).alias("epoch_hours_500k"),
        (F.lit(1_000_000) / per_second / 3600).alias("epoch_hours_1m"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "count")))).alias("buckets"),
    )


def report_json(report: DataFrame) -> DataFrame:
    """One row ``value``: {section: {key: count}} with sorted keys. One document has to fit in one row, so the
    number of keys is checked first; the long table has no such limit."""
    if report.limit(MAX_DOCUMENT_KEYS + 1).count() > MAX_DOCUMENT_KEYS:
        raise ValueError(f"a report of more than {MAX_DOCUMENT_KEYS} keys stays a table")
    by_section = report.groupBy("section").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "count")))).alias("counts"))
    folded = by_section.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", F.to_json("counts").alias("json"))))).alias("m"))
    parts = F.transform(F.map_entries("m"), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), e["value"]))
    cleaned = F.transform(parts, lambda p: F.regexp_replace(p, r'^\["((?:[^"\\]|\\.)*)"\]', '"$1"'))
    return folded.select(F.concat(F.lit("{"), F.concat_ws(",", cleaned), F.lit("}")).alias("value"))
