"""Eligibility, balancing and training filters on manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import text
from ..functions.licenses import is_allowed_license
from ..session import cut_lineage
from .shuffles import ordered_take, seeded_take


def is_eligible(lossy: str = "lossy", duplicate_of: str = "duplicate_of", near: str = "near_duplicate_of", license_: str = "license") -> Column:
    def absent(c: str) -> Column:
        return text(F.col(c).cast("string")).isNull()

    return ~F.coalesce(F.col(lossy), F.lit(False)) & absent(duplicate_of) & absent(near) & is_allowed_license(license_)


def group_key(category: Column, bucket: Column) -> Column:
    return F.concat(F.coalesce(text(category), F.lit("uncategorized")), F.lit("|"), F.coalesce(bucket, F.lit("None")))


def balanced_sample(
    rows: DataFrame, target_count: int, per_bucket_cap: int | None = None, seed: int = 0, key: str = "rel_path", group: str = "group"
) -> DataFrame:
    """At most ``cap`` rows per group and ``target_count`` overall, both by a seeded shuffle.

    ``rows`` are read several times, so they should be a stored table.
    Without a cap it is the target shared out over the groups; what small groups leave over is not passed on.
    """
    cap = sample_cap(rows, target_count, per_bucket_cap, group)
    capped = cut_lineage(seeded_take(rows, [key], seed, F.lit(cap), [group]))
    return capped if capped.count() <= target_count else seeded_take(capped, [key], seed + 1, F.lit(target_count))


def sample_cap(rows: DataFrame, target_count: int, per_bucket_cap: int | None, group: str = "group") -> int:
    if per_bucket_cap:
        return per_bucket_cap
    groups = max(1, rows.select(group).distinct().count())
    return max(1, -(-target_count // groups))


def training_filter(
    rows: DataFrame, max_bucket_size: int | None = None, include_lossy: bool = False, limit: int | None = None, order: str = "rel_path"
) -> DataFrame:
    """Rows usable for training, the first ``limit`` by path: a predicate on the manifest, so nothing is decoded."""
    kept = rows
    if max_bucket_size is not None:
        kept = kept.where(F.col("bucket_size") <= max_bucket_size)
    if not include_lossy:
        kept = kept.where(~F.col("lossy"))
    return first_rows(kept, limit, order)


def exact_size_filter(rows: DataFrame, size: int, limit: int | None = None, order: str = "rel_path") -> DataFrame:
    return first_rows(rows.where(F.col("bucket_size") == size), limit, order)


def max_size_filter(rows: DataFrame, size: int, limit: int | None = None, order: str = "rel_path") -> DataFrame:
    return first_rows(rows.where(F.col("bucket_size") <= size), limit, order)


def first_rows(rows: DataFrame, limit: int | None, order: str = "rel_path") -> DataFrame:
    """The first ``limit`` rows by path (all without a limit). Only keys are looked at to find the cut, and no more sorted than its range."""
    if not limit:
        return rows
    # components compare one by one, as no character is smaller than this separator
    return ordered_take(rows, F.replace(F.col(order), F.lit("/"), F.lit("\x00")), limit)
