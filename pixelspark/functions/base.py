"""Small column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once per row.

    A column used inside a lambda is evaluated again for every element once the optimiser has merged the
    projections; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def pinned(value: Column) -> Column:
    """The value as a column of its own that the planner leaves where it is.

    Needed for arguments of Python UDFs, which cannot hold nested lambdas that use an outer lambda's variable.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def text(c: Column | str) -> Column:
    """NULL and '' both count as absent; yields NULL for either."""
    c = col(c)
    return F.when(F.length(c) > 0, c)


def seeded_hex(seed: int, *key: Column) -> Column:
    """Deterministic pseudo-random order key, the same in every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def seeded_int(seed: int, *key: Column) -> Column:
    """Uniform integer in 0 .. 2^32-1 from ``seeded_hex``."""
    return F.conv(F.substring(seeded_hex(seed, *key), 1, 8), 16, 10).cast("bigint")


def seeded_unit(seed: int, *key: Column) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_int(seed, *key) / F.lit(4294967296.0)
