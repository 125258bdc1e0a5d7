"""Building blocks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import seeded_hex
from ..session import cut_lineage

HEAVY_KEYS = 512  # rows of the broadcast side below: a bound that does not grow with the data
SPREAD = 256
RANGES = 255  # keys between which keys are counted; a bound on what the driver holds
SORTED_AT_ONCE = 1_000_000  # keys of a range that are sorted to find a cut
RANGE_DIGITS = 3  # hexadecimal digits: 4,096 ranges of a hash


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, for tables that grow with the data.

    Spark guesses sizes from compressed files and without the rows that an explode adds, so it takes paths, keys of blocks and the like
    for small and brings them whole to the driver. Stored hashes and results of joins it does not underrate so, they need no mark.
    """
    return df.hint("merge")


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, spread_by: Sequence[str], grows: bool = False) -> DataFrame:
    """Left join to a table with one row per key, safe for hot keys.

    The ``HEAVY_KEYS`` heaviest keys (by ``weight``, the number of left rows) are looked up in a broadcast of at
    most that many rows. Their left rows then carry a salt that cannot match and so scatter over the shuffle
    that serves all other keys, each of which holds less than 1/512 of the rows. With ``grows``, for a ``right`` that grows with the
    data, the other keys are never broadcast.
    """
    on = list(on)
    values = [c for c in right.columns if c not in on]
    heavy = right.orderBy(F.desc(weight), *on).limit(HEAVY_KEYS)
    heavy = heavy.select(*[F.col(k).alias(f"_h_{k}") for k in on], F.struct(*values).alias("_heavy"))
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    marked = left.join(F.broadcast(heavy), same, "left").drop(*[f"_h_{k}" for k in on])
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("int") + 1
    marked = marked.withColumn("_salt", F.when(F.col("_heavy").isNotNull(), salt).otherwise(F.lit(0)))
    zero = F.pmod(F.xxhash64(*on), F.lit(1)).cast("int")  # a plain 0 would be folded out of the keys of the shuffle
    light = right.select(*on, F.struct(*values).alias("_light"), zero.alias("_salt"))
    joined = marked.join(shuffled(light) if grows else light, [*on, "_salt"], "left")
    found = F.coalesce("_heavy", "_light")
    keep = [c for c in left.columns if c not in values]
    return joined.select(*keep, *[found[v].alias(v) for v in values])


def _histogram(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per (group, hash range) with the rows of the group before the range, and in all."""
    counts = df.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *groups,
        "_range",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )


def _keyed(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    hashed = df.withColumn("_hash", seeded_hex(seed, *[F.col(k) for k in key]))
    return hashed.withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))


def seeded_rank(
    df: DataFrame, key: Sequence[str], seed: int, groups: Sequence[str] = (), out: str = "rank", total: str | None = None
) -> DataFrame:
    """Exact 1-based position of every row in a seeded shuffle, per group or overall.

    Equal to ``row_number() over (partition by groups order by md5(seed:key), key)``, but each group is cut into
    4,096 hash ranges that are ranked apart and offset by a small histogram, so no task holds a whole group.
    ``total`` names a column for the size of the group.
    """
    groups = list(groups)
    hashed = _keyed(df, key, seed)
    offsets = _histogram(hashed, groups).select(*groups, "_range", "_before", *([F.col("_total").alias(total)] if total else []))
    joined = hashed.join(offsets, [*groups, "_range"])
    inside = Window.partitionBy(*groups, "_range").orderBy("_hash", *key)
    ranked = joined.withColumn(out, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
    return ranked.select(*df.columns, out, *([total] if total else []))


def _last_rows(narrow: DataFrame, key: Sequence[str], cuts: DataFrame, on: Sequence[str], give: Sequence[str]) -> DataFrame:
    """(give..., _last): order value of the ``_need``-th row of each hash range that ``cuts`` names.

    Only the ranges with a cut are sorted; ``narrow`` holds no more than keys, groups and hashes.
    """
    inside = Window.partitionBy(*on, *[g for g in give if g not in on]).orderBy("_hash", *key)
    edge = narrow.join(cuts, list(on)).withColumn("_rn", F.row_number().over(inside))
    return edge.where(F.col("_rn") == F.col("_need")).select(*give, F.struct("_hash", *key).alias("_last"))


def seeded_take(df: DataFrame, key: Sequence[str], seed: int, limit: Column, groups: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` rows of every group in a seeded shuffle.

    The order value of each group's last row is found on keys alone: a histogram of hash ranges names the range
    with the cut, and only that range is sorted. Rows are then kept by comparing with that value, so the rows
    themselves are read once and need no sort.
    """
    groups = list(groups)
    narrow = _keyed(df.select(*groups, *[k for k in key if k not in groups]), key, seed)
    histogram = _histogram(narrow, groups).withColumn("_limit", limit.cast("bigint"))
    inside = (F.col("_before") < F.col("_limit")) & (F.col("_before") + F.col("_n") >= F.col("_limit"))
    cuts = histogram.where(inside).select(*groups, "_range", (F.col("_limit") - F.col("_before")).alias("_need"))
    last = _last_rows(narrow, key, cuts, [*groups, "_range"], groups)
    mine = F.struct("_hash", *key)
    hashed = _keyed(df, key, seed)
    if not groups:
        one = last.agg(F.first("_last").alias("_last"))  # one row; NULL when the limit exceeds the rows
        kept = hashed.join(F.broadcast(one), F.lit(True)).where(F.col("_last").isNull() | (mine <= F.col("_last")))
        return kept.select(*df.columns)
    totals = histogram.groupBy(*groups).agg(F.sum("_n").alias("_weight"), F.max("_limit").alias("_limit"))
    table = totals.join(last, groups, "left")
    placed = lookup_join(hashed, table, groups, "_weight", key)
    return placed.where((F.col("_limit") > 0) & (F.col("_last").isNull() | (mine <= F.col("_last")))).select(*df.columns)


def seeded_split(df: DataFrame, key: Sequence[str], seed: int, parts: Sequence[tuple[str, float | None]], out: str = "split") -> DataFrame:
    """Label rows with exact-count parts of a seeded shuffle.

    ``parts`` lists (label, fraction) in shuffle order; a part has ``max(1, round_half_even(n * fraction))``
    rows and the last one, with fraction None, the rest. The order values of the parts' last rows are found on
    keys alone (see ``seeded_take``); labelling compares with them, so the rows are read once and not shuffled.
    """
    narrow = _keyed(df.select(*key), key, seed)
    ends, end = [], F.lit(0).cast("bigint")
    for i, (_, fraction) in enumerate(parts[:-1]):
        end = end + F.greatest(F.lit(1), F.bround(F.col("_total") * F.lit(fraction)).cast("bigint"))
        ends.append(F.struct(F.lit(i).alias("i"), end.alias("at")))
    inside = F.filter(F.array(*ends), lambda e: (e["at"] > F.col("_before")) & (e["at"] <= F.col("_before") + F.col("_n")))
    cuts = _histogram(narrow, []).select("_range", "_before", F.explode(inside).alias("e"))
    cuts = cuts.select("_range", F.col("e.i").alias("_part"), (F.col("e.at") - F.col("_before")).alias("_need"))
    last = _last_rows(narrow, key, F.broadcast(cuts), ["_range"], ["_part"])  # one row per part
    bounds = last.agg(F.map_from_entries(F.collect_list(F.struct("_part", "_last"))).alias("_bounds"))
    hashed = _keyed(df, key, seed).join(F.broadcast(bounds), F.lit(True))
    mine = F.struct("_hash", *key)
    label = F.when(F.lit(False), F.lit(""))
    for i, (name, _) in enumerate(parts[:-1]):
        bound = F.col("_bounds")[i]
        # a part that would end after the last row has no bound and takes all that is left
        label = label.when(bound.isNull() | (mine <= bound), name)
    return hashed.select(*df.columns, label.otherwise(parts[-1][0]).alias(out))


def _range_of(key: Column, bounds: list, low: int = 0, high: int | None = None) -> Column:
    """Number of bounds at or below the key, by halving."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key < F.lit(bounds[middle]), _range_of(key, bounds, low, middle)).otherwise(_range_of(key, bounds, middle + 1, high))


def ordered_take(df: DataFrame, key: Column, limit: int, ranges: int = RANGES, sorted_at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """The first ``limit`` rows by ``key`` (a string), in no order; of rows with one key at the cut as many as fit.

    Nothing is sorted but keys of the range that holds the cut: keys are counted in ranges between ``ranges`` keys drawn by hash from those in
    question, the range with the cut is cut up again until it is small, and its keys give the last one taken. ``df`` is scanned for each
    step, for its keys alone, and once for the rows.
    """
    keys = df.select(F.coalesce(key, F.lit("")).alias("k"))
    low, high, inside, before = None, None, F.lit(True), 0  # the keys in question, and how many lie below them
    while True:
        some = keys.where(inside)
        bounds = sorted({r.k for r in some.orderBy(F.xxhash64("k"), "k").limit(ranges).collect()})
        counts = dict(some.groupBy(_range_of(F.col("k"), bounds).alias("r")).agg(F.count(F.lit(1))).collect())  # one row a range
        at = 0
        while at <= len(bounds) and before + counts.get(at, 0) < limit:
            before += counts.get(at, 0)
            at += 1
        if at > len(bounds):
            return df
        low, high = bounds[at - 1] if at else low, bounds[at] if at < len(bounds) else high
        inside = (F.lit(True) if low is None else F.col("k") >= low) & (F.lit(True) if high is None else F.col("k") < high)
        if counts[at] <= sorted_at_once or len(bounds) == 1:
            break
    need = limit - before
    cut = keys.where(inside).orderBy("k").limit(need).agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n")).first()["k"]
    ends = keys.where(inside & (F.col("k") <= cut)).agg(F.count_if(F.col("k") < cut).alias("below"), F.count_if(F.col("k") == cut).alias("there")).first()
    mine = F.coalesce(key, F.lit(""))
    if ends["below"] + ends["there"] == need:
        return df.where(mine <= cut)
    return df.where(mine < cut).unionByName(df.where(mine == cut).limit(need - ends["below"]))


def ordered_rank(df: DataFrame, order: Column, out: str = "rank") -> DataFrame:
    """Exact 1-based position of every row in one overall order, without bringing the rows to one task.

    A range-partitioned sort numbers rows inside their partition; the partition sizes, one row per partition,
    turn that into overall positions. The sorted rows are stored first so that both passes see the same cut.
    """
    placed = cut_lineage(df.orderBy(order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_local", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + F.col("_local") + 1)
    return ranked.select(*df.columns, out)
