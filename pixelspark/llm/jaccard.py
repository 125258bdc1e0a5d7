"""Exact similarity join on sets of word shingles: links are pairs of sets whose intersection is at least a given share of their union.

Sets that can have no partner leave early. Two linked sets of n >= m elements share at least ``PERCENT`` % of n, so they have
some of the smallest hashes in common: only about a third of each set is dealt to find those that share enough. Of the sets that
are left, only the elements that another one has are kept, rarest first.

Then the join is split by size. A small set enumerates its subsets of just the size that a partner of each possible size must share;
whoever meets at a subset is linked, so a group at a subset needs one link a member and no comparison. Larger sets are found by
scanning inverted lists of their rarest elements. The boundary between the two is the one of least cost, the number of subsets
below it plus the lengths of the lists scanned above it.

A list first compares its members with its most central one (the one with most of its elements shared), which joins nearly all of a
crowd of near copies at one pair a member. Only pairs that are still apart and that size and place in the list allow are compared
afterwards, so no link between different sets is lost. Long lists are cut into parts for this.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shuffles import lookup_join
from ..session import cut_lineage, scratch_path, stored
from .arrays import mix, shingle_sets
from .base import first_row, keep_rows, map_batches, row_key
from .simhash import components, majority, near_links

WORDS = 5
PERCENT = 80
SMALL = 24  # no set above this size enumerates subsets: with a tenth of 25 missing they are over 50,000
DIVIDE = 8  # one in so many elements is asked to be shared among the smallest hashes
BROADCAST_ROWS = 200_000  # narrow rows; more are joined by shuffles
PART = 1024  # members of an inverted list that are compared in one group


def least_common(n: int, percent: int) -> int:
    """Elements that a set of n shares with any partner."""
    return -(-percent * n // 100)


def needed(n: int, m: int, percent: int) -> int:
    """Elements that linked sets of n and m share."""
    return -(-percent * (n + m) // (100 + percent))


def _needed(n: str, m: str, percent: int) -> str:
    return f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _describe(texts: pa.Array, words: int, percent: int) -> dict:
    """Of each text: name (a, b) and size of its set, its smallest hashes, of which the first ``told`` are only witnesses, and how many of
    those hashes other sets of the same slice have."""
    sets = shingle_sets(texts, words)
    names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    probes, told, known = [np.empty(0, np.uint64)] * len(sets), [0] * len(sets), [0] * len(sets)
    first = list({name: i for i, name in reversed(list(enumerate(names)))}.values())  # of equal sets one speaks
    ends = [len(sets[i]) - least_common(len(sets[i]), percent) + -(-len(sets[i]) // DIVIDE) for i in first]
    parts = [sets[i][:end] for i, end in zip(first, ends)]
    tokens = np.concatenate([np.empty(0, np.uint64), *parts])
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, at, inverse, counts = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    witness = np.zeros(len(tokens), bool)
    witness[at] = True
    for i, start, stop in zip(first, *(np.searchsorted(owner, np.arange(len(parts)) + k) for k in (0, 1))):
        s, t, w = shared[start:stop], tokens[start:stop], witness[start:stop]
        probes[i], told[i], known[i] = np.concatenate([t[s & w], t[~s]]), int((s & w).sum()), int(s.sum())
    low, high = np.uint64, (1 << 64) - 1
    return {
        "a": _signed(np.array([x & high for x in names], low)),
        "b": _signed(np.array([x >> 64 for x in names], low)),
        "n": np.array([len(s) for s in sets], np.int64),
        "known": np.array(known, np.int64),
        "told": np.array(told, np.int64),
        "probe": pa.array([_signed(p) for p in probes], pa.list_(pa.int64())),
    }


def _promising(rows: DataFrame, percent: int) -> DataFrame:
    """Sets (a, b, n, least, first) that share enough of their smallest hashes with others to have a partner."""
    dealt = rows.where("size(probe) > 0").select("a", "told", F.posexplode("probe").alias("i", "t")).selectExpr("a", "t", "i >= told as counts")
    met = dealt.selectExpr("*", "min(a) over (partition by t) as low", "max(a) over (partition by t) as high")
    hits = met.where("low <> high and counts").groupBy("a").agg(F.count(F.lit(1)).alias("hits"))
    sets = rows.groupBy("a", "b").agg(F.first("n").alias("n"), F.max("known").alias("known"), F.min(first_row()).alias("first"), F.count(F.lit(1)).alias("copies"))
    enough = f"known + coalesce(hits, 0) >= ({percent} * n + {100 * DIVIDE - 1}) div {100 * DIVIDE}"
    return sets.join(hits, "a", "left").withColumn("promising", F.expr(f"n > 0 and {enough}")).select("a", "b", "n", "first", "copies", "promising")


def _elements(docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(u, a, b, s): numbered promising sets with their elements, from one row of ``docs`` each."""
    spark = docs.sparkSession
    wanted = cut_lineage(sets.where("promising").select("a", "b", "first.row_id", "first.row_hash"))
    n = wanted.count()
    texts = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, ["row_id", "row_hash"]).select("a", "b", "text")

    def work(batch: pa.RecordBatch) -> dict:
        return {"a": batch.column(0), "b": batch.column(1), "s": pa.array([_signed(s) for s in shingle_sets(batch.column(2), words)], pa.list_(pa.int64()))}

    folder = scratch_path(spark, "elements")
    made = map_batches(texts, work, "a bigint, b bigint, s array<bigint>")
    made.withColumn("u", F.monotonically_increasing_id()).write.parquet(folder)
    found = spark.read.parquet(folder)
    return found if found.count() == n else found.dropDuplicates(["a", "b"])  # repeated rows have equal sets


def _ranked(elements: DataFrame, percent: int) -> DataFrame:
    """(u, a, b, n, s): sets with their elements that others have too, as (df, t) with the rarest first; only those with enough of them."""
    dealt = elements.select("u", F.explode("s").alias("t"))
    df = dealt.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = lookup_join(dealt, df, ["t"], "df", ["u"]).where("df is not null")
    ordered = shared.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r"))
    sizes = elements.select("u", "a", "b", F.size("s").cast("bigint").alias("n"))
    return sizes.join(ordered, "u").where(f"100 * size(r) >= {percent} * n").withColumnRenamed("r", "s")


def boundary(ranked: DataFrame, percent: int) -> int:
    """The size up to which sets enumerate subsets, so that subsets below plus list lengths above are fewest."""
    prefix = f"aggregate(slice(s, 1, size(s) - cast(({percent} * n + 99) div 100 as int) + 1), 0D, (x, e) -> x + e.df)"
    cost = ranked.where(F.col("n") <= SMALL).groupBy("n", F.size("s").alias("r")).agg(F.count(F.lit(1)).alias("k"), F.expr(f"sum({prefix})").alias("scan"))
    subsets, scans = dict.fromkeys(range(SMALL + 1), 0.0), dict.fromkeys(range(SMALL + 1), 0.0)
    for row in cost.collect():  # at most SMALL * SMALL rows
        subsets[row.n] += row.k * sum(comb(row.r, needed(row.n, m, percent)) for m in partner_sizes(row.n, percent))
        scans[row.n] += row.scan
    return min(range(SMALL + 1), key=lambda x: (sum(subsets[n] for n in range(x + 1)) + sum(scans[n] for n in range(x + 1, SMALL + 1)), -x))


def partner_sizes(n: int, percent: int) -> range:
    return range(least_common(n, percent), 100 * n // percent + 1)


def _without(h: np.ndarray, leave: int) -> np.ndarray:
    """Sums of the hashes of all subsets that leave out ``leave`` of the elements, pairwise sums of two independent hashes each."""
    from itertools import combinations

    both = np.stack([h, mix(h + np.uint64(7))])
    total = both.sum(axis=1, dtype=np.uint64)
    out = np.fromiter((i for c in combinations(range(len(h)), leave) for i in c), np.int64).reshape(comb(len(h), leave), leave)
    return total[:, None] - both[:, out].sum(axis=2, dtype=np.uint64)


def subset_links(ranked: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b): links of all linked sets of at most ``most`` elements, as one or two per set and subset."""

    def work(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("u", "low", "high", "x", "y", "large")}
        for u, n, s in zip(*(c.to_pylist() for c in batch.columns)):
            h = mix(np.array(s, np.int64).view(np.uint64))
            for m in partner_sizes(n, percent):
                leave = len(h) - needed(n, m, percent)
                if m <= most and leave >= 0:
                    x, y = _without(h, leave)
                    k = len(x)
                    for name, value in zip(out, (u, min(n, m), max(n, m))):
                        out[name].append(np.full(k, value, np.int64))
                    out["x"].append(_signed(x))
                    out["y"].append(_signed(y))
                    out["large"].append(np.full(k, n > m))
        none = np.empty(0, np.int64)
        return {k: np.concatenate([none, *v]).astype(bool if k == "large" else np.int64) for k, v in out.items()}

    small = ranked.where(F.col("n") <= most).select("u", "n", F.col("s.t").alias("s"))
    dealt = cut_lineage(map_batches(small, work, "u bigint, low bigint, high bigint, x bigint, y bigint, large boolean"))
    keys = ["low", "high", "x", "y"]
    # sets of two sizes must both be there; of one size, two of them
    both = "if(low = high, count(1) > 1, bool_or(large) and not bool_and(large))"
    meet = dealt.groupBy(*keys).agg(F.min("u").alias("least"), F.count(F.lit(1)).alias("members"), F.expr(both).alias("linked")).where("linked").drop("linked")
    joined = lookup_join(dealt, meet, keys, "members", ["u"]).where("least is not null and least <> u")
    return joined.select(F.col("u").alias("a"), F.col("least").alias("b")).distinct()


def inverted_lists(ranked: DataFrame, above: int, percent: int) -> DataFrame:
    """(t, u, n, r, i, index): members of the lists that sets with a partner above ``above`` are found by: place i of element t among
    the r shared elements of set u, and whether a partner of equal or greater size looks here."""
    large = ranked.where(100 * F.col("n") >= percent * (above + 1)).withColumn("r", F.size("s").cast("bigint"))
    probe = f"cast(r - ({percent} * n + 99) div 100 + 1 as int)"
    placed = large.select("u", "n", "r", F.posexplode(F.expr(f"slice(s, 1, {probe})")).alias("i", "e"))
    lists = placed.selectExpr("e.t as t", "u", "n", "r", "cast(i as bigint) as i", f"i <= r - {_needed('n', 'n', percent)} as index")
    folder = scratch_path(ranked.sparkSession, "lists")
    lists.write.parquet(folder)
    return ranked.sparkSession.read.parquet(folder)


def _possible(x: str, y: str, above: int, percent: int) -> str:
    """x comes first by (n, r, u): what sizes and places allow."""
    return (
        f"struct({x}.n, {x}.r, {x}.u) < struct({y}.n, {y}.r, {y}.u) and {x}.index and {y}.n > {above} and 100 * {x}.n >= {percent} * {y}.n "
        f"and least({x}.r - {x}.i, {y}.r - {y}.i) >= {_needed(f'{x}.n', f'{y}.n', percent)}"
    )


def _verified(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """(a, b): those of the pairs (a, b) of set numbers that are linked."""
    own = ranked.select("u", "n", F.col("s.t").alias("s"))
    both = pairs.distinct().join(own.selectExpr("u as b", "n as m", "s as z"), "b").join(own.selectExpr("u as a", "n", "s"), "a")
    common = F.size(F.array_intersect("s", "z"))
    return both.where((100 + percent) * common >= percent * (F.col("n") + F.col("m"))).select("a", "b")


def fingerprint_links(elements: DataFrame, ranked: DataFrame, percent: int, bits: int) -> DataFrame:
    """(a, b): links between sets whose SimHash fingerprints are within ``bits``, each verified; a fingerprint's first set speaks for it."""
    spark = elements.sparkSession

    def work(batch: pa.RecordBatch) -> dict:
        found = [majority(np.asarray(s, np.int64).view(np.uint64)) for s in batch.column(1).to_numpy(zero_copy_only=False)]
        return {"u": batch.column(0), "h": _signed(np.array(found, np.uint64))}

    folder = scratch_path(spark, "fingerprints")
    map_batches(elements.select("u", "s"), work, "u bigint, h bigint").join(ranked.select("u"), "u", "left_semi").write.parquet(folder)
    made = spark.read.parquet(folder)
    first = made.groupBy("h").agg(F.min("u").alias("first"), F.count(F.lit(1)).alias("sets"))
    equal = lookup_join(made, first, ["h"], "sets", ["u"]).selectExpr("first as a", "u as b").where("a <> b")
    near = near_links(first.select("h"), bits).selectExpr("a as x", "b as y").distinct()
    near = near.join(first.selectExpr("h as x", "first as a"), "x").join(first.selectExpr("h as y", "first as b"), "y")
    return _verified(equal.union(near.selectExpr("least(a, b) as a", "greatest(a, b) as b")), ranked, percent)


def list_links(lists: DataFrame, ranked: DataFrame, links: DataFrame, above: int, percent: int) -> DataFrame:
    """(a, b): links that together with ``links`` join what is linked: to each list's central member first, then between what is still
    apart."""
    central = F.max_by(F.struct("u", "n", "r", "i", "index"), F.struct(F.col("r") / F.col("n"), -F.col("u"))).alias("centre")
    centres = lists.groupBy("t").agg(central, F.count(F.lit(1)).alias("members")).where("members > 1")
    folder = scratch_path(lists.sparkSession, "centred")
    lookup_join(lists, centres, ["t"], "members", ["u"]).where("centre is not null").write.parquet(folder)
    full = lists.sparkSession.read.parquet(folder)
    row = F.struct("u", "n", "r", "i", "index").alias("x")
    near = full.select(row, F.col("centre").alias("y")).where(f"x.u <> y.u and ({_possible('x', 'y', above, percent)} or {_possible('y', 'x', above, percent)})")
    first = _verified(near.selectExpr("least(x.u, y.u) as a", "greatest(x.u, y.u) as b"), ranked, percent)
    found = cut_lineage(links.union(first))

    roots = components(found)
    placed = full.join(roots.withColumnRenamed("h", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    apart = placed.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    apart = stored(apart.select("t", "size"), "apart")
    open_lists = cut_lineage(lookup_join(placed.drop("members", "centre"), apart, ["t"], "size", ["u"]).where("size is not null"))
    parts = F.expr(f"cast(size div {PART} as int) + 1")
    cut = open_lists.withColumn("part", F.pmod(F.xxhash64("u"), parts).cast("int"))
    every = open_lists.where("index").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    x, y = every.alias("x"), cut.alias("y")
    on = (F.col("x.t") == F.col("y.t")) & (F.col("x.part") == F.col("y.part"))
    rest = x.join(y, on & F.expr(f"x.root <> y.root and {_possible('x', 'y', above, percent)}"))
    last = _verified(rest.selectExpr("least(x.u, y.u) as a", "greatest(x.u, y.u) as b"), ranked, percent)
    return found.union(last)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, most: int | None = None, bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set), component_id, and row keys (its own, and the first of its component).

    ``component_id`` is the smallest doc_id that links reach, the row's own included; NULL ids are passed over unless a component has no
    other. Texts without words (NULL, empty, white space) are linked with nothing, not even with each other; their component is their
    own id. Repeated rows and equal texts share a component. A text of fewer than ``words`` words has one element, all its words. An empty
    table gives none. ``percent`` is 50 to 100; ``most`` overrides the size up to which subsets are enumerated. With ``bits``, sets whose
    fingerprints are within so many bits are linked first; the result is the same.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.select(F.struct("doc_id", *row_key()).alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column(0)} | _describe(batch.column(1), words, percent)

    folder = scratch_path(spark, "shingles")
    kind = keyed.schema["key"].dataType.simpleString()
    map_batches(keyed, work, f"key {kind}, a bigint, b bigint, n bigint, known bigint, told bigint, probe array<bigint>").select("key.*", "a", "b", "n", "known", "told", "probe").write.parquet(folder)
    rows = spark.read.parquet(folder)
    place = scratch_path(spark, "sets")
    _promising(rows, percent).write.parquet(place)
    sets = spark.read.parquet(place)

    numbered = scratch_path(spark, "ranked")
    elements = _elements(docs, sets, words)
    _ranked(elements, percent).write.parquet(numbered)
    ranked = spark.read.parquet(numbered)
    above = boundary(ranked, percent) if most is None else most
    links = stored(subset_links(ranked, above, percent), "links")
    if bits is not None:
        links = links.union(stored(fingerprint_links(elements, ranked, percent, bits), "near"))
    linked = components(list_links(inverted_lists(ranked, above, percent), ranked, links, above, percent))

    # each step is stored, as the next ones name it several times: one plan of all of them would hold 20 joins, which the driver plans
    # again after each stage
    members = linked.union(linked.select("root", "root").distinct()).withColumnRenamed("h", "u")
    members = stored(members.join(ranked.select("u", "a", "b"), "u").join(sets.select("a", "b", "first"), ["a", "b"]), "members")
    firsts = stored(members.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("size")), "firsts")
    named = lookup_join(members.select("a", "b", "root"), firsts, ["root"], "size", ["a"]).select("a", "b", F.col("first").alias("reached"))
    classes = sets.where("n > 0").select("a", "b", "first", "copies").join(named, ["a", "b"], "left").select("a", "b", "copies", F.coalesce("reached", "first").alias("c"))
    classes = stored(classes, "classes")
    out = lookup_join(rows.select("doc_id", "row_id", "row_hash", "a", "b", "n"), classes, ["a", "b"], "copies", ["row_hash"])
    out = out.withColumn("c", F.coalesce("c", first_row()))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c.doc_id").alias("component_id"), "row_id", "row_hash", F.struct("c.row_id", "c.row_hash").alias("component_row"))


def drop_similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int | None = None) -> DataFrame:
    """Rows of ``docs`` (columns doc_id, text and any others) with one of each component: the one of the smallest doc_id.

    Repeated rows leave one. NULL and empty texts are no copies of each other and stay. An empty table stays empty.
    """
    return keep_rows(docs, similar_groups(docs, words=words, percent=percent, bits=bits).select("component_row.row_id", "component_row.row_hash"))
