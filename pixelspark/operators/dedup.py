"""Exact and near duplicates.

Near duplicates are 64-bit hashes at most ``k`` bits apart. Equal hashes are collapsed first, so a group of
copies is one row from then on. What remains is matched in one of three exact ways, the next one only
for hashes that the one before finds crowded:

* Block keys: cut the bits into blocks; two hashes within ``k`` bits agree on all but ``k`` of them, so they meet
  under one of the keys made of ``blocks - k`` agreeing blocks. Used for keys shared by few hashes.
* Finer blocks: hashes under a crowded key are keyed once more, with more and finer blocks.
* Midpoints: two hashes within ``k`` bits have a common value within ``k/2`` bits of both. Hashes that are still
  crowded send every such value to an aggregation that keeps only the earliest hash of each value. No pair is
  ever built, so a crowd costs a fixed number of rows per member, and the aggregation combines before the shuffle.

Limits above ``MAX_BLOCKS_HAMMING`` go by distances to pivots instead, see ``metric``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.hashing import hamming
from ..session import cut_lineage, stored
from .graph import components
from .metric import WideNeighbours
from .shuffles import lookup_join, shuffled

CROWD = 256  # hashes under one block key before its members are matched in the next way
FINER_BLOCKS = 3  # blocks added when crowded hashes are keyed again
LARGE = 20_000  # hashes of a component from which it is solved by rounds
MAX_BLOCKS_HAMMING = 8  # beyond, see the metric module


def with_duplicate_of(df: DataFrame, digest: str, order: str, path: str, out: str = "duplicate_of") -> DataFrame:
    """Path of the first row with the same digest; NULL on the first row itself."""
    firsts = df.groupBy(digest).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(path).alias("p"))).alias("_first"), F.count(F.lit(1)).alias("_copies")
    )
    firsts = firsts.where(F.col("_copies") > 1)
    joined = lookup_join(df, firsts, [digest], "_copies", [path], grows=True)
    is_first = (F.col("_first.o") == F.col(order)) & (F.col("_first.p") == F.col(path))
    return joined.select(*df.columns, F.when(~is_first, F.col("_first.p")).alias(out))


def distinct_hashes(df: DataFrame, h: str, order: str, key: str) -> DataFrame:
    """(h, ord, key, copies): every hash with its earliest row."""
    first = F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("k")))
    grouped = df.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("h")).agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("h", F.col("f.o").alias("ord"), F.col("f.k").alias("key"), "copies")


def block_count(k: int, n_codes: int) -> int:
    """Blocks to cut 64 bits into: more, finer blocks make each key longer, so the smallest number is taken that
    leaves few random hashes per key."""
    blocks = k + 1
    while blocks < k + 6 and n_codes / 2 ** (64 * (blocks - k) / blocks) > 16:
        blocks += 1
    return blocks


def block_masks(k: int, blocks: int) -> list[int]:
    """Masks of all block combinations of which two hashes within ``k`` bits agree on at least one."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block_bits = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(block_bits, blocks - k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _block_keys(codes: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(
        *[F.struct(F.lit(i).alias("band"), F.col("h").bitwiseAND(F.lit(m).cast("bigint")).alias("v")) for i, m in enumerate(masks)]
    )
    return codes.select("h", "ord", F.explode(keys).alias("b")).select("h", "ord", "b.band", "b.v")


def _ball(codes: DataFrame, radius: int) -> DataFrame:
    """Every value within ``radius`` bits of each hash, once: bits are flipped in rising order."""
    layer = codes.withColumn("v", F.col("h")).withColumn("_last", F.lit(-1))
    out = layer
    for _ in range(radius):
        layer = layer.where("_last < 63").withColumn("_last", F.explode(F.expr("sequence(_last + 1, 63)")))
        layer = layer.withColumn("v", F.expr("v ^ shiftleft(1L, _last)"))
        out = out.unionByName(layer)
    return out.drop("_last")


class HashNeighbours:
    """Distinct hashes prepared for neighbour questions within ``k`` bits."""

    def __init__(self, codes: DataFrame, k: int, crowd: int = CROWD):
        self.k = k
        counted = Observation()
        self.codes = stored(codes.observe(counted, F.count(F.lit(1)).alias("n")), "codes")
        blocks = block_count(k, counted.get["n"])
        self._sparse: list[DataFrame] = []
        self.crowded = self._match_by_blocks(self.codes.select("h", "ord"), blocks, crowd)
        if self.crowded is not None:
            self.crowded = self._match_by_blocks(self.crowded, blocks + FINER_BLOCKS, crowd)
        self._pairs: DataFrame | None = None

    def _match_by_blocks(self, codes: DataFrame, blocks: int, crowd: int) -> DataFrame | None:
        """Note the members of uncrowded keys and return the hashes under crowded ones, if any.

        A near pair is either found under an uncrowded key or has both its hashes among those returned.
        """
        keys = _block_keys(codes, block_masks(self.k, blocks))
        sizes = keys.groupBy("band", "v").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        most = Observation()
        placed = lookup_join(keys, sizes, ["band", "v"], "members", ["h"], grows=True).where("members is not null")
        placed = stored(placed.observe(most, F.max("members").alias("most")), "keys")
        self._sparse.append(placed.where(F.col("members") <= crowd).select("h", "ord", "band", "v"))
        if (most.get["most"] or 0) <= crowd:
            return None
        return stored(placed.where(F.col("members") > crowd).select("h", "ord").distinct(), "crowded")

    def sparse_pairs(self) -> DataFrame:
        """(h, ord, other, other_ord): each neighbour pair under an uncrowded key, the earlier hash as ``other``; found once."""
        if self._pairs is not None:
            return self._pairs
        found = None
        for members in self._sparse:
            earlier = members.select("band", "v", F.col("h").alias("other"), F.col("ord").alias("other_ord"))
            pairs = members.join(shuffled(earlier), ["band", "v"]).where(F.col("other_ord") < F.col("ord"))
            pairs = pairs.where(hamming("h", "other") <= self.k).select("h", "ord", "other", "other_ord")
            found = pairs if found is None else found.unionByName(pairs)
        self._pairs = stored(found, "pairs")
        return self._pairs

    def earliest_match(self, among: DataFrame | None = None) -> DataFrame:
        """(h, distance, match): for each hash the nearest earlier one, the earliest on a tie.

        ``among`` restricts which hashes (column ``h``) may be matched.
        """
        keys = self.codes.select(F.col("h").alias("other"), F.col("key").alias("match"))
        pairs = self.sparse_pairs()
        if among is not None:
            pairs = pairs.join(among.select(F.col("h").alias("other")), "other", "left_semi")
        best = pairs.groupBy("h").agg(F.min(F.struct(hamming("h", "other").alias("d"), F.col("other_ord").alias("o"), F.col("other").alias("m"))).alias("best"))
        if self.crowded is not None:
            sources = self.crowded.select("h", "ord")
            if among is not None:
                sources = sources.join(among, "h", "left_semi")
            targets = self.crowded.select("h", "ord")
            for d in range(1, self.k + 1):
                # the smallest d with an earlier hash is its distance, as nothing earlier lies nearer
                marks = _ball(sources, d // 2).groupBy("v").agg(F.min(F.struct("ord", "h")).alias("s"))
                hits = _ball(targets, d - d // 2).join(shuffled(marks), "v").where(F.col("s.ord") < F.col("ord"))
                level = hits.groupBy("h").agg(F.min("s").alias("s"))
                level = level.select("h", F.struct(F.lit(d).alias("d"), F.col("s.ord").alias("o"), F.col("s.h").alias("m")).alias("best"))
                best = best.unionByName(level)
            best = best.groupBy("h").agg(F.min("best").alias("best"))
        found = best.select("h", F.col("best.d").alias("distance"), F.col("best.m").alias("other"))
        return found.join(shuffled(keys), "other").select("h", "distance", "match")

    def cliques(self) -> DataFrame:
        """(clique, h, ord): sets of mutually near hashes that together cover every near pair."""
        pairs = self.sparse_pairs().dropDuplicates(["h", "other"])
        clique = F.struct(F.col("other").alias("a"), F.col("h").alias("b"))
        both = F.explode(F.array(F.struct("h", "ord"), F.struct(F.col("other").alias("h"), F.col("other_ord").alias("ord"))))
        out = pairs.select(clique.alias("clique"), both.alias("m")).select("clique", "m.h", "m.ord")
        return out if self.crowded is None else out.unionByName(self._crowd_cliques())

    def _crowd_cliques(self) -> DataFrame:
        codes = self.crowded.select("h", "ord")
        out = _ball(codes, self.k // 2).select(F.struct(F.col("v").alias("a"), F.col("v").alias("b")).alias("clique"), "h", "ord")
        # an odd distance has no midpoint: one side reaches one bit further. Mark the two sides of bit i apart.
        return out.unionByName(self._odd_cliques(codes)) if self.k % 2 else out

    def links(self) -> DataFrame:
        """(a, b) that connect what is near: the pairs under uncrowded keys, and for crowds one link a member and clique."""
        pairs = self.sparse_pairs().select(F.col("h").alias("a"), F.col("other").alias("b"))
        if self.crowded is None:
            return pairs
        members = self._crowd_cliques()
        least = members.groupBy("clique").agg(F.min("h").alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1")
        return pairs.unionByName(lookup_join(members, least, ["clique"], "members", ["h"], grows=True).where("b < h").select(F.col("h").alias("a"), "b"))

    def first_come_by_rounds(self, among: DataFrame) -> DataFrame:
        """What a first-come pass keeps of ``among`` (h), a union of whole components.

        Each round keeps the hashes that are the earliest of all their open cliques and closes those cliques; that is exactly what
        the pass would do. Only hashes with an open neighbour stay in the loop.
        """
        members = cut_lineage(self.cliques().join(among, "h", "left_semi"))
        kept = among.join(shuffled(members.select("h").distinct()), "h", "left_anti")
        while not members.isEmpty():  # every round closes the clique of the earliest hash, so this ends
            first = members.groupBy("clique").agg(F.min(F.struct("ord", "h")).alias("f"))
            leads = members.join(shuffled(first), "clique").groupBy("h").agg(F.min((F.col("f.h") == F.col("h")).cast("int")).alias("lead"))
            winners = cut_lineage(leads.where("lead = 1").select("h"))
            kept = kept.unionByName(winners)
            closed = first.join(winners, F.col("f.h") == winners["h"], "left_semi").select("clique")
            out = members.join(shuffled(closed), "clique", "left_semi").select("h").distinct()
            members = cut_lineage(members.join(shuffled(out), "h", "left_anti"))
        return kept

    def _odd_cliques(self, codes: DataFrame) -> DataFrame:
        """Cliques for an odd limit: the members of a value with bit i left open are within k of each other."""
        near = _ball(codes, self.k // 2)
        edge = near.select("h", "ord", "v", F.explode(F.expr("sequence(0, 63)")).alias("i"))
        low = F.expr("v & ~shiftleft(1L, i)")
        return edge.select(F.struct(low.alias("a"), F.expr("v | shiftleft(1L, i)").alias("b")).alias("clique"), "h", "ord").distinct()


def neighbours_within(codes: DataFrame, k: int, crowd: int = CROWD) -> HashNeighbours | WideNeighbours:
    """Neighbour questions by block keys, or by distances to pivots where blocks would be too short to tell hashes apart."""
    if not 0 <= k <= 64:
        raise ValueError("the Hamming limit must be between 0 and 64")
    return HashNeighbours(codes, k, crowd) if k <= MAX_BLOCKS_HAMMING else WideNeighbours(codes, k)


def with_near_duplicate_of(
    df: DataFrame, h: str, order: str, key: str, k: int = 4, out: str = "near_duplicate_of", crowd: int = CROWD
) -> DataFrame:
    """Key of an earlier row within ``k`` bits, every earlier row counting, duplicates included.

    An earlier row with the same hash comes first (the earliest such row), then the smallest (distance, order).
    """
    codes = distinct_hashes(df, h, order, key)
    neighbours = neighbours_within(codes, k, crowd)
    found = neighbours.codes.join(neighbours.earliest_match(), "h", "left")
    found = found.select(F.col("h").alias(h), F.struct(F.col("ord").alias("o"), F.col("key").alias("k")).alias("_first"), "match", "copies")
    joined = lookup_join(df, found, [h], "copies", [key])
    is_first = (F.col("_first.o") == F.col(order)) & (F.col("_first.k") == F.col(key))
    return joined.select(*df.columns, F.when(is_first, F.col("match")).otherwise(F.col("_first.k")).alias(out))


def _first_come(k: int):
    """Arrow pass over (root, ord, h) sorted by root and order: the hashes a first-come pass keeps in each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, kept = None, np.zeros(16, np.uint64)
        n = 0
        for batch in batches:
            out = []
            for r, h in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy()):
                if r != root:
                    root, n = r, 0
                if not (np.bitwise_count(kept[:n] ^ h.view(np.uint64)) <= k).any():
                    if n == len(kept):
                        kept = np.append(kept, np.zeros(n, np.uint64))
                    kept[n] = h.view(np.uint64)
                    n += 1
                    out.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])

    return run


def greedy_representatives(neighbours: HashNeighbours | WideNeighbours, large: int = LARGE) -> DataFrame:
    """Hashes (column h) that a first-come pass keeps when it rejects every hash near one already kept.

    No hash outside a component of near hashes has a say in it. Components of up to ``large`` hashes are each passed through in
    order, many in one task; larger ones go by rounds, see ``_by_rounds``. Hashes without a neighbour are kept.
    """
    if isinstance(neighbours, WideNeighbours):
        return neighbours.first_come()
    roots, most = components(neighbours.links())
    if not most:
        return neighbours.codes.select("h")
    small, rest = neighbours.codes.select("h", "ord").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h")), None
    if most >= large:  # else no component can be that large
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= large)
        marked = cut_lineage(lookup_join(small, sizes, ["root"], "size", ["h"]))
        small, rest = marked.where("size is null"), marked.where("size is not null").select("h")
    ordered = small.repartition("root").sortWithinPartitions("root", "ord").select("root", "h")
    kept = ordered.mapInArrow(_first_come(neighbours.k), "h bigint")
    return kept if rest is None else kept.unionByName(neighbours.first_come_by_rounds(rest))


def greedy_dedup(df: DataFrame, digest: str, h: str, order: str, key: str, k: int = 4, crowd: int = CROWD) -> DataFrame:
    """First-come deduplication: only accepted rows reject later ones.

    Adds ``status`` (accepted, duplicate, near_duplicate), ``duplicate_of`` and ``near_duplicate_of``. A copy is a
    ``duplicate`` only of an accepted row; a copy of a rejected row is a ``near_duplicate`` like that row. Rows of
    one hash all name the accepted row nearest to it among those before its first row.
    """
    firsts = df.groupBy(F.col(h).alias("h")).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(digest).alias("d"))).alias("f"), F.count(F.lit(1)).alias("copies")
    )
    codes = firsts.select("h", F.col("f.o").alias("ord"), F.col("f.k").alias("key"), F.col("f.d").alias("digest"), "copies")
    neighbours = neighbours_within(codes, k, crowd)
    kept = stored(greedy_representatives(neighbours), "kept")
    matches = neighbours.earliest_match(among=kept)
    state = neighbours.codes.join(kept.withColumn("_kept", F.lit(True)), "h", "left").join(matches, "h", "left")
    state = state.select(
        F.col("h").alias(h),
        F.struct(F.col("ord").alias("o"), F.col("key").alias("k"), F.col("digest").alias("d")).alias("_first"),
        F.coalesce("_kept", F.lit(False)).alias("_kept"),
        "match",
        "copies",
    )
    joined = lookup_join(df, state, [h], "copies", [key])
    is_first = (F.col("_first.o") == F.col(order)) & (F.col("_first.k") == F.col(key))
    copy = F.col("_kept") & ~is_first & (F.col("_first.d") == F.col(digest))
    status = F.when(F.col("_kept") & is_first, "accepted").when(copy, "duplicate").otherwise("near_duplicate")
    near = F.when(F.col("_kept"), F.col("_first.k")).otherwise(F.col("match"))
    return joined.select(
        *df.columns,
        status.alias("status"),
        F.when(status == "duplicate", F.col("_first.k")).alias("duplicate_of"),
        F.when(status == "near_duplicate", near).alias("near_duplicate_of"),
    )

