"""Neighbours in Hamming distance at any limit, by distances to pivots.

Every hash belongs to its nearest pivot's cell, on the ring of its distance to it. By the triangle inequality all hashes within ``k`` of a
target lie, in each cell, on rings from d - k to d + k (d: the target's distance to that pivot), and no further out than k beyond
the target's distance to its own nearest pivot. So a target visits cells with an interval of rings, and is compared there in
blocks; only its best match of a cell comes out, never pairs. Cells are cut into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stored
from .shuffles import ordered_rank

PIVOTS = 16
PART = 65_536  # hashes of a cell compared in one group
BLOCK = 4096
NONE = np.iinfo(np.int64).max


def _best_of_cell(k: int, by_distance: bool):
    """Arrow pass over one part of a cell after another: its sources by ring, then the targets that visit it."""

    def best(rings, hashes, ranks, lo, hi, h, rank) -> tuple[np.ndarray, np.ndarray]:
        value, match = np.full(len(h), NONE), np.zeros(len(h), np.int64)
        start, stop = np.searchsorted(rings, lo.min(), "left"), np.searchsorted(rings, hi.max(), "right")
        for at in range(start, stop, BLOCK):
            some = slice(at, min(stop, at + BLOCK))
            d = np.bitwise_count(h.view(np.uint64)[:, None] ^ hashes[some].view(np.uint64)).astype(np.int64)
            near = (d <= k) & (ranks[some] < rank[:, None])
            score = np.where(near, (d << 56 if by_distance else 0) + ranks[some], NONE)
            least = score.argmin(axis=1)
            found = score[np.arange(len(h)), least]
            better = found < value
            value[better], match[better] = found[better], hashes[some][least[better]]
        return value, match

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sources = None, []
        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns])
            out_h, out_v, out_m = [], [], []
            for group in np.split(rows, np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) + 1):
                if len(group) and (group[0, 0], group[0, 1]) != cell:
                    cell, sources = (group[0, 0], group[0, 1]), []
                if len(group) and group[0, 2] == 0:
                    sources.append(group[:, 3:])
                elif len(group) and sources:
                    sources = [np.concatenate(sources)]
                    rings, _, hashes, ranks = np.ascontiguousarray(sources[0].T)
                    for at in range(0, len(group), 256):
                        some = np.ascontiguousarray(group[at : at + 256, 3:].T)
                        value, match = best(rings, hashes, ranks, *some)
                        hit = value < NONE
                        out_h.append(some[2][hit])
                        out_v.append(value[hit])
                        out_m.append(match[hit])
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (out_h, out_v, out_m)], names=["h", "value", "match"])

    return run


class WideNeighbours:
    """Distinct hashes prepared for neighbour questions within any ``k`` bits."""

    def __init__(self, codes: DataFrame, k: int):
        self.k = k
        counted = Observation()
        ranked = ordered_rank(codes, F.col("ord"), "rank")
        self.codes = stored(ranked.observe(counted, F.count(F.lit(1)).alias("n")), "codes")
        self.count = counted.get["n"]
        pivots = [r.h for r in self.codes.select("h").orderBy(F.xxhash64("h"), "h").limit(PIVOTS).collect()] or [0]
        self.distances = F.array(*[F.bit_count(F.col("h").bitwiseXOR(F.lit(p))) for p in pivots])

    def _visits(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """(cell, part, kind, lo, hi, h, rank): sources once with their ring, targets in every cell that may hold a neighbour."""
        least = F.array_min("d")
        placed = sources.select("h", "rank").withColumn("d", self.distances).withColumn("lo", least)
        placed = placed.withColumn("cell", F.array_position("d", F.col("lo")) - 1)
        sizes = {r.cell: r.n // PART + 1 for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS rows
        parts = F.array(*[F.lit(sizes.get(i, 0)) for i in range(max(sizes, default=0) + 1)])
        own = placed.withColumn("part", F.pmod(F.xxhash64("h"), F.get(parts, F.col("cell").cast("int"))))
        own = own.selectExpr("cell", "part", "0L as kind", "cast(lo as bigint) as lo", "cast(lo as bigint) as hi", "h", "rank")
        far = targets.select("h", "rank").withColumn("d", self.distances).withColumn("least", least)
        far = far.select("h", "rank", "least", F.posexplode("d").alias("cell", "c"))
        far = far.selectExpr("cell", f"greatest(0, c - {self.k}) as lo", f"least(64, c + {self.k}, least + {self.k}) as hi", "h", "rank").where("lo <= hi")
        far = far.withColumn("parts", F.coalesce(F.get(parts, F.col("cell")), F.lit(0))).where("parts > 0")
        visits = far.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
        visits = visits.selectExpr("cast(cell as bigint) as cell", "cast(part - 1 as bigint) as part", "1L as kind", "cast(lo as bigint) as lo", "cast(hi as bigint) as hi", "h", "rank")
        return own.unionByName(visits)

    def _matches(self, sources: DataFrame, targets: DataFrame, by_distance: bool) -> DataFrame:
        """(h, value, match): for each target the earlier source within ``k`` that is nearest, or the earliest; none has no row."""
        order = ["cell", "part", "kind", "lo", "hi", "h"]
        dealt = self._visits(sources, targets).repartition("cell", "part").sortWithinPartitions(*order).select(*order, "rank")
        found = dealt.mapInArrow(_best_of_cell(self.k, by_distance), "h bigint, value bigint, match bigint")
        return found.groupBy("h").agg(F.min(F.struct("value", "match")).alias("m")).select("h", "m.value", "m.match")

    def earliest_match(self, among: DataFrame | None = None) -> DataFrame:
        """(h, distance, match): key of the nearest earlier hash, the earliest on a tie; ``among`` restricts who may be matched."""
        sources = self.codes if among is None else self.codes.join(among, "h", "left_semi")
        found = self._matches(sources, self.codes, True)
        keys = self.codes.select(F.col("h").alias("match"), F.col("key").alias("name"))
        return found.join(keys, "match").select("h", F.shiftright("value", 56).cast("int").alias("distance"), F.col("name").alias("match"))

    def first_come(self) -> DataFrame:
        """Hashes (h) that a first-come pass keeps. Each round keeps the open hashes without an earlier open neighbour and closes theirs."""
        open_, kept = self.codes.select("h", "rank"), None
        while True:
            barred = self._matches(open_, open_, False)
            winners = stored(open_.join(barred, "h", "left_anti"), "winners")
            kept = winners.select("h") if kept is None else kept.unionByName(winners.select("h"))
            closed = self._matches(winners, open_, False).select("h").unionByName(winners.select("h"))
            left = Observation()
            open_ = stored(open_.join(closed, "h", "left_anti").observe(left, F.count(F.lit(1)).alias("n")), "open")
            if not left.get["n"]:
                return kept
