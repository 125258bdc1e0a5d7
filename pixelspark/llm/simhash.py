"""Near duplicates by SimHash and pigeonhole blocks.

A fingerprint has 64 bits; two texts are linked when their fingerprints differ in at most ``bits`` of them. Cut the bits
into ``blocks`` pieces: fingerprints within ``bits`` agree on at least ``blocks - bits`` pieces, so they share the value of
some combination of so many pieces. Each distinct fingerprint is dealt to all combinations, and under each shared value the
members are compared by Hamming distance.

Equal fingerprints are one row from the start, so a group of copies costs nothing. Values with up to ``PAIRED`` members give
their near pairs, so at most a fixed number a member; those with more give only links that join parts that were apart, fewer
than they have members.
Values with more than ``CROWD`` members are not compared in pairs: their members go to midpoints. Two fingerprints within
4 bits have a value within 2 bits of both, so sending each crowded fingerprint to all values within half the distance, and joining
those that meet, is the same relation at a fixed cost per fingerprint, by aggregation alone.

Links are closed to components by alternating star contractions over distinct fingerprints, with state in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .base import first_row, keep_rows, map_texts, row_key
from .recipes import LOWER

WORDS = 4
BITS = 4
BLOCKS = 7
SEED = 42
CROWD = 2048
PAIRED = 32


def _hashes(text: str, n: int = WORDS) -> np.ndarray:
    """XXH64 of the text's shingles of ``n`` words."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts, stops = (ends - sizes)[: len(words) - n + 1].tolist(), (ends - 1)[n - 1 :].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: str | None) -> int:
    """A bit is one if it is set in over half of the hashes; without words the fingerprint is zero."""
    return majority(_hashes(text or ""))


def majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    out, ones = 0, np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # long texts in stretches
        ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    for bit in 2 * ones > len(h):
        out = out << 1 | int(bit)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_id, row_hash, h): the fingerprint as a signed number. NULL texts are empty ones."""

    def start():
        return lambda ids, texts: {"key": ids, "h": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.select(F.struct("doc_id", *row_key()).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return map_texts(keyed, start, f"key {keyed.schema['key'].dataType.simpleString()}, h bigint").select("key.*", "h")


def block_masks(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """Signed masks of all combinations of blocks of which near fingerprints agree on one at least."""
    edges = [i * 64 // blocks for i in range(blocks + 1)]
    pieces = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(pieces, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's part, given links a-b among n members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _near(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near pairs of a value's members, found row by row; links that join nothing new are left out."""
    part = np.arange(len(h))
    a, b = [], []
    for i in range(len(h) - 1):
        close = i + 1 + np.flatnonzero(np.bitwise_count(h[i + 1 :] ^ h[i]) <= bits)
        close = close[part[close] != part[i]]
        if len(close):
            _, firsts = np.unique(part[close], return_index=True)
            close = close[firsts]
            a += [i] * len(close)
            b += close.tolist()
            joined = np.isin(part, np.append(part[close], part[i]))
            part[joined] = part[joined].min()
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(values: np.ndarray, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (smaller position first) among members under equal values; rows are sorted by value."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(values)]]))
    a, b = [], []
    small = sizes <= PAIRED
    for step in range(1, int(sizes[small].max(initial=1))):  # members of all small groups at once, by distance in the group
        i = np.flatnonzero(values[:-step] == values[step:])
        i = i[small[np.searchsorted(starts, i, "right") - 1]]
        i = i[np.bitwise_count(h[i] ^ h[i + step]) <= bits]
        a.append(i)
        b.append(i + step)
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        x, y = _near(h[start : start + size], bits)
        a.append(start + x)
        b.append(start + y)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def block_links(distinct: DataFrame, bits: int, blocks: int, crowd: int) -> DataFrame:
    """(a, b): links under shared values; a row with b NULL is a crowded fingerprint a."""
    masks = F.array(*[F.struct(F.lit(i).cast("int").alias("t"), F.lit(m).cast("bigint").alias("m")) for i, m in enumerate(block_masks(bits, blocks))])
    dealt = distinct.select("h", F.explode(masks).alias("x")).select(F.col("x.t").alias("t"), F.col("h").bitwiseAND(F.col("x.m")).alias("v"), "h")
    ordered = dealt.repartition("t", "v").sortWithinPartitions("t", "v", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        kept = np.empty((0, 3), np.int64)  # the last value's members so far
        crowded = None  # a value found crowded: all its further members are
        for batch in batches:
            new = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            if crowded is not None:
                same = (new[:, 0] == crowded[0]) & (new[:, 1] == crowded[1])
                yield out(new[same, 2], [None] * int(same.sum()))
                new = new[~same]
                if not len(new):
                    continue
                crowded = None
            rows = np.vstack([kept, new])
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            group = np.zeros(len(rows), np.int64)
            group[change] = 1
            group = np.cumsum(group)
            sizes = np.bincount(group) if len(rows) else np.empty(0, np.int64)
            heavy = sizes > crowd
            if heavy.any():
                many = heavy[group]
                yield out(rows[many, 2], [None] * int(many.sum()))
                if heavy[-1]:
                    crowded = rows[-1, :2].copy()
            last = group == len(sizes) - 1
            done = ~last & ~heavy[group]
            kept = rows[last & ~heavy[group]]
            x, y = _compare(group[done], rows[done, 2].view(np.uint64), bits)
            h = rows[done, 2]
            yield out(h[x], h[y])
        x, y = _compare(np.zeros(len(kept), np.int64), np.ascontiguousarray(kept[:, 2]).view(np.uint64), bits) if len(kept) else ([], [])
        yield out(kept[x, 2] if len(kept) else [], kept[y, 2] if len(kept) else [])

    return ordered.mapInArrow(run, "a bigint, b bigint")


def midpoint_links(crowded: DataFrame, bits: int) -> DataFrame:
    """(a, b) that connect exactly the near ones among distinct ``h``: each goes to all values within half the distance, and the
    smallest at a value links with the others there."""
    if bits % 2:
        raise ValueError("midpoints need an even number of bits")
    flips = [0] + [sum(1 << i for i in c) for n in range(1, bits // 2 + 1) for c in combinations(range(64), n)]
    masks = F.explode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in flips])).alias("m")  # 2,081 for 4 bits
    sent = crowded.select("h", masks).select("h", F.col("h").bitwiseXOR(F.col("m")).alias("v"))
    first = sent.groupBy("v").agg(F.min("h").alias("b"), F.max("h").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # values with more than two: all others link with the smallest
    pairs = first.where("n = 2").select("a", "b")
    many = sent.join(first.where("n > 2").select("v", "b"), "v").where("h <> b").select(F.col("h").alias("a"), "b")
    return pairs.union(many)


def near_links(distinct: DataFrame, bits: int = BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(a, b): links within ``bits`` that join all that are near among distinct ``h``."""
    found = cut_lineage(block_links(distinct, bits, blocks, crowd))
    links = found.where("b is not null")
    crowded = found.where("b is null").select(F.col("a").alias("h")).distinct()
    return links if crowded.isEmpty() else links.union(midpoint_links(cut_lineage(crowded), bits))


def components(links: DataFrame) -> DataFrame:
    """(h, root) for every linked value: root is the smallest value that can be reached.

    Alternating stars: each value's larger neighbours, then its smaller ones, are tied to the smallest neighbour, until nothing
    changes. The number of rounds grows with the logarithm of the longest path.
    """

    edges = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # done when each value hangs on one smaller value that hangs on none
        ends = edges.selectExpr("a as h", "1 as above", "0 as below").union(edges.selectExpr("b as h", "0 as above", "1 as below"))
        counts = ends.groupBy("h").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
        if counts.where("below > 1 or below = 1 and above > 0").isEmpty():
            return edges.selectExpr("b as h", "a as root")
        both = edges.union(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("m as a", "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        ties = F.explode(F.expr("array(struct(m as a, b as b), struct(m as a, a as b))")).alias("e")
        edges = cut_lineage(large.join(low, "b").select(ties).select("e.*").where("a <> b").distinct())


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id, and the row's key.

    ``component_id`` is the smallest doc_id that links reach, the row's own included; NULL ids are passed over, and a
    component with NULL ids only has a NULL component_id. NULL and empty texts have fingerprint zero and are linked like
    any other. Repeated rows share their component. An empty table gives none.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "fingerprints")
    fingerprints(df, id_col, text_col).write.parquet(folder)  # narrow, and read three times
    rows = spark.read.parquet(folder)
    distinct = rows.select("h").distinct()
    linked = components(near_links(distinct, bits, blocks, crowd))
    smallest = rows.groupBy("h").agg(F.min("doc_id").alias("least"), F.min(first_row()).alias("first"))
    roots = smallest.join(linked, "h", "left").withColumn("root", F.coalesce("root", "h"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    named = roots.select("h", "root").join(ids, "root").select("h", "component_id", F.struct("first.row_id", "first.row_hash").alias("component_row"))
    # hot fingerprints: plain shuffles on both sides, whose large partitions adaptive execution splits
    return rows.join(named, "h").select("doc_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("fingerprint"), "component_id", "row_id", "row_hash", "component_row")


def drop_near(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (columns doc_id, text and any others) with one of each component: the one of the smallest doc_id, NULL ids last.

    NULL and empty texts are near each other, so one of them stays. Of rows that share id and text one stays. An empty table stays empty.
    """
    return keep_rows(docs, near_groups(docs).select("component_row.row_id", "component_row.row_hash"))
