"""The trie of conversation prefixes, as double arrays per prefix shard.

A node is a distinct sequence of turns that some conversation starts with. Conversations become sequences of turn keys, equal ones
are one sequence from the start with their number and their smallest id, so a conversation that a third of all share costs one.

Sequences are dealt by prefix. A prefix that more than ``CROWD`` sequences start with is an upper node; below the upper nodes, each
shortest other prefix is a shard, so no shard holds more than ``CROWD`` sequences however common a first turn is. A shard numbers its turns
densely and packs its trie into two arrays: the child of node s by turn c stands at BASE[s] + c and is one if CHECK there is s. Walking
all sequences through the arrays at once gives every node's members, leaves and savings, complete within the shard.

Upper nodes are shared by shards: each shard's root gives its aggregates to its ancestors, which are merged globally. They are few, at
most one in ``CROWD`` sequences at each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shuffles import lookup_join
from ..session import cut_lineage, scratch_path
from .base import map_batches

CROWD = 4096
HEAD_GROUP = 20
HEADS = 4
ID_BITS = 12  # ids joined in one text before they are hashed
ROOT = hashlib.md5(b"").hexdigest()
NODE = "key string, depth bigint, parent string, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def head_length(conv: str) -> str:
    """Turns that conversation ``conv`` takes over from the first of its group."""
    return f"crc32(cast(cast({conv} as string) as binary)) % {HEADS}"


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, words): every conversation as the keys and word counts of its turns, those taken over first."""
    read = turns.where("conv_id is not null").selectExpr("cast(conv_id as bigint) as conv_id", "turn", "coalesce(cast(role as string), '') as role", "coalesce(cast(text as string), '') as text")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    narrow = read.select("conv_id", "turn", "role", key.alias("key"), words.alias("words"))
    place = F.expr("row_number() over (partition by conv_id order by turn nulls first, role, key)").cast("bigint")
    folder = scratch_path(turns.sparkSession, "turns")
    narrow.withColumn("place", place).drop("turn", "role").write.parquet(folder)
    placed = turns.sparkSession.read.parquet(folder)
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).withColumn("h", F.expr(head_length("conv_id")))
    convs = convs.withColumn("from", F.expr(f"conv_id - conv_id % {HEAD_GROUP}"))
    heads = placed.where(F.col("place") < HEADS).selectExpr("conv_id as from", "key", "words", "place")
    taken = convs.where("h > 0").join(heads, "from").where("place <= h").selectExpr("conv_id", "key", "words", f"place - {HEADS} as place")
    own = placed.where(f"place > {head_length('conv_id')}").select("conv_id", "key", "words", "place")
    turn = F.struct("place", "key", "words")
    lists = taken.union(own).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return convs.select("conv_id").join(lists, "conv_id", "left").selectExpr("conv_id", "coalesce(t.key, array()) as keys", "coalesce(t.words, array()) as words")


def with_prefixes(convs: DataFrame) -> DataFrame:
    """(conv_id, keys, prefix, words): prefix has the keys of all prefixes, the empty one first."""

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for keys in batch.column(1).to_pylist():
            chain = [ROOT]
            for k in keys:
                chain.append(hashlib.md5((chain[-1] + k).encode()).hexdigest())
            out.append(chain)
        return {"conv_id": batch.column(0), "keys": batch.column(1), "prefix": out, "words": batch.column(2)}

    return map_batches(convs, work, "conv_id bigint, keys array<string>, prefix array<string>, words array<bigint>")


class Sequences:
    """Sequences of turn numbers, one after another in one array, the longest first so that those that go on are always the first ones."""

    def __init__(self, turns: list[list[str]]):
        numbers: dict[str, int] = {}
        self.lengths = np.array([len(t) for t in turns], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes = np.array([numbers.setdefault(k, len(numbers)) for t in turns for k in t], np.int64)
        self.distinct = len(numbers)
        self.deepest = int(self.lengths[0]) if len(turns) else 0

    def going(self, depth: int) -> int:
        """How many have more than ``depth`` turns."""
        return int(np.searchsorted(-self.lengths, -depth, "left"))

    def at(self, depth: int) -> np.ndarray:
        """Places of turn ``depth`` (from 0) of those that have it."""
        return self.starts[: self.going(depth)] + depth


class DoubleArray:
    """BASE and CHECK over dense turn numbers; state 0 is the root of a shard."""

    def __init__(self, sequences: Sequences):
        self.base = np.zeros(sequences.distinct + 2, np.int64)
        self.check = np.full(sequences.distinct + 2, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no free place lies before this one
        state = np.zeros(len(sequences.lengths), np.int64)
        for depth in range(sequences.deepest):
            code = sequences.codes[sequences.at(depth)]
            state = state[: len(code)]
            edges = np.unique(np.stack([state, code], axis=1), axis=0)
            for group in np.split(edges, np.flatnonzero(np.diff(edges[:, 0])) + 1):
                self._pack(int(group[0, 0]), group[:, 1])
            state = self.base[state] + code

    def _pack(self, state: int, children: np.ndarray) -> None:
        """First base at which all children fall on free places."""
        while self.check[self.free] >= 0:
            self.free += 1
            self._grow(self.free + 1)
        base = self.free - int(children[0])
        while True:
            self._grow(base + int(children[-1]) + 1)
            if not (self.check[base + children] >= 0).any():
                break
            base += 1
        self.base[state] = base
        self.check[base + children] = state

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Child of each state by each turn, -1 where there is none."""
        to = self.base[state] + code
        inside = (state >= 0) & (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == state), to, -1)


def shard_nodes(depth: int, turns: list[list[str]], prefix: list[list[str]], words: list[list[int]], n: list[int], conv: list[int]) -> dict:
    """Columns of NODE for all nodes of a shard, whose root has ``depth`` turns; the first row is the root."""
    order = sorted(range(len(turns)), key=lambda i: -len(turns[i]))
    turns, prefix, words = ([x[i] for i in order] for x in (turns, prefix, words))
    count, ids = np.array(n, np.int64)[order], np.array(conv, np.int64)[order]
    sequences = Sequences([t[depth:] for t in turns])
    trie = DoubleArray(sequences)
    size = len(trie.check)
    members, least, children = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    cost, key, levels = np.zeros(size, np.int64), np.empty(size, object), []
    state = np.zeros(len(turns), np.int64)
    for d in range(sequences.deepest + 1):
        np.add.at(members, state, count[: len(state)])
        np.minimum.at(least, state, ids[: len(state)])
        level, one = np.unique(state, return_index=True)
        levels.append(level)
        for s, i in zip(level.tolist(), one.tolist()):
            key[s], cost[s] = prefix[i][depth + d], words[i][depth + d - 1] if depth + d else 0
        on = sequences.going(d)
        state = trie.step(state[:on], sequences.codes[sequences.at(d)])
    nodes, parent = np.concatenate(levels), trie.check
    np.add.at(children, parent[nodes[1:]], 1)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * cost
    for level in levels[:0:-1]:  # from the deepest level up
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    return {
        "key": key[nodes].tolist(),
        "depth": np.repeat(np.arange(len(levels)), [len(x) for x in levels]) + depth,
        "parent": [prefix[0][depth - 1] if depth else None, *key[parent[nodes[1:]]].tolist()],
        "conv_id": least[nodes],
        "parent_conv_id": [None, *least[parent[nodes[1:]]].tolist()],
        "n_convs": members[nodes],
        "n_children": children[nodes],
        "n_leaves": leaves[nodes],
        "saved_tokens": saved[nodes],
    }


def _shards(sequences: DataFrame) -> DataFrame:
    """NODE rows of all shards, from (shard, root, keys, prefix, words, n, conv_id)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(NODE))

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(shard_nodes(rows[0][1], *([r[i] for r in rows] for i in range(2, 7))), schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    dealt = sequences.repartition("shard").sortWithinPartitions("shard")
    return dealt.select("shard", "root", "keys", "prefix", "words", "n", "conv_id").mapInArrow(run, NODE)


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): SHA-256 of each node's own conversations' ids, ascending, comma-joined. Ids come in texts of a
    bounded range of ids each, which are hashed one after another, so no list of a common node's ids is held anywhere."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = ends.withColumn("part", F.shiftright("conv_id", ID_BITS)).groupBy("key", "part").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, hashlib.sha256()
        for batch in batches:
            keys, digests = [], []
            for key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        keys.append(last)
                        digests.append(digest.hexdigest())
                    last, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def prefix_trie(turns: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per node of the trie of rebuilt conversations of ``turns`` (conv_id, turn, role, text): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key.

    A conversation's turns are ordered by turn, NULL first, equal ones by role and content; a repeated row is a turn of its own. NULL
    roles and texts are empty. Rows whose conv_id is NULL belong to no conversation and are left out. The root is there if any
    conversation is; an empty table gives no node. ``crowd`` (1 or more) bounds the sequences of a shard and changes no result.
    """
    spark = turns.sparkSession
    folder = scratch_path(spark, "conversations")
    with_prefixes(rebuilt(turns)).write.parquet(folder)
    convs = spark.read.parquet(folder)
    end = F.element_at("prefix", -1).alias("key")
    place = scratch_path(spark, "sequences")
    one = convs.groupBy(end).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("keys", "prefix", "words")])
    one.write.parquet(place)
    sequences = spark.read.parquet(place)

    prefixes = sequences.select("key", F.posexplode("prefix").alias("depth", "at"))
    hot = cut_lineage(prefixes.where("depth > 0").groupBy("at").agg(F.count(F.lit(1)).alias("sequences")).where(F.col("sequences") > crowd))
    deepest = F.lit(0)
    if not hot.isEmpty():
        marked = lookup_join(prefixes.where("depth > 0"), hot, ["at"], "sequences", ["key"]).where("sequences is not null")
        sequences = sequences.join(marked.groupBy("key").agg(F.max("depth").alias("hot")), "key", "left")
        deepest = F.coalesce("hot", F.lit(0))
    # the root is an upper node at any size
    dealt = sequences.withColumn("root", (deepest + 1).cast("bigint")).withColumn("shard", F.expr("try_element_at(prefix, cast(root + 1 as int))"))
    made = scratch_path(spark, "nodes")
    _shards(dealt.where("shard is not null")).write.parquet(made)
    nodes = spark.read.parquet(made)

    # what shard roots and the sequences that end at an upper node give to the upper nodes above
    chains = dealt.withColumn("path", F.expr("slice(prefix, 1, cast(root as int))")).withColumn("costs", F.expr("slice(words, 1, cast(root as int) - 1)"))
    chains = chains.withColumn("of", F.coalesce("shard", "key"))
    paths = chains.groupBy("of").agg(F.first("path").alias("path"), F.first("costs").alias("costs"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
    below = nodes.where("parent_conv_id is null").select(F.col("key").alias("of"), "n_leaves", "saved_tokens")
    given = paths.join(below, "of", "left").select("path", "costs", "n", "conv_id", F.posexplode("path").alias("depth", "key"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens")])
    given = given.withColumn("cost", F.expr("if(depth = 0, 0, try_element_at(costs, depth))"))
    sums = [F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("cost").alias("cost")]
    chain = F.first(F.expr("slice(path, 1, depth + 1)")).alias("chain")
    upper = cut_lineage(given.groupBy("key", F.col("depth").cast("bigint").alias("depth")).agg(*sums, chain).withColumn("own", F.expr("(n_convs - 1) * cost")))
    total = upper.select(F.explode("chain").alias("key"), "own").groupBy("key").agg(F.sum("own").alias("below"))
    parent = F.expr("try_element_at(chain, cast(depth as int))")  # of the prefixes from depth 0, the one before last
    upper = upper.join(total, "key").withColumn("parent", F.when(F.col("depth") > 0, parent))
    kids = upper.select("parent").union(nodes.where("parent_conv_id is null").select("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    upper = upper.join(kids.withColumnRenamed("parent", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    upper = upper.selectExpr("key", "depth", "parent", "conv_id", "n_convs", "n_children", "if(n_children = 0, 1, leaves) as n_leaves", "saved + below as saved_tokens")
    upper = cut_lineage(upper)

    # parents of shard roots and upper nodes are upper nodes
    names = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"), "n_children")
    open_ends = upper.unionByName(nodes.where("parent_conv_id is null").drop("parent_conv_id"))
    named = lookup_join(open_ends.withColumnRenamed("n_children", "kids"), names, ["parent"], "n_children", ["key"])
    named = named.select("key", "depth", "conv_id", F.col("above").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens")
    whole = named.unionByName(nodes.where("parent_conv_id is not null").drop("parent"))
    digests = end_digests(convs.select(end, "conv_id"))
    nothing = hashlib.sha256().hexdigest()
    joined = whole.join(digests, "key", "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "key")
