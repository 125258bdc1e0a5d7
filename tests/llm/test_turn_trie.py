"""The prefix trie beside a plain dictionary of prefixes, at any size of shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pixelspark.llm.turn_trie import DoubleArray, Sequences, prefix_trie

from .conftest import TABLES, same

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, n_convs int"


def count(text):
    return len(text.encode().split())


def reference(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    convs = {c: [(t[2], t[4]) for t in sorted(own)] for c, own in turns.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
        for d in range(len(made) + 1):
            nodes[tuple(made[:d])].append(c)
        ends[tuple(made)].append(c)
    below, kids, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in nodes:
        if node:
            kids[node[:-1]] += 1
    for node, members in nodes.items():
        for d in range(len(node) + 1):
            below[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(members) - 1) * (count(node[-1][1]) if node else 0)
    out = []
    for node, members in nodes.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), kids[node], below[node], saved[node], digest))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r)[:8] for r in prefix_trie(df, **options).collect()), key=repr)


def conversations(seed=6):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), *range(400, 440), -5, -40, 10_000_000, 5_000]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            text = rng.choice(["same start", "Same start", None, "", "one two\nthree", f"text {rng.randrange(4)}"]) if turn > 1 else "same start"
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", None, "assistant"]) if turn > 2 else "user", text, "x", 1))
    rows += [(700, t, "user", f"long {t}", "x", 1) for t in range(300)] + rows[-3:]
    rows += [(None, 1, "user", "of no conversation", None, None), (None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("crowd", [4096, 1, 3, 20])
def test_trie_at_any_shard_size(spark, crowd):
    rows = conversations()
    same(found(spark.createDataFrame(rows, SCHEMA).repartition(3), crowd=crowd), reference(rows))


def test_table(spark):
    df = spark.read.parquet(f"{TABLES}/conversations.parquet")
    same(found(df), reference(df.collect()))


def test_nothing_and_turnless(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, None, None, None, None, None)]  # h is 1 or more: its only turn gives way to a conversation that is not there
    assert zlib.crc32(b"7") % 4 > 0
    same(found(spark.createDataFrame(rows, SCHEMA)), reference(rows))


def test_double_array():
    rng = random.Random(3)
    turns = sorted({tuple(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(400)}, key=lambda t: -len(t))
    sequences = Sequences([list(t) for t in turns])
    trie = DoubleArray(sequences)
    state, states = np.zeros(len(turns), np.int64), {}
    for d in range(sequences.deepest):
        state = trie.step(state[: sequences.going(d)], sequences.codes[sequences.at(d)])
        assert (state > 0).all()
        for t, s in zip(turns, state.tolist()):
            assert states.setdefault(t[: d + 1], s) == s
    assert len(set(states.values())) == len(states) == len({t[:d] for t in turns for d in range(1, len(t) + 1)})
    numbers = {k: sequences.codes[sequences.starts[i] + j] for i, t in enumerate(turns) for j, k in enumerate(t)}
    for prefix, s in states.items():
        for letter, code in numbers.items():
            step = int(trie.step(np.array([s]), np.array([code]))[0])
            assert step == states.get(prefix + (letter,), -1)
    np.testing.assert_array_equal(trie.step(np.array([-1]), np.array([0])), [-1])
