import random

import pytest
from pyspark.sql import functions as F

from pixelspark.operators.dedup import greedy_dedup, with_duplicate_of, with_near_duplicate_of


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def clustered_rows(seed, n=160, flips=5):
    """Rows around a few centres, with equal hashes and equal digests among them."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(n):
        h = rng.choice(centres)
        for _ in range(rng.randrange(flips)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, f"r{i:04d}", h))
    return [(i, key, signed(h), f"d{h % 97}-{h}-{rng.randrange(2)}") for i, key, h in rows]


def distance(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def expected_near(rows, k):
    out = {}
    for i, key, h, _ in rows:
        earlier = [(distance(h, other), j, name) for j, name, other, _ in rows[:i] if distance(h, other) <= k]
        out[key] = min(earlier)[2] if earlier else None
    return out


def expected_greedy(rows, k):
    kept, out, turned_away = [], {}, {}
    for i, key, h, digest in rows:
        copy = next((name for _, name, _, d in kept if d == digest), None)
        near = [(distance(h, other), j, name) for j, name, other, _ in kept if distance(h, other) <= k]
        if copy:
            out[key] = ("duplicate", copy, None)
        elif near:
            # all rows of one hash name the row that turned the first of them away
            out[key] = ("near_duplicate", None, turned_away.setdefault(h, min(near)[2]))
        else:
            out[key] = ("accepted", None, None)
            kept.append((i, key, h, digest))
    return out


@pytest.mark.parametrize("k,crowd", [(4, 256), (4, 1), (3, 1), (0, 256)])
def test_near_duplicates_match_brute_force(spark, k, crowd):
    rows = clustered_rows(k * 10 + crowd)
    df = spark.createDataFrame(rows, "ord int, key string, h bigint, digest string").repartition(5)
    got = {r["key"]: r["near_duplicate_of"] for r in with_near_duplicate_of(df, "h", "ord", "key", k, crowd=crowd).collect()}
    assert got == expected_near(rows, k)


@pytest.mark.parametrize("k,crowd", [(4, 256), (3, 1)])
def test_greedy_matches_sequential_pass(spark, k, crowd):
    rows = clustered_rows(k * 7 + crowd, n=120)
    df = spark.createDataFrame(rows, "ord int, key string, h bigint, digest string").repartition(5)
    out = greedy_dedup(df, "digest", "h", "ord", "key", k, crowd).collect()
    assert {r["key"]: (r["status"], r["duplicate_of"], r["near_duplicate_of"]) for r in out} == expected_greedy(rows, k)


def test_chain_separates_the_two_meanings(spark):
    rows = [(0, "a", 0, "x"), (1, "b", 0b1111, "y"), (2, "c", 0b11111111, "z")]
    df = spark.createDataFrame(rows, "ord int, key string, h bigint, digest string")
    flags = {r["key"]: r["near_duplicate_of"] for r in with_near_duplicate_of(df, "h", "ord", "key").collect()}
    assert flags == {"a": None, "b": "a", "c": "b"}
    status = {r["key"]: r["status"] for r in greedy_dedup(df, "digest", "h", "ord", "key").collect()}
    assert status == {"a": "accepted", "b": "near_duplicate", "c": "accepted"}


def test_flat_images_share_one_hash(spark):
    df = spark.range(50).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("key"), F.lit(-1).cast("bigint").alias("h"), F.col("id").cast("string").alias("digest"))
    out = with_near_duplicate_of(df, "h", "ord", "key")
    assert out.where("near_duplicate_of = '0'").count() == 49


def test_hot_digest_is_found_everywhere(spark):
    df = spark.range(3000).select("id", F.format_string("p%05d", "id").alias("path"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"))
    out = with_duplicate_of(df, "digest", "id", "path")
    assert out.where("duplicate_of = 'p00000'").count() == 999
    assert out.where("duplicate_of is not null").count() == 999
    assert out.count() == 3000


def test_limit_is_guarded(spark):
    df = spark.createDataFrame([(0, "a", 0)], "ord int, key string, h bigint")
    for k in (-1, 65):
        with pytest.raises(ValueError, match="Hamming"):
            with_near_duplicate_of(df, "h", "ord", "key", k)


@pytest.mark.parametrize("k", [8, 9, 13, 24, 40, 64])
def test_wide_limits_match_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr("pixelspark.operators.metric.PART", 20)
    rows = clustered_rows(k, n=150, flips=14)
    df = spark.createDataFrame(rows, "ord int, key string, h bigint, digest string").repartition(5)
    got = {r["key"]: r["near_duplicate_of"] for r in with_near_duplicate_of(df, "h", "ord", "key", k).collect()}
    assert got == expected_near(rows, k)
    out = greedy_dedup(df, "digest", "h", "ord", "key", k).collect()
    assert {r["key"]: (r["status"], r["duplicate_of"], r["near_duplicate_of"]) for r in out} == expected_greedy(rows, k)


def chain_rows(n, step=2):
    rows, h = [], 0
    for i in range(n):
        rows.append((i, f"c{i:03d}", signed(h), f"d{i}"))
        for b in range(step):
            h ^= 1 << (step * i + b) % 64
    return rows


def test_components_are_passed_through_in_order(spark):
    """A chain of 24 hashes, alternately kept and turned away, takes no round per link; large components give the same by rounds."""
    from pixelspark.operators import dedup

    rows = chain_rows(24)
    rows += [(i + 100, f"x{key}", h, d) for i, key, h, d in clustered_rows(5, n=80)]
    df = spark.createDataFrame(rows, "ord int, key string, h bigint, digest string").repartition(4)
    spark.sparkContext.setJobGroup("chain", "chain")
    out = greedy_dedup(df, "digest", "h", "ord", "key", 2).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "other")
    assert {r["key"]: (r["status"], r["duplicate_of"], r["near_duplicate_of"]) for r in out} == expected_greedy(rows, 2)
    assert jobs <= 45
    neighbours = dedup.neighbours_within(dedup.distinct_hashes(df, "h", "ord", "key"), 2)
    same = [sorted(r.h for r in dedup.greedy_representatives(neighbours, large).collect()) for large in (1, 5, 20_000)]
    assert same[0] == same[1] == same[2]


def test_keys_and_paths_are_not_broadcast(spark, monkeypatch):
    """Block keys, balls and paths meet by shuffles, however small Spark guesses them."""
    from pixelspark.operators import dedup

    plans = []
    keep = dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name: plans.append(df) or keep(df, name))
    df = spark.createDataFrame(clustered_rows(3), "ord int, key string, h bigint, digest string")
    for crowd in (256, 1):
        plans.append(dedup.HashNeighbours(dedup.distinct_hashes(df, "h", "ord", "key"), 4, crowd).earliest_match())
    plans.append(with_duplicate_of(df, "digest", "ord", "key"))
    lines = [x for p in plans for x in p._jdf.queryExecution().sparkPlan().toString().splitlines() if "HashJoin" in x]
    assert lines and all("_h_" in x for x in lines)  # the heaviest keys only


def test_connected_components(spark):
    from pixelspark.operators.graph import components

    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(100)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(900, i) for i in range(500, 540)]
    part = {x: x for p in pairs for x in p}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    roots, most = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    got = {r.node: r.root for r in roots.collect()}
    assert got == {x: find(x) for x in part if find(x) != x} and most >= len(got)
    assert components(spark.createDataFrame([], "a bigint, b bigint"))[1] == 0
