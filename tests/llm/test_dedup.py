"""Exact and near groups beside brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pixelspark.llm import simhash
from pixelspark.llm.recipes import chunks, drop_exact, exact_groups, normalised
from pixelspark.llm.simhash import block_links, components, drop_near, fingerprint, midpoint_links, near_groups

from .conftest import same


def reference_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", normalised(text)) if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_parts(n, pairs):
    part = list(range(n))

    def find(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_pairs(hashes, bits):
    h = np.array(hashes, np.uint64)
    return [(i, j) for i in range(len(h)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(h[i + 1 :] ^ h[i]) <= bits)).tolist()]


def test_chunks_follow_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 105) for _ in range(200_000))
    same(b"".join(chunks(data)), data)
    assert chunks(b"") == []
    assert all(len(c) <= 16_384 for c in chunks(data)) and all(len(c) >= 1024 for c in chunks(data)[:-1])
    assert len(set(chunks(data)) & set(chunks(data[777:]))) > 0.8 * len(chunks(data))
    same(b"".join(chunks(b"a" * 100_000)), b"a" * 100_000)


def brute_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(normalised(r.text), []).append(r.doc_id)
    out = []
    for data, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(str(i), str(keep), len(ids), hashlib.sha256(data).hexdigest()) for i in ids]
    return sorted(out), len(groups)


def test_exact_groups(spark, docs, odd, empty):
    for df in (docs, odd):
        want, n = brute_groups(df.collect())
        rows = exact_groups(df).collect()
        same(sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows), want)
        assert sum(r.kept for r in rows) == n and all(r.doc_id == r.keep_id for r in rows if r.kept)
        kept = drop_exact(df)
        assert kept.columns == df.columns
        assert (kept.count(), len({normalised(r.text) for r in kept.collect()})) == (n, n)
    assert exact_groups(empty).count() == 0 and drop_exact(empty).count() == 0


def test_identifiers_are_verified(docs, monkeypatch):
    from pixelspark.llm import recipes

    monkeypatch.setattr(recipes, "identifier", lambda chunk, kind: hashlib.sha256(chunk).digest()[: 1 if kind == "short" else 32])
    assert recipes.verified_hash(docs, ("short", "sha256")) == "sha256"


def test_fingerprints(docs):
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "one", "One two", "a b c d", "a b c d e", "é x y z \x0b w q"]
    same([fingerprint(t) for t in texts], [reference_fingerprint(t or "") for t in texts])


def test_near_groups(docs, odd, empty):
    for df in (docs, odd):
        rows = df.collect()
        hashes = [reference_fingerprint(r.text or "") for r in rows]
        roots = reference_parts(len(rows), near_pairs(hashes, 4))
        least = {}
        for r, root in zip(rows, roots):
            least[root] = min((x for x in (least.get(root), r.doc_id) if x is not None), default=None)
        want = sorted((str(r.doc_id), f"{h:016x}", str(least[root])) for r, h, root in zip(rows, hashes, roots))
        same(sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_groups(df).collect()), want)
        assert drop_near(df).count() == len(least) and drop_near(df).columns == df.columns
    assert near_groups(empty).count() == 0 and drop_near(empty).count() == 0


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    for _ in range(n):
        h = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(64)
        out.add(h)
    return sorted(out)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_links_of_crowds(spark):
    hashes = clustered(500, 7)
    want = reference_parts(len(hashes), near_pairs(hashes, 4))
    table = spark.createDataFrame([(signed(h),) for h in hashes], "h bigint").repartition(3)
    at = {signed(h): i for i, h in enumerate(hashes)}
    for crowd in (10_000, 3):
        found = block_links(table, 4, 7, crowd)
        links = [(at[r.a], at[r.b]) for r in found.where("b is not null").collect()]
        assert all(bin(hashes[a] ^ hashes[b]).count("1") <= 4 for a, b in links)
        crowded = found.where("b is null").select(F.col("a").alias("h")).distinct()
        assert (crowded.count() > 0) == (crowd < 10_000)
        links += [(at[r.a], at[r.b]) for r in midpoint_links(crowded, 4).collect()]
        same(reference_parts(len(hashes), links), want)
        assert len(links) <= len(simhash.block_masks()) * simhash.PAIRED / 2 * len(hashes)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 120)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(1000, i) for i in range(500, 560)]
    want = reference_parts(1001, pairs)
    got = {r.h: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    same([got.get(i, i) for i in sorted(linked)], [want[i] for i in sorted(linked)])


def test_masks_cover_all_near_pairs():
    rng = random.Random(4)
    masks = simhash.block_masks()
    for _ in range(2000):
        h, other = rng.getrandbits(64), 0
        for b in rng.sample(range(64), 4):
            other |= 1 << b
        assert any((other & m) == 0 for m in masks)


def test_ids_of_any_type_and_repeated_rows(spark):
    rows = [("b", "same text"), ("a", "Same Text"), (None, "same text"), ("c", "another one")] + [("b", "same text")] * 2000
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    groups = exact_groups(df).collect()
    same(sorted((r.doc_id or "", r.keep_id, r.group_size) for r in groups), sorted((i or "", "c" if t == "another one" else "b", 1 if t == "another one" else 2003) for i, t in rows))
    assert sum(r.kept for r in groups) == 2
    same(sorted(r.doc_id for r in drop_exact(df).collect()), ["b", "c"])
    same(sorted(r.doc_id for r in drop_near(df).collect()), ["a", "c"])
