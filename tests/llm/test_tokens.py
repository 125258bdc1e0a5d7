"""Encoding, packing and token files beside the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pixelspark.llm.bitplanes import pack_frame, read_documents, read_token_files, unpack_frame, write_token_files
from pixelspark.llm.bpe import TrieEncoder, decode, encode, round_trip
from pixelspark.llm.packing import pack_documents, pack_items
from pixelspark.llm.words import LibraryEncoder

from .conftest import same

BYTES, WORDS = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def odd_strings(n=400):
    rng = random.Random(1)
    parts = ["a", "the", "don't", "we'll", "é", "é", "İ", "Σας", "12", "3,4", "...", "%%%", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "́", "😀", "日本", "_", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "foo.Bar"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("path,space", [(BYTES, "prefix"), (WORDS, "drop")])
def test_words_equal_the_library(library, path, space):
    texts = odd_strings()
    for text, packed in zip(texts, LibraryEncoder(path, space)(texts)):
        same(memoryview(packed).cast("I").tolist(), library[path].encode(text, add_special_tokens=False).ids)


def test_trie_equals_the_library(library):
    texts = odd_strings() + ["aaaaaaaaaaaaa", "abababab", "   \n   x", "supercalifragilistic" * 30]
    for text, packed in zip(texts, TrieEncoder(BYTES, public_tokenizers.PATTERN)(texts)):
        same(memoryview(packed).cast("I").tolist(), library[BYTES].encode(text, add_special_tokens=False).ids)


def test_memory_limit_changes_nothing(docs):
    texts = [r.text for r in docs.limit(30).collect()]
    small = LibraryEncoder(BYTES)
    small.memory.most = 10
    same([small([t])[0] for t in texts], LibraryEncoder(BYTES)(texts))


def test_round_trip(spark, docs, odd, empty, library):
    for df in (docs, odd):
        want = sorted((r.doc_id is None, r.doc_id or 0, *digests(library, r.text or "")) for r in df.collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(df, BYTES, public_tokenizers.PATTERN).collect())
        same(got, want)
    assert round_trip(empty, BYTES, public_tokenizers.PATTERN).count() == 0


def digests(library, text):
    ids = library[BYTES].encode(text, add_special_tokens=False).ids
    whole = library[BYTES].decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()


def test_encode_then_decode(odd):
    texts = decode(encode(odd, BYTES, public_tokenizers.PATTERN), BYTES)
    same(sorted(r.text for r in texts.collect()), sorted(r.text or "" for r in odd.collect()))


@pytest.mark.parametrize("limits", [(2048, 256, 2048), (64, 3, 50), (2048, 2, 1500)])
def test_packing(docs, library, limits):
    tokens, segments, loss = limits
    ids = {r.doc_id: library[BYTES].encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, BYTES, 1, tokens, segments, loss).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.start))
    assert pieces.keys() == ids.keys()
    for key, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids[key])
    padded = total = 0
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens and len(own) <= segments and sum(n - (s == 0) for _, n, s in own) <= loss
        total += at
        padded += 0 if at & (at - 1) == 0 else tokens - at
    if limits == (2048, 256, 2048):
        assert padded < 0.01 * total


def test_packing_odd_rows(odd, empty, library):
    rows = pack_documents(odd, BYTES, 1).collect()
    sizes = [len(library[BYTES].encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect()]
    assert sum(r.length for r in rows) == sum(sizes) and sum(r.start == 0 for r in rows) == len(sizes)
    assert pack_documents(empty, BYTES, 1).count() == 0


def test_pack_items(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 900), rng.randint(1, 6), rng.randint(0, 500)) for i in range(3000)] + [(-1, 5000, 1, 1), (-2, None, None, None)]
    limits = {"tokens": 2048, "segments": 16, "loss": 1024}
    df = spark.createDataFrame(rows, "ex bigint, tokens bigint, segments bigint, loss bigint")
    demand = {r[0]: [x or 0 for x in r[1:]] for r in rows}
    sequences, seen = defaultdict(list), []
    for r in pack_items(df, "ex", limits).collect():
        seen.append(r.id)
        assert r.fits == (r.id != -1)
        sequences[r.sequence_id].append(r.id)
    assert sorted(seen) == sorted(demand)
    for own in sequences.values():
        if own != [-1]:
            assert all(sum(demand[i][k] for i in own) <= limit for k, limit in enumerate(limits.values()))
    least = max(sum(d[k] for i, d in demand.items() if i != -1) / limit for k, limit in enumerate(limits.values()))
    assert len(sequences) < 1.15 * least
    assert pack_items(df.limit(0), "ex", limits).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("high", [1, 2, 255, 256, 49_408, 2**32])
def test_frames(kind, high):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 100, 101, 1000):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
        frame = pack_frame(ids, kind, block_ids=100)
        assert (unpack_frame(frame) == ids).all()
        if n > 300:
            assert (unpack_frame(frame, range(2, 3)) == ids[200:300]).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, docs, library, tmp_path, kind):
    folder = str(tmp_path / "files")
    write_token_files(docs, folder, WORDS, 2, space="drop", kind=kind, frame_ids=5_000, block_ids=1_000)
    ids = {r.doc_id: library[WORDS].encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    at, rows = 0, sorted(read_token_files(spark, folder).collect())
    assert [r.doc_id for r in rows] == sorted(ids)
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens
    same(sorted((r.doc_id, r.ids) for r in read_documents(spark, folder).collect()), sorted(ids.items()))


def test_token_files_odd_rows(spark, odd, empty, tmp_path):
    write_token_files(odd, str(tmp_path / "odd"), WORDS, 2, space="drop")
    rows = sorted(read_token_files(spark, str(tmp_path / "odd")).collect(), key=lambda r: r.start)
    assert len(rows) == odd.count() and [r.doc_id is None for r in rows][:2] == [True, True]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    write_token_files(empty, str(tmp_path / "empty"), WORDS, 2, space="drop")
    assert read_token_files(spark, str(tmp_path / "empty")).count() == 0
