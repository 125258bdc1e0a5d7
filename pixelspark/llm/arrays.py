"""Texts of an Arrow column as numpy arrays: words, their hashes, and sets of shingles, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

TERM = np.zeros(256, bool)
TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

_random = np.random.default_rng(13)  # fixed values: the hash function
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _random.integers(1, 1 << 63, 1, dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)
PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ONE = np.uint64(0xBF58476D1CE4E5B9)
TWO = np.uint64(0x94D049BB133111EB)
STRETCH = 1 << 20  # bytes hashed at once; bounds the memory that a long text takes


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * ONE
    x = (x ^ (x >> np.uint64(27))) * TWO
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each one starts (one more entry than texts). No text may be NULL."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes, none across texts: (start among the true bytes, length, text) of each."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edges] = inside[edges]
    at = np.flatnonzero(first)
    packed = np.cumsum(inside, dtype=np.int64)
    starts = packed[at] - 1
    lengths = np.diff(np.append(starts, packed[-1] if len(packed) else 0))
    return starts, lengths, np.searchsorted(offsets, at, "right") - 1


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(term, text) of every run of letters A-Z, in lower case, and characters beyond ASCII."""
    data, offsets = text_bytes(texts)
    inside = TERM[data]
    starts, _, owner = runs(inside, offsets)
    letters = LOWER[data[inside]]
    ends = np.append(starts, len(letters)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(letters)), owner


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word in order; words are what white space separates, A-Z lower-cased."""
    inside = ~SPACE[data]
    starts, lengths, owner = runs(inside, offsets)
    letters = data[inside]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + STRETCH)))
        begin, n = starts[at], lengths[at:stop]
        total = int(n.sum())
        local = starts[at:stop] - begin
        places = np.arange(total) - np.repeat(local, n)
        powers = np.cumprod(np.full(int(n.max()), STEP, np.uint64))
        values = BYTE[LOWER[letters[begin : begin + total]]] * powers[places]
        out[at:stop] = mix(np.add.reduceat(values, local) + n.astype(np.uint64) * ONE)
        at = stop
    return out, owner


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its runs of ``words`` words. A shorter text has one for all its words, one
    without words none."""
    data, offsets = text_bytes(texts)
    hashes, owner = word_hashes(data, offsets)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    sums = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        sums += hashes[k : k + len(sums)] * PLACE[k]
    sums = mix(sums)
    out = []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if end - begin >= words:
            out.append(np.unique(sums[begin : end - words + 1]))
        elif end > begin:
            short = np.append(hashes[begin:end] * PLACE[: end - begin], np.array([end - begin], np.uint64) * TWO)
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
