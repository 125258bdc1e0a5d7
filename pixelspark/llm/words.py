"""Exact token ids of whole texts, with every distinct word encoded once as long as a worker remembers it.

A byte-level pre-tokenizer starts a new piece at every space that stands before a visible character, and single line
breaks are pieces of their own. Texts are therefore cut there first; what lies between is encoded once and looked up
afterwards. Runs of white space are cut as the pre-tokenizer cuts them: all but the last character, which stays alone or,
if it is a space, joins the next word.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

from .arrays import runs, text_bytes

RUN = re.compile(r"[^\S\x1c-\x1f]{2,}")  # the four separators are no white space to the pre-tokenizer
MARKED = re.compile(r"([^\W\d_]+)[^\w\s]+")
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
BLANK = np.zeros(256, bool)
BLANK[[32, 10]] = True
OTHER_SPACE = re.compile("|".join(c for c in map(chr, range(128, 0x3001)) if c.isspace()).encode())
JOINED = 500  # new words encoded in one call of the library
WORDS_KEPT = 600_000  # distinct words remembered at once by a worker; a bound on memory, results do not depend on it


def _simple(text: str, spaced: bool, out: list) -> None:
    """Text without runs of white space, as (words as they are, words after a space) pairs."""
    for i, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        head = ["\n"] if i else []
        if first or spaced and not i:
            head.append(" " + first if spaced and not i else first)
        out.append((head, rest))


def pieces(text: str) -> list[tuple[list[str], list[str]]]:
    """Cut a text so that encoding the pieces one by one equals encoding the text."""
    out: list = []
    if not RUN.search(text):
        if text:
            _simple(text, False, out)
        return out
    at, spaced = 0, False
    for run in RUN.finditer(text):
        if run.start() > at:
            _simple(text[at : run.start()], spaced, out)
        gap, spaced = run.group(), False
        if run.end() < len(text):
            out.append(([gap[:-1]] if gap[-1] == " " else [gap[:-1], gap[-1]], []))
            spaced = gap[-1] == " "
        else:
            out.append(([gap], []))
        at = run.end()
    if at < len(text):
        _simple(text[at:], spaced, out)
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``pieces`` for many texts at once whose only white space is ASCII: where pieces start, as places in their bytes."""
    white = WHITE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    full = offsets[:-1][np.diff(offsets) > 0]  # where texts with content start
    before[full] = False
    last = np.zeros(len(data), bool)
    last[np.append(full[1:], len(data)) - 1 if len(full) else full] = True
    after[last] = False
    single = white & ~before & ~after
    many = white & (before | after)
    first = single & ((data == 32) | (data == 10)) | many & ~before | many & ~after & ~last
    # what follows a line break, or a run that does not end in a space, is a piece of its own
    closes = (single & (data == 10) | many & ~after & (data != 32)) & ~last
    first[1:] |= closes[:-1]
    first[full] = True
    return np.flatnonzero(first)


def kept_by_worker(key: tuple, make: Callable):
    """An object that a Python worker makes once and keeps for its later tasks."""
    store = sys.modules.setdefault("_pixelspark_worker", types.ModuleType("_pixelspark_worker")).__dict__.setdefault("kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


class WordMemory:
    """Values of words, asked for in batches; ``encode`` maps new words to values.

    When it is full, the words at hand become the older half, from which words still in use come back.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int = WORDS_KEPT):
        self.encode, self.most = encode, most
        self.plain: dict = {}
        self.spaced: dict = {}  # keyed without the space
        self.older: tuple[dict, dict] = ({}, {})

    def _learn(self, known: dict, older: dict, wanted: set, before: str) -> None:
        new = [w for w in wanted if w not in known]
        back = {w: older[w] for w in new if w in older}
        known.update(back)
        new = [w for w in new if w not in back]
        known.update(zip(new, self.encode([before + w for w in new] if before else new), strict=True))

    def learn(self, cut: list[list[tuple[list[str], list[str]]]]) -> None:
        if len(self.plain) + len(self.spaced) > self.most // 2:
            self.older = (self.plain, self.spaced)
            self.plain, self.spaced = {}, {}
        heads: set = set()
        rests: set = set()
        for text in cut:
            for head, rest in text:
                heads.update(head)
                rests.update(rest)
        self._learn(self.plain, self.older[0], heads, "")
        self._learn(self.spaced, self.older[1], rests, " ")

    def values(self, text: list[tuple[list[str], list[str]]]) -> list:
        out: list = []
        for head, rest in text:
            out.extend(map(self.plain.__getitem__, head))
            out.extend(map(self.spaced.__getitem__, rest))
        return out


class WordIds:
    """Token ids of words (UTF-8), asked for in batches; ``encode`` gives the ids of new words as little-endian unsigned 32-bit numbers.

    All ids lie one after another in one array. When more than ``most`` words are known, only those at hand are kept.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int = WORDS_KEPT):
        self.encode, self.most = encode, most
        self.rows: dict[bytes, int] = {}
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _add(self, words: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        self.rows.update(zip(words, range(len(self.counts), len(self.counts) + len(words))))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.counts, self.ids = np.append(self.counts, counts), np.append(self.ids, ids)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Row of each of these distinct words in ``starts`` and ``counts``."""
        found = [self.rows.get(w, -1) for w in words]
        if len(self.rows) + found.count(-1) > self.most and len(self.rows) > len(words):
            here = np.array([r for r in found if r >= 0], np.int64)
            kept, counts, ids = [w for w, r in zip(words, found) if r >= 0], self.counts[here], self.gather(here)
            self.rows = {}
            self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
            self._add(kept, counts, ids)
            found = [self.rows.get(w, -1) for w in words]
        out = np.array(found, np.int64)
        gaps = np.flatnonzero(out < 0)
        if len(gaps):
            new = [words[i] for i in gaps.tolist()]
            out[gaps] = np.arange(len(self.counts), len(self.counts) + len(new))
            made = list(self.encode([w.decode() for w in new]))
            self._add(new, np.array([len(x) // 4 for x in made], np.int64), np.frombuffer(b"".join(made), "<u4"))
        return out

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, one after another."""
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[rows] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class LibraryEncoder:
    """Ids as the tokenizers library gives them, as little-endian unsigned 32-bit numbers.

    ``space``: "prefix" for byte-level files whose words carry the space before them, "drop" for files that drop white
    space. Texts with a special token's string are left to the library as a whole.
    """

    def __init__(self, path: str, space: str = "prefix"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.space = space
        names = self.library.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(names.values()) + 1, bool)  # tokens that begin with a space
        self.ends = np.zeros(len(self.starts), bool)  # tokens that end a word
        for name, i in names.items():
            self.starts[i], self.ends[i] = name.startswith("\u0120"), name.endswith("</w>")
        self.line = names.get("\u010a", -1)
        self.memory = WordIds(self._ids)

    @classmethod
    def of_worker(cls, path: str, space: str = "prefix") -> LibraryEncoder:
        return kept_by_worker(("library", path, space), lambda: cls(path, space))

    def _one(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        """Many words in one call, as calls cost more than short words: joined where the pre-tokenizer cuts anyway. Words are
        told apart by ids: with the space before them each has one token that begins with a space; as they are, a line break
        stands between them; where white space is dropped, the tokens that end a word are counted. Words that do not keep to
        this are encoded alone."""
        out: list = [None] * len(words)
        if self.space == "drop":
            for n, group in self._by_ends(words):
                self._joined(words, group, " ", out, lambda ids, n=n: np.flatnonzero(self.ends[ids])[n - 1 :: n] + 1, n)
        else:
            spaced = [i for i, w in enumerate(words) if w[0] == " " and len(w) > 1]
            plain = [i for i, w in enumerate(words) if not w[0].isspace()]
            self._joined(words, spaced, "", out, lambda ids: np.append(np.flatnonzero(self.starts[ids])[1:], len(ids)))
            self._joined(words, plain, "\n", out, lambda ids: np.append(np.flatnonzero(ids == self.line) + 1, len(ids)), skip=1)
        return [self._one(w) if x is None else x for w, x in zip(words, out)]

    def _by_ends(self, words: list[str]) -> list[tuple[int, list[int]]]:
        """Words of letters, which are one piece each, and such words with marks behind, which are two."""
        whole, marked = [], []
        for i, w in enumerate(words):
            if w.isalpha():
                whole.append(i)
            elif (m := MARKED.fullmatch(w)) and m[1].isalpha():
                marked.append(i)
        return [(1, whole), (2, marked)]

    def _joined(self, words: list[str], group: list[int], glue: str, out: list, borders: Callable, per_word: int = 1, skip: int = 0) -> None:
        run = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        todo = [group[at : at + JOINED] for at in range(0, len(group), JOINED)]
        while todo:
            some = todo.pop()
            text = glue.join([words[i] for i in some])
            highs: list[int] = []
            if len(text.split()) == len(some):  # else there is white space inside or at the end of a word
                ids = np.array(run([text], add_special_tokens=False)[0].ids, "<u4")
                if self.space != "drop" or np.count_nonzero(self.ends[ids]) == per_word * len(some):
                    highs = borders(ids).tolist()
            if len(highs) != len(some):
                if len(some) > 8:
                    todo += [some[: len(some) // 2], some[len(some) // 2 :]]
                continue
            packed, low = ids.tobytes(), 0
            for i, high in zip(some, highs):
                out[i] = packed[low : 4 * (high - skip)] if high < len(ids) else packed[low:]
                low = 4 * high

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(piece, text) in order, such that encoding the pieces one by one equals encoding the texts."""
        if self.space == "drop":
            inside = ~BLANK[data]
            starts, _, owner = runs(inside, offsets)
            data = data[inside]
        else:
            starts = piece_starts(data, offsets)
            owner = np.searchsorted(offsets, starts, "right") - 1
        ends = np.append(starts, len(data)).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]), owner

    def _apart(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict[int, bytes]:
        """Texts that are not cut by bytes: those with a special token's string, which the library takes whole, and those with white
        space beyond ASCII."""
        out: dict[int, bytes] = {}
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            out = {i: self._one(t) for i, t in enumerate(texts.to_pylist()) if any(s in t for s in self.special)}
        if self.space != "drop" and OTHER_SPACE.search(raw):
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if i not in out and OTHER_SPACE.search(raw, a, b):
                    words = [w.encode() for head, rest in pieces(raw[a:b].decode()) for w in (*head, *(" " + r for r in rest))]
                    known = list(dict.fromkeys(words))
                    at = dict(zip(known, self.memory(known).tolist()))
                    out[i] = self.memory.gather(np.array([at[w] for w in words], np.int64)).tobytes()
        return out

    def ids(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (one more entry than texts). ``end_id`` closes every text."""
        data, offsets = text_bytes(texts)
        apart = self._apart(texts, data, offsets)
        words, owner = self._cut(data, offsets)
        if apart:
            stays = ~np.isin(owner, list(apart))
            words, owner = words.filter(pa.array(stays)), owner[stays]
        coded = words.dictionary_encode()
        rows = self.memory(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        found = self.memory.gather(rows)
        counts = np.bincount(owner, self.memory.counts[rows], len(texts)).astype(np.int64)
        lengths = counts + (end_id is not None)
        for i, x in apart.items():
            lengths[i] += len(x) // 4
        ends = np.cumsum(lengths)
        if not apart and end_id is None:
            return found, np.append(0, ends)
        out = np.full(ends[-1] if len(ends) else 0, end_id or 0, "<u4")
        firsts = ends - lengths
        out[np.arange(len(found)) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)] = found
        for i, x in apart.items():
            out[firsts[i] : firsts[i] + len(x) // 4] = np.frombuffer(x, "<u4")
        return out, np.append(0, ends)

    def split(self, texts: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text."""
        found, ends = self.ids(texts, end_id)
        return [found[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.split(pa.array(texts, pa.string()))]
