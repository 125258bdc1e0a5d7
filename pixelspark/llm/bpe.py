"""BPE encoding and decoding by a walk over a trie of words.

Byte-pair encoding has this property: the encoding of a text's prefix of length d ends in exactly one token t, and before t
stands the encoding of the prefix of length d - len(t). t is the longest vocabulary entry ending at d that stays apart from
the last token of that shorter prefix. So a prefix needs one state, its last token, and words with a common prefix share
the states of that prefix. Distinct words of a slice form a trie, walked depth-first (sorted order visits its nodes in that
order, with the states of the current path on a stack), so each shared prefix is computed once.

A worker holds one slice's words and a bounded memory of finished words; nothing is shuffled or broadcast.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import documents, map_texts
from .words import WordMemory, kept_by_worker, pieces


def byte_letters() -> dict[str, int]:
    """Letter -> byte in byte-level files: visible Latin-1 characters stand for themselves, other bytes follow from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


PAIRS_KEPT = 400_000  # neighbouring tokens whose verdict a task remembers at once


class Vocabulary:
    """Tokens as bytes, and the merges that make them; ids of merged tokens follow the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in data["model"]["vocab"]}
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = raw[token]
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        order = -1
        for merge in data["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = ids[left + right]
            if made < order:
                raise ValueError("ids of merged tokens have to follow the order of merges")
            order = made
            self.merged[ids[left], ids[right]] = made
            self.halves[made] = (ids[left], ids[right])
        if max((i for i in ids.values() if i not in self.halves), default=-1) > min(self.halves, default=1 << 32):
            raise ValueError("ids of single bytes have to come before those of merged tokens")
        self.id_of = {raw[token]: i for token, i in ids.items() if len(raw[token]) == 1 or self._reached(i)}
        self.length = list(map(len, self.bytes_of))
        self.endings: dict = {}  # by a token's bytes from the last to the first: (token that is complete there or -1, what follows)
        for token, i in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            node = self.endings
            for byte in token[:0:-1]:
                node = node.setdefault(byte, (-1, {}))[1]
            node[token[0]] = (i, node[token[0]][1] if token[0] in node else {})
        self._apart: dict[int, bool] = {}

    def _reached(self, token: int) -> bool:
        """Whether encoding the token's own bytes gives the token: its halves would stay apart but for their merge."""
        left, right = self.halves[token]
        return self._stay(left, right, token)

    def _stay(self, a: int, b: int, made: int | None = None) -> bool:
        """Whether neighbours a, b never merge across their border, going back through the merges that built them.

        ``made`` is the one merge of a and b themselves that is allowed. Undoing the later-built side shows which tokens
        met at the border before; they may only have merged if that merge comes earlier than the one that was undone.
        Of equal merges the left one happens first.
        """
        bound = 1 << 32
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound and across != made:
                return False
            made = None
            if a > b:
                if a not in self.halves:
                    return True
                bound, a = a, self.halves[a][1]
            else:
                if b not in self.halves:
                    return True
                bound, b = b + 1, self.halves[b][0]

    def apart(self, a: int, b: int) -> bool:
        if len(self._apart) > PAIRS_KEPT:
            self._apart.clear()
        fits = self._apart[a << 32 | b] = self._stay(a, b)
        return fits

    def walk(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of words by a depth-first walk over their trie."""
        out: dict[bytes, list[int]] = {b"": []}
        endings, known, length = self.endings, self._apart, self.length
        last: list[int] = [-1]  # last[d]: last token of the path's prefix of length d
        before = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                node, start, chosen = endings, d, -1
                while start:
                    start -= 1
                    step = node.get(word[start])
                    if step is None:
                        break
                    token, node = step
                    if token < 0:
                        continue
                    if start:
                        pair = last[start] << 32 | token
                        fits = known.get(pair)
                        if fits is None:
                            fits = self.apart(last[start], token)
                        if fits:
                            chosen = token
                    else:
                        chosen = token
                last.append(chosen)
            ids, d = [], len(word)
            while d:
                token = last[d]
                ids.append(token)
                d -= length[token]
            ids.reverse()
            out[word] = ids
            before = word
        return out


class TrieEncoder:
    """Encodes texts: special tokens apart, the rest cut into words by the pre-tokenizer's pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True)))).split if self.vocabulary.special else None
        self.memory = WordMemory(self._values)

    def _values(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        parts = [[p.encode() for p in self.find(w)] for w in words]
        ids = self.vocabulary.walk(list({p for ps in parts for p in ps}))
        packed = {p: array("I", x).tobytes() for p, x in ids.items()}
        return [packed[ps[0]] if len(ps) == 1 else b"".join([packed[p] for p in ps]) for ps in parts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        special = self.vocabulary.special
        cut: list[list] = []  # per text: cut segments with special tokens between
        marks: list[list[str]] = []
        for t in texts:
            hits = [s for s in special if s in t]
            segments = self.split(t) if hits else [t]
            cut.append([pieces(s) for s in segments])
            marks.append(self._marks(t) if hits else [])
        self.memory.learn([c for segments in cut for c in segments])
        out = []
        for segments, between in zip(cut, marks):
            values = self.memory.values(segments[0])
            for mark, segment in zip(between, segments[1:]):
                values.append(array("I", [special[mark]]).tobytes())
                values += self.memory.values(segment)
            out.append(b"".join(values))
        return out

    def _marks(self, text: str) -> list[str]:
        import regex

        return regex.findall("|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))), text)


def decode_bytes(packed: bytes, bytes_of: list[bytes]) -> str:
    """Text of packed ids; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(bytes_of.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of whole texts. A NULL or empty text has no ids; repeated rows each have their own row."""

    def start():
        encoder = kept_by_worker(("trie", path, pattern), lambda: TrieEncoder(path, pattern))

        def work(ids: pa.Array, texts: list[str]) -> dict:
            return {"doc_id": ids, "ids": [memoryview(packed).cast("I").tolist() for packed in encoder(texts)]}

        return work

    docs = documents(df, id_col, text_col)
    return map_texts(docs, start, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of token ids; NULL ids give an empty text, an id outside the vocabulary is an error."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bytes_of = Vocabulary(path).bytes_of
        for batch in batches:
            texts = [decode_bytes(array("I", x or []).tobytes(), bytes_of) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: digests of the ids and of the text decoded from them.

    NULL and empty texts have no tokens and the digests of empty strings; repeated rows give repeated results; an empty
    table gives none.
    """

    def start():
        encoder = kept_by_worker(("trie", path, pattern), lambda: TrieEncoder(path, pattern))
        bytes_of = encoder.vocabulary.bytes_of
        decimal = list(map(str, range(len(bytes_of))))

        def work(ids: pa.Array, texts: list[str]) -> dict:
            encoded = encoder(texts)
            return {
                "doc_id": ids,
                "n_tokens": [len(packed) // 4 for packed in encoded],
                "ids_sha256": [hashlib.sha256(",".join(map(decimal.__getitem__, memoryview(packed).cast("I"))).encode()).hexdigest() for packed in encoded],
                "decoded_sha256": [hashlib.sha256(decode_bytes(packed, bytes_of).encode()).hexdigest() for packed in encoded],
            }

        return work

    docs = documents(df, id_col, text_col)
    return map_texts(docs, start, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
