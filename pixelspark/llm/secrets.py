"""Secrets, and credentials that come in parts.

Single patterns are reported as they are. Weak candidates (a named identifier, a long mixed string, an endpoint) are reported
only where they complement each other: parts are joined with the parts of other kinds whose intervals lie within reach in the
same scope. Scopes are stretches of text between blank lines. The join is a sweep over sorted positions, so many parts in one
text make no pairs. Parts of different rows never belong together, so the work is local to a row and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import documents, map_texts, slices

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]
REACH = 300  # code points between parts of one credential
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(
    r"""(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.IGNORECASE | re.ASCII
)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]{4,}|(?<![\w.@-])(?:[a-z0-9-]{1,63}\.){1,6}(?:com|net|org|io|dev|cloud|internal|local)(?::[0-9]{2,5})?(?![\w.-])""", re.ASCII)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
# finds every text that can have any report, with few others
HINT = (
    r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]|(?-i:AKIA[A-Z0-9])|(?-i:[0-9a-f]{24})"""
    r"""|(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]"""
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _mixed(value: str) -> bool:
    """Digits, capitals and small letters: no word, number or path of words."""
    return any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)


class _Near:
    """Intervals by scope and start, asked whether one of them is within reach of another interval."""

    def __init__(self, spans: list[Span], scopes: list[int]):
        self.scopes = scopes
        self.starts = sorted((s, e) for _, s, e in spans)
        self.longest = max((e - s for s, e in self.starts), default=0)

    def has(self, start: int, end: int) -> bool:
        scope = bisect_left(self.scopes, start + 1)
        at = bisect_left(self.starts, (start - REACH - self.longest, -1))
        while at < len(self.starts) and self.starts[at][0] <= end + REACH:
            s, e = self.starts[at]
            if e >= start - REACH and (e <= start or s >= end) and bisect_left(self.scopes, s + 1) == scope:
                return True
            at += 1
        return False


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts with their complement in reach: an identifier or a mixed string with the other, an endpoint with both."""
    identifiers = [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    anchors = identifiers + [x for x in base if x[0] == "access"]
    if not anchors:
        return []
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        """Outside the reports of single patterns."""
        at = bisect_left(starts, e)
        return not any(b > s for _, b in taken[max(0, at - 3) : at])

    secrets = [("secret", *m.span()) for m in SECRET.finditer(text) if _mixed(m[0]) and free(*m.span())]
    strong = [x for x in base if x[0] in ("assign", "hex")]
    scopes = [m.start() + 1 for m in BLANK_LINE.finditer(text)]
    by_anchor, by_secret = _Near(anchors, scopes), _Near(secrets + strong, scopes)
    out = [x for x in identifiers if by_secret.has(x[1], x[2])]
    out += [x for x in secrets if by_anchor.has(x[1], x[2])]
    if out:
        out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text) if by_anchor.has(*m.span()) and by_secret.has(*m.span())]
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _candidates(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_pylist()


def spans_of(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text, in order."""
    out = []
    for text, may in zip(texts, _candidates(pa.array(texts, pa.string()))):
        base = base_spans(text) if may else []
        out.append((in_order(base), in_order(base + linked_spans(text, base)) if may else []))
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the single patterns, digest of their spans, and all spans as ``kind:start:end``.

    Places are code points, the end exclusive. NULL and empty texts have no spans (counts 0, empty ``spans``); repeated
    rows give equal rows; an empty table gives none.
    """

    def start():
        def work(ids: pa.Array, texts: list[str]) -> dict:
            found = spans_of(texts)
            counts = {f"n_{kind}": [sum(x[0] == kind for x in base) for base, _ in found] for kind in BASE}
            digests = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
            return {"doc_id": ids} | counts | {"base_sha256": digests, "spans": [_written(every) for _, every in found]}

        return work

    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, start, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """All rows with all their columns, every span in the text replaced by ``mark``; NULL texts stay NULL.

    Overlapping spans are replaced together. ``length_col``, if there is one, counts the code points of changed texts.
    Empty texts stay empty, repeated rows are each treated alike, an empty table stays empty.
    """
    schema = df.schema
    arrow = to_arrow_schema(schema)
    at = df.columns.index(text_col)
    place = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches):
        for batch in batches:
            for part in slices(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), f"c{at}"):
                texts = part.column(at).to_pylist()
                arrays = list(part.columns)
                lengths = arrays[place].to_pylist() if place is not None else None
                for i, (_, spans) in enumerate(spans_of([t or "" for t in texts])):
                    if not spans:
                        continue
                    out, done = [], 0
                    for _, s, e in sorted(spans, key=lambda x: x[1]):
                        if s >= done:
                            out += [texts[i][done:s], mark]
                        done = max(done, e)
                    texts[i] = "".join(out) + texts[i][done:]
                    if lengths is not None:
                        lengths[i] = len(texts[i])
                arrays[at] = pa.array(texts, arrow[at].type)
                if place is not None:
                    arrays[place] = pa.array(lengths, arrow[place].type)
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return df.mapInArrow(run, T.StructType(schema.fields))
