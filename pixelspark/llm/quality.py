"""Line-first cleaning: rules for punctuation, navigation and boilerplate on each line, then a verdict on the document.

Failing lines are removed; a document that loses more than half of its word characters this way is rejected, as is one that
fails the base rules (fewer than 20 words, or more than 30 % of its words in repeated windows of 8 words). Everything is local
to a row: no shuffle, and hot sources or copies burden no task.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import fresh, map_texts, slices

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words
MOST_LOST = 50  # per cent of word characters
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
ENDS = tuple(x.encode() for x in ".!?:;…。！？\"”»'’)")
BOILERPLATE = re.compile(
    rb"(?i)all rights reserved|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|subscribe to (?:our|the) newsletter"
    rb"|(?:enable|requires) javascript|lorem ipsum|powered by|accept (?:all )?cookies"
)
NAVIGATION = re.compile(
    rb"(?i)\b(?:home|menu|about us|contact(?: us)?|log ?in|sign (?:in|up)|register|search|next(?: page)?|previous|back to top|read more"
    rb"|click here|skip to content|share this|follow us|sitemap|faq)\b"
)


def _fails(line: bytes, words: list[bytes], symbols: int) -> bool:
    """Whether a line with words breaks a rule."""
    n = len(words)
    if symbols >= 3 and 10 * symbols > 3 * n:  # markup, table cells, menus with bars
        return True
    ends = words[-1].endswith(ENDS)
    if not ends and n < 5 and len(line) < 60 and len(line.decode("utf-8", "replace")) < 30:  # fragment without an end
        return True
    if n <= 8 and not ends and NAVIGATION.search(line):
        return True
    if n <= 30 and BOILERPLATE.search(line):
        return True
    if n >= 10 and 2 * len(set(words)) <= n + 2:  # can one word be more than half of the line?
        return 2 * max(Counter(words).values()) > n
    return False


def _points(data: bytes) -> int:
    """Code points of UTF-8 bytes, white space left out."""
    return len(data.decode("utf-8", "replace").translate(WHITE))


WHITE = dict.fromkeys(SPACES)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows that are found twice or more, the first ones included."""
    windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    often = Counter(windows)
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + WINDOW - max(i, until)
            until = i + WINDOW
    return covered


def _may_repeat(words: list[list[bytes]]) -> np.ndarray:
    """Which texts have two windows of equal hash: all that repeat a window, and by rare chance others."""
    sizes = np.array([len(w) for w in words])
    hashes = np.fromiter((hash(w) for ws in words for w in ws), np.int64, sizes.sum()).astype(np.uint64)
    out = np.zeros(len(words), bool)
    if len(hashes) < WINDOW:
        return out
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), sizes)
    n = len(hashes) - WINDOW + 1
    rolled = owner[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        rolled = (rolled ^ hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(32)
    inside = owner[:n] == owner[WINDOW - 1 :]
    rolled, owner = rolled[inside], owner[:n][inside]
    order = np.argsort(rolled, kind="stable")
    same = np.flatnonzero(rolled[order][1:] == rolled[order][:-1])
    out[owner[order[same]].astype(np.int64)] = True
    return out


def assess(texts: list[str | None], with_text: bool = False) -> dict:
    """Columns of the verdict for a slice of texts; with ``with_text`` also the text without failing lines."""
    out: dict = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "chars_removed")}
    cleaned: list = []
    all_words: list[list[bytes]] = []
    for text in texts:
        data = (text or "").encode("utf-8", "replace")
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        words: list[bytes] = []
        seen: set[bytes] = set()
        dups = removed = lost = 0
        kept_lines = []
        for line in data.split(b"\n"):
            own = line.split()
            if own:
                words += own
                dups += line in seen
                seen.add(line)
                here = len(line) - len(line.translate(None, SYMBOLS)) if symbols else 0
                if _fails(line, own, here):
                    removed += 1
                    lost += _points(line)
                    continue
            kept_lines.append(line)
        points = len(text or "") - sum(map(data.count, (bytes([b]) for b in SPACES)))
        all_words.append(words)
        for key, value in zip(out, (len(words), points, symbols, dups, 0, False, False, removed, lost)):
            out[key].append(value)
        if with_text:
            cleaned.append(text if not removed else b"\n".join(kept_lines).decode())
    for i in np.flatnonzero(_may_repeat(all_words)):
        out["n_repeat_words"][i] = repeated_words(all_words[i])
    for i, (n, repeats) in enumerate(zip(out["n_words"], out["n_repeat_words"])):
        out["base_failed"][i] = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
        out["kept"][i] = not out["base_failed"][i] and 100 * out["chars_removed"][i] <= MOST_LOST * out["word_chars"][i]
    if with_text:
        out["text"] = cleaned
    return out


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    "lines_removed bigint, chars_removed bigint"
)


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, base_failed and kept. A NULL or empty text has no words and is rejected; repeated rows
    get equal verdicts; an empty table gives none."""

    def start():
        return lambda ids, texts: {"doc_id": ids} | assess(texts)

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(docs, start, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def clean(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Kept rows with all their columns; their text lacks the failing lines and ``length_col``, if there is one, counts
    its code points. Columns may have any names and any NULLs; NULL and empty texts are rejected. Repeated rows
    each stay or go alike; an empty table stays empty."""
    original = fresh(df, "text_as_read")
    lengths = length_col if length_col in df.columns else None
    columns = [f for f in df.schema.fields]
    schema = T.StructType(columns)
    arrow = to_arrow_schema(schema)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch.rename_columns([original if i == at else f"c{i}" for i in range(batch.num_columns)]), original):
                texts = part.column(at).to_pylist()
                result = assess(texts, with_text=True)
                keep = pa.array(result["kept"], pa.bool_())
                arrays = list(part.columns)
                arrays[at] = pa.array(result["text"], arrow[at].type)
                if lengths is not None:
                    place = arrow.get_field_index(lengths)
                    changed = [n > 0 for n in result["lines_removed"]]
                    counts = [len(t) if c else old for t, c, old in zip(result["text"], changed, arrays[place].to_pylist())]
                    arrays[place] = pa.array(counts, arrow[place].type)
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow).filter(keep)

    return df.mapInArrow(run, schema)
