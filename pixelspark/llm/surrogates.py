"""Personal data replaced by keyed surrogates of the same kind.

A surrogate is the image of the value under a keyed permutation of all values of its form: digits stay digits, vowels vowels,
consonants consonants, each of its script, with the same marks, length and capitals; card numbers keep their check digit,
addresses of hosts stay addresses, listed given names become listed given names of the same gender. So equal values get equal
surrogates in every document (coreference), different values different ones (distinctness), without a table of all values.

That no two values share a surrogate is checked all the same over the whole corpus: digests of (value, surrogate) pairs are
combined before they move and grouped by surrogate. Should two values meet, as values of different forms might, the next round
of the key is used.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import documents, map_texts

KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "number", "person")
EMAIL = r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])"
CARD = r"(?<![\w-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
PHONE = r"(?<![\w.])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{0,2}[0-9]{2,5}){2,5}(?!\w)"
NUMBER = r"(?<!\w)[0-9]{7,}(?!\w)"
TITLES = {
    "Mr": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Sir": "m", "господин": "m", "κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f", "госпожа": "f", "κυρία": "f",
    "Dr": "", "Prof": "",
}
# fixed values: common given names by gender, one list per script
GIVEN = {
    "f": ["Alice", "Amelia", "Anna", "Carmen", "Charlotte", "Clara", "Elena", "Emily", "Emma", "Eva", "Helen", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nora", "Olivia", "Paula", "Rosa", "Sarah", "Sophie", "Teresa"],
    "m": ["Adam", "Anton", "Carlos", "Charles", "Daniel", "David", "Felix", "George", "Hugo", "Jack", "James", "John", "Jose", "Karl", "Louis", "Lucas", "Martin", "Michael", "Oscar", "Paul", "Peter", "Robert", "Thomas", "William"],
    "f-cyrillic": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"],
    "m-cyrillic": ["Алексей", "Андрей", "Борис", "Дмитрий", "Иван", "Николай", "Павел", "Сергей"],
}
_NAME = r"[^\W\d_][\w'’-]*"
PERSON = (
    rf"(?<!\w)(?:(?P<title>{'|'.join(map(re.escape, TITLES))})\.?\x20(?P<titled>{_NAME}(?:\x20{_NAME}){{0,2}})"
    rf"|(?P<listed>(?:{'|'.join(n for names in GIVEN.values() for n in names)})\x20{_NAME}(?:\x20{_NAME})?))(?!\w)"
)
# fixed values: letters that stand for each other, by script and sound
ALPHABETS = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)
CLASS = {c: a for a in ALPHABETS for c in a}
# what every entity holds, so a superset of the patterns: no word boundaries, which RE2 knows for ASCII only
_TITLE, _LISTED = "|".join(map(re.escape, TITLES)), "|".join(n for names in GIVEN.values() for n in names)
HINT = rf"@|[0-9](?:[^0-9\n]{{0,3}}[0-9]){{6}}|[0-9]\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]|[A-Z]{{2}}[0-9]{{2}}|(?:{_TITLE})\.?\x20|(?:{_LISTED})\x20"


class Permutation:
    """Keyed permutation of the numbers below ``size``: an unbalanced Feistel network, walked until it stays inside."""

    def __init__(self, key: bytes, form: str, size: int):
        self.size = size
        bits = max(2, (size - 1).bit_length())
        self.low = bits // 2
        self.high = bits - self.low
        self.key, self.form = key, form.encode()

    def _mix(self, step: int, value: int, bits: int) -> int:
        data = self.form + bytes([0, step]) + value.to_bytes(-(-max(value.bit_length(), 1) // 8), "big")
        digest = hashlib.shake_256(self.key + data).digest(-(-bits // 8))
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def __call__(self, value: int) -> int:
        if self.size < 2:
            return value
        while True:
            left, right = value >> self.low, value & ((1 << self.low) - 1)
            for step in range(0, 8, 2):
                left ^= self._mix(step, right, self.high)
                right ^= self._mix(step + 1, left, self.low)
            value = left << self.low | right
            if value < self.size:
                return value


class Surrogates:
    """Surrogates of values under a key."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(50_000)(self._of)  # repeated values of a task

    def _spell(self, text: str, form: str) -> str:
        """Permute a lower-case text among those with the same letters' classes at the same places."""
        classes = [CLASS.get(c) for c in text]
        value, size = 0, 1
        for c, a in zip(text, classes):
            if a:
                value, size = value * len(a) + a.index(c), size * len(a)
        shape = "".join(a[0] if a else c for c, a in zip(text, classes))
        value = Permutation(self.key, f"{form}:{shape}", size)(value)
        out = []
        for c, a in zip(reversed(text), reversed(classes)):
            if a:
                value, at = divmod(value, len(a))
                c = a[at]
            out.append(c)
        return "".join(reversed(out))

    def _cased(self, text: str, form: str) -> str:
        """Capitals stay where they are; variants that differ only in capitals stay variants of one value."""
        low = "".join(c.lower() if len(c.lower()) == 1 and c.lower() in CLASS else c for c in text)
        return "".join(n.upper() if c != o and len(n.upper()) == 1 else n for n, c, o in zip(self._spell(low, form), text, low))

    def _digits(self, text: str, form: str, from_: int = 0) -> str:
        digits = "".join(c for c in text[from_:] if c in "0123456789")
        new = iter(self._spell(digits, form))
        return text[:from_] + "".join(next(new) if c in "0123456789" else c for c in text[from_:])

    def _given(self, name: str, gender: str) -> str:
        for group, names in GIVEN.items():
            if name in names:
                return names[Permutation(self.key, f"given:{group}", len(names))(names.index(name))]
        listed = {n for names in GIVEN.values() for n in names}
        keep = 1 if len(name) > 3 else 0  # the ending, which often shows the gender
        out = name
        while True:
            out = self._cased(out[: len(out) - keep], f"given:{gender}:{name[len(name) - keep :]}") + name[len(name) - keep :]
            if out not in listed:
                return out

    def _of(self, kind: str, value: str, gender: str = "") -> str:
        if kind == "email":
            local, _, host = value.partition("@")
            *labels, top = host.split(".")
            return f"{self._cased(local, 'local')}@{'.'.join([self._cased(x, 'host') for x in labels] + [top])}"
        if kind == "ip":
            a, b, c, d = map(int, value.split("."))
            new = Permutation(self.key, "ip", 1 << 32)(a << 24 | b << 16 | c << 8 | d)
            return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
        if kind == "card":
            digits = "".join(c for c in value if c in "0123456789")
            if _check_digit(digits[:-1]) == digits[-1]:
                body = self._spell(digits[:-1], "card")
                new = iter(body + _check_digit(body))
                return "".join(next(new) if c in "0123456789" else c for c in value)
            while True:  # invalid numbers stay invalid, so that they never meet valid ones
                digits = self._spell(digits, "card")
                if _check_digit(digits[:-1]) != digits[-1]:
                    new = iter(digits)
                    return "".join(next(new) if c in "0123456789" else c for c in value)
        if kind == "phone" and value.startswith("+"):
            return self._digits(value, "phone", re.match(r"\+[0-9]{1,3}", value).end())
        if kind == "iban":
            return value[:2] + self._cased(value[2:], "iban")
        if kind == "person":
            first, *rest = value.split(" ")
            if not rest:  # a title and a family name
                return self._cased(first, "family")
            return " ".join([self._given(first, gender), *[self._cased(x, "family") for x in rest]])
        return self._digits(value, kind)


def _check_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


PATTERN = re.compile(
    "|".join(f"(?P<{k}>{p})" for k, p in zip(KINDS, (EMAIL, IBAN, IP, CARD, SSN, PHONE, NUMBER, PERSON)))
)


def entities(text: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, value, gender) from left to right, none overlapping."""
    out = []
    for m in PATTERN.finditer(text):
        kind = next(k for k in KINDS if m[k] is not None)
        start, end = m.span()
        gender = ""
        if kind == "person":
            start, end = m.span("titled") if m["titled"] else m.span("listed")
            gender = TITLES.get(m["title"] or "", "")
            words = text[start:end].split(" ")
            named = next((i for i, w in enumerate(words) if not w[0].isupper()), len(words))
            if not named or m["listed"] and named < 2:
                continue
            end = start + len(" ".join(words[:named]))
        elif kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
            continue
        out.append((kind, start, end, text[start:end], gender))
    return out


def _replaced(texts: list[str], make: Surrogates) -> list[tuple[str, list]]:
    """(new text, [(kind, start, end, value, surrogate)]) of each text."""
    out = []
    for text, may in zip(texts, pc.match_substring_regex(pa.array(texts, pa.string()), HINT).to_pylist()):
        found = [(k, s, e, v, make.of(k, v, g)) for k, s, e, v, g in entities(text)] if may else []
        parts, done = [], 0
        for _, s, e, _, new in found:
            parts += [text[done:s], new]
            done = e
        out.append(("".join(parts) + text[done:] if found else text, found))
    return out


def _key(key: bytes, round_: int) -> bytes:
    return hmac.new(key, b"round %d" % round_, hashlib.sha256).digest()


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate) digests that stand for two values or more, over all of (doc_id, text)."""

    def start():
        make = Surrogates(key)

        def work(ids: pa.Array, texts: list[str]) -> dict:
            pairs = {(k, v.lower(), n.lower()) for _, found in _replaced(texts, make) for k, _, _, v, n in found}
            rows = [(k, hmac.digest(key, v.encode(), "sha256"), hmac.digest(key, n.encode(), "sha256")) for k, v, n in pairs]
            return {"kind": [r[0] for r in rows], "value": [r[1] for r in rows], "surrogate": [r[2] for r in rows]}

        return work

    pairs = map_texts(docs, start, "kind string, value binary, surrogate binary").groupBy("kind", "surrogate", "value").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("values")).where("values > 1")


def replace(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8) -> DataFrame:
    """(doc_id, text, n_entities, entities) per row; ``entities`` lists kind:start:end of the text as read.

    NULL and empty texts give empty ones without entities; repeated rows give equal rows, as do equal values everywhere;
    an empty table gives none.
    """
    docs = documents(df, id_col, text_col)
    for round_ in range(rounds):
        own = _key(key, round_)
        if collisions(docs, own).isEmpty():
            break
    else:
        raise ValueError("different values share a surrogate under every round of the key")

    def start():
        make = Surrogates(own)

        def work(ids: pa.Array, texts: list[str]) -> dict:
            done = _replaced(texts, make)
            spans = [",".join(f"{k}:{s}:{e}" for k, s, e, _, _ in found) for _, found in done]
            return {"doc_id": ids, "text": [t for t, _ in done], "n_entities": [len(found) for _, found in done], "entities": spans}

        return work

    return map_texts(docs, start, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_entities bigint, entities string")
