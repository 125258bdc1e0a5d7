"""The audit beside a plain count over every kept term."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from pixelspark.llm.divergence import audit, document_vectors

from .conftest import same

LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return LETTERS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def reference(rows, min_df=3, top=200):
    df, counts, of = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        of[lang].add(source)
        counts[lang, source].update(words(text))
        df[lang].update(set(words(text)))
    out = []
    for lang, sources in of.items():
        kept = [t for t, n in df[lang].items() if n >= min_df]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            own = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, audit(df, **options).collect()))


def test_audit(spark, docs, odd, empty):
    for df in (docs, odd, docs.union(docs)):
        rows = [(r.lang, r.source, r.text) for r in df.select("lang", "source", "text").collect()]
        same(found(df), reference(rows))
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    same(found(docs, min_df=1, top=7), reference(rows, 1, 7))
    assert audit(empty).count() == 0


def test_groups_without_terms(spark):
    rows = [("en", "a", "one two. Two!"), ("en", "b", None), ("en", "c", "12 34"), ("en", "a", "two"), ("en", "d", "two ONE"), ("xx", "a", ""), ("xx", "b", "one"), (None, None, "solo"), ("yy", "a", "É é")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    same(found(df), reference(rows))
    same(found(df, min_df=9), reference(rows, 9))


def test_counts_beyond_64_bits(spark):
    from pixelspark.llm.divergence import _share

    n = 10**15
    row = spark.createDataFrame([(n, 3 * n, 5)], "c bigint, t bigint, v bigint").select(F.expr(_share("c", "t", "v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (3 * n + 5)


def test_vectors():
    texts = ["B a b.A-a", "", "é1É", "b"]
    vocabulary, doc, term, count = document_vectors(pa.array(texts))
    got = Counter({(d, vocabulary[t].as_py()): c for d, t, c in zip(doc.tolist(), term.tolist(), count.tolist())})
    assert got == Counter((i, w) for i, t in enumerate(texts) for w in words(t))


def test_slices_bound_a_worker():
    """No more text is counted at once than other operators take."""
    from pixelspark.llm import base, divergence

    assert divergence.SLICE <= base.SLICE_BYTES
