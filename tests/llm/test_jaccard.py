"""The exact similarity join beside brute force: stars, chains, crowds, one common passage, every boundary of size."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

from pixelspark.llm.arrays import shingle_sets
from pixelspark.llm.jaccard import drop_similar, needed, partner_sizes, similar_groups
from pixelspark.llm.recipes import normalised

from .conftest import same
from .test_dedup import reference_parts


def reference_sets(texts, n=5):
    out = []
    for t in texts:
        w = normalised(t).split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def reference_links(sets, percent=80):
    """All linked pairs; only sets that share an element are compared."""
    having = {}
    for i, s in enumerate(sets):
        for e in s:
            having.setdefault(e, []).append(i)
    pairs = {(i, j) for m in having.values() for k, i in enumerate(m) for j in m[k + 1 :]}
    return [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def reference(rows, n=5, percent=80):
    sets = reference_sets([t for _, t in rows], n)
    least = {}
    roots = reference_parts(len(rows), reference_links(sets, percent))
    for (key, _), root in zip(rows, roots):
        known = [x for x in (least.get(root), key) if x is not None]
        least[root] = min(known, default=None)
    return sorted((str(key), len(s), str(least[root])) for (key, _), s, root in zip(rows, sets, roots))


def found(df, **options):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_groups(df, **options).collect())


def texts_of_all_kinds():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    out = []
    for n in [1, 2, 4, 5, 6, 8, 9, 10, 12, 14, 17, 20, 24, 29, 30, 60, 150, 400]:  # short and long, each edited
        base = [word() for _ in range(n)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy if rng.random() < 0.7 else copy[: max(1, len(copy) - rng.randint(0, 3))])
    passage = [word() for _ in range(60)]
    out += [[word() for _ in range(rng.randint(0, 80))] + passage + [word() for _ in range(rng.randint(0, 80))] for _ in range(60)]
    centre = [word() for _ in range(200)]
    for k in range(60):  # a star: each is near the centre only
        copy = list(centre)
        for i in range(3):
            copy[3 * k + i * 67 % 19] = word()
        out.append(copy)
    out.append(centre)
    chain = [word() for _ in range(120)]
    for k in range(0, 60, 2):
        chain = chain[:k] + [word(), word()] + chain[k + 2 :]
        out.append(chain)
    return [" ".join(w) for w in out] + ["", None, "  \n"]


def test_sets_of_shingles():
    texts = ["", "One two", "one TWO", "two one", "a b c d e f a b c d e", "x" * 70_000 + " y", "é ü\x0bA b C", " \t\r\n", "a b c d e"] + [t or "" for t in texts_of_all_kinds()]
    got, want = shingle_sets(pa.array(texts), 5), reference_sets(texts)
    same([len(g) for g in got], [len(w) for w in want])
    named = {}
    for g, w in zip(got, want):
        assert named.setdefault(g.tobytes(), w) == w
    assert len(named) == len({frozenset(w) for w in want})
    sliced = pa.array(["lost", *texts]).slice(1)
    assert all((a == b).all() for a, b in zip(got, shingle_sets(sliced, 5)))


def test_long_texts_in_stretches(monkeypatch):
    texts = pa.array([t or "" for t in texts_of_all_kinds()])
    want = shingle_sets(texts, 5)
    monkeypatch.setattr("pixelspark.llm.arrays.STRETCH", 50)
    assert all((a == b).all() for a, b in zip(want, shingle_sets(texts, 5)))


def test_sizes():
    for n in range(1, 80):
        for m in range(1, 120):
            shared = next(k for k in range(n + m + 1) if 100 * k >= 80 * (n + m - k))
            assert needed(n, m, 80) == shared and (m in partner_sizes(n, 80)) == (shared <= min(n, m))


@pytest.fixture(scope="module")
def kinds(spark):
    rows = list(enumerate(texts_of_all_kinds()))
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), reference(rows)


@pytest.mark.parametrize("most", [None, 0, 9, 16])
def test_links_at_every_boundary(kinds, most):
    df, want = kinds
    same(found(df, most=most), want)


def test_long_lists_in_parts(kinds, monkeypatch):
    df, want = kinds
    monkeypatch.setattr("pixelspark.llm.jaccard.PART", 7)
    monkeypatch.setattr("pixelspark.llm.jaccard.BROADCAST_ROWS", 0)
    same(found(df, most=0), want)


def test_other_sizes_and_shares(kinds):
    df, _ = kinds
    rows = [(r.doc_id, r.text) for r in df.collect()]
    same(found(df, words=3, percent=60), reference(rows, 3, 60))
    same(found(df, percent=100), reference(rows, 5, 100))
    with pytest.raises(ValueError):
        similar_groups(df, percent=30)


def test_odd_rows(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = df.collect()
        same(found(df), reference([(r.doc_id, r.text) for r in rows]))
        kept = drop_similar(df)
        assert kept.columns == df.columns
    sets = reference_sets([r.text for r in odd.collect()])
    own = [i for i, s in enumerate(sets) if not s]
    groups = len(set(reference_parts(len(sets), reference_links(sets)))) - len(own)
    blank = len({(r.doc_id, r.text) for r in odd.collect() if not (r.text or "").split()})
    assert drop_similar(odd).count() == groups + blank
    assert similar_groups(empty).count() == 0 and drop_similar(empty).count() == 0


def test_a_crowd_makes_few_pairs(spark, monkeypatch):
    """2,000 near copies of one text, and 3,000 repeats of one row: verified pairs stay in proportion to the rows."""
    from pixelspark.llm import jaccard

    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(2000):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(150)] = f"x{rng.randrange(100_000)}"
        rows.append((i, " ".join(copy)))
    rows += [(7, rows[7][1])] * 3000
    asked, verified = [], jaccard._verified

    def counted(pairs, ranked, percent):
        asked.append(pairs.distinct().count())
        return verified(pairs, ranked, percent)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    same(got, reference_of_crowd(rows))
    assert sum(asked) < 3 * 2000


@pytest.mark.parametrize("bits", [None, 4])
def test_no_plan_repeats_the_steps_before_it(kinds, monkeypatch, bits):
    """The driver plans a query again after each of its stages: every query that is run has few joins, the last one two."""
    df, _ = kinds
    joins = []

    def noted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return df

    write, checkpoint = DataFrameWriter.parquet, type(df).checkpoint
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: noted(self._df) and write(self, *a, **b))
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **b: checkpoint(noted(self), *a, **b))
    last = noted(similar_groups(df, bits=bits))
    assert len(joins) > 8 and joins[-1] == 2 and max(joins) <= 8
    assert last.count() == df.count()


def reference_of_crowd(rows):
    texts = list(dict.fromkeys(rows))
    sets = reference_sets([t for _, t in texts])
    codes = {e: i for i, e in enumerate({e for s in sets for e in s})}
    matrix = np.zeros((len(sets), len(codes)), np.float32)
    for i, s in enumerate(sets):
        matrix[i, [codes[e] for e in s]] = 1
    sizes, links = matrix.sum(axis=1), []
    for i in range(len(sets)):
        common = matrix[i + 1 :] @ matrix[i]
        links += [(i, i + 1 + j) for j in np.flatnonzero(100 * common >= 80 * (sizes[i] + sizes[i + 1 :] - common)).tolist()]
    roots = reference_parts(len(texts), links)
    of = {key: (len(s), texts[root][0]) for (key, _), s, root in zip(texts, sets, roots)}
    return sorted((str(k), of[k][0], str(of[k][1])) for k, _ in rows)


def test_the_stage_links_by_fingerprints_first(spark, monkeypatch):
    """SimHash finds verified links, the join the rest; the rows kept are those of brute force."""
    import corpus_pipeline
    from pixelspark.llm import jaccard

    seen = []
    step = jaccard.fingerprint_links

    def watched(elements, ranked, percent, bits):
        links = step(elements, ranked, percent, bits)
        sets = {r.u: set(r.s) for r in elements.collect()}
        seen.extend((len(sets[r.a] & sets[r.b]), len(sets[r.a] | sets[r.b])) for r in links.collect())
        return links

    monkeypatch.setattr(jaccard, "fingerprint_links", watched)
    rows = list(enumerate(texts_of_all_kinds()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    same(kept, sorted({int(c) for _, _, c in reference(rows)}))
    assert seen and all(100 * common >= 80 * either for common, either in seen)
