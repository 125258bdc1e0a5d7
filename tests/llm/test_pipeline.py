"""The five stages beside brute force, and the registration of the queries."""

from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pixelspark.llm.queries import QUERIES, SQL
from pixelspark.llm.quality import assess
from pixelspark.llm.recipes import normalised
from pixelspark.llm.secrets import base_spans

from .conftest import TABLES, same
from .test_dedup import reference_parts
from .test_jaccard import reference_links, reference_sets


def test_pipeline(spark, docs):
    out = assess([r.text for r in docs.collect()], with_text=True)
    rows = [(r.doc_id, t) for r, k, t in zip(docs.collect(), out["kept"], out["text"]) if k]
    last = {}
    for key, text in sorted(rows):
        last[normalised(text)] = (key, text)
    rows = sorted(last.values())
    roots = reference_parts(len(rows), reference_links(reference_sets([t for _, t in rows])))
    rows = [rows[i] for i in sorted(set(roots))]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for key, text in rows:
        for _, s, e in sorted(base_spans(text), key=lambda x: -x[1]):
            text = text[:s] + "[secret]" + text[e:] if "[secret]" not in text[s:] else text
        want[key] = len(library.encode(text, add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, TABLES).collect():
        got[r.doc_id] += r.length
    same(sorted(got), sorted(want))
    assert sum(got[k] != want[k] for k in got) <= 0.01 * len(got)  # the stand-in above redacts overlapping spans more simply


def test_stages_keep_the_columns(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, df, TABLES)
            assert after.columns == df.columns and after.schema["doc_id"].dataType == df.schema["doc_id"].dataType
            assert after.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, TABLES).columns[0] == "doc_id"


def test_registration():
    import __spark_entry__ as contract

    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(SQL))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    theirs = con.sql(SQL[name])
    order = [theirs.columns.index(c) for c in columns]
    same(sorted(tuple(r) for r in df.select(*columns).collect()), sorted(tuple(r[i] for i in order) for r in theirs.fetchall()))
