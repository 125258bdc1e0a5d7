"""How far the sources of a language diverge: in their word frequencies from each other, and in which terms from the language.

Documents become exact sparse count vectors, as a count vectorizer with a least document frequency per language and no cut of the
vocabulary makes them. Vectors of one (lang, source) are summed, first inside each slice of documents, so that one row per group,
term and slice moves, never one per occurrence, and a hot source or term is spread over slices.

Pairs of sources are evaluated sparsely. A source's value for a term that it lacks depends on the source alone, so the sum over the
whole vocabulary is that of two sources without any term, plus what the terms of either change, taken from a histogram of its
counts, plus a correction for each term that both have. Only the last needs terms side by side. All arithmetic is in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shuffles import lookup_join
from ..session import scratch_path
from .arrays import terms
from .base import map_batches

MIN_DF = 3
TOP = 200
SCALE = 1_000_000_000
SLICE = 4 << 20  # bytes of text counted at once; bounds the memory of a Python worker


def document_vectors(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary of the texts, and their sparse vectors as (text, place in the vocabulary, count)."""
    words, owner = terms(texts)
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    cells, counts = np.unique(owner * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary, cells // size, cells % size, counts


def group_sums(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of every term in a group, and documents that have it."""

    def work(batch: pa.RecordBatch) -> dict:
        vocabulary, doc, term, count = document_vectors(batch.column(2))
        groups: dict[tuple, int] = {}
        of = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
        size = max(1, len(vocabulary))
        cells, inverse = np.unique(of[doc] * size + term, return_inverse=True)
        group = pa.array(cells // size)
        return {
            "lang": pa.array([g[0] for g in groups], pa.string()).take(group),
            "source": pa.array([g[1] for g in groups], pa.string()).take(group),
            "term": vocabulary.take(pa.array(cells % size)).cast(pa.string()),
            "n": np.bincount(inverse, count, len(cells)).astype(np.int64),
            "df": np.bincount(inverse, minlength=len(cells)).astype(np.int64),
        }

    parts = map_batches(docs, work, "lang string, source string, term string, n bigint, df bigint", SLICE)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: str, total: str, size: str) -> str:
    """Smoothed share in parts of SCALE; decimals, as the product may pass 64 bits. An empty vocabulary has none, taken as one."""
    whole = f"(cast({total} as decimal(20,0)) + {size})"
    return f"1 + if({total} + {size} = 0, 0, cast({SCALE} as decimal(10,0)) * (cast({count} as decimal(20,0)) + 1) div {whole})"


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``df``, NULLs read as ''.

    Part ``pair`` has each other source of the language with the divergence over all kept terms; 0 if none is kept. Part ``term`` has
    the ``top`` kept terms that the group has more often than its language. Ranks count from 1, the greatest value first, equal values
    by item. A term is kept in a language if ``min_df`` of its rows have it; repeated rows count each. A group without terms takes part
    with counts of zero. An empty table gives none.
    """
    spark = df.sparkSession
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = df.select(*read)

    def stored(table: DataFrame, name: str) -> DataFrame:
        folder = scratch_path(spark, name)
        table.write.parquet(folder)
        return spark.read.parquet(folder)

    sums = stored(group_sums(docs), "sums")
    kept = sums.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("df").alias("d")).where(F.col("d") >= min_df).drop("d")
    counts = stored(sums.drop("df").join(kept, ["lang", "term"]), "kept")
    langs = counts.groupBy("lang", "term").agg(F.max("c").alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.fillna(0, ["own", "terms", "v", "total"]).withColumn("p0", F.expr(_share("0", "own", "v"))), "groups")

    seen = lookup_join(counts, groups, ["lang", "source"], "terms", ["term"])
    shares = seen.withColumns({"p": F.expr(_share("n", "own", "v")), "q": F.expr(_share("c", "total", "v"))})
    vectors = stored(shares.select("lang", "source", "term", "p", "q", "p0"), "vectors")

    own = vectors.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    order = "row_number() over (partition by lang, source order by value desc, item)"
    term = own.withColumn("rank", F.expr(order)).where(F.col("rank") <= top)

    one = groups.select("lang", "v", F.col("source").alias("a"), F.col("p0").alias("pa"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb"))
    pairs = one.join(other, "lang").where("a <> b")
    # what the terms of either source change, by distinct share instead of by term
    shapes = vectors.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    none = _gap("pa", "pb")
    left = pairs.join(shapes.withColumnRenamed("source", "a"), ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.expr(f"k * ({_gap('p', 'pb')} - {none})")).alias("x"))
    right = pairs.join(shapes.withColumnRenamed("source", "b"), ["lang", "b"]).groupBy("lang", "a", "b").agg(F.sum(F.expr(f"k * ({_gap('pa', 'p')} - {none})")).alias("x"))
    mine = vectors.select("lang", "term", F.col("source").alias("a"), "p", F.col("p0").alias("pa"))
    theirs = vectors.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("r"), F.col("p0").alias("pb"))
    fix = f"{_gap('p', 'r')} - {_gap('p', 'pb')} - {_gap('pa', 'r')} + {none}"
    both = mine.join(theirs, ["lang", "term"]).where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.expr(fix)).alias("x"))
    base = pairs.select("lang", "a", "b", F.expr(f"v * {none}").alias("x"))
    whole = base.unionByName(left).unionByName(right).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("x").alias("value"))
    pair = whole.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").withColumn("rank", F.expr(order))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pair.withColumn("part", F.lit("pair")).select(*out).unionByName(term.withColumn("part", F.lit("term")).select(*out))
