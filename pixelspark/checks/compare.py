"""Run checks beside DuckDB: ``python -m pixelspark.checks.compare <sf_dir> [name ...]``."""

from __future__ import annotations

import math
import sys
import time

from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = {"BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN"}


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=0, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(spark: SparkSession, sf_dir: str, name: str) -> str:
    """'ok', 'rows only', or what differs."""
    import duckdb

    from . import QUERIES, SQL

    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    if name not in SQL:
        return f"rows only ({len(ours)})"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(SQL[name])
    if sorted(rel.columns) != columns:
        return f"columns {columns} vs {sorted(rel.columns)}"
    odd = [(c, str(t)) for c, t in zip(rel.columns, rel.types) if str(t) not in PLAIN]
    if odd:
        return f"types {odd}"
    order = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}: {ours[:2]} | {theirs[:2]}"
    for a, b in zip(ours, theirs):
        if not all(map(_same, a, b)):
            return f"{columns}: {str(a)[:600]} vs {str(b)[:600]}"
    return f"ok ({len(ours)})"


def main() -> None:
    from ..session import local_session
    from . import QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    bad = 0
    for name in QUERIES:
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            outcome = compare(spark, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - a report of all checks is wanted
            outcome = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not outcome.startswith(("ok", "rows only"))
        print(f"{name:40s} {time.time() - start:6.2f}s {outcome}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
