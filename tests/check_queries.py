"""Compare registered queries with their SQL: python tests/check_queries.py [sf] [name…]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("0.0" if value == 0 else repr(value))
    if isinstance(value, dict):
        return str(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_kind(name: str) -> str:
    return {"bigint": "long", "int": "int", "double": "double"}.get(name, name)


def compare(spark, con, query, sql, sf_dir):
    """Empty text when equal, else the difference."""
    df = query(spark, sf_dir)
    names, rows = sorted_rows(df.columns, df.collect())
    if sql is None:
        return "" if rows else "no rows"
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    want_names, want = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    for name, kind in df.dtypes:
        if kind in pairs and types[name] != pairs[kind]:
            return f"type of {name}: {kind} != {types[name]}"
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    if not rows:
        return "no rows"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(bad)}/{len(rows)} rows differ, first {names}: {bad[0]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry
    from gridvigil.session import local_session

    args = sys.argv[1:]
    scale = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        kind = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
