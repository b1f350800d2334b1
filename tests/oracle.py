"""Compare a query with its SQL in DuckDB over the same tables."""

import math
from pathlib import Path

DATA = "/root/testdata"


def _norm(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def duck(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def check(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    names, data = duck(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    theirs = rows(names, data)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not bad, bad[:3]
    return len(mine)
