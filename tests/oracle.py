"""Spark rows against DuckDB rows: names, count and values whatever the order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def compare(con, df, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    ours = [r.asDict() for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple(_norm(r[c]) for c in sorted(names))
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    a, b = sorted(map(key, ours)), sorted(map(key, theirs))
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
