"""Run queries and oracle SQL side by side: python -m checks.compare [sf_dir] [name part ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


TIMES = [0.0]


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return f"{type(value).__name__}:{value}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    TIMES[0] = time.time()
    if sql is None:
        return len(mine[1]), None, "rows only"
    got = con.execute(sql)
    theirs = table([d[0] for d in got.description], got.fetchall())
    if mine[0] != theirs[0]:
        return len(mine[1]), False, f"columns {mine[0]} / {theirs[0]}"
    if mine[1] == theirs[1]:
        return len(mine[1]), True, ""
    only_mine = [r for r in mine[1] if r not in set(theirs[1])][:3]
    only_theirs = [r for r in theirs[1] if r not in set(mine[1])][:3]
    return len(mine[1]), False, f"{len(mine[1])}/{len(theirs[1])} rows; mine {only_mine} theirs {only_theirs}"[:1500]


def main(argv):
    from checks import ORACLE, QUERIES
    from quire.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            n, ok, note = compare(spark, con, sf_dir, query, ORACLE.get(name))
        except Exception as problem:
            n, ok, note = -1, False, f"{type(problem).__name__}: {str(problem)[:700]}"
        bad += ok is False
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {name:28s} {n:7d} {TIMES[0] - began:6.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
